import plistlib
import shutil
import zipfile

from conftest import SMALL
from lectern.sources.archives import read_epub, read_webarchive
from lectern.streaming.incremental import first_seen, windowed_counts

BODY = "<p>" + "word " * 40 + "</p>"


def test_epub_follows_the_spine(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "a.epub", "w") as z:
        z.writestr("o/book.opf", '<manifest><item id="b" href="two.xhtml"/><item id="a" href="one.xhtml"/><item id="c" href="ad.xhtml"/><item id="s" href="short.xhtml"/></manifest><spine><itemref idref="a"/><itemref idref="b"/><itemref idref="c"/><itemref idref="s"/></spine>')
        z.writestr("o/toc.ncx", "".join(f'<navPoint><navLabel><text>{t}</text></navLabel><content src="{f}#x"/></navPoint>' for t, f in (("2. B", "two.xhtml"), ("1. A &amp; C", "one.xhtml"), ("About the Publisher", "ad.xhtml"))))
        for name in ("one", "two", "ad"):
            z.writestr(f"o/{name}.xhtml", f"<html>{BODY}</html>")
        z.writestr("o/short.xhtml", "<p>tiny</p>")
    (tmp_path / "bad.epub").write_bytes(b"no zip")
    chapters, skipped = read_epub(spark, str(tmp_path))
    assert [(r["title"], r["slot"]) for r in chapters.orderBy("pos").collect()] == [("1. A & C", "01"), ("2. B", "02")]
    assert sorted(r["reason"] for r in skipped.collect()) == ["furniture", "short", "unreadable"]


def test_saved_pages(spark, tmp_path):
    good = {"WebMainResource": {"WebResourceMIMEType": "text/html", "WebResourceURL": "http://a.b/", "WebResourceData": "<p>é</p>".encode("latin-1"), "WebResourceTextEncodingName": "iso-8859-1"}}
    (tmp_path / "a.webarchive").write_bytes(plistlib.dumps(good, fmt=plistlib.FMT_BINARY))
    (tmp_path / "b.webarchive").write_bytes(plistlib.dumps({"WebMainResource": {"WebResourceMIMEType": "image/png", "WebResourceData": b"x"}}))
    (tmp_path / "c.webarchive").write_bytes(b"junk")
    rows = {r["path"].rsplit("/", 1)[1][0]: r for r in read_webarchive(spark, str(tmp_path)).collect()}
    assert (rows["a"]["url"], rows["a"]["html"], rows["a"]["error"]) == ("http://a.b/", "<p>é</p>", None)
    assert rows["b"]["error"] == "ValueError" and rows["c"]["error"]


def test_streams_equal_batches(spark, tmp_path):
    shutil.copy(f"{SMALL}/events.parquet", tmp_path / "events.parquet")
    batch = spark.read.parquet(str(tmp_path))
    stream = spark.readStream.schema(batch.schema).parquet(str(tmp_path))
    for name, f, mode in (("counts", windowed_counts, "complete"), ("firsts", lambda e: first_seen(e, "event_id"), "append")):
        q = f(stream).writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
        q.awaitTermination(120)
        want = f(batch).collect() if name == "counts" else batch.dropDuplicates(["event_id"]).collect()
        assert len(spark.table(name).collect()) == len(want) > 0
        if name == "counts":
            assert {(r["start"], r["event_type"], r["n"]) for r in spark.table(name).collect()} == {(r["start"], r["event_type"], r["n"]) for r in want}

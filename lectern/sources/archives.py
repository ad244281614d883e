"""E-books and saved web pages as tables of their parts."""

from __future__ import annotations

import io
import plistlib
import posixpath
import re
import zipfile
from collections.abc import Iterator
from html import unescape
from urllib.parse import unquote

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.functions.html import html_text
from lectern.operators.segment import assign_slots, is_furniture

LEAST_CHARS = 100
MEMBERS = "book string, pos int, member string, title string, html string, error string"


def _attr(tag: str, name: str) -> str:
    m = re.search(rf"\b{name}\s*=\s*[\"']([^\"']*)", tag)
    return unescape(m[1]) if m else ""


def epub_members(data: bytes) -> list[tuple[str, str | None, str]]:
    """(member, title from the table of contents, HTML) in reading order: by the spine, else the contents, else by name."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        names = z.namelist()
        text = lambda n: z.read(n).decode("utf-8", "replace")

        def find(ref: str, base: str) -> str | None:
            path = posixpath.normpath(posixpath.join(base, unquote(ref.split("#")[0])))
            return path if path in names else next((n for n in names if posixpath.basename(n) == posixpath.basename(path)), None)

        titles: dict[str, str] = {}
        for ncx in (n for n in names if n.endswith(".ncx")):
            for m in re.finditer(r"<navPoint\b.*?<text>(.*?)</text>.*?<content\b([^>]*)", text(ncx), re.S):
                if member := find(_attr(m[2], "src"), posixpath.dirname(ncx)):
                    titles.setdefault(member, unescape(re.sub(r"\s+", " ", m[1])).strip())
        order: list[str] = []
        for opf in (n for n in names if n.endswith(".opf")):
            body = text(opf)
            hrefs = {_attr(t, "id"): _attr(t, "href") for t in re.findall(r"<item\b[^>]*>", body)}
            order += [m for t in re.findall(r"<itemref\b[^>]*>", body) if (m := find(hrefs.get(_attr(t, "idref"), ""), posixpath.dirname(opf)))]
        order = order or list(titles) or sorted(n for n in names if n.lower().endswith((".htm", ".html", ".xhtml")))
        return [(n, titles.get(n), text(n)) for n in dict.fromkeys(order)]


def _read_epubs(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        for path, content in zip(pdf["path"], pdf["content"], strict=True):
            try:
                rows = [(path, i, member, title, page, None) for i, (member, title, page) in enumerate(epub_members(content))]
            except (zipfile.BadZipFile, KeyError) as e:
                rows = [(path, 0, None, None, None, type(e).__name__)]
            yield pd.DataFrame(rows, columns=["book", "pos", "member", "title", "html", "error"])


def read_epub(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """(chapters, skipped) of all e-books below a folder.

    Chapters are (book, pos, title, slot, text); skipped (book, pos, member, title, reason) are furniture by
    title, texts under LEAST_CHARS characters and unreadable archives.
    """
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.epub").load(folder).select("path", "content")
    rows = raw.mapInPandas(_read_epubs, MEMBERS).withColumn("text", html_text(F.col("html")))
    rows = rows.withColumn("title", F.coalesce("title", F.element_at(F.split("text", "\n"), 1)))
    reason = F.when(F.col("error").isNotNull(), "unreadable").when(is_furniture(F.col("title")), "furniture").when(F.length("text") < LEAST_CHARS, "short")
    rows = rows.withColumn("reason", reason)
    chapters = assign_slots(rows.where("reason is null").select("book", "pos", "title", "text"))
    return chapters, rows.where("reason is not null").select("book", "pos", "member", "title", "reason")


def _read_saved(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        rows = []
        for path, content in zip(pdf["path"], pdf["content"], strict=True):
            try:
                main = plistlib.loads(content)["WebMainResource"]
                kind, data = main.get("WebResourceMIMEType", ""), main.get("WebResourceData", b"")
                if kind not in ("text/html", "application/xhtml+xml") or not data:
                    raise ValueError("no HTML")
                html = data.decode(main.get("WebResourceTextEncodingName") or "utf-8", "replace")
                rows.append((path, main.get("WebResourceURL"), html, None))
            except Exception as e:  # whatever a malformed file raises is told in its row
                rows.append((path, None, None, type(e).__name__))
        yield pd.DataFrame(rows, columns=["path", "url", "html", "error"])


def read_webarchive(spark: SparkSession, folder: str) -> DataFrame:
    """(path, url, html, error) of saved pages: the main resource, which must be HTML."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.webarchive").load(folder).select("path", "content")
    return raw.mapInPandas(_read_saved, "path string, url string, html string, error string")

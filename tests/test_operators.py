"""Operators on small hand-made fixtures."""

import random

import pytest
from pyspark.sql import functions as F

from lectern.functions import html, identifiers, text
from lectern.operators import citations, reconcile, repair, resolve, segment, transcript, validate, worklist
from lectern.operators.components import components

RECORD = "rid long, src string, src_ord int, pos int, title string, authors array<string>, year int, publisher string, isbn_13 string, isbn_10 string, page_count int"


def one(spark, expr, **values):
    df = spark.createDataFrame([tuple(values.values())], list(values)) if values else spark.range(1)
    return df.select(expr.alias("x")).first()["x"]


def records(spark, *rows):
    full = [(i, r.get("src", "amazon"), r.get("src_ord", 0), i, r.get("title"), r.get("authors"), r.get("year"), r.get("publisher"), r.get("isbn_13"), r.get("isbn_10"), r.get("page_count")) for i, r in enumerate(rows)]
    return spark.createDataFrame(full, RECORD)


def test_same_isbn_is_one_record_and_fills_fields(spark):
    r = records(spark, {"src": "goodreads", "src_ord": 0, "title": "A", "isbn_13": "978", "year": 2023}, {"src": "amazon", "src_ord": 1, "title": "A: long", "isbn_13": "978", "year": 2022, "page_count": 10})
    merged, conflicts = reconcile.reconcile(r, reconcile.BOOK)
    (m,) = merged.collect()
    assert (m["title"], m["year"], m["page_count"], m["sources"]) == ("A: long", 2023, 10, ["goodreads", "amazon"])
    (c,) = conflicts.collect()
    assert (c["field"], c["evidence"]) == ("year", ["goodreads=2023", "amazon=2022"])


def test_subtitles_match_and_years_must_be_near(spark):
    r = records(spark, {"title": "Ethics", "year": 2000}, {"title": "Ethics of Care", "year": 2001}, {"title": "Ethics", "year": 2005}, {"title": "Ethics", "year": None}, {"title": "", "year": 2000})
    assert [tuple(p) for p in reconcile.title_pairs(r).collect()] == [(0, 1)]


def test_title_pairs_equal_brute_force(spark):
    rng = random.Random(5)
    rows = [{"title": " ".join(rng.choice("a b c d e f g".split()) for _ in range(rng.randint(0, 7))), "year": rng.choice([0, 1999, 2000, 2001, None])} for _ in range(80)]

    def alike(x, y):
        a, b = set((x["title"]).split()), set(y["title"].split())
        if not a or not b or not x["year"] or not y["year"] or abs(x["year"] - y["year"]) > 1:
            return False
        return a <= b or b <= a or len(a & b) / len(a | b) >= 0.85

    want = {(i, j) for i in range(80) for j in range(i + 1, 80) if alike(rows[i], rows[j])}
    assert {tuple(p) for p in reconcile.title_pairs(records(spark, *rows)).collect()} == want


def test_greedy_clusters_keep_one_record_a_source(spark):
    r = records(spark, {"src": "a", "title": "x y", "year": 2000}, {"src": "a", "title": "x y", "year": 2000}, {"src": "b", "src_ord": 1, "title": "x y z", "year": 2000})
    found = {x["rid"]: x["cluster"] for x in reconcile.greedy_clusters(r, reconcile.match_pairs(r, ("isbn_13",))).collect()}
    assert found == {0: 0, 2: 0}


def test_greedy_clusters_equal_slow_version(spark):
    rng = random.Random(7)
    rows = [{"src": rng.choice("abc"), "src_ord": 0, "isbn_13": rng.choice(["1", "2", "3", None]), "title": " ".join(rng.choice("u v w x y z".split()) for _ in range(3)), "year": rng.choice([1999, 2000, 2005])} for _ in range(70)]
    r = records(spark, *rows)
    pairs = [tuple(p) for p in reconcile.match_pairs(r, ("isbn_13",)).collect()]
    matches = {i: {b for a, b in pairs if a == i} | {a for a, b in pairs if b == i} for i in range(70)}
    clusters = []
    for i in range(70):
        for c in clusters:
            if matches[i] & set(c.values()):
                c.setdefault(rows[i]["src"], i)
                break
        else:
            clusters.append({rows[i]["src"]: i})
    want = {i: min(c.values()) for c in clusters for i in c.values()}
    assert {x["rid"]: x["cluster"] for x in reconcile.greedy_clusters(r, reconcile.match_pairs(r, ("isbn_13",))).collect()} == want


def test_reconcile_empty(spark):
    merged, conflicts = reconcile.reconcile(spark.createDataFrame([], RECORD), reconcile.BOOK)
    assert merged.count() == 0 and conflicts.count() == 0


@pytest.mark.parametrize("one_task", [1_000_000, 0])
def test_components_equal_union_find(spark, one_task):
    rng = random.Random(2)
    edges = [(rng.randint(0, 60), rng.randint(0, 60)) for _ in range(45)] + [(3, 3), (None, 4)]
    parent = list(range(61))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a is not None and b is not None:
            a, b = find(a), find(b)
            parent[max(a, b)] = min(a, b)
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "a long, b long"), one_task).collect()}
    assert got == {x: find(x) for x in range(61) if find(x) != x}


CORPUS = "slug string, path string, title string, authors array<string>, isbn string"


def test_resolver_ladder_and_refusals(spark):
    corpus = spark.createDataFrame(
        [("a", "1", "Sorting Things Out", ["Geoffrey C. Bowker"], "9780262"), ("b", "2", "Music: Eros", ["F. Kittler"], None), ("c", "3", "Music: Aphrodite", ["F. Kittler"], None), ("d", "4", "Other", ["A. B."], "9780262")], CORPUS
    )
    items = spark.createDataFrame(
        [
            (0, "b", None, None, None), (1, "z", "9780262", None, None), (2, "z", None, "Sorting Things Out: Classification", ["Bowker, Geoffrey C."]), (3, "z", None, "Music", ["Kittler, F."]),
            (4, "z", None, "Sorting Things Out", ["Else, X."]), (5, "z", None, "Music: Third", ["Kittler"]), (6, None, None, None, None),
        ],
        "rid long, slug string, isbn string, title string, authors array<string>",
    )
    got = {r["rid"]: (r["slug"], r["match"]) for r in resolve.resolve(items, corpus).collect()}
    assert got == {0: ("b", "path"), 1: ("a", "identifier"), 2: ("a", "title"), 3: (None, None), 4: (None, None), 5: (None, None), 6: (None, None)}


@pytest.mark.parametrize(
    ("draft", "keys"),
    [
        ("(Ahmed, 2010; Star 1999)", ["ahmed-2010", "star-1999"]),
        ("(Ahmed, 2010, 2012)", ["ahmed-2010"]),
        ("(Fujimura et al., 1994a)", ["fujimura-1994a"]),
        ("(see M’charek & Dijck 2001)", ["mcharek-2001"]),
        ("（斯特恩，2003）", ["斯特恩-2003"]),
        ("(2010) and ((12)", []),
        (None, []),
    ],
)
def test_citation_keys(spark, draft, keys):
    df = spark.createDataFrame([("f", draft)], "file string, text string")
    assert [r["key"] for r in citations.mentions(df).orderBy("at").collect()] == keys


def test_citation_tiers(spark):
    biblio = spark.createDataFrame([("ahmed-queer-2010", ""), ("ahmed-other-2006", ""), ("haraway-cyborg-1991", ""), ("fausto-sterling-five-sexes-2000", "")], "slug string, author_slug string")
    asked = spark.createDataFrame([("1", "ahmed", 2010, False), ("2", "ahmed", 1990, False), ("3", "harraway", 1990, False), ("4", "nobody", 1990, False), ("5", "fausto-sterling", 2000, False)], "key string, author string, year int, is_cjk boolean")
    states = {r["key"]: (r["tier"], r["status"]) for r in citations.statuses(citations.tiers(asked, citations.author_index(biblio))).collect()}
    assert states == {"1": (1, "single-hit"), "2": (2, "multi-hit"), "3": (3, "single-hit"), "4": (4, "miss"), "5": (1, "single-hit")}


def test_close_authors_equal_brute_force(spark):
    rng = random.Random(1)
    words = sorted({"".join(rng.choice("abc") for _ in range(rng.randint(1, 7))) for _ in range(60)})
    df = spark.createDataFrame([(w,) for w in words], "author string")

    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            new = [i]
            for j, y in enumerate(b, 1):
                new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
            row = new
        return row[-1]

    want = {(a, b) for a in words for b in words if a != b and distance(a, b) <= 2}
    assert {(r["a"], r["b"]) for r in citations.close_authors(df, df).collect()} == want


@pytest.mark.parametrize(
    ("titles", "slots"),
    [
        (["Preface", "1. A", "Interlude", "2. B", "Epilogue"], ["00a", "01", "01b", "02", "99a"]),
        (["A", "1. B", "C"], ["01", "02", "03"]),
        (["Chapter 1", "Chapter 1: again"], ["01", "01"]),
    ],
)
def test_slots(spark, titles, slots):
    df = spark.createDataFrame([("b", i, t) for i, t in enumerate(titles)], "book string, pos int, title string")
    assert [r["slot"] for r in segment.assign_slots(df).orderBy("pos").collect()] == slots


def test_headings_outside_fences(spark):
    doc = "intro\n# One\n```\n# not\n```\n## Two ##\ntext\n### Three"
    df = spark.createDataFrame([("d", doc), ("e", None)], "doc string, text string")
    got = [tuple(r) for r in segment.sections(df.where("doc = 'd'")).orderBy("idx").collect()]
    assert got == [("d", 0, None, 0, 1, 1), ("d", 1, "One", 1, 2, 5), ("d", 2, "Two", 2, 6, 8)]
    assert df.where("doc = 'd'").select(segment.nested_headings("text")).first()[0] == "intro\n### One\n```\n# not\n```\n#### Two ##\ntext\n##### Three"


def test_toc_levels_and_page_ends(spark):
    toc = spark.createDataFrame([("b", i, v) for i, v in enumerate([2, 4, 5, 2])], "book string, pos int, level int")
    assert [r["level"] for r in segment.toc_levels(toc).orderBy("pos").collect()] == [1, 2, 3, 1]
    pages = spark.createDataFrame([("b", 0, 1, 30), ("b", 1, 11, 30)], "book string, pos int, start int, n_pages int")
    assert [r["end"] for r in segment.page_ends(pages).orderBy("pos").collect()] == [10, 30]


def test_srt_and_cues(spark):
    srt = "1\n00:00:01,500 --> 00:00:02,000\nHello\nthere\n\n2\n00:01:00,000 --> 00:01:01,250\n\n\n3\n01:00:00,000 --> 01:00:01,000\nBye"
    cues = transcript.srt_cues(spark.createDataFrame([("d", srt)], "doc string, text string"))
    assert [tuple(r)[1:] for r in cues.orderBy("idx").collect()] == [(0, 1.5, 2.0, "Hello there"), (1, 3600.0, 3601.0, "Bye")]
    assert transcript.to_srt(cues).first()["text"].startswith("1\n00:00:01,500 --> 00:00:02,000\nHello there\n\n2\n01:00:00,000")
    tokens = [(1, 0, "environ", 0, 300), (1, 1, "mental", 2000, 2300), (1, 2, " policy", 2400, 2600), (1, 3, " now", 4000, 4100), (1, 4, "<end>", 4100, 4100), (1, 5, " x", None, None)]
    grouped = transcript.group_cues(spark.createDataFrame(tokens, "talk long, pos int, text string, start_ms long, end_ms long"))
    assert [(r["start"], r["end"], r["text"]) for r in grouped.orderBy("idx").collect()] == [(0.0, 2.6, "environmental policy"), (4.0, 4.1, "now")]


def test_transcript_states(spark):
    rows = [("live", f"line {i} " + "x" * 30) for i in range(12)] + [("loop", "same words again and again " + "y" * 20)] * 12 + [("blank", "[BLANK_AUDIO]")] * 3 + [("short", "hi")] + [("empty", None)]
    got = {r["doc"]: r["state"] for r in transcript.transcript_states(spark.createDataFrame(rows, "doc string, text string")).collect()}
    assert got == {"live": "live", "loop": "dead", "blank": "dead", "short": "dead", "empty": "empty"}


def test_translation_coverage(spark):
    rows = []
    for p in range(4):
        rows += [("good", 2 * p + 1, "a" * 300), ("good", 2 * p + 2, "" if p == 0 else "译" * 100), ("bad", 2 * p + 1, "a" * 300), ("bad", 2 * p + 2, "" if p else "译" * 100)]
    rows += [("few", 1, "a" * 300), ("few", 2, "译" * 100), ("few", 3, "a" * 300)]
    got = {r["doc"]: (r["pages"], r["verdict"]) for r in transcript.coverage(transcript.page_ratios(spark.createDataFrame(rows, "doc string, page int, text string"))).collect()}
    assert got == {"good": (4, "pass"), "bad": (4, "fail"), "few": (1, "abstain")}


@pytest.mark.parametrize(
    ("raw", "url"),
    [("HTTPS://Ex.org:443/a?b=1#c", "https://ex.org/a?b=1"), ("http://ex.org", "http://ex.org/"), ("http://ex.org:8080/x", "http://ex.org:8080/x"), ("http://u:p@ex.org/", None), ("ftp://ex.org/", None), ("http://ex.org/\x07", None), ("http://ex.org:99999/", None), ("http://[::1]:80/", "http://[::1]/"), (None, None)],
)
def test_web_urls(spark, raw, url):
    assert spark.createDataFrame([(raw,)], "r string").select(identifiers.web_url(F.col("r"))).first()[0] == url


def test_identifiers(spark):
    df = spark.createDataFrame([("0822373785", "978-0-8223-7378-0", "x")], "a string, b string, c string")
    assert [*df.select(identifiers.isbn13(F.col("a")), identifiers.isbn13(F.col("b")), identifiers.isbn13(F.col("c"))).first()] == ["9780822373780", "9780822373780", None]
    assert one(spark, identifiers.doi(F.col("d")), d=" DOI: 10.1/AB") == "10.1/ab"
    assert len(one(spark, identifiers.collision_slug(F.col("s"), F.lit("u")), s="a" * 90)) == 80
    assert one(spark, identifiers.language_tag(F.col("s")), s="ZH-Hans-cn") == "zh-hans-CN"
    assert one(spark, identifiers.language_tag(F.col("s")), s="zh_CN") is None and one(spark, identifiers.language_tag(F.col("s")), s="zh-cn") == "zh"


def test_years_and_text(spark):
    assert one(spark, text.year_signals(F.col("t"))["best_guess"], t="Copyright 2022 by X. Printed 2023") == 2023
    assert one(spark, text.inverted_index_text(F.col("m")), m={"b": [1, 3], "a": [0, 2]}) == "a b a b"
    assert one(spark, text.surname_slug(F.col("n")), n=" José O'Néil ") == "jose-oneil"
    assert one(spark, text.join_hyphenated(F.col("t")), t="inter-\nest pre-\nand post") == "interest pre-\nand post"
    assert one(spark, html.html_text(F.col("h")), h="<title>T</title><script>var x='<p>'</script><p>a &amp;amp; b</p><!-- c --><br>d") == "T\na &amp; b\nd"


def test_word_positions(spark):
    df = spark.createDataFrame([(1, ["b", "a", "b"]), (2, []), (3, None), (4, ["b"]), (5, ["a", "", "a"])], "k int, w array<string>")
    got = {r["k"]: r["index"] for r in text.word_positions(df, "k", "w").collect()}
    assert got == {1: {"b": [0, 2], "a": [1]}, 2: {}, 3: {}, 4: {"b": [0]}, 5: {"a": [0, 2], "": [1]}}
    assert text.word_positions(df.where("k > 9"), "k", "w").count() == 0


def test_punctuation(spark):
    cases = [("变化,然后", "变化，然后"), ("1,000 项", "1,000 项"), ("Yahoo!目录", "Yahoo!目录"), ("变化?Baldwin", "变化？Baldwin"), ("见(注一)和(note)", "见（注一）和(note)"), ("`码,码` 后,x", "`码,码` 后，x"), (None, None)]
    got = spark.createDataFrame([(i, a) for i, (a, _) in enumerate(cases)], "i int, t string").select("i", repair.full_width_punctuation("t").alias("p")).orderBy("i").collect()
    assert [r["p"]["text"] for r in got] == [b for _, b in cases]


def test_fill_only_and_upsert(spark):
    rows = spark.createDataFrame([(1, None, 5), (2, "a", None), (3, "", None)], "k int, s string, n int")
    found = spark.createDataFrame([(1, "x", 9), (2, "y", None)], "k int, s string, n int")
    filled, missed = repair.fill_only(rows, found, "k", ["s", "n"])
    assert sorted((r["k"], r["s"], r["n"], tuple(r["filled"])) for r in filled.collect()) == [(1, "x", 5, ("s",)), (2, "a", None, ()), (3, None, None, ())]
    assert [r["k"] for r in missed.collect()] == [3]
    old = spark.createDataFrame([(1, "a", 10, 10)], "k int, v string, first_seen int, last_seen int")
    new = spark.createDataFrame([(1, "", 20), (2, "b", 20)], "k int, v string, at int")
    assert sorted(tuple(r) for r in repair.upsert(old, new, "k", ["v"], "at").collect()) == [(1, "a", 10, 20), (2, "b", 20, 20)]


def test_modal_ties_and_inventory(spark):
    rows = spark.createDataFrame([("a", "x", 1), ("a", "y", 0), ("b", "x", 0), ("b", "x", 1), ("b", "y", 2)], "k string, v string, p int")
    assert sorted(tuple(r) for r in segment.modal(rows, "k", "v", "p", 0.5).collect()) == [("a", "y", 1, 2), ("b", "x", 2, 3)]
    ch = spark.createDataFrame([("a", "01", "f1", "s1", 1, 2), ("a", "01", "f2", "s2", None, None), ("b", "01", "f", "s", 5, 9)], "book string, slot string, filename string, slug string, start int, end int")
    assert {r["book"]: r["valid"] for r in validate.chapter_inventory(ch).collect()} == {"a": False, "b": True}


def test_work_until_done(spark):
    state = spark.createDataFrame([(3,), (1,)], "left int")
    out = worklist.until_done(state, lambda s: s.select(F.greatest(F.col("left") - 1, F.lit(0)).alias("left")), lambda s: s.where("left > 0"), 10)
    assert [r["left"] for r in out.collect()] == [0, 0]

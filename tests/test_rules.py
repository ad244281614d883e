"""Rules of headers, bodies, files, catalogues and citations, on literal cases."""

import json
import random

import pytest
from pyspark.sql import functions as F

from lectern.functions import identifiers
from lectern.operators import catalogues, citations, reconcile, repair, schemas, transcript, validate
from lectern.sources.markdown import dumped, parsed, read_markdown, write_files

HEADER = "path string, type string, fields map<string,string>, kinds map<string,string>"


def codes(spark, kind, fields, kinds=None):
    text = {k: v if v is None or isinstance(v, str) else json.dumps(v) for k, v in fields.items()}
    df = spark.createDataFrame([("p", kind, {"type": kind, **text}, kinds)], HEADER)
    return sorted((r["field"], r["code"]) for r in schemas.header_violations(df).collect())


BOOK = {"title": "A title", "authors": ["Ann Other"], "year": 1999, "publisher": "Press"}


@pytest.mark.parametrize(
    ("kind", "fields", "kinds", "want"),
    [
        ("book", BOOK, None, []),
        ("book", {**BOOK, "year": None, "isbn": "9780822373780", "doi": "10.1/x", "rating": 5}, None, []),
        ("book", {**BOOK, "year": "1999"}, {"year": "str"}, [("year", "int_type")]),
        ("book", {**BOOK, "authors": "Ann Other"}, {"authors": "str"}, [("authors", "list_type")]),
        ("book", {**BOOK, "authors": [], "category": "novel"}, None, [("authors", "too_short"), ("category", "literal_error")]),
        ("book", {**BOOK, "authors": ["A", "Bb", "x" * 121], "doi": "11.1/x", "rating": 0}, None, [("authors.0", "string_too_short"), ("authors.2", "string_too_long"), ("doi", "string_pattern_mismatch"), ("rating", "greater_than_equal")]),
        ("book", {"title": None, "authors": None, "year": 1200, "publisher": " P "}, None, [("authors", "list_type"), ("publisher", "string_too_short"), ("title", "string_type"), ("year", "greater_than_equal")]),
        ("paper", BOOK, None, [("journal", "missing"), ("publisher", "extra_forbidden"), ("themes", "missing")]),
        ("journal", {"title": "T T", "kind": "overview", "journal": "Jo"}, None, []),
        ("note", {"title": "T T", "created": "2024-02-30"}, None, [("created", "date_from_datetime_parsing")]),
        ("topic", {"title": "T T", "kind": "outline"}, None, [("kind", "value_error")]),
        ("topic", {"title": "T T", "kind": "outline", "subquestions": [{"id": "a"}, {"id": "b"}]}, None, []),
        ("topic", {"title": "T T", "kind": "outline", "subquestions": [{"id": "a"}, {"id": "a"}]}, None, [("kind", "value_error")]),
        ("topic", {"title": "T T", "kind": "overview", "created": "2024-01-01"}, None, [("kind", "value_error")]),
        ("topic", {"title": "T T", "kind": "card", "created": "2024-01-01", "themes": ["x"]}, None, []),
        ("webpage", {"title": "T T", "url": "https://a.b/c", "captured_at": "2024-01-01T00:00:00Z"}, None, []),
        ("webpage", {"title": "T T", "url": "https://me:pw@a.b/c", "captured_at": "2024-01-01T00:00:00+02:00"}, None, [("captured_at", "value_error"), ("url", "value_error")]),
        ("webpage", {"title": "T T", "url": "ftp://a.b/cc", "captured_at": "2024-01-01T00:00:00.5Z"}, None, [("captured_at", "value_error"), ("url", "value_error")]),
        ("monograph", {}, None, [("type", "deprecated_type")]),
        ("gadget", {}, None, [("type", "unknown_type")]),
        (None, {}, None, [("type", "unknown_type")]),
    ],
)
def test_header_violations(spark, kind, fields, kinds, want):
    assert codes(spark, kind, fields, kinds) == want


def test_headers_without_fields_and_snapshot(spark):
    df = spark.createDataFrame([("p", None, None, None)], HEADER)
    assert [r["code"] for r in schemas.header_violations(df).collect()] == ["no_frontmatter"]
    rows = {r["type"]: r["required"] for r in schemas.schema_snapshot(spark).collect()}
    assert rows["chapter"] == ["title", "authors", "year", "book"] and len(rows) == 11


def test_type_buckets(spark):
    df = spark.createDataFrame([(t,) for t in (None, "book", "overview", "A", "", "x")], "t string")
    got = [tuple(r["b"]) for r in df.select(schemas.type_bucket(F.col("t")).alias("b")).collect()]
    assert got == [("_missing_type", "missing_type"), ("book", None), ("book", "deprecated_type"), ("_unknown_type", "unknown_type"), ("_unknown_type", "unknown_type"), ("_unknown_type", "unknown_type")]


TALK = "## 核心论点\ntext\n## 分节摘要\n### a\nb\n## 关键概念\n| a |\n|---|\n## 项目关联\n- a\n## 文献人物\n- a\n## 时间脉络\n- a\n"


@pytest.mark.parametrize(
    ("kind", "body", "want"),
    [
        ("talk", TALK, []),
        ("talk", TALK.replace("### a\n", ""), [("block_kind_mismatch", "分节摘要")]),
        ("talk", TALK.replace("| a |\n|---|\n", "**term**: x\n"), [("block_kind_mismatch", "关键概念")]),
        ("talk", TALK.replace("| a |\n|---|\n", ""), []),
        ("talk", TALK.replace("| a |\n|---|\n", "| a |\nx\n- c\n"), [("block_kind_mismatch_soft", "关键概念")]),
        ("talk", TALK.replace("## 文献人物\n- a\n", ""), [("missing_required_h2", "文献人物")]),
        ("talk", TALK.replace("## 时间脉络", "#### 时间脉络"), [("heading_level_drift", "时间脉络"), ("block_kind_mismatch_soft", "文献人物")][:1]),
        ("talk", TALK.replace("## ", "#### ").replace("#### a", "##### a"), [("global_heading_level_drift", None)]),
        ("talk", TALK + "## More\nx\n```\n## 核心论点\n```\n", [("unknown_h2", "More")]),
        ("webpage", "## Summary\nx\n## Content\n", [("block_kind_mismatch", "Content")]),
        ("author", "## 与「一」的关联\nx", None),
        ("note", "anything", []),
        ("talk", None, None),
    ],
)
def test_body_violations(spark, kind, body, want):
    rows = schemas.body_violations(spark.createDataFrame([("p", kind, body)], "path string, type string, body string")).collect()
    got = sorted((r["fault"], r["h2"]) for r in rows)
    if want is None:
        assert len(got) >= 6
        assert kind != "author" or {("h2_alias", "与「一」的关联"), ("block_kind_mismatch", "项目关联")} <= set(got)
    else:
        assert got == sorted(want, key=lambda x: (x[0], x[1] or ""))


def test_fixed_headers():
    fix = lambda path="x.md", **h: schemas.fixed_header(h, path)
    assert fix(type="monograph", book_title="T", author="A", score="★★", year="1999")[0] == {"type": "book", "title": "T", "authors": ["A"], "rating": 2, "year": 1999}
    assert fix(type="book", title="T", book_title="U")[0] == {"type": "book", "title": "T"}
    assert fix(type="author", title="N", author="A", authors=["B"])[0] == {"type": "author", "name": "N"}
    assert fix(type="author", title="N", name="M")[0] == {"type": "author", "name": "M"}
    assert fix("vault/books/b-1999/ch01-x.md", type="chapter", book="other", source="s")[0] == {"type": "chapter", "book": "b-1999"}
    assert fix(type="talk", date="2024-01-01", slot="1")[0] == {"type": "talk", "date": "2024-01-01"}
    assert fix(type="paper", date="2024-01-01", publisher="P", pages="1-2")[0] == {"type": "paper", "publisher": "P"}
    assert fix(type="paper", year=1400, rating="good", themes=None, authors=["A", " ", 3])[0] == {"type": "paper", "themes": [], "authors": ["A"]}
    assert fix(type="gadget", tags=["a"], rating=4, year=1999) == ({"type": "gadget", "themes": ["a"], "rating": 4, "year": 1999}, ["renamed tags to themes"])
    assert list(schemas.in_order({"x": 1, "year": 2, "title": 3, "type": "book"}, "book")) == ["type", "title", "year", "x"]


def test_files_are_repaired_once(spark):
    text = "---\ntype: monograph\nthemes: [a, b]\nauthor: Ann Other\ntitle: 'On: x'\ntopics: []\n---\n# T\n## 全书核心论点\nx\n```\n## 章节间逻辑\n```\n"
    want = "---\ntype: book\ntitle: 'On: x'\nauthors:\n- Ann Other\nthemes:\n- a\n- b\n---\n# T\n## 核心论点\nx\n```\n## 章节间逻辑\n```\n"
    files = spark.createDataFrame([("a.md", text), ("b.md", want), ("c.md", "no header"), ("d.md", "---\ntype: gadget\n---\nx"), ("e.md", None)], "path string, text string")
    once = files.select("path", schemas.repair_file("path", "text").alias("r")).select("path", "r.*")
    got = {r["path"]: (r["text"], r["changes"]) for r in once.collect()}
    assert got["a.md"] == (want, ["type monograph to book", "renamed author to authors", "authors to a list", "heading 全书核心论点 to 核心论点"])
    assert got["b.md"] == (want, []) and got["c.md"] == ("no header", []) and got["d.md"][1] == [] and got["e.md"] == (None, [])
    flow = "---\ntype: book\nthemes: [a]\n---\n"
    assert schemas.repaired_text("x", flow) == ("---\ntype: book\nthemes:\n- a\n---\n", ["normalised"])


def test_files_are_written_and_read_again(spark, tmp_path):
    files = spark.createDataFrame([("books/b/one.md", "---\ntype: book\nyear: 1999\nbig: {a: [1, 2]}\ndate: 2024-01-02\nok: true\n---\nBody — é\n"), ("two.md", None)], "path string, text string")
    for _ in range(2):  # again over what is there
        assert sorted((r["path"], r["bytes"]) for r in write_files(files, str(tmp_path)).collect()) == [("books/b/one.md", len(files.first()["text"].encode())), ("two.md", 0)]
    assert sorted(p.name for p in tmp_path.rglob("*") if p.is_file()) == ["one.md", "two.md"]
    row = next(r for r in read_markdown(spark, str(tmp_path)).collect() if r["path"].endswith("one.md"))
    assert row["header"] == {"type": "book", "year": "1999", "big": '{"a": [1, 2]}', "date": "2024-01-02", "ok": "true"} and row["body"] == "Body — é\n"
    assert row["kinds"] == {"type": "str", "year": "int", "big": "map", "date": "date", "ok": "bool"}
    with pytest.raises(Exception, match="no path below"):
        write_files(spark.createDataFrame([("../x", "y")], "path string, text string"), str(tmp_path)).collect()
    assert parsed("---\na: b: c\n---\n")[2] == "malformed" and dumped({"a": ["x"], "b": "c: d"}) == "a:\n- x\nb: 'c: d'"


def test_sets_of_files_are_published_whole(spark, tmp_path):
    from lectern.sources import publish as P

    at = str(tmp_path)
    table = lambda *rows: spark.createDataFrame(rows, "path string, text string")
    assert P.current(at) is None and P.published(spark, at).count() == 0 and P.manifest(spark, at).count() == 0
    one = P.publish(table(("a.txt", "x"), ("b c/é.txt", "y")), at, expected="")
    assert (one["disposition"], one["files"], one["bytes"]) == ("created", 2, 2)
    assert {tuple(r) for r in P.published(spark, at).collect()} == {("a.txt", "x"), ("b c/é.txt", "y")}
    assert P.publish(table(("b c/é.txt", "y"), ("a.txt", "x")), at)["disposition"] == "unchanged"
    for rows, code in (([("a", "x"), ("a", "y")], "duplicate_filename"), ([("../a", "x")], "unsafe_filename"), ([("a", "")], "unsafe_filename"), ([(None, "x")], "unsafe_filename"), ([], "chapter_set_mismatch")):
        with pytest.raises(P.PublishError) as e:
            P.publish(table(*rows), at)
        assert e.value.code == code
    with pytest.raises(P.PublishError):
        P.publish(table(("a.txt", "z")), at, expected="0-0")
    assert P.current(at)["version"] == one["version"] and len(list((tmp_path / "versions").iterdir())) == 1
    two = P.publish(table(("a.txt", "z")), at, expected=one["fingerprint"])
    assert two["disposition"] == "replaced" and [tuple(r) for r in P.published(spark, at).collect()] == [("a.txt", "z")]


def test_backfill_by_strategies_in_order(spark):
    rows = spark.createDataFrame([(1, None, None), (2, "a", None), (3, None, 5)], "k int, s string, n int")
    one = spark.createDataFrame([(1, "x", None), (2, "y", None)], "k int, s string, n int")
    two = spark.createDataFrame([(1, "z", 7), (2, "z", 8), (3, "z", 9)], "k int, s string, n int")
    got = {r["k"]: (r["s"], r["n"], r["filled_by"]) for r in repair.backfill(rows, "k", ["s", "n"], [("one", one), ("two", two)]).collect()}
    assert got == {1: ("x", 7, {"s": "one", "n": "two"}), 2: ("a", 8, {"n": "two"}), 3: ("z", 5, {"s": "two"})}
    contracts = {r["type"]: r for r in schemas.artifact_contracts(spark).collect()}
    assert contracts["webpage"]["required"] == ["type", "title", "url", "captured_at"] and [tuple(s) for s in contracts["webpage"]["sections"]] == [("Summary", "paragraph", True), ("Content", "freeform", True)]


def test_tocs_and_manifests(spark):
    files = spark.createDataFrame([("v/b/ch10-x.md", "chapter", "Ten"), ("v/b/ch2-y.md", "chapter", None), ("v/b/appendix.md", "chapter", "App"), ("v/b/00-overview.md", "book", "B")], "path string, type string, title string")
    (row,) = schemas.chapter_tocs(files).collect()
    assert row["book"] == "v/b" and [tuple(c) for c in row["chapters"]] == [("ch2-y.md", ""), ("ch10-x.md", "Ten"), ("appendix.md", "App")]
    assert schemas.toc_report(schemas.chapter_tocs(files)).first()["text"].split("\n") == ["## v/b (3 chapters)", "", "- `ch2-y.md` — ", "- `ch10-x.md` — Ten", "- `appendix.md` — App"]
    names = spark.createDataFrame([("01_a.txt",), ("02_a.txt",), ("01_../a.txt",), ("01_a.pdf",), (None,)], "n string")
    assert [r[0] for r in names.select(schemas.safe_chapter_filename(F.col("n"), F.lit("01"))).collect()] == ["01_a.txt", None, None, None, None]


def test_diagnostics(spark):
    found = spark.createDataFrame([("p", "year", "missing"), ("p", "title", "missing"), ("p", "authors.0", "string_too_short"), ("q", "type", "unknown_type")], "path string, field string, code string")
    got = {r["id"]: (r["status"], r["action"], r["location"]) for r in validate.header_diagnostics(found).collect()}
    assert got == {
        "frontmatter.year.missing": ("needs_external_evidence", "run_quasi_search", "year"), "frontmatter.title.missing": ("human_review", "human_review", "title"),
        "frontmatter.authors.string_too_short": ("human_review", "human_review", "authors"), "frontmatter.document.unknown_type": ("human_review", "human_review", None),
    }
    body = spark.createDataFrame(
        [("p", "block_kind_mismatch", "关键概念", "table", "paragraph"), ("p", "block_kind_mismatch", "其他", "table", "paragraph"), ("p", "missing_required_h2", "x", None, None), ("p", "h2_alias", "a", "b", None)],
        "path string, fault string, h2 string, expected string, detected string",
    )
    got = sorted((r["id"], r["status"], r["severity"]) for r in validate.body_diagnostics(body).collect())
    assert got == [("body.document.h2_alias", "agent_fixable", "warning"), ("body.x.missing_required_h2", "agent_fixable", "error"), ("body.关键概念.block_kind_mismatch", "agent_fixable", "error"), ("body.其他.block_kind_mismatch", "human_review", "warning")]
    both = validate.merged_diagnostics(validate.header_diagnostics(found), validate.body_diagnostics(body))
    s = validate.summary(both).first()
    assert (s["n"], s["files"], s["agent_fixable"], s["needs_external_evidence"], s["human_review"], s["overall"]) == (8, 2, 3, 1, 4, "dirty")


def test_style_diagnostics(spark):
    text = '---\ntype: note\n---\n他说"你好"了。\n\n    缩进,码\n~~~\n围栏,码\n~~~\n见[链接](a,中)和[[维基,页]],好'
    rows = repair.style_diagnostics(spark.createDataFrame([("p", text)], "path string, text string")).collect()
    assert [(r["id"].split(".")[0], r["line"], r["column"], r["before"], r["after"], r["after_context"]) for r in rows] == [
        ("quote", 4, 3, '"你好"', "「你好」", "他说「你好」了。"),
        ("punctuation", 10, 20, ",", "，", "见[链接](a,中)和[[维基,页]]，好"),
    ]
    assert rows[0]["before_context"] == '他说"你好"了。'


@pytest.mark.parametrize(
    ("raw", "clean"),
    [
        ("Routledge is an imprint of T&F", "Routledge"), ("This X Books Imprint Is Published By Y", "X Books"), ("Berkeley : University of California Press", "University of California Press"),
        ("1999Macmillan Publishers Limited", "Macmillan Publishers Limited"), ("MIT Press; The MIT Press", "MIT Press"), ("Duke, United Kingdom, 2018", "Duke"), ("Wiley, Sons, 2018, x", "Wiley, Sons"),
        ("2018, Duke", "2018, Duke"), ("Short, " + "long " * 20, "Short"), ("Paris: X", "Paris: X"), ("", ""), (None, None),
    ],
)
def test_publishers(spark, raw, clean):
    df = spark.createDataFrame([(raw,)], "p string")
    assert df.select(repair.clean_publisher(F.col("p"))).first()[0] == clean


def test_more_publishers(spark):
    df = spark.createDataFrame([("Boston, Beacon Press, 2018Beacon Press",), ("Unknown House 1999, x",), ("London ; New York : Routledge",), ("Some Duke University Press",), ("",)], "p string")
    assert [r[0] for r in df.select(repair.normal_publisher(F.col("p"))).collect()] == ["Beacon Press", "Unknown House", "New York : Routledge", "University Press", ""]
    lists = spark.createDataFrame([(["Long Name Verlag", "X Press", "Y"],), (["Zed", "Abc Def"],), ([" "],), (None,)], "p array<string>")
    assert [r[0] for r in lists.select(repair.pick_publisher(F.col("p"))).collect()] == ["X Press", "Zed", "", ""]
    cities = spark.createDataFrame([(" New York ",), ("Duke",), ("",), (None,)], "p string")
    assert [r[0] for r in cities.select(repair.is_garbage_publisher(F.col("p"))).collect()] == ["city-only", None, "empty", "empty"]


def test_best_candidates_equal_brute_force(spark):
    rng = random.Random(3)
    words = [f"w{i:02d}x" for i in range(14)]
    make = lambda i: (i, rng.choice("ab"), " ".join(rng.choice(words) for _ in range(rng.randint(0, 6))), rng.choice([None, 0, 1990, 1995]), rng.choice(["P", "", None]), rng.choice(["1", None]))
    wanted, cands = [make(i) for i in range(60)], [make(i) for i in range(80)]
    schema = "id int, block string, title string, year int, publisher string, isbn string"
    w = spark.createDataFrame(wanted, schema).withColumnRenamed("id", "rid")
    c = spark.createDataFrame(cands, schema).withColumnRenamed("id", "idx")
    want = {}
    for i, b, t, y, *_ in wanted:
        best = None
        for j, b2, t2, y2, p, isbn in cands:
            a, e = set(t.split()), set(t2.split())
            if b != b2 or not a or not e or len(a & e) / min(len(a), len(e)) < 0.55:
                continue
            rank = (-len(a & e) / min(len(a), len(e)), abs(y2 - y) if y and y2 else 9999, -(bool(p) + bool(isbn)), j)
            best = min(best or rank, rank)
        if best:
            want[i] = best[3]
    got = {r["rid"]: r["c_idx"] for r in repair.best_candidates(w, c, "block", also=("publisher", "isbn")).collect()}
    assert got == want and len(want) > 30


def test_best_edition_points(spark):
    rows = [(1, 0, None, "1", None, 0, 1999), (1, 1, "978", None, None, None, None), (1, 2, None, None, "P", 5, None), (1, 3, None, None, "P", 5, None)]
    df = spark.createDataFrame(rows, "k int, idx int, isbn_13 string, isbn_10 string, publisher string, page_count int, year int")
    r = reconcile.best_edition(df, "k").first()
    assert (r["idx"], r["score"]) == (2, 30)


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("see https://Me:pw@Ex.org:8080/p?q=1#f, ok", "see https://ex.org:8080/p?<redacted>, ok"), ("(http://EX.org/a).", "(http://ex.org/a)."), ("http://a.b#f", "http://a.b?<redacted>"),
        ("Authorization: abc, x", "Authorization: <redacted>, x"), ("bearer xyz; cookie = 1", "bearer <redacted>; cookie = <redacted>"), ("api-key=1 apikey 2", "api-key=<redacted> apikey <redacted>"), ("my pass and longpass", "my <redacted> and <redacted>"),
        ("http://[bad", "<redacted-url>"), ("x" * 5000, "x" * 4000), (None, None),
    ],
)
def test_redaction(spark, text, want):
    df = spark.createDataFrame([(text,)], "t string")
    assert df.select(identifiers.redact(F.col("t"), ("pass", "longpass", ""))).first()[0] == want


def test_chinese_editions(spark):
    rows = [("9787100", "T", "P", None, True), ("978-957-1", None, None, None, True), ("97841", "中文", "出版", None, False), ("978604", "中文", None, None, False), ("9780822", "中文", None, None, True), ("9780822", "T", "P", ["译者"], True), (None, "かな中", None, None, False), (None, "T", "P", ["T."], False), (None, None, None, None, False)]
    df = spark.createDataFrame(rows, "i string, t string, p string, tr array<string>, want boolean")
    got = df.select("want", catalogues.is_chinese_edition(F.col("i"), F.col("t"), F.col("p"), F.col("tr")).alias("got")).collect()
    assert [r["got"] for r in got] == [r["want"] for r in got]


def test_candidates_and_ids(spark):
    schema = "douban_id string, source_id string, id string, title string, author string, authors array<string>, translator string, translators array<string>, publisher string, year int, isbn string, isbn_13 string, isbn_10 string"
    rows = [("1", None, None, "T", "A / B", None, None, [" C "], "P", 2000, "", None, "0822373785"), (None, None, "douban_cn:77", "U", None, ["X"], None, None, None, None, None, None, None), (None, "", "x:1", "V", None, None, None, None, None, None, None, None, None)]
    got = [tuple(r) for r in catalogues.normal_candidates(spark.createDataFrame(rows, schema)).collect()]
    assert got == [("1", "T", "A / B", ["A", "B"], "C", ["C"], "P", 2000, "9780822373780"), ("77", "U", "X", ["X"], "", [], None, None, None)]


def test_entry_lint(spark):
    schema = "slug string, kind string, title string, author string, authors array<string>, year int, publisher string, isbn string, doi string"
    rows = [
        ("ahmed-queer-2010", "book", "Queer", "[[ahmed|Sara Ahmed]]", None, 2010, "Duke", "1", None), ("a-2010", "book", "Talks (1999)", None, ["[[a]]"], 2011, None, "1", None), ("b-x-2010", "paper", "Read by X", "[[c]]", None, 0, None, None, ""),
        ("d-x", "paper", "T", "", ["D"], 1999, None, None, "10.1/x"), ("two-words-x-2000", "paper", "T", "[[other-one]]", None, 2000, None, None, "10.1/x"),
    ]
    got = sorted(tuple(r) for r in citations.entry_lint(spark.createDataFrame(rows, schema)).collect())
    assert got == [("a-2010", "missing-required", "publisher"), ("a-2010", "slug-year-mismatch", None), ("a-2010", "title-has-noise", None), ("b-x-2010", "author-slug-mismatch", None), ("b-x-2010", "missing-required", "year, doi"), ("b-x-2010", "title-has-noise", None)]


def test_citation_misses_have_lines_and_contexts(spark):
    draft = "One (Ahmed, 2010).\n" + "x" * 300 + " (work 1987and on) " + "y" * 300 + "\n(12 1987)"
    (row,) = citations.citation_misses(spark.createDataFrame([("f", draft), ("g", None)], "file string, text string")).collect()
    assert (row["file"], row["line"], row["raw"], len(row["context"])) == ("f", 2, "(work 1987and on)", 240)
    assert draft[row["lo"] : row["hi"]] == row["raw"] and "(work 1987and on)" in row["context"]


def test_transcripts_as_markdown(spark):
    bodies = {
        "live": "\n\n".join(f"`[00:{i:02d}]` line {i} " + "x" * 30 for i in range(12)), "loop": "\n".join(f"[1:00:{i:02d}] the same line again and again" for i in range(12)), "noise": "[00:01] " + "字幕由 " * 8 + "x" * 200,
        "blank": "[00:01] [BLANK_AUDIO]\n[00:02] [BLANK_AUDIO]\n[00:03] [BLANK_AUDIO]\n[00:04] x", "short": "[00:01] hi", "empty": "no stamps", "none": None,
    }
    rows = transcript.transcript_verdicts(spark.createDataFrame(list(bodies.items()), "doc string, body string")).collect()
    assert {r["doc"]: (r["state"], r["reason"]) for r in rows} == {
        "live": ("live", "usable"), "loop": ("dead", "repetition"), "noise": ("dead", "noise"), "blank": ("dead", "blank_audio"), "short": ("dead", "too_short"), "empty": ("empty", "no_cues"), "none": ("empty", "no_cues"),
    }


def one(spark, expr, **values):
    return spark.createDataFrame([tuple(values.values())], list(values)).select(expr.alias("x")).first()["x"]


def test_small_rules(spark):
    c = F.col
    assert one(spark, catalogues.expanded(c("t"), c("v")), t="a/{slug}-{n}.md", v={"slug": "x", "n": "1"}) == "a/x-1.md"
    assert one(spark, catalogues.expanded(c("t"), c("v")), t="a/{no}", v={"slug": "x"}) is None and one(spark, catalogues.expanded(c("t"), c("v")), t="plain", v={"a": "b"}) == "plain"
    assert tuple(one(spark, catalogues.slug_parts(c("s")), s="atanasoski-vora-surrogate-2019")) == ("vora surrogate", "atanasoski", 2019)
    assert tuple(one(spark, catalogues.page_signals(c("t")), t="a\f \fb\f")) == (3, 2) and tuple(one(spark, catalogues.page_signals(c("t")), t="a")) == (1, 1)
    draft = "Text.\n"
    more = one(spark, catalogues.with_records(c("t")), t=draft)
    assert more.startswith(draft) and one(spark, catalogues.with_records(c("t")), t=more) == more and one(spark, catalogues.without_records(c("t")), t=more) == draft
    assert one(spark, catalogues.without_records(c("t")), t="a <!-- proofread:start --> b") == "a\n" and one(spark, catalogues.without_records(c("t")), t="a") == "a"
    assert one(spark, catalogues.same_json(c("a"), c("b")), a='{"x": [1, {"y": null}], "z": 1}', b='{"z": 1.0, "x": [1, {"y": null}]}')
    assert not one(spark, catalogues.same_json(c("a"), c("b")), a='{"x": 1}', b='{"x": true}') and not one(spark, catalogues.same_json(c("a"), c("b")), a="[1, 2]", b="[2, 1]")
    assert one(spark, catalogues.valid_text(c("t"), 1, 3), t="abc") and not one(spark, catalogues.valid_text(c("t"), 1, 3), t=" ab") and not one(spark, catalogues.valid_text(c("t"), 1, 3), t="a\x07")
    assert one(spark, catalogues.valid_authors(c("a")), a=["A"]) and not one(spark, catalogues.valid_authors(c("a")), a=["A", ""])
    assert one(spark, catalogues.title_match(c("a"), c("b")), a="The New Book of Sorting Things", b="Sorting: a first edition") and not one(spark, catalogues.title_match(c("a"), c("b")), a="new book", b="Sorting")
    assert one(spark, catalogues.author_match(c("a"), c("b")), a=" Birkhead", b="T. BIRKHEAD") and not one(spark, catalogues.author_match(c("a"), c("b")), a="x", b="")
    assert one(spark, identifiers.pick_isbn(c("i")), i=["0-8223-7378-5", "978-0-8223-7378-0"]) == "9780822373780" and one(spark, identifiers.pick_isbn(c("i")), i=["0-8223-737-x"]) == "08223737X"
    assert one(spark, identifiers.subject_url(c("u")), u=" http://book.douban.com/subject/12//?a=1#b ") == "https://book.douban.com/subject/12/" and one(spark, identifiers.subject_url(c("u")), u="https://book.douban.com/subject/12/comments") is None
    assert one(spark, identifiers.wikilink_display(c("v")), v="[[a|B C]]") == "B C" and one(spark, identifiers.wikilink_display(c("v")), v='"D"') == "D" and one(spark, identifiers.wikilink_slug(c("v")), v=" [[a]] x") == "a"
    assert one(spark, identifiers.clean_title(c("t"), c("a")), t="Smith, *On* [[x|y]] (1999) - 书概览", a=["smith"]) == "On y"
    assert one(spark, identifiers.chapter_slug(F.lit("03"), c("t")), t="CH 3: " + "word " * 20).startswith("word-word") and len(one(spark, identifiers.chapter_slug(F.lit("03"), c("t")), t="x" * 90)) == 60
    assert one(spark, catalogues.identity(c("f")), f={"title": "T", "x": "y", "year": "1"}) == {"title": "T", "year": "1"}
    assert len(identifiers.filter_signature()) == 64


def test_cohering_pages(spark):
    rows = [("s", "1", "s", "1", True), ("s", "1", "t", "1", False), ("s", "1", "s", "2", False), (None, None, "s", "1", True), ("s", "1", None, "1", False), (None, None, "s", None, False)]
    df = spark.createDataFrame(rows, "a string, at string, b string, bt string, want boolean")
    assert all(r["want"] == r["got"] for r in df.select("want", catalogues.pages_cohere(F.col("a"), F.col("at"), F.col("b"), F.col("bt")).alias("got")).collect())


def test_caches(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"by_isbn": {"1": 2}}')
    (tmp_path / "b.json").write_text("{broken")
    (tmp_path / "c.json").write_text('{"by_isbn": []}')
    empty = {"version": 1, "by_isbn": {}, "by_douban_id": {}}
    assert catalogues.read_cache(spark, str(tmp_path / "a.json")) == {**empty, "by_isbn": {"1": 2}}
    assert all(catalogues.read_cache(spark, str(tmp_path / n)) == empty for n in ("b.json", "c.json", "none.json"))

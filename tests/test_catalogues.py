from pyspark.sql import functions as F

from lectern.operators import catalogues as C
from lectern.sources.markdown import header_text, parse_header, read_markdown


def test_works_of_catalogues(spark):
    raw = spark.createDataFrame(
        [("W1", "T", [("Ann A",)], 2020, "https://doi.org/10.1/X", 3, {"b": [1], "a": [0]})],
        "id string, title string, authorships array<struct<name:string>>, publication_year int, doi string, cited_by_count int, abstract_inverted_index map<string,array<int>>",
    )
    r = C.scholarly_works(raw).first()
    assert (r["authors"], r["doi"], r["abstract"]) == (["Ann A"], "10.1/x", "a b")
    raw = spark.createDataFrame([("k", "T", ["A"], 1999, ["P", "Q"], ["0-8223-7378-5", "9780822373780"])], "key string, title string, author_name array<string>, first_publish_year int, publisher array<string>, isbn array<string>")
    r = C.library_editions(raw).first()
    assert (r["publisher"], r["isbn_13"], r["isbn_10"]) == ("P / Q", "9780822373780", "0822373785")
    raw = spark.createDataFrame([("v", "T", None, ["A"], "2001-05", "P", "d" * 400, 9, [("ISBN_13", "978")])], "id string, title string, subtitle string, authors array<string>, published_date string, publisher string, description string, page_count int, identifiers array<struct<type:string,identifier:string>>")
    r = C.volumes(raw).first()
    assert (r["year"], len(r["description"]), r["isbn_13"], r["isbn_10"]) == (2001, 300, "978", None)


def test_editions_and_proof(spark):
    df = spark.createDataFrame([("9787100000000", "T", None), ("9780822373780", "中文", None), (None, "かな中", None), (None, "中文", None), (None, None, None)], "i string, t string, p string")
    assert [r[0] for r in df.select(C.is_chinese_edition(F.col("i"), F.col("t"), F.col("p"))).collect()] == [True, True, False, True, False]
    df = spark.createDataFrame(
        [("On Sorting Things by Bowker", "Sorting Things", "Bowker", None), ("On Sorting Things", "Sorting Things", "Bowker", None), ("see 10.1/AB here", "X", "Y", "10.1/ab"), (None, "X", "Y", None), ("text", "", "", None)],
        "text string, title string, who string, d string",
    )
    assert [r[0] for r in df.select(C.proves_identity(F.col("text"), F.col("title"), F.col("who"), F.col("d"))).collect()] == [True, False, True, True, True]


def test_cards_topics_and_books(spark):
    notes = spark.createDataFrame([("b", "k", "slug", None, None, None), ("b", "l", None, None, None, None), ("b", "", "x", None, None, None)], "batch_id string, key string, picked_slug string, status string, flag boolean, recommended_action string")
    assert sorted(tuple(r)[1:] for r in C.review_cards(notes).collect()) == [("k", "slug", "matched", False, "accept"), ("l", None, "unresolved", True, "search")]
    members = spark.createDataFrame([("t", "q", "book", "a-b"), ("t", "q", "book", "c-d"), ("u", "q", "book", "Bad Slug"), ("u", "q", "book", "ok-1")], "topic string, subquestion string, kind string, slug string")
    have = spark.createDataFrame([("book", "a-b")], "kind string, slug string")
    assert sorted((r["slug"], r["present"]) for r in C.topic_projection(members, have).collect()) == [("a-b", True), ("c-d", False)]
    ch = spark.createDataFrame([("x", "01"), ("x", "02")], "book string, slot string")
    assert tuple(C.book_status(ch, ch.where("slot = '01'")).first()) == ("x", 2, 1, ["02"])


def test_markdown_round_trip(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / ".hidden").mkdir()
    (tmp_path / "a" / "one.md").write_text('---\ntitle: "On: x"\nauthors:\n  - A B\n  - C\nyear: 1999\n---\nBody\n')
    (tmp_path / "a" / "two.md").write_text("no header")
    (tmp_path / "a" / "three.md").write_text("---\n- list\n---\nx")
    (tmp_path / ".hidden" / "x.md").write_text("---\na: 1\n---\n")
    rows = {r["path"].rsplit("/", 1)[1]: r for r in read_markdown(spark, str(tmp_path)).collect()}
    assert set(rows) == {"one.md", "two.md", "three.md"}
    assert rows["one.md"]["header"] == {"title": "On: x", "authors": '["A B", "C"]', "year": "1999"} and rows["one.md"]["body"] == "Body\n"
    assert rows["two.md"]["error"] == "missing_header" and rows["three.md"]["error"] == "malformed"
    text = spark.createDataFrame([({"title": "On: x", "year": "1999", "gone": ""},)], "h map<string,string>").select(header_text(F.col("h"))).first()[0]
    assert text == '---\ntitle: "On: x"\nyear: 1999\n---\n' and parse_header(text.strip("-\n")) == {"title": "On: x", "year": "1999"}

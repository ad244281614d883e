"""Steps that once took a call a group, more memory with more rows, or left rows out."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from lectern.functions import text
from lectern.operators import citations, repair, segment, transcript, validate
from lectern.plans import texts


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_contents_levels_need_no_call_a_book(spark):
    rng = random.Random(1)
    rows = [(b, p, rng.randint(1, 6)) for b in range(40) for p in range(rng.randint(1, 12))]
    want = {}
    for book in range(40):
        levels = [v for b, _, v in rows if b == book]
        before = 0
        for p, v in enumerate(levels):
            before = min(v - min(levels) + 1, before + 1)
            want[book, p] = before
    out = segment.toc_levels(spark.createDataFrame(random.Random(2).sample(rows, len(rows)), "book int, pos int, level int"))
    assert "Python" not in plan_of(out) and "InPandas" not in plan_of(out)
    assert {(r["book"], r["pos"]): r["level"] for r in out.collect()} == want


def test_paragraphs_and_cues_need_no_call_a_talk(spark):
    rng = random.Random(3)
    cues, want = [], {}
    for talk in range(60):
        at, number, begin = 0.0, 0, None
        for idx in range(rng.randint(1, 40)):
            end = at + rng.randint(1, 20)
            cues.append((talk, idx, at, end, "x"))
            begin = at if begin is None else begin
            want[talk, idx] = number
            if end - begin >= 45:
                number, begin = number + 1, None
            at = end + rng.randint(0, 3)
    out = transcript.paragraphs(spark.createDataFrame(rng.sample(cues, len(cues)), "talk long, idx long, start double, end double, text string"))
    assert "InPandas" not in plan_of(out)
    assert {(r["talk"], r["idx"]): r["paragraph"] for r in out.collect()} == want
    tokens = [(t, p, " a", 1000 * p, 1000 * p + 10) for t in range(50) for p in range(t % 4)]
    grouped = transcript.group_cues(spark.createDataFrame(tokens, "talk long, pos int, text string, start_ms long, end_ms long"))
    assert "InPandas" not in plan_of(grouped)
    assert sorted((r["talk"], r["idx"], r["start"]) for r in grouped.collect()) == [(t, p, float(p)) for t in range(50) for p in range(t % 4)]


@pytest.mark.parametrize("second, shown, srt", [(0.0, "00:00", "00:00:00,000"), (75.5, "01:15", "00:01:15,500"), (3605.007, "1:00:05", "01:00:05,007"), (400_000.0, "111:06:40", "111:06:40,000")])
def test_stamps(spark, second, shown, srt):
    assert tuple(spark.range(1).select(transcript.stamp(F.lit(second)), transcript.stamp(F.lit(second), True)).first()) == (shown, srt)


def test_best_candidates_look_up_each_title_once(spark):
    """As many rows as a title has copies once met as many others, all pairs of the two."""
    rows = [(i, ("small red box", "large blue cup", "hot iron ring")[i % 3], 1950 + i % 4, "b", None if i % 5 else "p") for i in range(600)]
    w = spark.createDataFrame([r[:4] for r in rows], "rid int, title string, year int, block string")
    c = spark.createDataFrame([(i, t, y, b, p) for i, t, y, b, p in rows], "idx int, title string, year int, block string, publisher string")
    got = repair.best_candidates(w, c, "block")
    best = {r["rid"]: (r["c_idx"], r["overlap"], r["gap"]) for r in got.collect()}
    want = {}
    for i, title, year, _, _ in rows:
        same = [(abs(y - year), p is None, j) for j, t, y, _, p in rows if t == title]
        gap, _, j = min(same)
        want[i] = (j, 1.0, gap)
    assert best == want
    met = max(int(m.value()) for m in _metrics(got, "numOutputRows", "Join"))
    assert met <= 1000, met


def _metrics(df, name, of):
    """Values of a metric of the operators of a plan that ran."""
    df.collect()
    out, plan = [], df._jdf.queryExecution().executedPlan()
    stack = [plan.executedPlan() if plan.nodeName() == "AdaptiveSparkPlan" else plan]
    while stack:
        p = stack.pop()
        if of in p.nodeName() and p.metrics().contains(name):
            out.append(p.metrics().apply(name))
        stack += [p.plan()] if "QueryStage" in p.nodeName() else []
        kids = p.children()
        stack += [kids.apply(i) for i in range(kids.size())]
    return out


def test_tiers_by_class_lose_no_pair(spark):
    authors = ("ahmed", "ahmedq", "latour", "nobody", "latour-")
    asked = spark.createDataFrame([(f"c{i}", authors[i % 5], 1990 + i % 3, False) for i in range(90)], "key string, author string, year int, is_cjk boolean")
    biblio = spark.createDataFrame([(f"{('ahmed', 'latour')[i % 2]}-work{i}-{1990 + i % 4}", "") for i in range(40)], "slug string, author_slug string")
    index = citations.author_index(biblio)
    plain = sorted(tuple(r) for r in citations.tiers(asked, index).collect())
    by_class = citations.tiers_by_class(asked, index).collect()
    pairs = {}
    for r in by_class:
        if r["key"] == r["same_as"]:
            pairs.setdefault(r["key"], []).append((r["tier"], r["slug"], r["edits"], r["year_offset"]))
    told = {r["key"]: r["same_as"] for r in by_class}
    assert sorted((k, *p) for k, head in told.items() for p in pairs[head]) == plain
    assert all(r["n"] == len([p for p in pairs[r["same_as"]] if p[1] is not None]) for r in by_class)
    assert len(by_class) < len(plain) / 2
    states = {r["key"]: (r["tier"], r["status"], r["n"]) for r in citations.statuses(citations.tiers(asked, index)).collect()}
    assert {r["key"]: (r["tier"], r["status"], r["n"]) for r in citations.statuses_by_class(asked, index).collect()} == states


def test_abstracts_of_texts_without_words(spark, tmp_path):
    import duckdb

    rows = [(1, "a b  a"), (2, ""), (3, " \n\t"), (4, None), (5, "a\x0bb\u00a0c d"), (6, "\u3000x\x85y\x1cz")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    want = duckdb.connect().sql(texts.ORACLE_SQL["abstract_from_positions"].replace("documents", f"'{tmp_path}/documents.parquet/*.parquet'")).fetchall()
    assert sorted(tuple(r) for r in texts.abstract_from_positions(spark, str(tmp_path)).collect()) == sorted(want)


def test_publishers_are_worked_out_step_by_step(spark):
    size = len(repair.clean_publisher(F.col("p"))._jc.toString())
    assert size < 20_000


def test_accents_need_no_python(spark):
    import unicodedata

    words = [None, "", "plain", "José O’Néil", "ﬁn Ⅳ ½ Å ǅ", "a \u0301 b", "각 한", "ą̧\u0345x", "क़ि", "\U0001d400\U0001f600é", "Łódź ß"]
    df = spark.createDataFrame([(i, w) for i, w in enumerate(words)], "i int, w string").select("i", text.without_accents(F.col("w")).alias("w"))
    assert "Python" not in plan_of(df)
    want = [None if w is None else "".join(c for c in unicodedata.normalize("NFKD", w) if not unicodedata.combining(c)) for w in words]
    assert [r["w"] for r in df.orderBy("i").collect()] == want


def test_inventories_and_agreed_entries_count_nothing_distinct_by_key(spark):
    ch = spark.createDataFrame([("a", 1, 1, 1), ("a", 2, 2, 1), ("b", 1, 1, 1), ("b", 2, 2, 2), ("c", None, 1, 1), ("d", 1, 3, 3)], "book string, slot int, filename int, slug int").select("*", F.lit(1).alias("start"), F.lit(2).alias("end"))
    out = validate.chapter_inventory(ch)
    assert "Expand" not in plan_of(out)
    assert {(r["book"], r["chapters"], r["valid"]) for r in out.collect()} == {("a", 2, False), ("b", 2, True), ("c", 1, False), ("d", 1, True)}
    maps = spark.createDataFrame([(0, 1, 5), (1, 1, 5), (0, 2, 5), (1, 2, 6), (0, 3, 5), (0, 4, 7), (0, 4, 7), (1, 4, None), (0, 5, 1), (0, 5, 2), (1, 5, 1), (0, 6, None), (1, 6, None)], "map_id int, k int, v int")
    agreed = transcript.agreed_entries(maps)
    assert plan_of(agreed).count("Expand") == 0
    assert sorted(tuple(r) for r in agreed.collect()) == [(1, 5), (4, 7)]


def test_headers_and_bodies_go_through_arrow(spark):
    import yaml
    from pyspark.util import PythonEvalType

    from lectern.operators import schemas
    from lectern.sources import markdown
    from lectern.sources.markdown import split_header

    texts_ = ["---\na: 1\nb: [x, y]\nc: 2020-01-02\nd: null\ne: 'q'\n---\nbody", "none", None, "---\n- x\n---\nrest", "---\na: [\n---\n"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts_)], "i int, t string")
    got = [tuple(r["p"]) for r in df.select("i", split_header("t").alias("p")).orderBy("i").collect()]
    kinds = {"a": "int", "b": "list", "c": "date", "d": "null", "e": "str"}
    assert got[0] == ({"a": "1", "b": '["x", "y"]', "c": "2020-01-02", "d": None, "e": "q"}, kinds, "body", None)
    assert got[1:] == [(None, None, "none", "missing_header"), (None, None, None, "missing_header"), (None, None, "rest", "malformed"), (None, None, "", "malformed")]
    bodies = [("1", "book", "## 核心论点\nx\n~~~\n## 精读章节\n~~~"), ("2", None, "x"), ("3", "webpage", None)]
    out = schemas.body_violations(spark.createDataFrame(bodies, "path string, type string, body string"))
    assert schemas._body_faults.evalType == split_header.evalType == PythonEvalType.SQL_SCALAR_ARROW_UDF
    assert markdown._LOADER is yaml.CSafeLoader
    assert {(r["path"], r["fault"], r["h2"]) for r in out.collect()} == {("1", "missing_required_h2", h) for h in ("章节逻辑", "关键概念", "理论贡献", "精读章节")} | {("3", "missing_required_h2", h) for h in ("Summary", "Content")}


def test_frequent_words_lie_in_no_single_task(spark, monkeypatch):
    from lectern.operators import reconcile
    from lectern.sources.tables import spread

    df = spark.range(10).withColumn("k", F.col("id") % 3)
    assert spread(df, 10, "k", each=1).rdd.getNumPartitions() == 10
    assert spread(df, 10, "k") is df
    rows = [(i, f"w{i // 2} base part", 1900 + i % 2) for i in range(60)]
    records = spark.createDataFrame(rows, "rid long, title string, year int")
    monkeypatch.setattr(reconcile, "HOT", 5)
    out = reconcile.title_pairs(records)
    assert "BroadcastHashJoin" in plan_of(out)
    assert sorted(tuple(r) for r in out.collect()) == [(i, i + 1) for i in range(0, 60, 2)]


def test_slots_are_parted_by_the_number_of_lines(spark, monkeypatch):
    asked = []
    monkeypatch.setattr(texts, "spread", lambda df, rows, *keys: asked.append((rows, keys)) or df.repartition(7, *keys), raising=False)
    assert "hashpartitioning(l_orderkey" in plan_of(texts.slot_assignment(spark, "/root/testdata/sf0.001"))
    assert [k for _, k in asked] == [("l_orderkey",)] and asked[0][0] > 0

"""Queries: validation, profiles, diagnostics and reports over the reference tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.operators import schemas, segment, transcript, validate
from lectern.operators.validate import Rule
from lectern.sources.tables import read_table


def field_coverage(spark: SparkSession, d: str) -> DataFrame:
    docs = read_table(spark, d, "documents").select("doc_id", "lang", "source")
    labels = read_table(spark, d, "labels").withColumn("quality", F.when(F.col("doc_id") % 2 == 0, F.col("quality")))
    return validate.field_coverage(docs.join(labels, "doc_id", "left"), "doc_id", "lang", ["source", "quality", "toxic"])


def type_buckets(spark: SparkSession, d: str) -> DataFrame:
    """Event kinds as record types: present, former, missing and unknown ones."""
    raw = F.when(F.col("event_type") == "view", "book").when(F.col("event_type") == "click", "monograph").when(F.col("event_type") == "signup", "author-profile").when(F.col("event_type") == "error", "A")
    raw = F.when(F.col("event_id") % 11 != 0, F.coalesce(raw, F.when(F.col("event_id") % 2 == 0, "paper").otherwise("gadget")))
    rows = read_table(spark, d, "events").select(schemas.type_bucket(raw).alias("b")).select("b.bucket", "b.problem")
    return rows.groupBy("bucket", "problem").agg(F.count("*").alias("n"))


def _rules() -> list[Rule]:
    return [
        validate.within("p_size", 5, 40),
        validate.within("p_retailprice", 900.0, 990.0),
        validate.one_of("p_type", "ECONOMY", "PROMO", "SMALL", "STANDARD"),
        validate.matches("p_brand", "^Brand#[0-9]$"),
        validate.sized("p_name", 8, 12),
        validate.required("comment"),
    ]


def _broken(spark: SparkSession, d: str) -> DataFrame:
    part = read_table(spark, d, "part").withColumn("comment", F.when(F.col("p_partkey") % 9 != 0, "ok"))
    return validate.violations(part, "p_partkey", _rules())


def constraint_violations(spark: SparkSession, d: str) -> DataFrame:
    return _broken(spark, d)


def _headers(spark: SparkSession, d: str) -> DataFrame:
    """Parts as headers of papers, books, a former and an unknown type; short titles, short authors, years out of bounds, fields of other types."""
    k = F.col("p_partkey")
    kind = F.when(k % 4 == 0, "paper").when(k % 4 == 1, "book").when(k % 4 == 2, "monograph").otherwise("gadget")
    values = {
        "type": kind, "title": F.when(k % 5 == 0, " x ").otherwise(F.col("p_name")), "authors": F.when(k % 3 == 0, '["Ann B.", "C"]').otherwise('["Ann Other"]'),
        "year": F.when(k % 8 != 0, (k % 700 + 1400).cast("string")), "publisher": F.col("p_brand"), "rating": F.when(k % 7 == 0, "7").otherwise("3"), "shelf": F.lit("x"),
    }
    fields = F.map_from_arrays(F.array(*[F.lit(n) for n in values]), F.array(*values.values()))
    return read_table(spark, d, "part").select(k.cast("string").alias("path"), kind.alias("type"), fields.alias("fields"))


def header_violations(spark: SparkSession, d: str) -> DataFrame:
    return schemas.header_violations(_headers(spark, d))


def _bodies(spark: SparkSession, d: str) -> DataFrame:
    """Parts as bodies of books: an old heading, a list in the place of a table, a heading too deep, missing and unknown sections, all headings too deep."""
    k = F.col("p_partkey")
    part = lambda heading, text: F.concat(F.lit(heading + "\n"), text, F.lit("\n\n"))
    words = F.col("p_name")
    usual = F.concat(
        part("## 核心论点", words),
        F.when(k % 2 == 1, part("## 章节间逻辑", words)).otherwise(part("## 章节逻辑", words)),
        F.when(k % 3 == 0, part("## 关键概念", F.lit("| a | b |\n|---|---|\n| c | d |"))).otherwise(part("## 关键概念", F.lit("- a\n- b"))),
        F.when(k % 5 == 0, part("### 理论贡献", words)).otherwise(part("## 理论贡献", F.concat(F.lit("```\n## not a heading\n```\n"), words))),
        F.when(k % 7 == 0, "").otherwise(part("## 精读章节", F.lit("1. a\n2. b"))),
        F.when(k % 11 == 0, part("## Extra", words)).otherwise(""),
    )
    return read_table(spark, d, "part").select(k.cast("string").alias("path"), F.lit("book").alias("type"), F.when(k % 13 == 0, F.concat(F.lit("### a\n"), words)).otherwise(usual).alias("body"))


def body_violations(spark: SparkSession, d: str) -> DataFrame:
    return schemas.body_violations(_bodies(spark, d))


def _diagnostics(spark: SparkSession, d: str) -> DataFrame:
    return validate.merged_diagnostics(validate.header_diagnostics(header_violations(spark, d)), validate.body_diagnostics(body_violations(spark, d)))


def diagnostics_routing(spark: SparkSession, d: str) -> DataFrame:
    return _diagnostics(spark, d).groupBy("id", "severity", "status", "action").agg(F.count("*").alias("n"))


def diagnostics_summary(spark: SparkSession, d: str) -> DataFrame:
    return validate.summary(_diagnostics(spark, d), "pass")


def top_errors_per_type(spark: SparkSession, d: str) -> DataFrame:
    e = read_table(spark, d, "events").select("event_type", (F.get_json_object("props", "$.k").cast("int") % 17).alias("code"))
    return validate.top_k(e, "event_type", "code", 5)


def modal_kind_ratio(spark: SparkSession, d: str) -> DataFrame:
    e = read_table(spark, d, "events").withColumn("kind_", F.when(F.col("user_id") % 3 == 0, F.when(F.col("event_id") % 7 == 0, F.col("event_type")).otherwise("view")).otherwise(F.col("event_type")))
    return segment.modal(e, "user_id", "kind_", "event_id")


def fixed_headers(spark: SparkSession, d: str) -> DataFrame:
    """Parts as headers to repair: former types and names, ratings in stars, impossible years, fields of no type."""
    k = F.col("p_partkey")
    header = F.to_json(
        F.struct(
            F.when(k % 2 == 0, "monograph").otherwise("chapter").alias("type"), F.col("p_name").alias("tags"), F.lit("Ann Other").alias("author"), F.when(k % 3 == 0, "★★★").when(k % 3 == 1, "good").alias("rating"),
            (k % 700 + 1400).cast("string").alias("year"), F.lit("1").alias("slot"),
        )
    )
    fixed = schemas.fix_header(F.concat(F.lit("vault/books/b"), k.cast("string"), F.lit("/ch01.md")), header)
    out = read_table(spark, d, "part").select(k.alias("path"), fixed.alias("f")).select("path", "f.header", F.array_join("f.changes", ";").alias("changes"))
    get = lambda n: F.get_json_object("header", f"$.{n}").alias(n)
    return out.select("path", *[get(n) for n in ("type", "themes", "authors", "rating", "year", "book", "slot")], "changes")


def chapter_inventories(spark: SparkSession, d: str) -> DataFrame:
    """Orders as books, their lines as chapters."""
    li = read_table(spark, d, "lineitem")
    rows = li.select(F.col("l_orderkey").alias("book"), F.col("l_linenumber").alias("slot"), F.col("l_linenumber").alias("filename"), F.col("l_partkey").alias("slug"), F.lit(1).alias("start"), F.col("l_linenumber").alias("end"))
    return validate.chapter_inventory(rows)


def complete_orders(spark: SparkSession, d: str) -> DataFrame:
    """The lines of orders all of whose lines were returned or none open."""
    li = read_table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_linestatus")
    return validate.all_or_nothing(li, "l_orderkey", F.col("l_linestatus") == "F").select("l_orderkey", "l_linenumber", "l_quantity")


def weighted_median_price(spark: SparkSession, d: str) -> DataFrame:
    li = read_table(spark, d, "lineitem").select("l_returnflag", F.floor(F.col("l_extendedprice") / 100).cast("long").alias("price"), F.col("l_quantity").cast("long").alias("q"))
    return segment.weighted_median(li, "l_returnflag", "price", "q")


def gap_sessions(spark: SparkSession, d: str) -> DataFrame:
    s = segment.sessions(read_table(spark, d, "events").select("user_id", "event_id", "ts", "value"), "user_id", "ts", 6 * 3600)
    return s.groupBy("user_id", "session").agg(F.count("*").alias("n"), F.min("ts").alias("start"), F.max("ts").alias("end"))


def agreed_map(spark: SparkSession, d: str) -> DataFrame:
    part = read_table(spark, d, "part")
    maps = part.select(F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))).alias("map_id"), F.col("p_partkey").alias("k"), "p_size")
    maps = maps.where("not (map_id = 2 and k % 10 = 0)").select("map_id", "k", F.when((F.col("map_id") == 1) & (F.col("k") % 7 == 0), F.col("p_size") + 1).otherwise(F.col("p_size")).alias("v"))
    return transcript.agreed_entries(maps)


QUERIES = {
    f.__name__: f
    for f in (
        field_coverage, type_buckets, constraint_violations, diagnostics_routing, diagnostics_summary, top_errors_per_type, modal_kind_ratio, header_violations, body_violations, fixed_headers,
        chapter_inventories, complete_orders, weighted_median_price, gap_sessions, agreed_map,
    )
}

_BROKEN = """
p AS (SELECT *, CASE WHEN p_partkey % 9 <> 0 THEN 'ok' END AS comment FROM part),
b AS (SELECT p_partkey, 'p_size' AS field, 'out_of_range' AS code FROM p WHERE p_size NOT BETWEEN 5 AND 40 UNION ALL SELECT p_partkey, 'p_retailprice', 'out_of_range' FROM p WHERE p_retailprice NOT BETWEEN 900 AND 990
UNION ALL SELECT p_partkey, 'p_type', 'not_allowed' FROM p WHERE p_type NOT IN ('ECONOMY', 'PROMO', 'SMALL', 'STANDARD') UNION ALL SELECT p_partkey, 'p_brand', 'malformed' FROM p WHERE NOT regexp_full_match(p_brand, 'Brand#[0-9]')
UNION ALL SELECT p_partkey, 'p_name', 'bad_length' FROM p WHERE length(p_name) NOT BETWEEN 8 AND 12 UNION ALL SELECT p_partkey, 'comment', 'missing' FROM p WHERE comment IS NULL)"""
_HEADERS = """
h AS (SELECT p_partkey AS k, CAST(p_partkey AS VARCHAR) AS path, p_partkey % 4 = 0 AS paper, CASE WHEN p_partkey % 8 <> 0 THEN p_partkey % 700 + 1400 END AS y, p_name FROM part),
g AS (SELECT * FROM h WHERE k % 4 < 2),
hv AS (SELECT path, 'type' AS field, CASE k % 4 WHEN 2 THEN 'deprecated_type' ELSE 'unknown_type' END AS code FROM h WHERE k % 4 >= 2
UNION ALL SELECT path, 'title', 'string_too_short' FROM g WHERE k % 5 = 0 OR length(p_name) < 2 UNION ALL SELECT path, 'authors.1', 'string_too_short' FROM g WHERE k % 3 = 0
UNION ALL SELECT path, 'year', CASE WHEN y < 1500 THEN 'greater_than_equal' ELSE 'less_than_equal' END FROM g WHERE y NOT BETWEEN 1500 AND 2030 UNION ALL SELECT path, 'rating', 'less_than_equal' FROM g WHERE k % 7 = 0
UNION ALL SELECT path, 'shelf', 'extra_forbidden' FROM g UNION ALL SELECT path, unnest(['journal', 'themes']), 'missing' FROM g WHERE paper UNION ALL SELECT path, 'publisher', 'extra_forbidden' FROM g WHERE paper)"""
_BODIES = """
b AS (SELECT p_partkey AS k, CAST(p_partkey AS VARCHAR) AS path FROM part), u AS (SELECT * FROM b WHERE k % 13 <> 0),
bv AS (SELECT path, 'global_heading_level_drift' AS fault, CAST(NULL AS VARCHAR) AS h2, '2' AS expected, '3' AS detected FROM b WHERE k % 13 = 0
UNION ALL SELECT path, 'h2_alias', '章节间逻辑', '章节逻辑', NULL FROM u WHERE k % 2 = 1
UNION ALL SELECT path, 'block_kind_mismatch', '关键概念', 'table', CASE WHEN k % 5 = 0 THEN 'h3' ELSE 'bullet-list' END FROM u WHERE k % 5 = 0 OR k % 3 <> 0
UNION ALL SELECT path, 'heading_level_drift', '理论贡献', '2', '3' FROM u WHERE k % 5 = 0 UNION ALL SELECT path, 'missing_required_h2', '精读章节', NULL, NULL FROM u WHERE k % 7 = 0 UNION ALL SELECT path, 'unknown_h2', 'Extra', NULL, NULL FROM u WHERE k % 11 = 0)"""
_ROUTED = """
r AS (SELECT path, 'frontmatter_schema' AS pass, 'frontmatter.' || CASE WHEN field = 'type' THEN 'document' ELSE string_split(field, '.')[1] END || '.' || code AS id, 'error' AS severity,
  CASE WHEN code = 'missing' AND field = 'journal' THEN 'needs_external_evidence' ELSE 'human_review' END AS status, CASE WHEN code = 'missing' AND field = 'journal' THEN 'run_quasi_search' ELSE 'human_review' END AS action FROM hv
UNION ALL SELECT path, 'body_schema', 'body.' || CASE WHEN fault IN ('h2_alias', 'global_heading_level_drift') THEN 'document' ELSE h2 END || '.' || fault, CASE WHEN fault = 'missing_required_h2' THEN 'error' ELSE 'warning' END,
  CASE WHEN fault IN ('block_kind_mismatch', 'unknown_h2') THEN 'human_review' ELSE 'agent_fixable' END,
  CASE WHEN fault = 'missing_required_h2' THEN 'insert_required_stub' WHEN fault IN ('block_kind_mismatch', 'unknown_h2') THEN 'human_review' ELSE 'normalize_heading_level' END FROM bv)"""

ORACLE_SQL = {
    "field_coverage": """WITH j AS (SELECT d.doc_id, lang, source, CASE WHEN d.doc_id % 2 = 0 THEN quality END AS quality, toxic FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id),
u AS (SELECT lang, doc_id, 'source' AS field, source AS v FROM j UNION ALL SELECT lang, doc_id, 'quality', CAST(quality AS VARCHAR) FROM j UNION ALL SELECT lang, doc_id, 'toxic', CAST(toxic AS VARCHAR) FROM j)
SELECT lang, field, count(v) AS count, round(count(v) / count(*), 4) AS coverage, list_sort(list(doc_id) FILTER (WHERE v IS NOT NULL))[1:5] AS examples FROM u GROUP BY lang, field HAVING count(v) > 0""",
    "type_buckets": """WITH r AS (SELECT CASE WHEN event_id % 11 = 0 THEN NULL ELSE CASE event_type WHEN 'view' THEN 'book' WHEN 'click' THEN 'monograph' WHEN 'signup' THEN 'author-profile' WHEN 'error' THEN 'A' ELSE CASE WHEN event_id % 2 = 0 THEN 'paper' ELSE 'gadget' END END END AS t FROM events)
SELECT CASE WHEN t IS NULL THEN '_missing_type' WHEN t IN ('book', 'paper') THEN t WHEN t = 'monograph' THEN 'book' WHEN t = 'author-profile' THEN 'author' ELSE '_unknown_type' END AS bucket,
  CASE WHEN t IS NULL THEN 'missing_type' WHEN t IN ('monograph', 'author-profile') THEN 'deprecated_type' WHEN t IN ('A', 'gadget') THEN 'unknown_type' END AS problem, count(*) AS n FROM r GROUP BY 1, 2""",
    "constraint_violations": f"WITH {_BROKEN} SELECT * FROM b",
    "diagnostics_routing": f"WITH {_HEADERS}, {_BODIES}, {_ROUTED} SELECT id, severity, status, action, count(*) AS n FROM r GROUP BY ALL",
    "diagnostics_summary": f"""WITH {_HEADERS}, {_BODIES}, {_ROUTED} SELECT pass, count(*) AS n, count(DISTINCT path) AS files, CAST(0 AS BIGINT) AS auto_fixed, count(*) FILTER (WHERE status = 'agent_fixable') AS agent_fixable,
count(*) FILTER (WHERE status = 'needs_external_evidence') AS needs_external_evidence, count(*) FILTER (WHERE status = 'human_review') AS human_review, 'dirty' AS overall FROM r GROUP BY pass""",
    "top_errors_per_type": """WITH e AS (SELECT event_type, CAST(json_extract_string(props, '$.k') AS INTEGER) % 17 AS code FROM events), c AS (SELECT event_type, code, count(*) AS n FROM e GROUP BY ALL),
r AS (SELECT *, round(n / sum(n) OVER (PARTITION BY event_type), 4) AS share, CAST(row_number() OVER (PARTITION BY event_type ORDER BY n DESC, code) AS INTEGER) AS rank FROM c) SELECT * FROM r WHERE rank <= 5""",
    "modal_kind_ratio": """WITH e AS (SELECT user_id, event_id, CASE WHEN user_id % 3 = 0 AND event_id % 7 <> 0 THEN 'view' ELSE event_type END AS k FROM events), c AS (SELECT user_id, k, count(*) AS n, min(event_id) AS f FROM e GROUP BY ALL),
r AS (SELECT *, sum(n) OVER (PARTITION BY user_id) AS total, row_number() OVER (PARTITION BY user_id ORDER BY n DESC, f) AS o FROM c)
SELECT user_id, CASE WHEN n / total < 0.6 THEN 'mixed' ELSE k END AS kind, n, CAST(total AS BIGINT) AS total FROM r WHERE o = 1""",
    "header_violations": f"WITH {_HEADERS} SELECT * FROM hv",
    "body_violations": f"WITH {_BODIES} SELECT * FROM bv",
    "fixed_headers": """WITH h AS (SELECT p_partkey AS k, p_partkey % 2 = 0 AS book, p_partkey % 3 AS m, p_partkey % 700 + 1400 AS y, p_name FROM part)
SELECT k AS path, CASE WHEN book THEN 'book' ELSE 'chapter' END AS type, '["' || p_name || '"]' AS themes, '["Ann Other"]' AS authors, CASE WHEN m = 0 THEN '3' END AS rating, CASE WHEN y BETWEEN 1500 AND 2030 THEN CAST(y AS VARCHAR) END AS year,
  CASE WHEN NOT book THEN 'b' || k END AS book, CAST(NULL AS VARCHAR) AS slot,
  concat_ws(';', CASE WHEN book THEN 'type monograph to book' END, 'renamed tags to themes', 'renamed author to authors', 'authors to a list', CASE m WHEN 0 THEN 'rating to a number' WHEN 1 THEN 'dropped rating' END,
  CASE WHEN y BETWEEN 1500 AND 2030 THEN 'year to a number' ELSE 'dropped year' END, CASE WHEN NOT book THEN 'book from the path' END, 'dropped slot', 'themes to a list') AS changes FROM h""",
    "chapter_inventories": "SELECT l_orderkey AS book, count(*) AS chapters, bool_and(l_linenumber >= 1) AND count(*) = count(DISTINCT l_linenumber) AND count(*) = count(DISTINCT l_partkey) AS valid FROM lineitem GROUP BY 1",
    "complete_orders": "SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_linestatus <> 'F')",
    "weighted_median_price": """WITH p AS (SELECT l_returnflag, CAST(floor(l_extendedprice / 100) AS BIGINT) AS price, sum(CAST(l_quantity AS BIGINT)) AS w FROM lineitem GROUP BY 1, 2),
r AS (SELECT *, sum(w) OVER (PARTITION BY l_returnflag ORDER BY price) AS run, sum(w) OVER (PARTITION BY l_returnflag) AS total FROM p) SELECT l_returnflag, min(price) AS median FROM r WHERE run >= total / 2 GROUP BY 1""",
    "gap_sessions": """WITH g AS (SELECT *, CASE WHEN epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id)) > 6 * 3600000000 THEN 1 ELSE 0 END AS new FROM events),
s AS (SELECT *, CAST(sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS session FROM g)
SELECT user_id, session, count(*) AS n, min(ts) AS start, max(ts) AS "end" FROM s GROUP BY 1, 2""",
    "agreed_map": "SELECT p_partkey AS k, p_size AS v FROM part WHERE p_partkey % 10 <> 0 AND p_partkey % 7 <> 0",
}

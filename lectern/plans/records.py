"""Queries: reconciliation, resolution, merging and enrichment over the reference tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.functions.text import content_tokens
from lectern.operators import reconcile, repair, resolve, validate, worklist
from lectern.sources.tables import read_table

SOURCES = ("goodreads", "amazon", "openlibrary", "googlebooks")


def catalogue(spark: SparkSession, d: str) -> DataFrame:
    """Parts as records of four catalogues, four records a work: some without ISBN, titles with and without a subtitle."""
    k, work = F.col("p_partkey"), F.floor(F.col("p_partkey") / 4).cast("long")
    return read_table(spark, d, "part").select(
        k.alias("rid"),
        F.element_at(F.array(*[F.lit(s) for s in SOURCES]), (k % 4 + 1).cast("int")).alias("src"),
        (k % 4).cast("int").alias("src_ord"),
        k.alias("pos"),
        F.concat(F.lit("W"), work.cast("string"), F.lit(": base"), F.when(k % 2 == 1, F.concat(F.lit(" part S"), (k % 3).cast("string"))).otherwise("")).alias("title"),
        (1900 + work % 100 + F.when(k % 4 == 3, 1).otherwise(0)).cast("int").alias("year"),
        F.when(k % 3 != 0, F.col("p_brand")).alias("publisher"),
        F.when(k % 5 != 0, F.concat(F.lit("978"), F.lpad(work.cast("string"), 10, "0"))).alias("isbn_13"),
        F.col("p_size").alias("page_count"),
    )


KIND = reconcile.Kind(keys=("isbn_13",), priority={"year": ("amazon", "goodreads"), "publisher": ("openlibrary", "goodreads", "amazon"), "isbn_13": SOURCES}, conflicts=("year", "publisher", "page_count"))
_CAT = """
cat AS (SELECT p_partkey AS rid, p_partkey // 4 AS work, p_partkey % 4 AS o,
  ['goodreads','amazon','openlibrary','googlebooks'][p_partkey % 4 + 1] AS src,
  'W' || (p_partkey // 4) || ': base' || CASE WHEN p_partkey % 2 = 1 THEN ' part S' || (p_partkey % 3) ELSE '' END AS title,
  CAST(1900 + (p_partkey // 4) % 100 + CASE WHEN p_partkey % 4 = 3 THEN 1 ELSE 0 END AS INTEGER) AS year,
  CASE WHEN p_partkey % 3 <> 0 THEN p_brand END AS publisher,
  CASE WHEN p_partkey % 5 <> 0 THEN '978' || lpad(CAST(p_partkey // 4 AS VARCHAR), 10, '0') END AS isbn_13, p_size AS page_count FROM part)"""
_PICK = "arg_min({c}, CASE src {w} ELSE 9 END * 10 + o) FILTER (WHERE {c} IS NOT NULL)"


def _pick(c: str, sources: tuple[str, ...]) -> str:
    return _PICK.format(c=c, w=" ".join(f"WHEN '{s}' THEN {i}" for i, s in enumerate(sources)) or "WHEN '' THEN 0")


def reconciled_records(spark: SparkSession, d: str) -> DataFrame:
    merged, _ = reconcile.reconcile(catalogue(spark, d), KIND)
    return merged.select("cluster", "title", "year", "publisher", "isbn_13", "page_count", F.size("sources").cast("long").alias("n_sources"), F.element_at("field_src", "year").alias("year_from"))


def merge_conflicts(spark: SparkSession, d: str) -> DataFrame:
    return reconcile.reconcile(catalogue(spark, d), KIND)[1].select("cluster", "field", "n_values", F.array_join("evidence", ";").alias("evidence"))


def title_match_pairs(spark: SparkSession, d: str) -> DataFrame:
    return reconcile.title_pairs(catalogue(spark, d))


def ranked_books(spark: SparkSession, d: str) -> DataFrame:
    merged, _ = reconcile.reconcile(catalogue(spark, d), KIND)
    return reconcile.ranked(merged.withColumn("cited_by_count", F.col("page_count")), "book", 30).select("cluster", F.size("sources").cast("long").alias("n_sources"), "page_count")


def priority_coalesce(spark: SparkSession, d: str) -> DataFrame:
    """Texts held by several sources: language by the sources' order, in one aggregate."""
    docs = read_table(spark, d, "documents").select(F.md5("text").alias("text_id"), "source", "lang", "doc_id", "n_chars")
    pick = reconcile.by_priority(F.col("n_chars"), F.col("source"), F.col("doc_id"), ("src3", "src1", "src2"))
    return docs.groupBy("text_id").agg(pick.alias("p"), F.countDistinct("source").alias("n_sources")).select("text_id", F.col("p.value").alias("n_chars"), F.col("p.src").alias("chosen_from"), "n_sources")


def longest_title(spark: SparkSession, d: str) -> DataFrame:
    part = read_table(spark, d, "part")
    return part.groupBy("p_brand").agg(F.max_by("p_name", F.struct(F.length("p_name"), -F.col("p_partkey"))).alias("title"))


def identifier_ladder(spark: SparkSession, d: str) -> DataFrame:
    """Customers looked up among every other one of them: by slug, by identifier, by title and author."""
    c = read_table(spark, d, "customer").select("c_custkey", F.lower(F.regexp_replace("c_name", "#", "-")).alias("slug"), F.concat(F.lit("Work "), F.col("c_custkey").cast("string"), F.lit(": On "), F.col("c_mktsegment")).alias("title"), F.array(F.concat(F.lit("Smith"), (F.col("c_custkey") % 7).cast("string"), F.lit(", A."))).alias("authors"), F.concat(F.lit("i"), F.col("c_custkey").cast("string")).alias("isbn"))
    corpus = c.where("c_custkey % 2 = 0").select("slug", F.col("slug").alias("path"), "title", "authors", "isbn")
    k = F.col("c_custkey")
    items = c.select(
        k.alias("rid"),
        F.when(k % 3 == 0, F.col("slug")).otherwise("none").alias("slug"),
        F.when(k % 3 == 1, F.col("isbn")).alias("isbn"),
        F.when(k % 5 == 0, F.element_at(F.split("title", ":"), 1)).otherwise(F.col("title")).alias("title"),
        F.when(k % 11 == 0, F.array(F.lit("B. Jones"))).otherwise(F.array(F.concat(F.lit("A. Smith"), (k % 7).cast("string")))).alias("authors"),
    )
    return resolve.resolve(items, corpus)


def url_owner_ambiguity(spark: SparkSession, d: str) -> DataFrame:
    pages = read_table(spark, d, "pages").select(F.regexp_extract("url", "^[a-z]+://([^/?#]+)", 1).alias("url"), F.concat(F.lit("page-"), F.col("page_id").cast("string")).alias("slug"))
    return resolve.url_owners(pages)


def best_candidate_top1(spark: SparkSession, d: str) -> DataFrame:
    """For parts of small size the best of the large ones of the same brand, by title overlap."""
    part = read_table(spark, d, "part").select(F.col("p_partkey").alias("rid"), F.concat_ws(" ", "p_name", F.lower("p_type")).alias("title"), (F.col("p_size") + 1950).alias("year"), "p_brand", F.when(F.col("p_partkey") % 2 == 0, F.lit("press")).alias("publisher"), F.col("p_partkey").alias("idx"))
    return repair.best_candidates(part.where("year < 1960"), part.where("year >= 1960"), "p_brand").select("rid", F.col("c_idx").alias("candidate"), F.round("overlap", 6).alias("overlap"), "gap")


def fill_only_backfill(spark: SparkSession, d: str) -> DataFrame:
    docs = read_table(spark, d, "documents").select("doc_id", F.when(F.col("doc_id") % 4 != 0, F.col("lang")).alias("lang"), F.when(F.col("doc_id") % 3 != 0, F.col("source")).alias("source"))
    found = read_table(spark, d, "labels").select("doc_id", F.concat(F.lit("q"), F.col("quality").cast("string")).alias("lang"), F.concat(F.lit("t"), F.col("toxic").cast("string")).alias("source"))
    filled, _ = repair.fill_only(docs, found, "doc_id", ["lang", "source"])
    return filled.select("doc_id", "lang", "source", F.array_join("filled", ",").alias("filled"))


def backfill_misses(spark: SparkSession, d: str) -> DataFrame:
    docs = read_table(spark, d, "documents").select("doc_id", F.when(F.col("doc_id") % 4 != 0, F.col("lang")).alias("lang"))
    return repair.fill_only(docs, read_table(spark, d, "labels").select("doc_id", F.lit("en").alias("lang")), "doc_id", ["lang"])[1]


def cache_upsert(spark: SparkSession, d: str) -> DataFrame:
    """Users' last kind and value of event, of January's first half, with the second half's on top."""
    e = read_table(spark, d, "events")
    last = lambda rows: rows.groupBy("user_id").agg(F.max_by("event_type", F.struct("ts", "event_id")).alias("kind"), F.min("ts").alias("lo"), F.max("ts").alias("hi"))
    old = last(e.where("ts < timestamp'2024-01-15'")).select("user_id", "kind", F.col("lo").alias("first_seen"), F.col("hi").alias("last_seen"))
    new = last(e.where("ts >= timestamp'2024-01-15' and user_id % 3 <> 0")).select("user_id", F.when(F.col("kind") != "error", F.col("kind")).otherwise("").alias("kind"), F.col("hi").alias("at"))
    return repair.upsert(old, new, "user_id", ["kind"], "at")


def keep_first_worklist(spark: SparkSession, d: str) -> DataFrame:
    e = read_table(spark, d, "events")
    pick = lambda kind, m: e.where((F.col("event_type") == kind) & (F.col("event_id") % m == 0)).select("user_id").distinct()
    work = worklist.open_work(e.select("user_id", "event_id", "event_type", "ts"), pick("view", 5), pick("error", 40), pick("signup", 40), "user_id", "event_id")
    return work.select("user_id", "event_id", "event_type")


def work_integrity(spark: SparkSession, d: str) -> DataFrame:
    return worklist.integrity(read_table(spark, d, "documents"), read_table(spark, d, "labels").where("quality = 1"), "doc_id")


def referential_orphans(spark: SparkSession, d: str) -> DataFrame:
    return validate.orphans(read_table(spark, d, "documents"), "doc_id", read_table(spark, d, "labels"), "doc_id").select("doc_id", "lang")


def content_words(spark: SparkSession, d: str) -> DataFrame:
    return read_table(spark, d, "part").select("p_partkey", F.array_join(F.array_sort(content_tokens(F.concat_ws(" ", "p_name", F.lit("with the"), "p_type"))), " ").alias("words"))


QUERIES = {
    f.__name__: f
    for f in (
        reconciled_records, merge_conflicts, title_match_pairs, ranked_books, priority_coalesce, longest_title, identifier_ladder, url_owner_ambiguity, best_candidate_top1,
        fill_only_backfill, backfill_misses, cache_upsert, keep_first_worklist, work_integrity, referential_orphans, content_words,
    )
}

ORACLE_SQL = {
    "reconciled_records": f"""WITH {_CAT}
SELECT min(rid) AS cluster, arg_max(title, length(title) * 10 - o) AS title, {_pick('year', ('amazon', 'goodreads'))} AS year, {_pick('publisher', ('openlibrary', 'goodreads', 'amazon'))} AS publisher,
  {_pick('isbn_13', SOURCES)} AS isbn_13, {_pick('page_count', ())} AS page_count, count(*) AS n_sources, arg_min(src, CASE src WHEN 'amazon' THEN 0 WHEN 'goodreads' THEN 1 ELSE 2 + o END) AS year_from FROM cat GROUP BY work""",
    "merge_conflicts": f"""WITH {_CAT}, v AS (SELECT work, o, src, 'year' AS field, CAST(year AS VARCHAR) AS value FROM cat UNION ALL SELECT work, o, src, 'publisher', publisher FROM cat UNION ALL SELECT work, o, src, 'page_count', CAST(page_count AS VARCHAR) FROM cat),
c AS (SELECT work, min(rid) AS cluster FROM cat GROUP BY work)
SELECT cluster, field, count(DISTINCT value) AS n_values, string_agg(src || '=' || value, ';' ORDER BY o) AS evidence FROM v JOIN c USING (work) WHERE value IS NOT NULL GROUP BY cluster, field HAVING count(DISTINCT value) >= 2""",
    "title_match_pairs": f"""WITH {_CAT}, t AS (SELECT rid, year, list_distinct(string_split(trim(regexp_replace(lower(title), '[^a-z0-9_]+', ' ', 'g')), ' ')) AS w FROM cat),
p AS (SELECT x.rid AS a, y.rid AS b, len(list_intersect(x.w, y.w)) AS n, len(x.w) AS na, len(y.w) AS nb FROM t x JOIN t y ON x.rid < y.rid AND abs(x.year - y.year) <= 1)
SELECT a, b FROM p WHERE n = least(na, nb) OR n / (na + nb - n) >= 0.85""",
    "ranked_books": f"""WITH {_CAT}, m AS (SELECT min(rid) AS cluster, count(*) AS n_sources, {_pick('page_count', ())} AS page_count FROM cat GROUP BY work)
SELECT * FROM m ORDER BY n_sources DESC, page_count DESC, cluster LIMIT 30""",
    "priority_coalesce": """WITH d AS (SELECT md5(text) AS text_id, n_chars, source, doc_id, CASE source WHEN 'src3' THEN 0 WHEN 'src1' THEN 1 WHEN 'src2' THEN 2 ELSE 3 END AS r FROM documents),
o AS (SELECT *, row_number() OVER (PARTITION BY text_id ORDER BY r, doc_id) AS n, FROM d)
SELECT text_id, max(n_chars) FILTER (WHERE n = 1) AS n_chars, max(source) FILTER (WHERE n = 1) AS chosen_from, count(DISTINCT source) AS n_sources FROM o GROUP BY text_id""",
    "longest_title": "SELECT p_brand, p_name AS title FROM (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY length(p_name) DESC, p_partkey) AS n FROM part) WHERE n = 1",
    "identifier_ladder": """WITH c AS (SELECT c_custkey AS k, lower(replace(c_name, '#', '-')) AS slug, 'work ' || c_custkey AS stem, 'work ' || c_custkey || ' on ' || lower(c_mktsegment) AS full_, 'smith' || c_custkey % 7 AS who FROM customer)
SELECT k AS rid, CASE WHEN even AND (k % 3 = 0 OR k % 3 = 1 OR k % 11 <> 0) THEN slug END AS slug,
  CASE WHEN NOT even THEN NULL WHEN k % 3 = 0 THEN 'path' WHEN k % 3 = 1 THEN 'identifier' WHEN k % 11 <> 0 THEN 'title' END AS match FROM (SELECT *, k % 2 = 0 AS even FROM c)""",
    "url_owner_ambiguity": """SELECT url, min(slug) AS slug, count(DISTINCT slug) AS n_owners, CASE WHEN count(DISTINCT slug) > 1 THEN 'ambiguous' ELSE 'owned' END AS status
FROM (SELECT regexp_extract(url, '^[a-z]+://([^/?#]+)', 1) AS url, 'page-' || page_id AS slug FROM pages) GROUP BY url""",
    "best_candidate_top1": """WITH p AS (SELECT p_partkey AS k, p_brand, p_size + 1950 AS y, list_distinct(list_filter(string_split(p_name || ' ' || lower(p_type), ' '), lambda w: length(w) > 2)) AS w FROM part),
j AS (SELECT a.k AS rid, b.k AS candidate, len(list_intersect(a.w, b.w)) / least(len(a.w), len(b.w)) AS o, abs(a.y - b.y) AS gap FROM p a JOIN p b ON a.p_brand = b.p_brand AND a.y < 1960 AND b.y >= 1960)
SELECT rid, candidate, round(o, 6) AS overlap, gap FROM (SELECT *, row_number() OVER (PARTITION BY rid ORDER BY o DESC, gap, candidate % 2, candidate) AS n FROM j WHERE o >= 0.55) WHERE n = 1""",
    "fill_only_backfill": """WITH j AS (SELECT d.doc_id, CASE WHEN d.doc_id % 4 <> 0 THEN lang END AS l, CASE WHEN d.doc_id % 3 <> 0 THEN source END AS s, 'q' || quality AS q, 't' || toxic AS t FROM documents d LEFT JOIN labels USING (doc_id))
SELECT doc_id, coalesce(l, q) AS lang, coalesce(s, t) AS source, concat_ws(',', CASE WHEN l IS NULL AND q IS NOT NULL THEN 'lang' END, CASE WHEN s IS NULL AND t IS NOT NULL THEN 'source' END) AS filled FROM j""",
    "backfill_misses": "SELECT doc_id FROM documents WHERE doc_id % 4 = 0 AND doc_id NOT IN (SELECT doc_id FROM labels)",
    "cache_upsert": """WITH l AS (SELECT user_id, ts < TIMESTAMP '2024-01-15' AS old, event_type, min(ts) OVER w AS lo, max(ts) OVER w AS hi, row_number() OVER (PARTITION BY user_id, ts < TIMESTAMP '2024-01-15' ORDER BY ts DESC, event_id DESC) AS n FROM events
  WINDOW w AS (PARTITION BY user_id, ts < TIMESTAMP '2024-01-15')),
o AS (SELECT * FROM l WHERE old AND n = 1), w AS (SELECT * FROM l WHERE NOT old AND n = 1 AND user_id % 3 <> 0)
SELECT coalesce(o.user_id, w.user_id) AS user_id, coalesce(CASE WHEN w.event_type <> 'error' THEN w.event_type END, o.event_type) AS kind, least(o.lo, w.hi) AS first_seen, greatest(o.hi, w.hi) AS last_seen FROM o FULL JOIN w ON o.user_id = w.user_id""",
    "keep_first_worklist": """SELECT user_id, min(event_id) AS event_id, arg_min(event_type, event_id) AS event_type FROM events WHERE user_id IN (SELECT user_id FROM events WHERE event_type = 'view' AND event_id % 5 = 0)
AND user_id NOT IN (SELECT user_id FROM events WHERE event_type = 'error' AND event_id % 40 = 0) AND user_id NOT IN (SELECT user_id FROM events WHERE event_type = 'signup' AND event_id % 40 = 0) GROUP BY user_id""",
    "work_integrity": "SELECT 'left' AS side, doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE quality = 1) UNION ALL SELECT DISTINCT 'right', doc_id FROM labels WHERE quality = 1 AND doc_id NOT IN (SELECT doc_id FROM documents)",
    "referential_orphans": "SELECT doc_id, lang FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)",
    "content_words": "SELECT p_partkey, array_to_string(list_sort(list_distinct(list_filter(string_split(p_name || ' ' || lower(p_type), ' '), lambda w: length(w) > 2))), ' ') AS words FROM part",
}

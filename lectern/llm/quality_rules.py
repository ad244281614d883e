"""Quality rules from cross-document line frequency.

Boilerplate is what many documents of one host repeat word for word. Each normalised line is hashed,
the distinct documents that hold it are counted per host, lines above the host's limit are removed,
and a document of which the removal leaves too little is rejected.

Plan: the counting pass shuffles one 128-bit hash a line, never the text. What is above the limits is
small: a host of d documents with l lines each has at most d * l / (MAX_SHARE * d) such lines. That
table is counted; up to BROADCAST_ROWS keys (some 50 bytes each) it is joined to the documents as one
broadcast row a host, so the text isn't shuffled; beyond it, an equi-join by host and line takes its place.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.llm._tables import keep, once, read_table

#: A line is removed if more distinct documents of its host hold it than both of these allow.
MIN_DOCS = 10
MAX_SHARE = 0.005
#: A document that lost lines is rejected if less than this share of its visible characters is left.
MIN_LEFT = 0.5
BROADCAST_ROWS = 1_000_000


def normal_line(line: Column) -> Column:
    """Lower case, runs of digits as 0, other runs than ASCII letters, digits and letters beyond ASCII as one space."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(line), "[0-9]+", "0"), "[\\x00-\\x2f\\x3a-\\x60\\x7b-\\x7f]+", " "))


def line_key(line: Column) -> Column:
    """Two 64-bit hashes of the normalised line; null for a line without letters and digits."""
    key = lambda n: F.when(n != "", F.struct(F.xxhash64(n).alias("k1"), F.xxhash64(F.lit("b"), n).alias("k2")))
    return F.get(F.transform(F.array(normal_line(line)), key), F.lit(0))  # so that the line is normalised once


def _lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n")


def _keys(text: Column) -> Column:
    """The keys of a text's lines."""
    return F.array_compact(F.transform(_lines(text), line_key))


def frequent_lines(docs: DataFrame) -> DataFrame:
    """(host, key, n_docs) of the lines above their host's limit; a null source is a host of its own, named ''."""
    host = F.coalesce(F.col("source").cast("string"), F.lit("")).alias("host")
    base = docs.select(F.col("doc_id").alias("doc"), host, F.col("text"))
    keys = base.select("doc", "host", F.explode(_keys(F.col("text"))).alias("key"))
    counts = keys.distinct().groupBy("host", "key").agg(F.count("*").alias("n_docs")).where(F.col("n_docs") > MIN_DOCS)
    totals = base.select("host", "doc").distinct().groupBy("host").agg(F.count("*").alias("total"))
    return counts.join(totals, "host").where(F.col("n_docs") > F.col("total") * MAX_SHARE).select("host", "key", "n_docs")


def judge(docs: DataFrame, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """The documents' columns, `text` without its frequent lines, and n_lines, n_removed and kept.

    Lines are split at line feeds. A line of any length counts if it has any letter or digit; a document
    holds it once, however often it repeats there; rows that repeat a doc_id count as one document, and
    rows with a null doc_id as one together. Blank lines are never removed. `kept` is false if lines were removed and less than MIN_LEFT of the
    characters other than white space is left. A null text stays null, an empty one empty, and both
    are kept: there is no frequent line in them. An empty table gives an empty one. Further columns
    pass through, but ones named n_lines, n_removed or kept are replaced.
    """
    docs = docs.drop("n_lines", "n_removed", "kept")
    often = keep(frequent_lines(docs).select("host", "key"), "frequent")
    host = F.coalesce(F.col("source").cast("string"), F.lit(""))
    if often.count() <= broadcast_rows:
        # a line is looked for in one of many small lists, four lines each, not in all of its host's
        sizes = often.groupBy("host").agg(F.ceil(F.count("*") / 4).cast("int").alias("lists"))
        place = lambda key, lists: F.pmod(F.xxhash64(key["k1"]), lists).cast("int")
        filled = often.join(sizes, "host").groupBy("host", place(F.col("key"), F.col("lists")).alias("at")).agg(F.collect_set("key").alias("keys"))
        all_ = sizes.select("host", F.explode(F.sequence(F.lit(0), F.col("lists") - 1)).alias("at")).join(filled, ["host", "at"], "left")
        entry = F.struct("at", F.coalesce("keys", F.array().cast("array<struct<k1:bigint,k2:bigint>>")).alias("keys"))
        by_host = all_.groupBy(F.col("host").alias("_lectern_host")).agg(F.transform(F.array_sort(F.collect_list(entry)), lambda e: e["keys"]).alias("_lectern_often"))
        joined = docs.join(F.broadcast(by_host), host == by_host["_lectern_host"], "left")
        known = lambda key: F.array_contains(F.get("_lectern_often", place(key, F.size("_lectern_often"))), key)
    else:
        base = docs.select(F.col("doc_id").alias("_lectern_doc"), host.alias("host"), F.explode(_keys(F.col("text"))).alias("key"))
        mine = base.distinct().join(often, ["host", "key"]).groupBy("_lectern_doc", F.col("host").alias("_lectern_host")).agg(F.collect_set("key").alias("_lectern_often"))
        joined = docs.join(mine, docs["doc_id"].eqNullSafe(mine["_lectern_doc"]) & (host == mine["_lectern_host"]), "left")
        known = lambda key: F.array_contains("_lectern_often", key)
    lines = _lines(F.col("text"))
    bare = lambda c: F.length(F.regexp_replace(c, "\\s+", ""))
    # lines are normalised once
    keys = F.transform(lines, line_key)
    gone = F.transform("_lectern_keys", lambda k: F.coalesce(known(k), F.lit(False)))
    out = once(joined, "_lectern_keys", F.when(F.col("_lectern_often").isNotNull(), keys))
    out = once(out, "_lectern_gone", gone)
    left = F.filter(lines, lambda x, i: ~F.get("_lectern_gone", i))
    out = once(out, "_lectern_left", F.when(F.array_contains("_lectern_gone", True), left))
    text = F.when(F.col("_lectern_left").isNotNull(), F.array_join("_lectern_left", "\n")).otherwise(F.col("text"))
    n = F.size(lines).cast("long")
    out = out.withColumns({"_lectern_text": text, "n_lines": n, "n_removed": F.coalesce(n - F.size("_lectern_left"), F.lit(0)).cast("long")})
    out = out.withColumn("kept", (F.col("n_removed") == 0) | (bare(F.col("_lectern_text")) >= bare(F.col("text")) * MIN_LEFT))
    return out.select(*[F.col("_lectern_text").alias("text") if c == "text" else F.col(f"`{c}`") for c in docs.columns], "n_lines", "n_removed", "kept")


def quality_filter(docs: DataFrame) -> DataFrame:
    """The documents that pass, with their columns and without their frequent lines; n_chars, where there is one, is brought up to date."""
    out = judge(docs).where("kept").select(*docs.columns)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents kept, their remaining text and how many lines went."""
    out = judge(read_table(spark, sf_dir, "documents"))
    return out.where("kept").select("doc_id", "source", "text", "n_lines", "n_removed")


ORACLE_SQL = f"""
WITH raw AS (SELECT doc_id, source, text, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
l AS (SELECT doc_id, coalesce(source, '') AS host, unnest(lines) AS line, generate_subscripts(lines, 1) AS i FROM raw),
k AS (SELECT *, nullif(trim(regexp_replace(regexp_replace(lower(line), '[0-9]+', '0', 'g'), '[\\x00-\\x2f\\x3a-\\x60\\x7b-\\x7f]+', ' ', 'g')), '') AS key FROM l),
c AS (SELECT host, key, count(DISTINCT doc_id) AS n FROM k WHERE key IS NOT NULL GROUP BY host, key),
t AS (SELECT coalesce(source, '') AS host, count(DISTINCT doc_id) AS total FROM raw GROUP BY 1),
often AS (SELECT host, key FROM c JOIN t USING (host) WHERE n > {MIN_DOCS} AND n > total * {MAX_SHARE}),
j AS (SELECT k.doc_id, k.i, k.line, often.key IS NOT NULL AS gone FROM k LEFT JOIN often ON k.host = often.host AND k.key = often.key),
d AS (SELECT doc_id, coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT gone), '') AS text,
        count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_removed FROM j GROUP BY doc_id)
SELECT d.doc_id, raw.source, d.text, d.n_lines, d.n_removed FROM d JOIN raw USING (doc_id)
WHERE n_removed = 0 OR length(regexp_replace(d.text, '\\s+', '', 'g')) >= {MIN_LEFT} * length(regexp_replace(raw.text, '\\s+', '', 'g'))
"""

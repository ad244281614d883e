"""Queries: rules of catalogues, editions, styles, chapters and topics over the reference tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.functions import identifiers
from lectern.operators import catalogues, reconcile, repair, schemas, transcript, validate
from lectern.sources.tables import read_table


def best_editions(spark: SparkSession, d: str) -> DataFrame:
    """Parts of one size as editions of a work."""
    k = F.col("p_partkey")
    rows = read_table(spark, d, "part").select(
        F.col("p_size").alias("work"), k.alias("idx"), F.when(k % 2 == 1, "978").alias("isbn_13"), F.when(k % 3 == 0, "1").otherwise("").alias("isbn_10"),
        F.when(k % 5 != 0, F.col("p_brand")).alias("publisher"), (k % 4).alias("page_count"), F.when(k % 7 != 0, 1999).otherwise(0).alias("year"),
    )
    return reconcile.best_edition(rows, "work").select("work", "idx", F.col("score").cast("int").alias("score"))


def style_changes(spark: SparkSession, d: str) -> DataFrame:
    """Half-width marks and straight quotes in Chinese, below a header; code is left alone."""
    text = F.concat(F.lit("---\ntype: note\n---\n第一章,"), F.col("p_name"), F.lit('\n`码,码` 他说"你好'), F.col("p_size").cast("string"), F.lit('"。'))
    found = repair.style_diagnostics(read_table(spark, d, "part").select(F.col("p_partkey").alias("path"), text.alias("text")))
    return found.select("path", "id", "line", "column", "before", "after", "before_context", "after_context")


def scraped_catalogues(spark: SparkSession, d: str) -> DataFrame:
    """Parts as what the pages of five catalogues gave."""
    part = read_table(spark, d, "part").withColumn("k", F.col("p_partkey"))
    name, key = F.col("p_name"), F.col("p_partkey").cast("string")
    raws = {
        "goodreads": part.where("k % 5 = 0").select(name.alias("title"), F.array("p_brand").alias("authors"), F.lit(1999).alias("year"), F.col("p_size").alias("page_count"), F.lit(4.5).alias("avg_rating"), key.alias("goodreads_id"), F.lit("u").alias("url")),
        "storygraph": part.where("k % 5 = 1").select(name.alias("title"), F.col("p_brand").alias("translator"), F.array().cast("array<string>").alias("categories"), F.array("p_type").alias("genres"), key.alias("storygraph_id")),
        "amazon": part.where("k % 5 = 2").select(name.alias("title"), F.col("p_brand").alias("publisher"), key.alias("asin"), F.lit(3.5).alias("amazon_rating"), F.lit("9787").alias("isbn_13")),
        "scholar": part.where("k % 5 = 3").select(F.concat(F.lit("[BOOK] [PDF] "), name).alias("title"), F.concat(F.lit("http://x/"), key).alias("url"), F.col("p_type").alias("abstract")),
        "douban_cn": part.where("k % 5 = 4").select(name.alias("title"), F.when(F.col("k") % 2 == 0, "9787100").otherwise("9784100").alias("isbn_13"), F.lit("出版社").alias("publisher"), key.alias("douban_subject_id"), F.lit(8.1).alias("douban_rating")),
    }
    out = None
    for source, raw in raws.items():
        one = catalogues.scraped_books(raw, source)
        out = one if out is None else out.unionByName(one)
    lists = [F.array_join(c, "|").alias(c) for c in ("authors", "translators", "categories")]
    return out.select("source", "source_id", "title", "year", "publisher", "isbn_13", "page_count", "description", "preview_link", "ratings_average", "language", *lists)


def edition_rows(spark: SparkSession, d: str) -> DataFrame:
    """Parts as records of a Chinese catalogue, several rows an id, some not Chinese."""
    k = F.col("p_partkey")
    none = F.lit(None).cast("string")
    books = read_table(spark, d, "part").select(
        F.floor(k / 3).cast("string").alias("source_id"), k.alias("pos"), F.when(k % 4 == 0, F.concat(F.lit("书"), "p_name")).otherwise(F.col("p_name")).alias("title"), F.array(F.lit("作者"), F.lit("")).alias("authors"),
        F.array(F.when(k % 5 == 0, "译者").otherwise("T.")).alias("translators"), F.col("p_brand").alias("publisher"), F.lit(2000).alias("year"), none.alias("isbn_13"), F.lit("x").alias("isbn_10"), F.lit("").alias("original_title"), F.lit(1).alias("ratings_count"), F.lit("").alias("preview_link"),
    )
    return catalogues.edition_candidates(books).select("id", "title", "author", "translator", "isbn")


def search_variants(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("p_partkey")
    title = F.when(k % 4 != 3, F.concat("p_name", F.when(k % 2 == 0, F.concat(F.lit(": "), "p_type")).otherwise(F.lit(""))))
    author, query, isbn = F.when(k % 3 == 0, "Ann  Other"), F.when(k % 8 == 3, F.col("p_brand")), F.lit("978")
    return read_table(spark, d, "part").select("p_partkey", F.array_join(catalogues.query_variants(title, author, query, isbn), "|").alias("variants"))


def chapter_names(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("p_partkey")
    title = (
        F.when(k % 4 == 0, F.concat(F.lit("Chapter "), k.cast("string"), F.lit(": "), F.initcap("p_name"))).when(k % 4 == 1, F.concat(F.lit("第"), k.cast("string"), F.lit("章 导言")))
        .when(k % 4 == 2, F.concat(F.lit("Chapter "), k.cast("string"))).otherwise(F.concat(F.lit("Éric's "), F.col("p_name"), F.lit(" & "), F.repeat(F.lit("long word "), 8)))
    )
    slot = F.lpad((k % 100).cast("string"), 2, "0")
    return read_table(spark, d, "part").select("p_partkey", identifiers.chapter_slug(slot, title).alias("slug"), identifiers.file_name(slot, title).alias("file"))


def transcript_verdicts(spark: SparkSession, d: str) -> DataFrame:
    """Conversations as transcripts: each turn a stamped line, some of silence, some of one line, one turn in a row."""
    c = read_table(spark, d, "conversations")
    k = F.col("conv_id")
    said = F.when(k % 5 == 0, "[BLANK_AUDIO]").when(k % 5 == 1, "字幕由 字幕志愿者 字幕由 字幕志愿者").when(k % 5 == 2, F.col("role")).otherwise(F.regexp_replace("text", "\\s+", " "))
    line = F.concat(F.lit("`[00:"), F.lpad((F.col("turn") % 60).cast("string"), 2, "0"), F.lit("]` "), F.trim(said))
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", line.alias("l")))), lambda x: x["l"]), "\n\n")
    docs = c.groupBy(k.alias("doc")).agg(F.when(F.min(k) % 17 == 3, F.lit("no stamps")).otherwise(body).alias("body"))
    return transcript.transcript_verdicts(docs).select("doc", "state", "reason", "n", "chars", "noise")


def map_disagreements(spark: SparkSession, d: str) -> DataFrame:
    part = read_table(spark, d, "part")
    k = F.col("p_partkey")
    built = part.where("p_partkey % 3 <> 0").select(k.alias("k"), F.when(k % 7 == 0, F.col("p_size") + 1).otherwise(F.col("p_size")).alias("v"))
    return validate.disagreements(part.select(k.alias("k"), F.col("p_size").alias("v")), built)


def cleaned_names(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("c_custkey")
    authors = identifiers.clean_authors(F.array(F.concat(F.lit(' "[[smith|Smith '), F.col("c_mktsegment"), F.lit(']]" ')), F.lit("[[plain]]"), F.lit(" "), F.lit(None).cast("string")))
    raw = F.when(k % 2 == 0, F.concat(F.lit("SMITH "), F.col("c_mktsegment"), F.lit(", **On** [[a|b]] (1999) — 书籍概览"))).otherwise(F.concat(F.lit(" On: "), F.col("c_name"), F.lit("-书概览 ")))
    title = identifiers.clean_title(raw, authors)
    return read_table(spark, d, "customer").select("c_custkey", F.array_join(authors, "|").alias("authors"), title.alias("title"), identifiers.before_colon(title).alias("head"), identifiers.last_name(F.get(authors, F.lit(0))).alias("last"))


def topic_assignments(spark: SparkSession, d: str) -> DataFrame:
    """Lines of orders as members of topics: usable ones once each, their roles, and what new questions assign."""
    li = read_table(spark, d, "lineitem")
    kind = F.when(F.col("l_suppkey") % 2 == 0, "book").otherwise("paper")
    role = F.when(F.col("l_linestatus") == "F", F.when(F.col("l_partkey") % 3 == 0, "theory").otherwise("aside"))
    row = li.select(F.col("l_orderkey").alias("topic"), F.col("l_linenumber").alias("pos"), (F.col("l_partkey") % 2).cast("string").alias("subq"), kind.alias("kind"), (F.col("l_suppkey") % 9).cast("string").alias("slug"), role.alias("role"), (F.col("l_returnflag") != "R").alias("usable"), F.lit("p").alias("path"))
    members, given = catalogues.topic_state(row)
    new = catalogues.assigned(members, row.where("role is not null"))
    total = lambda df, what: df.groupBy("topic").agg(F.count("*").alias("n")).withColumn("what", F.lit(what))
    return total(members, "members").unionByName(total(given, "given")).unionByName(total(new, "new"))


def manifest_faults(spark: SparkSession, d: str) -> DataFrame:
    """Lines of orders as chapters of a manifest: slots told twice, names with a folder, files that are empty or not there, pages out of order."""
    li = read_table(spark, d, "lineitem")
    n, p = F.col("l_linenumber"), F.col("l_partkey")
    rows = li.select(
        F.col("l_orderkey").alias("book"), F.when(p % 11 == 0, "x1").otherwise(F.lpad(n.cast("string"), 2, "0")).alias("slot"), F.concat(F.when(p % 7 == 0, "a/").otherwise(""), n.cast("string"), F.lit(".txt")).alias("filename"),
        F.when(p % 5 == 0, 10).alias("start"), F.when(p % 5 == 0, F.lit(5) + p % 9).when(p % 13 == 0, 3).alias("end"), F.when(p % 6 != 0, p % 4).alias("size"), F.when(p % 3 == 0, "s").alias("sha256"), F.when(p % 9 == 0, "s").otherwise("t").alias("observed_sha256"),
    )
    return schemas.manifest_faults(rows).groupBy("code").agg(F.count("*").alias("n"))


def chapter_lists(spark: SparkSession, d: str) -> DataFrame:
    """Lines of orders as chapters of books, in the order of their numbers, as a report."""
    li = read_table(spark, d, "lineitem").select("l_orderkey", (F.col("l_linenumber") * 4).alias("n"), "l_returnflag").distinct().groupBy("l_orderkey", "n").agg(F.min("l_returnflag").alias("flag"))
    files = li.select(F.concat(F.lit("books/b"), F.col("l_orderkey").cast("string"), F.lit("/ch"), F.col("n").cast("string"), F.lit("-x.md")).alias("path"), F.when(F.col("n") != 4, "chapter").otherwise("book").alias("type"), F.col("flag").alias("title"))
    return schemas.toc_report(schemas.chapter_tocs(files))


QUERIES = {
    f.__name__: f
    for f in (
        best_editions, style_changes, scraped_catalogues, edition_rows, search_variants, chapter_names, transcript_verdicts, map_disagreements, cleaned_names, topic_assignments, manifest_faults, chapter_lists,
    )
}

_FAULTS = """
l AS (SELECT l_orderkey AS book, l_linenumber AS n, l_partkey AS p, CASE WHEN l_partkey % 11 = 0 THEN 'x1' ELSE lpad(CAST(l_linenumber AS VARCHAR), 2, '0') END AS slot,
  CASE WHEN l_partkey % 7 = 0 THEN 'a/' ELSE '' END || l_linenumber || '.txt' AS f FROM lineitem),
w AS (SELECT *, count(*) OVER (PARTITION BY book, slot) AS slots, count(*) OVER (PARTITION BY book, f) AS files FROM l)"""

ORACLE_SQL = {
    "best_editions": """WITH s AS (SELECT p_size AS work, p_partkey AS idx, CAST(CASE WHEN p_partkey % 2 = 1 THEN 20 ELSE 0 END + CASE WHEN p_partkey % 3 = 0 THEN 10 ELSE 0 END + CASE WHEN p_partkey % 5 <> 0 THEN 15 ELSE 0 END
  + CASE WHEN p_partkey % 4 <> 0 THEN 15 ELSE 0 END + CASE WHEN p_partkey % 7 <> 0 THEN 5 ELSE 0 END AS INTEGER) AS score FROM part)
SELECT work, idx, score FROM (SELECT *, row_number() OVER (PARTITION BY work ORDER BY score DESC, idx) AS n FROM s) WHERE n = 1""",
    "style_changes": """WITH p AS (SELECT p_partkey AS path, '第一章,' || p_name AS a, '第一章，' || p_name AS b, '`码,码` 他说"你好' || p_size || '"。' AS c, '`码,码` 他说「你好' || p_size || '」。' AS e, '你好' || p_size AS q FROM part)
SELECT path, 'quote.cjk_ascii_quote' AS id, 5 AS line, 9 AS "column", '"' || q || '"' AS before, '「' || q || '」' AS after, c AS before_context, e AS after_context FROM p
UNION ALL SELECT path, 'punctuation.cjk_halfwidth', 4, 4, ',', '，', a, b FROM p""",
    "scraped_catalogues": """WITH p AS (SELECT *, p_partkey % 5 AS m, CAST(p_partkey AS VARCHAR) AS id FROM part)
SELECT ['goodreads', 'storygraph', 'amazon', 'scholar', 'douban_cn'][m + 1] AS source, CASE WHEN m = 3 THEN 'http://x/' || id ELSE id END AS source_id, p_name AS title, CASE WHEN m = 0 THEN 1999 END AS year,
  CASE m WHEN 2 THEN p_brand WHEN 4 THEN '出版社' ELSE '' END AS publisher, CASE m WHEN 2 THEN '9787' WHEN 4 THEN CASE WHEN p_partkey % 2 = 0 THEN '9787100' ELSE '9784100' END END AS isbn_13, CASE WHEN m = 0 THEN CAST(p_size AS INTEGER) END AS page_count,
  CASE WHEN m = 3 THEN p_type ELSE '' END AS description, CASE m WHEN 0 THEN 'u' WHEN 3 THEN 'http://x/' || id ELSE '' END AS preview_link, CAST(CASE m WHEN 0 THEN 4.5 WHEN 2 THEN 3.5 WHEN 4 THEN 8.1 END AS DOUBLE) AS ratings_average,
  CASE WHEN m = 4 AND p_partkey % 2 = 0 THEN 'zh' END AS language, CASE WHEN m = 0 THEN p_brand ELSE '' END AS authors, CASE WHEN m = 1 THEN p_brand ELSE '' END AS translators, CASE WHEN m = 1 THEN p_type ELSE '' END AS categories FROM p""",
    "edition_rows": """WITH b AS (SELECT p_partkey // 3 AS s, p_partkey AS k, CASE WHEN p_partkey % 4 = 0 THEN '书' ELSE '' END || p_name AS title, CASE WHEN p_partkey % 5 = 0 THEN '译者' ELSE 'T.' END AS translator FROM part WHERE p_partkey % 4 = 0 OR p_partkey % 5 = 0)
SELECT 'douban_cn:' || s AS id, title, '作者' AS author, translator, 'x' AS isbn FROM (SELECT *, row_number() OVER (PARTITION BY s ORDER BY k) AS n FROM b) WHERE n = 1""",
    "search_variants": """WITH p AS (SELECT p_partkey AS k, p_name AS h, p_name || CASE WHEN p_partkey % 2 = 0 THEN ': ' || p_type ELSE '' END AS t, p_brand FROM part)
SELECT k AS p_partkey, CASE WHEN k % 4 <> 3 THEN concat_ws('|', '"' || t || '"', '"' || t || '" 原作名', '"' || t || '" 译者', CASE WHEN k % 2 = 0 THEN '"' || h || '"|"' || h || '" 原作名|"' || h || '" 译者' END,
  CASE WHEN k % 3 = 0 THEN '"' || t || '" "Ann Other"|"' || t || '" Other|' || t || ' Ann Other|"Ann Other"|Ann Other' END)
 WHEN k % 8 = 3 THEN '"' || p_brand || '"|"' || p_brand || '" 原作名|' || p_brand ELSE '978' END AS variants FROM p""",
    "chapter_names": """WITH p AS (SELECT p_partkey AS k, p_partkey % 4 AS m, lpad(CAST(p_partkey % 100 AS VARCHAR), 2, '0') AS slot, p_name, array_to_string(list_transform(string_split(p_name, ' '), lambda w: upper(w[1]) || w[2:]), ' ') AS cap FROM part),
s AS (SELECT *, CASE m WHEN 0 THEN replace(p_name, ' ', '-') WHEN 1 THEN 'section-' || slot WHEN 2 THEN 'chapter-' || k ELSE 'eric-s-' || replace(p_name, ' ', '-') || repeat('-long-word', 8) END AS s,
  CASE m WHEN 0 THEN 'Chapter ' || k || ' ' || cap WHEN 1 THEN '第' || k || '章 导言' WHEN 2 THEN 'Chapter ' || k ELSE 'Érics ' || p_name || '  ' || repeat('long word ', 8) END AS t FROM p)
SELECT k AS p_partkey, CASE WHEN length(s) > 60 THEN regexp_extract(s[1:60], '^(.*)-[^-]*$', 1) ELSE s END AS slug, slot || '_' || regexp_replace(regexp_replace(t[1:50], '\\s+', '_', 'g'), '^_+|_+$', '', 'g') || '.txt' AS file FROM s""",
    "transcript_verdicts": """WITH t AS (SELECT conv_id AS doc, CASE conv_id % 5 WHEN 0 THEN '[BLANK_AUDIO]' WHEN 1 THEN '字幕由 字幕志愿者 字幕由 字幕志愿者' WHEN 2 THEN role ELSE trim(regexp_replace(text, '\\s+', ' ', 'g')) END AS t FROM conversations),
a AS (SELECT doc, count(*) AS n, count(DISTINCT t) / count(*) AS u, CAST(sum(length(t)) AS BIGINT) AS chars, CAST(sum(CASE doc % 5 WHEN 0 THEN 1 WHEN 1 THEN 4 ELSE 0 END) AS BIGINT) AS noise FROM t WHERE doc % 17 <> 3 GROUP BY doc),
r AS (SELECT *, CASE WHEN doc % 5 = 0 AND n >= 3 THEN 'blank_audio' WHEN noise >= 8 THEN 'noise' WHEN n >= 10 AND u < 0.25 THEN 'repetition' WHEN chars < 200 THEN 'too_short' ELSE 'usable' END AS reason FROM a)
SELECT doc, CASE WHEN reason = 'usable' THEN 'live' ELSE 'dead' END AS state, reason, n, chars, noise FROM r UNION ALL SELECT DISTINCT conv_id, 'empty', 'no_cues', 0, 0, 0 FROM conversations WHERE conv_id % 17 = 3""",
    "map_disagreements": "SELECT count(*) AS n FROM part WHERE p_partkey % 3 <> 0 AND p_partkey % 7 = 0 AND p_partkey <> 0",
    "cleaned_names": """SELECT c_custkey, 'Smith ' || c_mktsegment || '|plain' AS authors, CASE WHEN c_custkey % 2 = 0 THEN 'On b' ELSE 'On: ' || c_name END AS title, CASE WHEN c_custkey % 2 = 1 THEN 'On' END AS head, c_mktsegment AS last FROM customer""",
    "topic_assignments": """WITH r AS (SELECT l_orderkey AS topic, CASE WHEN l_suppkey % 2 = 0 THEN 'book' ELSE 'paper' END AS kind, l_suppkey % 9 AS slug, CASE WHEN l_linestatus = 'F' THEN CASE WHEN l_partkey % 3 = 0 THEN 'theory' ELSE 'aside' END END AS role, l_returnflag <> 'R' AS usable FROM lineitem),
m AS (SELECT DISTINCT topic, kind, slug FROM r WHERE usable)
SELECT topic, count(*) AS n, 'members' AS what FROM m GROUP BY topic UNION ALL SELECT topic, count(*), 'given' FROM r WHERE usable AND role IS NOT NULL GROUP BY topic UNION ALL SELECT topic, count(*), 'new' FROM r JOIN m USING (topic, kind, slug) WHERE role = 'theory' GROUP BY topic""",
    "manifest_faults": f"""WITH {_FAULTS}, f AS (SELECT 'slot' AS code FROM w WHERE p % 11 = 0 OR slots > 1 UNION ALL SELECT 'unsafe_filename' FROM w WHERE p % 7 = 0 UNION ALL SELECT 'filename' FROM w WHERE files > 1
UNION ALL SELECT 'chapter_set_incomplete' FROM w WHERE p % 6 = 0 OR p % 4 = 0 UNION ALL SELECT 'chapter_set_mismatch' FROM w WHERE p % 3 = 0 AND p % 9 <> 0
UNION ALL SELECT 'manifest_page_range_invalid' FROM w WHERE (p % 5 = 0 AND 5 + p % 9 < 10) OR (p % 5 <> 0 AND p % 13 = 0)) SELECT code, count(*) AS n FROM f GROUP BY code""",
    "chapter_lists": """WITH l AS (SELECT l_orderkey AS b, l_linenumber * 4 AS n, min(l_returnflag) AS flag FROM lineitem WHERE l_linenumber > 1 GROUP BY 1, 2)
SELECT 'books/b' || b AS book, '## books/b' || b || ' (' || count(*) || ' chapters)' || chr(10) || chr(10) || string_agg('- `ch' || n || '-x.md` — ' || flag, chr(10) ORDER BY n) AS text FROM l GROUP BY b""",
}

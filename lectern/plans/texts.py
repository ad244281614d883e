"""Queries: addresses, HTML, segmentation, transcripts and scalar functions over the reference tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.functions import html, identifiers, text
from lectern.operators import repair, segment, transcript
from lectern.sources.tables import read_table, spread


def isbn13_check_digit(spark: SparkSession, d: str) -> DataFrame:
    body = F.lpad(F.col("p_partkey").cast("string"), 9, "0")
    value = F.when(F.col("p_partkey") % 3 == 0, F.concat(F.substring(body, 1, 1), F.lit("-"), F.substring(body, 2, 8), F.lit("-X"))).when(F.col("p_partkey") % 3 == 1, F.concat(F.lit("978"), body, F.lit("7"))).otherwise(body)
    return read_table(spark, d, "part").select("p_partkey", identifiers.isbn13(value).alias("isbn"))


def doi_normalise(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("doc_id").cast("string")
    raw = F.when(F.col("doc_id") % 4 == 0, F.concat(F.lit(" https://doi.org/10.1000/AB."), k)).when(F.col("doc_id") % 4 == 1, F.concat(F.lit("doi: 10.1000/ab."), k)).when(F.col("doc_id") % 4 == 2, F.concat(F.lit("dx.doi.org/10.1000/Ab."), k)).otherwise("")
    text_ = F.concat(F.lit("see 10.1000/AB."), k, F.lit(", and (10.1000/ab."), k, F.lit(").")) 
    return read_table(spark, d, "documents").select("doc_id", identifiers.doi(raw).alias("doi"), F.array_join(identifiers.dois_in(text_), " ").alias("found"))


def title_norms(spark: SparkSession, d: str) -> DataFrame:
    title = F.concat(F.lit("The "), F.initcap("p_name"), F.when(F.col("p_partkey") % 2 == 0, ": A  Study—of things!").otherwise(""))
    return read_table(spark, d, "part").select("p_partkey", text.normal_title(title).alias("normal"), F.array_join(text.title_keys(title), "|").alias("keys"), F.round(text.jaccard_title(title, F.concat("p_name", F.lit(" study"))), 6).alias("jaccard"), F.round(text.overlap(title, F.concat(F.lit("study of "), F.col("p_type"))), 6).alias("overlap"))


def author_surnames(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("c_custkey")
    names = F.array(F.concat(F.lit("Van Dijk"), (k % 9).cast("string"), F.lit(", José")), F.concat(F.lit("Ana M. O'Neil-"), F.col("c_mktsegment")), F.lit(None).cast("string"))
    return read_table(spark, d, "customer").select("c_custkey", F.array_join(F.array_sort(text.surnames(names)), "|").alias("names"))


def surname_slugs(spark: SparkSession, d: str) -> DataFrame:
    """Whole texts as names, by their digest."""
    docs = read_table(spark, d, "documents")
    return docs.select("doc_id", F.md5(text.surname_slug(F.col("text"))).alias("digest"))


def url_canonical(spark: SparkSession, d: str) -> DataFrame:
    p = read_table(spark, d, "pages")
    k = F.col("page_id")
    raw = F.when(k % 5 == 0, F.regexp_replace("url", "^(https?)://([^/]+)", "HTTP://$2:80")).when(k % 5 == 1, F.replace("url", F.lit("://"), F.lit("://me:pw@"))).when(k % 5 == 2, F.regexp_replace("url", "^https?", "ftp")).otherwise(F.col("url"))
    u = identifiers.web_url(raw)
    return p.select("page_id", u.alias("url"), identifiers.collision_slug(F.concat(F.lit("page-"), k.cast("string")), u).alias("slug"))


def html_text_stats(spark: SparkSession, d: str) -> DataFrame:
    t = html.html_text(F.col("html"))
    return read_table(spark, d, "pages").select("page_id", F.length(t).cast("long").alias("chars"), F.size(F.split(t, "\n")).cast("long").alias("lines"), F.md5(t).alias("digest"))


def html_title_site(spark: SparkSession, d: str) -> DataFrame:
    return read_table(spark, d, "pages").select("page_id", html.html_title(F.col("html")).alias("title"), html.html_site(F.col("html"), F.col("url")).alias("site"))


def script_ratio(spark: SparkSession, d: str) -> DataFrame:
    t = F.col("text")
    return read_table(spark, d, "documents").groupBy("lang").agg(F.sum(text.latin_letters(t)).alias("latin"), F.sum(text.han_letters(t)).alias("han"), F.sum(text.cjk_dominant(t).cast("int")).alias("dominant"), F.sum(F.length(t)).alias("chars"))


def year_signals(spark: SparkSession, d: str) -> DataFrame:
    o = read_table(spark, d, "orders")
    k, y = F.col("o_orderkey"), F.year("o_orderdate")
    s = lambda c: c.cast("string")
    page = F.when(k % 4 == 0, F.concat(F.lit("First published in "), s(y), F.lit(". Copyright 1990."))).when(k % 4 == 1, F.concat(F.lit("Copyright "), s(y), F.lit(" A. B. Printed "), s(y + k % 4))).when(k % 4 == 2, F.concat(F.lit("Printed "), s(y), F.lit(", again "), s(y - 7))).otherwise("no date")
    g = text.year_signals(page)
    return o.select("o_orderkey", g["first_published"].alias("first_published"), g["copyright_year"].alias("copyright_year"), F.array_join(F.transform(g["other_years"], s), " ").alias("years"), g["best_guess"].alias("best_guess"))


def abstract_from_positions(spark: SparkSession, d: str) -> DataFrame:
    """Documents' words by their positions, and back to the words in a row; words are parted by the white space that RE2 knows."""
    docs = read_table(spark, d, "documents")
    words = docs.select("doc_id", F.filter(F.split("text", "[\\t\\n\\f\\r ]+"), lambda w: w != "").alias("words"))
    index = text.word_positions(words.where("words is not null"), "doc_id", "words")
    told = index.select("doc_id", F.md5(text.inverted_index_text(F.col("index"))).alias("digest"))
    return told.unionByName(docs.where("text is null").select("doc_id", F.lit(None).cast("string").alias("digest")))


def redacted_text(spark: SparkSession, d: str) -> DataFrame:
    t = F.concat(F.lit("token="), F.md5("url"), F.lit(" at https://me:pw@"), F.regexp_replace("url", "^[a-z]+://", ""), F.lit(", then http://EX.org/a?b=1#c. Cookie: abc; end"))
    return read_table(spark, d, "pages").select("page_id", identifiers.redact(t).alias("text"))


def clean_publishers(spark: SparkSession, d: str) -> DataFrame:
    k, brand = F.col("p_partkey"), F.col("p_brand")
    raw = (
        F.when(k % 8 == 0, F.concat(brand, F.lit(" is an imprint of a Group"))).when(k % 8 == 1, F.concat(F.lit("Berkeley : "), brand)).when(k % 8 == 2, F.concat(F.lit("1999"), brand, F.lit("; Other")))
        .when(k % 8 == 3, F.concat(F.lit("This "), brand, F.lit(" Imprint Is Published By Others"))).when(k % 8 == 4, F.concat(brand, F.lit(" ,  Sons, United Kingdom, 2018")))
        .when(k % 8 == 5, F.concat(brand, F.lit(", "), F.repeat(F.lit("very long "), 9))).when(k % 8 == 6, "New York")
    )
    names = F.array(F.lit(" "), F.concat(brand, F.lit(" Group of Things")), F.concat(brand, F.lit(" University Press")), F.concat(brand, F.lit(" Books")))
    return read_table(spark, d, "part").select(
        "p_partkey", repair.clean_publisher(raw).alias("publisher"), repair.is_garbage_publisher(raw).alias("garbage"), repair.pick_publisher(names).alias("picked"), repair.normal_publisher(F.concat(F.lit("London ; X: "), F.concat_ws(", ", names))).alias("normal")
    )


def language_tags(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("doc_id")
    raw = F.when(k % 4 == 0, "ZH-cn").when(k % 4 == 1, F.concat(F.upper("lang"), F.lit("-Latn-us"))).when(k % 4 == 2, F.concat("lang", F.lit("_x"))).otherwise(F.col("lang"))
    return read_table(spark, d, "documents").select("doc_id", identifiers.language_tag(raw).alias("tag"))


def pair_ratio_median(spark: SparkSession, d: str) -> DataFrame:
    return transcript.coverage(_ratios(spark, d))


def weakest_k(spark: SparkSession, d: str) -> DataFrame:
    return transcript.weakest(_ratios(spark, d), 2)


def _ratios(spark: SparkSession, d: str) -> DataFrame:
    """Conversations as translations: each even turn answers the one before."""
    c = read_table(spark, d, "conversations").select(F.col("conv_id").alias("doc"), (F.col("turn") + 1).alias("page"), "text")
    return transcript.page_ratios(c, target=F.length(F.regexp_replace("text", "[^aeiou]", "")))


def transcript_state(spark: SparkSession, d: str) -> DataFrame:
    c = read_table(spark, d, "conversations")
    k = F.col("conv_id")
    t = F.when(k % 5 == 0, "[BLANK_AUDIO]").when(k % 5 == 1, "Thanks for watching Thanks for watching Thanks for watching").when(k % 5 == 2, F.col("role")).otherwise(F.col("text"))
    return transcript.transcript_states(c.select(k.alias("doc"), t.alias("text"))).select("doc", "n", F.round("uniq", 6).alias("uniq"), "chars", F.col("noise").cast("long").alias("noise"), "state")


def segment_boundaries(spark: SparkSession, d: str) -> DataFrame:
    lines = read_table(spark, d, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    return segment.islands(lines, "doc_id", "pos", F.col("line").rlike("^[A-E]")).groupBy("doc_id", "part").agg(F.count("*").alias("lines"), F.min("pos").alias("start"))


def slot_assignment(spark: SparkSession, d: str) -> DataFrame:
    """Orders' lines as tables of contents: some lines are numbered chapters."""
    li = read_table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    li = spread(li, li.count(), "l_orderkey").withColumn("pos", F.row_number().over(_by_order()))
    n = F.row_number().over(_by_order())
    title = F.when(F.col("l_partkey") % 3 != 0, F.concat((n % 40).cast("string"), F.lit(". Part"))).otherwise("Interlude")
    toc = li.select(F.col("l_orderkey").alias("book"), "pos", title.alias("title"))
    return segment.assign_slots(toc).select("book", "pos", "slot")


def _by_order():
    from pyspark.sql import Window

    return Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey")


def toc_end_pages(spark: SparkSession, d: str) -> DataFrame:
    li = read_table(spark, d, "lineitem").select(F.col("l_orderkey").alias("book"), (F.col("l_linenumber") * 10 + F.col("l_partkey") % 7).alias("start"), F.col("l_suppkey").alias("pos"), F.lit(200).cast("long").alias("n_pages"))
    return segment.page_ends(li.distinct()).select("book", "start", "end", "pos")


def block_kinds(spark: SparkSession, d: str) -> DataFrame:
    lines = read_table(spark, d, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    marked = F.when(F.col("pos") % 4 == 0, F.concat(F.lit("- "), "line")).when(F.col("pos") % 4 == 1, F.concat(F.lit("12. "), "line")).when((F.col("pos") % 4 == 2) & (F.col("doc_id") % 2 == 0), F.concat(F.lit("> "), "line")).otherwise(F.col("line"))
    return lines.select(segment.block_kind(marked).alias("kind"), "doc_id").groupBy("kind").agg(F.count("*").alias("n"), F.countDistinct("doc_id").alias("docs"))


def year_values(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("o_orderkey")
    raw = F.when(k % 3 == 0, F.concat(F.lit(" "), (k % 900 + 1300).cast("string"))).when(k % 3 == 1, "199x").otherwise((k % 3000).cast("string"))
    return read_table(spark, d, "orders").select("o_orderkey", text.year_in(raw).alias("year"), text.stars(F.repeat(F.lit("★"), (k % 7).cast("int"))).cast("int").alias("stars"))


QUERIES = {
    f.__name__: f
    for f in (
        isbn13_check_digit, doi_normalise, title_norms, author_surnames, surname_slugs, url_canonical, html_text_stats, html_title_site, script_ratio, year_signals, abstract_from_positions, redacted_text,
        clean_publishers, language_tags, pair_ratio_median, weakest_k, transcript_state, segment_boundaries, slot_assignment, toc_end_pages, block_kinds, year_values,
    )
}

_SUM = " + ".join(f"CAST(b[{i}] AS INTEGER) * {1 if i % 2 else 3}" for i in range(1, 13))
_U = "^([A-Za-z][A-Za-z0-9+.-]*)://([^/?#]*)([^?#]*)(\\?[^#]*)?"
_RATIOS = """
p AS (SELECT conv_id AS doc, turn // 2 AS pair, turn % 2 AS odd, length(regexp_replace(text, '[^A-Za-z]', '', 'g')) AS s, length(regexp_replace(text, '[^aeiou]', '', 'g')) AS t FROM conversations),
r AS (SELECT doc, pair, max(CASE WHEN odd = 1 THEN t END) / max(CASE WHEN odd = 0 THEN s END) AS ratio FROM p GROUP BY doc, pair HAVING max(CASE WHEN odd = 0 THEN s END) >= 200 AND max(CASE WHEN odd = 1 THEN t END) IS NOT NULL)"""
_ENT = [("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "''"), ("&apos;", "''"), ("&mdash;", "—"), ("&ndash;", "–"), ("&hellip;", "…"), ("&amp;", "&")]


def _unescaped(sql: str) -> str:
    for a, b in _ENT:
        sql = f"replace({sql}, '{a}', '{b}')"
    return sql


_H1 = "regexp_replace(regexp_replace(regexp_replace(html, '(?is)<script\\b.*?</script\\s*>', ' ', 'g'), '(?is)<style\\b.*?</style\\s*>', ' ', 'g'), '(?is)<noscript\\b.*?</noscript\\s*>', ' ', 'g')"
_H2 = f"regexp_replace(regexp_replace({_H1}, '(?s)<!--.*?-->', ' ', 'g'), '(?i)<(?:br|/p|/div|/li|/h[1-6]|/tr|/title)\\b[^>]*>', chr(10), 'g')"
_H3 = "regexp_replace(regexp_replace(" + "regexp_replace(" + _unescaped(f"regexp_replace({_H2}, '(?s)<[^>]*>', ' ', 'g')") + ", '[ \\t\\r\\x{A0}]+', ' ', 'g'), ' *\\n[ \\n]*', chr(10), 'g'), '^[ \\n]+|[ \\n]+$', '', 'g')"

ORACLE_SQL = {
    "isbn13_check_digit": f"""WITH p AS (SELECT p_partkey AS k, lpad(CAST(p_partkey AS VARCHAR), 9, '0') AS n, '978' || lpad(CAST(p_partkey AS VARCHAR), 9, '0') AS b FROM part)
SELECT k AS p_partkey, CASE k % 3 WHEN 0 THEN b || ((10 - ({_SUM}) % 10) % 10) WHEN 1 THEN b || '7' END AS isbn FROM p""",
    "doi_normalise": "SELECT doc_id, CASE WHEN doc_id % 4 < 3 THEN '10.1000/ab.' || doc_id END AS doi, '10.1000/ab.' || doc_id AS found FROM documents",
    "title_norms": """WITH p AS (SELECT p_partkey AS k, p_name, lower(p_type) AS t, p_partkey % 2 = 0 AS e FROM part),
q AS (SELECT *, 'the ' || p_name || CASE WHEN e THEN ' a study of things' ELSE '' END AS normal FROM p), w AS (SELECT *, string_split(normal, ' ') AS a, list_append(string_split(p_name, ' '), 'study') AS b FROM q),
j AS (SELECT *, len(list_intersect(list_distinct(a), list_distinct(b))) AS n, len(list_distinct(a)) AS na, len(list_distinct(b)) AS nb FROM w)
SELECT k AS p_partkey, normal, CASE WHEN e THEN normal[5:] || '|' || p_name ELSE p_name END AS keys, round(CASE WHEN n = least(na, nb) THEN 1.0 ELSE n / (na + nb - n) END, 6) AS jaccard,
  round((CASE WHEN e THEN 1 ELSE 0 END + CASE WHEN list_contains(string_split(p_name, ' '), t) THEN 1 ELSE 0 END) / 2, 6) AS overlap FROM j""",
    "author_surnames": "SELECT c_custkey, array_to_string(list_sort(['dijk' || c_custkey % 9, lower(c_mktsegment)]), '|') AS names FROM customer",
    "surname_slugs": """SELECT doc_id, md5(lower(regexp_replace(regexp_replace(regexp_replace(strip_accents(regexp_replace(text, '^\\s+|\\s+$', '', 'g')), '[''’`]', '', 'g'), '\\s+', '-', 'g'), '[^a-zA-Z0-9-]', '', 'g'))) AS digest FROM documents""",
    "url_canonical": f"""WITH r AS (SELECT page_id AS k, regexp_extract(url, '{_U}', 1) AS s, regexp_extract(url, '{_U}', 2) AS h, regexp_extract(url, '{_U}', 3) AS p, regexp_extract(url, '{_U}', 4) AS q FROM pages),
u AS (SELECT k, CASE WHEN k % 5 IN (1, 2) THEN NULL ELSE CASE WHEN k % 5 = 0 THEN 'http' ELSE s END || '://' || lower(h) || CASE WHEN p = '' THEN '/' ELSE p END || CASE WHEN q = '?' THEN '' ELSE q END END AS url FROM r)
SELECT k AS page_id, url, 'page-' || k || '-' || sha256(url)[1:8] AS slug FROM u""",
    "html_text_stats": f"WITH t AS (SELECT page_id, {_H3} AS t FROM pages) SELECT page_id, length(t) AS chars, len(string_split(t, chr(10))) AS lines, md5(t) AS digest FROM t",
    "html_title_site": "SELECT page_id, nullif(trim(regexp_replace(" + _unescaped("regexp_extract(html, '(?is)<title[^>]*>(.*?)</title', 1)") + ", '\\s+', ' ', 'g')), '') AS title, coalesce(nullif(regexp_extract(html, '(?is)<meta\\s[^>]*property=[\"'']og:site_name[\"''][^>]*content=[\"'']([^\"'']*)', 1), ''), lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#:]*)', 1))) AS site FROM pages",
    "script_ratio": "SELECT lang, CAST(sum(length(regexp_replace(text, '[^A-Za-z]', '', 'g'))) AS BIGINT) AS latin, CAST(sum(length(regexp_replace(text, '[^\\x{4E00}-\\x{9FFF}]', '', 'g'))) AS BIGINT) AS han, CAST(0 AS BIGINT) AS dominant, CAST(sum(length(text)) AS BIGINT) AS chars FROM documents GROUP BY lang",
    "year_signals": """WITH o AS (SELECT o_orderkey AS k, CAST(year(o_orderdate) AS INTEGER) AS y FROM orders)
SELECT k AS o_orderkey, CASE WHEN k % 4 = 0 THEN y END AS first_published, CASE WHEN k % 4 = 0 THEN 1990 WHEN k % 4 = 1 THEN y END AS copyright_year,
 CASE k % 4 WHEN 0 THEN CASE WHEN y = 1990 THEN '1990' ELSE y || ' 1990' END WHEN 1 THEN y || ' ' || (y + 1) WHEN 2 THEN y || ' ' || (y - 7) ELSE '' END AS years, CASE k % 4 WHEN 0 THEN y WHEN 1 THEN y + 1 WHEN 2 THEN y END AS best_guess FROM o""",
    "abstract_from_positions": "SELECT doc_id, md5(array_to_string(list_filter(regexp_split_to_array(text, '\\s+'), lambda w: w <> ''), ' ')) AS digest FROM documents",
    "redacted_text": "SELECT page_id, 'token=<redacted> at https://' || lower(regexp_extract(regexp_replace(url, '^[a-z]+://', ''), '^[^/?#]*')) || regexp_extract(regexp_replace(url, '^[a-z]+://', ''), '^[^/?#]*([^?#]*)', 1) || '?<redacted>, then http://ex.org/a?<redacted>. Cookie: <redacted>; end' AS text FROM pages",
    "clean_publishers": """SELECT p_partkey, CASE p_partkey % 8 WHEN 4 THEN p_brand || ', Sons' WHEN 6 THEN 'New York' WHEN 7 THEN NULL ELSE p_brand END AS publisher,
  CASE p_partkey % 8 WHEN 6 THEN 'city-only' WHEN 7 THEN 'empty' END AS garbage, p_brand || ' Books' AS picked, p_brand || ' Books' AS normal FROM part""",
    "language_tags": "SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'zh' WHEN 1 THEN lang || '-latn-US' WHEN 3 THEN lang END AS tag FROM documents",
    "pair_ratio_median": f"WITH {_RATIOS}, a AS (SELECT doc, count(*) AS pages, median(ratio) AS median FROM r GROUP BY doc) SELECT *, CASE WHEN pages < 3 THEN 'abstain' WHEN median >= 0.22 THEN 'pass' ELSE 'fail' END AS verdict FROM a",
    "weakest_k": f"WITH {_RATIOS} SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY doc ORDER BY ratio, pair) AS INTEGER) AS rank FROM r) WHERE rank <= 2",
    "transcript_state": """WITH t AS (SELECT conv_id AS doc, CASE conv_id % 5 WHEN 0 THEN '[BLANK_AUDIO]' WHEN 1 THEN 'Thanks for watching Thanks for watching Thanks for watching' WHEN 2 THEN role ELSE text END AS t FROM conversations),
a AS (SELECT doc, count(*) AS n, count(DISTINCT t) / count(*) AS u, CAST(sum(length(t)) AS BIGINT) AS chars, CAST(sum(CASE doc % 5 WHEN 0 THEN 1 WHEN 1 THEN 3 ELSE 0 END) AS BIGINT) AS noise FROM t GROUP BY doc)
SELECT doc, n, round(u, 6) AS uniq, chars, noise, CASE WHEN (doc % 5 = 0 AND n >= 3) OR noise >= 8 OR (n >= 10 AND u < 0.25) OR chars < 200 THEN 'dead' ELSE 'live' END AS state FROM a""",
    "segment_boundaries": """WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS pos FROM documents),
s AS (SELECT doc_id, pos, CAST(sum(CASE WHEN regexp_matches(line, '^[A-E]') THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY pos) AS BIGINT) AS part FROM l) SELECT doc_id, part, count(*) AS lines, CAST(min(pos) AS INTEGER) AS start FROM s GROUP BY 1, 2""",
    "slot_assignment": """WITH t AS (SELECT l_orderkey AS book, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS pos, l_partkey % 3 <> 0 AS num FROM lineitem),
w AS (SELECT *, count(*) FILTER (WHERE num) OVER b AS many, min(pos) FILTER (WHERE num) OVER b AS f, max(pos) FILTER (WHERE num) OVER b AS l, max(CASE WHEN num THEN pos END) OVER (PARTITION BY book ORDER BY pos) AS cur FROM t WINDOW b AS (PARTITION BY book))
SELECT book, CAST(pos AS INTEGER) AS pos, CASE WHEN many < 2 THEN lpad(CAST(pos AS VARCHAR), 2, '0') WHEN num THEN lpad(CAST(pos % 40 AS VARCHAR), 2, '0') WHEN pos < f THEN '00' || chr(CAST(96 + pos AS INTEGER))
 WHEN pos > l THEN '99' || chr(CAST(96 + pos - l AS INTEGER)) ELSE lpad(CAST(cur % 40 AS VARCHAR), 2, '0') || chr(CAST(97 + pos - cur AS INTEGER)) END AS slot FROM w""",
    "toc_end_pages": """WITH l AS (SELECT DISTINCT l_orderkey AS book, CAST(l_linenumber * 10 + l_partkey % 7 AS BIGINT) AS start, l_suppkey AS pos FROM lineitem)
SELECT book, start, greatest(start, coalesce(lead(start) OVER (PARTITION BY book ORDER BY start, pos) - 1, 200)) AS "end", pos FROM l""",
    "block_kinds": """WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS pos FROM documents),
k AS (SELECT doc_id, CASE pos % 4 WHEN 0 THEN 'bullet-list' WHEN 1 THEN 'numbered-list' WHEN 2 THEN CASE WHEN doc_id % 2 = 0 THEN 'blockquote-list' END END AS k, line FROM l)
SELECT coalesce(k, CASE WHEN regexp_matches(line, '^[-*]\\s+') THEN 'bullet-list' WHEN regexp_matches(line, '^[0-9]+\\.\\s+') THEN 'numbered-list' WHEN regexp_matches(line, '^\\|.*\\|$') THEN 'table' WHEN line LIKE '>%' THEN 'blockquote-list' ELSE 'paragraph' END) AS kind, count(*) AS n, count(DISTINCT doc_id) AS docs FROM k GROUP BY 1""",
    "year_values": """WITH o AS (SELECT o_orderkey AS k, CASE o_orderkey % 3 WHEN 0 THEN o_orderkey % 900 + 1300 WHEN 2 THEN o_orderkey % 3000 END AS y FROM orders)
SELECT k AS o_orderkey, CAST(CASE WHEN y BETWEEN 1500 AND 2030 THEN y END AS INTEGER) AS year, CAST(CASE WHEN k % 7 BETWEEN 1 AND 5 THEN k % 7 END AS INTEGER) AS stars FROM o""",
}

"""Queries: citations extracted, looked up and rendered, over drafts derived from orders and customers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.functions.identifiers import author_prefixes
from lectern.operators import citations
from lectern.sources.tables import read_table

NAMES = ("ahmed", "bennett", "costanza", "fujimura", "haraway", "latour", "mcruer", "stengers")


def _name(k: Column) -> Column:
    return F.element_at(F.array(*[F.lit(n) for n in NAMES]), (k % 8 + 1).cast("int"))


def drafts(spark: SparkSession, d: str) -> DataFrame:
    """A draft an order, its customer and date cited: one or two works in a parenthesis, some with a second author, a letter after the year, or no author."""
    o = read_table(spark, d, "orders")
    k, y = F.col("o_custkey"), F.year("o_orderdate").cast("string")
    one = F.concat(F.initcap(_name(k)), F.when(k % 5 == 0, " & Barad").when(k % 5 == 1, " et al.").otherwise(""), F.lit(", "), y, F.when(k % 7 == 0, "a").otherwise(""))
    two = F.concat(F.initcap(_name(k + 3)), F.lit(" "), y)
    body = F.when(k % 3 == 0, F.concat(one, F.lit("; "), two)).when(k % 11 == 1, F.lit("2010, p. 3")).otherwise(one)
    return o.select(F.col("o_orderkey").alias("file"), F.concat(F.lit("As shown (see "), body, F.lit("), and again ("), two, F.lit(") in full.")).alias("text"))


def citation_mentions(spark: SparkSession, d: str) -> DataFrame:
    return citations.mentions(drafts(spark, d)).select("file", F.col("at").cast("long").alias("nth"), "key", "authors_raw", F.col("author.et_al").alias("et_al"))


def citation_extract(spark: SparkSession, d: str) -> DataFrame:
    return citations.citations(drafts(spark, d)).select("key", "authors_raw", "year", "n_mentions", "n_files")


def _biblio(spark: SparkSession, d: str) -> DataFrame:
    """Works: an author and a year each, some authors misspelt."""
    k = F.col("s_suppkey")
    name = _name(k)
    typo = F.when(k % 4 == 0, F.concat(F.substring(name, 1, 3), F.lit("x"), F.expr("substring(" + "n" + ", 5)"))).otherwise(F.col("n"))
    return read_table(spark, d, "supplier").withColumn("n", name).select(F.concat(typo, F.lit("-work"), k.cast("string"), F.lit("-"), (F.lit(1990) + k % 12).cast("string")).alias("slug"), F.lit("").alias("author_slug"))


def author_prefix_index(spark: SparkSession, d: str) -> DataFrame:
    part = read_table(spark, d, "part").select(F.concat(F.replace("p_name", F.lit(" "), F.lit("-")), F.lit("-"), F.lower("p_type")).alias("body"), "p_partkey")
    return part.select("p_partkey", F.explode(author_prefixes(F.col("body"))).alias("author"))


def _asked(spark: SparkSession, d: str) -> DataFrame:
    c = read_table(spark, d, "customer")
    k = F.col("c_custkey")
    base = _name(k)
    author = F.when(k % 6 == 1, F.concat(base, F.lit("q"))).when(k % 6 == 2, F.lit("nobody")).otherwise(base)
    return c.select(F.concat(F.lit("c"), k.cast("string")).alias("key"), author.alias("author"), (F.lit(1985) + k % 25).cast("int").alias("year"), F.lit(False).alias("is_cjk"))


def citation_tiers(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of works and citations that stand for those of the same author and year, and which those are."""
    return citations.tiers_by_class(_asked(spark, d), citations.author_index(_biblio(spark, d)))


def bib_outcomes(spark: SparkSession, d: str) -> DataFrame:
    states = citations.statuses_by_class(_asked(spark, d), citations.author_index(_biblio(spark, d)))
    n = F.substring("key", 2, 20).cast("int")
    decisions = states.where(n % 9 == 0).select("key", F.when(n % 2 == 0, "work:x").otherwise("new:x").alias("decision"))
    return citations.outcomes(states, decisions).groupBy("outcome").agg(F.count("*").alias("n"))


def citation_coverage_misses(spark: SparkSession, d: str) -> DataFrame:
    li = read_table(spark, d, "lineitem").select(F.col("l_orderkey").alias("file"), (F.col("l_linenumber") * 10).alias("lo"), (F.col("l_linenumber") * 10 + F.col("l_quantity").cast("int") % 9).alias("hi"), "l_linestatus")
    return citations.uncovered(li.where("l_linestatus = 'O'").drop("l_linestatus"), li.where("l_linestatus = 'F'").select("file", (F.col("lo") - 9).alias("lo"), (F.col("lo") - 8).alias("hi")))


def bibtex_entries(spark: SparkSession, d: str) -> DataFrame:
    p = read_table(spark, d, "part")
    return citations.bibtex(p.select(F.col("p_partkey").alias("key"), F.when(F.col("p_size") % 2 == 0, "paper").otherwise("book").alias("kind"), F.concat("p_name", F.lit(" & {co}")).alias("title"), F.col("p_brand").alias("author"), (F.col("p_size") + 1950).alias("year"), F.col("p_type").alias("publisher")))


def entry_lint(spark: SparkSession, d: str) -> DataFrame:
    """Customers as entries of books and papers."""
    k = F.col("c_custkey")
    base = F.lower("c_mktsegment")
    c = read_table(spark, d, "customer").select(
        F.concat(base, F.lit("-work-"), k.cast("string"), F.lit("-"), (F.lit(1980) + k % 30).cast("string")).alias("slug"),
        F.when(k % 2 == 0, "book").otherwise("paper").alias("kind"),
        F.when(k % 8 == 0, F.lit("Title (1999)")).when(k % 8 == 1, F.lit("")).when(k % 8 == 2, "Told By two").otherwise("Title").alias("title"),
        F.when(k % 9 == 0, F.lit("")).when(k % 3 == 0, F.lit("[[other|Ann Other]]")).when(k % 3 == 1, F.lit("[[two-words|Ann]]")).otherwise(F.concat(F.lit("[["), base, F.lit("]]"))).alias("author"),
        F.when(k % 9 == 0, F.array(F.when(k % 2 == 0, "Some Body").otherwise(""))).alias("authors"),
        (F.lit(1980) + k % 30 + F.when(k % 4 == 0, 1).otherwise(0)).cast("int").alias("year"),
        F.when(k % 5 != 0, F.lit("Press")).alias("publisher"),
        F.lit("978").alias("isbn"),
        F.when(k % 7 != 0, F.lit("10.1/x")).alias("doi"),
    )
    return citations.entry_lint(c)


def _loose_drafts(spark: SparkSession, d: str) -> DataFrame:
    """Drafts with a citation, a parenthesis that the pattern for citations can't read, one without a name, and one over two lines."""
    k = F.col("o_orderkey")
    loose = F.when(k % 3 == 0, "(work of 1987 and later)").when(k % 3 == 1, "(12 of 1987)").otherwise("(in the year,1987)")
    return read_table(spark, d, "orders").select(k.alias("file"), F.concat(F.lit("As told (Ahmed, 2010).\n\nThen "), loose, F.lit(" came\n(x"), F.when(k % 2 == 0, "yz").otherwise(""), F.lit(" 1999)")).alias("text"))


def loose_citations(spark: SparkSession, d: str) -> DataFrame:
    return citations.loose_spans(_loose_drafts(spark, d))


def citation_lines(spark: SparkSession, d: str) -> DataFrame:
    return citations.citation_spans(_loose_drafts(spark, d)).groupBy("line", "raw", "context").agg(F.count("*").alias("n"))


QUERIES = {f.__name__: f for f in (citation_mentions, citation_extract, author_prefix_index, citation_tiers, bib_outcomes, citation_coverage_misses, bibtex_entries, entry_lint, loose_citations, citation_lines)}

_L = "['" + "','".join(NAMES) + "']"
_CAP = "(upper({0}[1]) || {0}[2:])"
_M = f"""
o AS (SELECT o_orderkey AS file, o_custkey AS k, year(o_orderdate) AS y, {_L}[o_custkey % 8 + 1] AS n1, {_L}[(o_custkey + 3) % 8 + 1] AS n2 FROM orders),
m AS (SELECT file, 0 AS nth, n1 || '-' || y || CASE WHEN k % 7 = 0 THEN 'a' ELSE '' END AS key, {_CAP.format('n1')} || CASE k % 5 WHEN 0 THEN ' & Barad' WHEN 1 THEN ' et al.' ELSE '' END AS authors_raw, k % 5 = 1 AS et_al, y FROM o WHERE k % 3 = 0 OR k % 11 <> 1
UNION ALL SELECT file, 1, n2 || '-' || y, {_CAP.format('n2')}, false, y FROM o WHERE k % 3 = 0
UNION ALL SELECT file, CASE WHEN k % 3 = 0 THEN 2 WHEN k % 11 <> 1 THEN 1 ELSE 0 END, n2 || '-' || y, {_CAP.format('n2')}, false, y FROM o)"""
_T = f"""
b AS (SELECT s_suppkey AS k, {_L}[s_suppkey % 8 + 1] AS n, 1990 + s_suppkey % 12 AS y FROM supplier),
w AS (SELECT CASE WHEN k % 4 = 0 THEN n[1:3] || 'x' || n[5:] ELSE n END AS author, 'work' || k AS w, y FROM b),
i AS (SELECT author || '-' || w || '-' || y AS slug, y, author FROM w UNION ALL SELECT author || '-' || w || '-' || y, y, author || '-' || w FROM w),
a AS (SELECT 'c' || c_custkey AS key, CASE c_custkey % 6 WHEN 1 THEN {_L}[c_custkey % 8 + 1] || 'q' WHEN 2 THEN 'nobody' ELSE {_L}[c_custkey % 8 + 1] END AS author, 1985 + c_custkey % 25 AS year FROM customer),
f AS (SELECT key, CASE WHEN i.y = year THEN 1 ELSE 2 END AS tier, slug, 0 AS edits, abs(i.y - year) AS year_offset FROM a JOIN i USING (author)
  UNION ALL SELECT key, 3, slug, levenshtein(a.author, i.author), abs(i.y - year) FROM a JOIN i ON a.author <> i.author AND levenshtein(a.author, i.author) <= 2 AND abs(i.y - year) <= 3 WHERE a.author NOT IN (SELECT author FROM i)),
t AS (SELECT f.* FROM f JOIN (SELECT key, min(tier) AS best FROM f GROUP BY key) USING (key) WHERE tier = best UNION ALL SELECT DISTINCT key, 4, NULL, NULL, NULL FROM a WHERE key NOT IN (SELECT key FROM f))"""

#: The same for the least key of those that ask for the same author and year.
_H = _T.replace("\na AS (", "\nc AS (").replace("FROM customer),", """FROM customer),
m AS (SELECT key, min(key) OVER (PARTITION BY author, year) AS same_as, author, year FROM c), a AS (SELECT key, author, year FROM m WHERE key = same_as),""")

ORACLE_SQL = {
    "citation_mentions": f"WITH {_M} SELECT file, nth, key, authors_raw, et_al FROM m",
    "citation_extract": f"WITH {_M} SELECT key, arg_min(authors_raw, file * 10 + nth) AS authors_raw, CAST(min(y) AS INTEGER) AS year, count(*) AS n_mentions, count(DISTINCT file) AS n_files FROM m GROUP BY key",
    "author_prefix_index": "WITH p AS (SELECT p_partkey, string_split(replace(p_name, ' ', '-') || '-' || lower(p_type), '-') AS w FROM part) SELECT DISTINCT p_partkey, array_to_string(w[1:n], '-') AS author FROM p, unnest([1, 2, 3]) u(n) WHERE n <= len(w)",
    "citation_tiers": f"""WITH {_H}, n AS (SELECT key, tier, count(slug) AS n FROM t GROUP BY ALL)
SELECT key, key AS same_as, tier, n, slug, edits, year_offset FROM t JOIN n USING (key, tier) UNION ALL SELECT m.key, same_as, tier, n, NULL, NULL, NULL FROM m JOIN n ON n.key = same_as WHERE m.key <> same_as""",
    "bib_outcomes": f"""WITH {_T}, s AS (SELECT key, min(tier) AS tier, count(slug) AS n, CAST(key[2:] AS INTEGER) AS k FROM t GROUP BY key)
SELECT CASE WHEN k % 9 = 0 AND k % 2 = 0 THEN 'emitted' WHEN k % 9 = 0 THEN 'new_pending' WHEN n = 0 THEN 'skipped' WHEN n > 1 THEN 'first_of_many' ELSE 'emitted' END AS outcome, count(*) AS n FROM s GROUP BY 1""",
    "citation_coverage_misses": """WITH l AS (SELECT l_orderkey AS file, l_linenumber * 10 AS lo, l_linenumber * 10 + CAST(l_quantity AS INTEGER) % 9 AS hi, l_linestatus AS s FROM lineitem), loose AS (SELECT file, lo - 9 AS lo, lo - 8 AS hi FROM l WHERE s = 'F')
SELECT * FROM loose WHERE NOT EXISTS (SELECT 1 FROM l WHERE l.s = 'O' AND l.file = loose.file AND l.lo <= loose.lo AND loose.hi <= l.hi)""",
    "bibtex_entries": """SELECT p_partkey AS key, '@' || CASE WHEN p_size % 2 = 0 THEN 'article' ELSE 'book' END || '{' || p_partkey || ',' || chr(10) || '  title = {' || p_name || ' \\& \\{co\\}},' || chr(10) || '  author = {' || p_brand || '},' || chr(10)
 || '  year = {' || (p_size + 1950) || '},' || chr(10) || '  publisher = {' || p_type || '},' || chr(10) || '}' AS entry FROM part""",
    "entry_lint": """WITH c AS (SELECT c_custkey AS k, lower(c_mktsegment) || '-work-' || c_custkey || '-' || (1980 + c_custkey % 30) AS slug, c_custkey % 9 = 0 AND c_custkey % 2 = 1 AS nobody FROM customer),
m AS (SELECT slug, concat_ws(', ', CASE WHEN k % 8 = 1 THEN 'title' END, CASE WHEN k % 2 = 0 AND k % 5 = 0 THEN 'publisher' END, CASE WHEN k % 2 = 1 AND k % 7 = 0 THEN 'doi' END, CASE WHEN nobody THEN 'author/authors' END) AS detail FROM c)
SELECT slug, 'missing-required' AS code, detail FROM m WHERE detail <> '' UNION ALL SELECT slug, 'slug-year-mismatch', NULL FROM c WHERE k % 4 = 0
UNION ALL SELECT slug, 'author-slug-mismatch', NULL FROM c WHERE k % 3 = 0 AND k % 9 <> 0 UNION ALL SELECT slug, 'title-has-noise', NULL FROM c WHERE k % 8 IN (0, 2)""",
    "loose_citations": """WITH o AS (SELECT o_orderkey AS file, o_orderkey % 3 AS m, o_orderkey % 2 = 0 AS e FROM orders),
t AS (SELECT *, CASE m WHEN 0 THEN '(work of 1987 and later)' WHEN 1 THEN '(12 of 1987)' ELSE '(in the year,1987)' END AS loose FROM o)
SELECT file, 8 AS lo, 21 AS hi, 1 AS line, '(Ahmed, 2010)' AS raw, 'As told (Ahmed, 2010).' AS context FROM o
UNION ALL SELECT file, 29, CAST(29 + length(loose) AS INTEGER), 3, loose, 'Then ' || loose || ' came' FROM t WHERE m <> 1
UNION ALL SELECT file, CAST(35 + length(loose) AS INTEGER), CAST(45 + length(loose) AS INTEGER), 4, '(xyz 1999)'[1:10], '(xyz 1999)' FROM t WHERE e""",
    "citation_lines": """WITH o AS (SELECT o_orderkey % 3 AS m, o_orderkey % 2 = 0 AS e FROM orders)
SELECT 1 AS line, '(Ahmed, 2010)' AS raw, 'As told (Ahmed, 2010).' AS context, count(*) AS n FROM o UNION ALL SELECT 3, '(work of 1987 and later)', 'Then (work of 1987 and later) came', count(*) FROM o WHERE m = 0
UNION ALL SELECT 3, '(in the year,1987)', 'Then (in the year,1987) came', count(*) FROM o WHERE m = 2 UNION ALL SELECT 4, '(xyz 1999)', '(xyz 1999)', count(*) FROM o WHERE e""",
}

"""Queries: texts cut to cues, sections and pages, catalogues' answers as records, and further scalar functions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.functions import identifiers, text
from lectern.operators import catalogues, reconcile, segment, transcript, worklist
from lectern.sources.markdown import header_text, split_header
from lectern.sources.tables import read_table


def sniffed_identifiers(spark: SparkSession, d: str) -> DataFrame:
    """Identifiers within words: ISBNs of 10 and 13 digits, one with too few, the first DOI and all of them."""
    k = F.col("p_partkey")
    n = F.lpad(k.cast("string"), 9, "0")
    isbn = F.when(k % 3 == 0, F.concat(F.lit("ISBN 978-"), n, F.lit("-x."))).when(k % 3 == 1, F.concat(F.lit("no "), F.substring(n, 1, 1), F.lit("-"), F.substring(n, 2, 8), F.lit("-x!"))).otherwise("only 123 456")
    words = F.concat(F.lit("See 10.1234/Ab_c."), k.cast("string"), F.lit("; or https://doi.org/10.99999/x("), k.cast("string"), F.lit("), end."))
    return read_table(spark, d, "part").select("p_partkey", identifiers.isbn_digits(isbn).alias("isbn"), identifiers.first_doi(words).alias("first"), F.array_join(identifiers.dois_in(words), " ").alias("all"))


def _outlines(spark: SparkSession, d: str) -> DataFrame:
    """Parts as Markdown: text before the first heading or not, a heading in fenced code, deeper ones, closing signs."""
    k = F.col("p_partkey")
    body = F.concat(
        F.when(k % 2 == 0, F.lit("intro\n")).otherwise(""), F.lit("# "), F.col("p_name"), F.lit(" #\ntext\n```\n# not one\n```\n"), F.when(k % 3 == 0, F.lit("## Two\n\n")).otherwise(""), F.lit("### "), F.col("p_type"), F.lit("\nend"),
    )
    return read_table(spark, d, "part").select(k.alias("doc"), body.alias("text"))


def outline_sections(spark: SparkSession, d: str) -> DataFrame:
    return segment.sections(_outlines(spark, d))


def deeper_headings(spark: SparkSession, d: str) -> DataFrame:
    levels = F.transform(segment.headings(F.col("text")), lambda h: h["level"])
    return _outlines(spark, d).select("doc", segment.nested_headings("text").alias("text"), F.array_join(levels, ",").alias("levels"), segment.level_drift(F.filter(levels, lambda v: v > 2)).alias("drift"))


def subtitle_cues(spark: SparkSession, d: str) -> DataFrame:
    """Conversations as subtitles, read, written and read again; turns without words are no cues."""
    c = read_table(spark, d, "conversations")
    t = F.col("turn")
    stamp = lambda s: F.format_string("%02d:%02d:%02d,%03d", F.floor(s / 3600), F.floor(s / 60) % 60, s % 60, t % 1000)
    words = F.when(t % 3 == 2, F.lit("")).otherwise(F.concat("role", F.lit("\nsays "), t.cast("string")))
    cue = F.concat((t + 1).cast("string"), F.lit("\n"), stamp(t * 70), F.lit(" --> "), stamp(t * 70 + 60), F.lit("\n"), words)
    docs = c.groupBy(F.col("conv_id").alias("doc")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", cue.alias("c")))), lambda x: x["c"]), "\n\n").alias("text"))
    again = transcript.srt_cues(transcript.to_srt(transcript.srt_cues(docs)))
    return again.select("doc", "idx", F.round("start", 3).alias("start"), F.round("end", 3).alias("end"), "text")


def _tokens(spark: SparkSession, d: str) -> DataFrame:
    """Events of a user as spoken words, each a minute long at most, with no end for errors."""
    e = read_table(spark, d, "events")
    ms = F.unix_millis(F.col("ts").cast("timestamp")) - F.unix_millis(F.expr("cast(timestamp_ntz'2024-01-01 00:00:00' as timestamp)"))
    return e.select(F.col("user_id").alias("talk"), F.col("event_id").alias("pos"), F.when(F.col("event_type") == "error", "<end>").otherwise(F.concat(F.lit(" "), "event_type")).alias("text"), ms.alias("start_ms"), (ms + F.col("event_id") % 60_000).alias("end_ms"))


def spoken_cues(spark: SparkSession, d: str) -> DataFrame:
    """Words as cues, parted by pauses of over an hour."""
    cues = transcript.group_cues(_tokens(spark, d), 3_600_000, 1 << 60)
    return cues.select("talk", "idx", F.round("start", 3).alias("start"), F.round("end", 3).alias("end"), "text")


def cue_paragraphs(spark: SparkSession, d: str) -> DataFrame:
    """Lines of orders as cues of ten seconds in a row: five of them make a paragraph of 45 seconds at least."""
    li = read_table(spark, d, "lineitem").select(F.col("l_orderkey").alias("talk")).groupBy("talk").agg((F.count("*") * 3).alias("n"))
    cues = li.select("talk", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)).alias("idx"))
    cues = cues.select("talk", "idx", (F.col("idx") * 10).cast("double").alias("start"), (F.col("idx") * 10 + 10).cast("double").alias("end"), F.lit("x").alias("text"))
    stamps = transcript.stamp(F.col("start") * 100), transcript.stamp(F.col("end"), True)
    return transcript.paragraphs(cues, 45).select("talk", "idx", F.col("paragraph").alias("paragraph"), stamps[0].alias("shown"), stamps[1].alias("srt"))


def page_ranges(spark: SparkSession, d: str) -> DataFrame:
    """Lines of orders as pages, in two ranges that share one."""
    pages = read_table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("book"), F.col("l_linenumber").alias("page")).agg(F.min("l_returnflag").alias("text"))
    specs = pages.select("book").distinct().select("book", F.explode(F.array(F.struct(F.lit("one").alias("title"), F.lit(1).alias("start"), F.lit(3).alias("end")), F.struct(F.lit("two").alias("title"), F.lit(3).alias("start"), F.lit(9).alias("end")))).alias("s"))
    return segment.pages_in_ranges(pages, specs.select("book", "s.title", "s.start", "s.end"))


def contents_levels(spark: SparkSession, d: str) -> DataFrame:
    """Lines of orders as a table of contents of which every second entry is deeper by more than one level; pages where originals and translations take turns."""
    li = read_table(spark, d, "lineitem").select(F.col("l_orderkey").alias("book"), F.col("l_linenumber").alias("pos")).distinct()
    toc = li.select("book", "pos", F.when(F.col("pos") % 2 == 1, 3).otherwise(6).alias("level"))
    page, n = F.col("pos") * 3, F.lit(20)
    return segment.toc_levels(toc).select("book", "pos", "level", segment.split_page(page, n).cast("int").alias("original"), segment.split_page(page, n, True).cast("int").alias("translated"), segment.slot_order(F.concat(F.col("pos").cast("string"), F.lit("b"))).alias("slot"))


def best_engines(spark: SparkSession, d: str) -> DataFrame:
    e = read_table(spark, d, "events")
    name = F.element_at(F.array(*[F.lit(x) for x in ("parakeet", "apple", "whisper", "soniox", "other")]), (F.col("event_id") % 5 + 1).cast("int"))
    runs = e.groupBy(F.col("user_id").alias("talk"), name.alias("engine")).agg(F.count(F.when(F.col("event_type") != "view", 1)).alias("n_segments"))
    return transcript.primary_engine(runs)


def paper_records(spark: SparkSession, d: str) -> DataFrame:
    """Parts as papers of two catalogues, found by DOI; the venue by the registry, the year by the index."""
    k = F.col("p_partkey")
    work = F.floor(k / 2).cast("long")
    rows = read_table(spark, d, "part").select(
        k.alias("rid"), F.when(k % 2 == 0, "openalex").otherwise("crossref").alias("src"), (k % 2).cast("int").alias("src_ord"), k.alias("pos"), F.concat(F.lit("T"), k.cast("string")).alias("title"), F.array(F.lit("A")).alias("authors"),
        F.when(k % 2 == 0, 1990).otherwise(2000).alias("year"), F.concat(F.lit("10.1/"), work.cast("string")).alias("doi"), F.col("p_brand").alias("publisher"), F.concat(F.lit("v"), (k % 2).cast("string")).alias("venue"),
    )
    merged, conflicts = reconcile.reconcile(rows, reconcile.PAPER)
    n = conflicts.groupBy("cluster").agg(F.count("*").alias("conflicts"))
    return merged.join(n, "cluster", "left").select("cluster", "title", "year", "venue", "publisher", F.size("sources").cast("long").alias("n_sources"), F.coalesce("conflicts", F.lit(0)).alias("conflicts"))


def catalogue_answers(spark: SparkSession, d: str) -> DataFrame:
    """Parts as the answers of four catalogues, as records."""
    part = read_table(spark, d, "part")
    k, key = F.col("p_partkey"), F.col("p_partkey").cast("string")
    works = part.where("p_partkey % 4 = 0").select(
        key.alias("id"), F.col("p_name").alias("title"), F.array(F.struct(F.col("p_brand").alias("name"))).alias("authorships"), F.lit(1999).alias("publication_year"), F.concat(F.lit("https://doi.org/10.1/X"), key).alias("doi"), F.lit(3).alias("cited_by_count"),
        F.map_from_arrays(F.array(F.lit("b"), F.lit("a")), F.array(F.array(F.lit(1)), F.array(F.lit(0), F.lit(2)))).alias("abstract_inverted_index"),
    )
    registered = part.where("p_partkey % 4 = 1").select(
        F.concat(F.lit("10.1/Y"), key).alias("doi"), F.array(F.concat("p_name", F.lit(" &amp; co"))).alias("title"), F.array(F.struct(F.lit("Ann").alias("given"), F.col("p_brand").alias("family")), F.struct(F.lit(None).cast("string").alias("given"), F.lit("").alias("family"))).alias("author"),
        F.array(F.col("p_type")).alias("container_title"), F.lit(2001).alias("issued_year"), F.lit("P").alias("publisher"), F.lit("1").alias("volume"), F.lit("2").alias("issue"), F.lit("3-4").alias("page"),
    )
    library = part.where("p_partkey % 4 = 2").select(key.alias("key"), F.col("p_name").alias("title"), F.array("p_brand").alias("author_name"), F.lit(1980).alias("first_publish_year"), F.array(F.lit("P"), F.lit("Q")).alias("publisher"), F.array(F.lit("0-8223-7378-5"), F.concat(F.lit("978"), F.lpad(key, 10, "0"))).alias("isbn"))
    identifier = lambda t, v: F.struct(F.lit(t).alias("type"), v.alias("identifier"))
    volumes = part.where("p_partkey % 4 = 3").select(
        key.alias("id"), F.col("p_name").alias("title"), F.lit(None).cast("string").alias("subtitle"), F.array("p_brand").alias("authors"), F.when(k % 8 == 3, "2010-05").otherwise("c. 2010").alias("published_date"), F.lit("P").alias("publisher"), F.repeat(F.lit("d"), 400).alias("description"),
        F.col("p_size").alias("page_count"), F.array(identifier("ISBN_13", key), identifier("OTHER", F.lit("x"))).alias("identifiers"),
    )
    none = lambda t="string": F.lit(None).cast(t)
    shape = lambda df, **given: df.select(*[given.get(c, F.col(c) if c in df.columns else none("int" if c == "year" else "string")).alias(c) for c in ("title", "authors", "year", "doi", "abstract", "venue", "publisher", "isbn_13", "isbn_10", "pages", "description")])
    out = [catalogues.scholarly_works(works), catalogues.registered_works(registered), catalogues.library_editions(library), catalogues.volumes(volumes)]
    total = None
    for name, df in zip(("works", "registry", "library", "volumes"), out, strict=True):
        one = shape(df, authors=F.array_join("authors", "|")).withColumn("catalogue", F.lit(name))
        total = one if total is None else total.unionByName(one)
    return total


def plain_words(spark: SparkSession, d: str) -> DataFrame:
    """People by slashes, slugs of headings, texts without colour codes, words joined over lines, dates of milliseconds, digests of rows."""
    k, name = F.col("c_custkey"), F.col("c_name")
    return read_table(spark, d, "customer").select(
        "c_custkey", F.array_join(text.people(F.concat(F.lit(" A B/ "), name, F.lit(" //"))), "|").alias("people"), text.heading_slug(F.concat(F.lit("-- "), name, F.lit(": 中文 & The very long rest of a heading"))).alias("slug"),
        text.clean_text(F.concat(F.lit("\u001b[31m"), name, F.lit("\u001b[0m​\u0007!"))).alias("clean"), text.join_hyphenated(F.concat(F.lit("inter-\nest pre-\nand co-\n"), F.lower("c_mktsegment"))).alias("joined"),
        identifiers.epoch_ms_date(k * 86_400_000).alias("day"), identifiers.fingerprint(F.col("c_custkey"), F.col("c_mktsegment")).alias("digest"), identifiers.valid_slug(F.concat(F.lower("c_mktsegment"), F.when(k % 2 == 0, "_").otherwise("-x"))).alias("valid"),
    )


def header_fields(spark: SparkSession, d: str) -> DataFrame:
    """Parts as files with headers, written by one function and split by another; some without a header, some with a list for one."""
    k = F.col("p_partkey")
    head = header_text(F.map_from_arrays(F.array(F.lit("title"), F.lit("size"), F.lit("gone")), F.array(F.concat("p_name", F.lit(": x")), F.col("p_size").cast("string"), F.lit(""))))
    whole = F.when(k % 5 == 0, F.lit("no header")).when(k % 5 == 1, F.lit("---\n- list\n---\nbody")).otherwise(F.concat(head, F.lit("body")))
    p = read_table(spark, d, "part").select("p_partkey", split_header(whole).alias("p"))
    return p.select("p_partkey", F.element_at("p.header", "title").alias("title"), F.element_at("p.header", "size").alias("size"), F.element_at("p.kinds", "size").alias("kind"), "p.body", "p.error")


def proved_texts(spark: SparkSession, d: str) -> DataFrame:
    """Whether texts hold a work's title and author, or its DOI; whether they look like its article."""
    k = F.col("p_partkey")
    body = F.when(k % 4 == 0, F.concat(F.lit("The "), F.initcap("p_name"), F.lit(", by Ann OTHER. "))).when(k % 4 == 1, F.concat(F.lit("On "), "p_name")).when(k % 4 == 2, F.lit("doi 10.1/AB")).otherwise("")
    long_ = F.concat(body, F.lit("Introduction "), F.repeat(F.lit("word "), 100))
    proved = catalogues.proves_identity(body, F.col("p_name"), F.lit("Other"), F.when(k % 4 == 2, "https://doi.org/10.1/ab"))
    return read_table(spark, d, "part").select("p_partkey", proved.alias("proved"), catalogues.looks_like_article(long_, F.col("p_name"), F.lit("Other")).alias("article"), F.round(catalogues.title_recall(F.concat("p_name", F.lit(" besides")), F.col("p_name")), 6).alias("recall"))


def reviewed_topics(spark: SparkSession, d: str) -> DataFrame:
    """Notes by their state, topics' members by whether they are there, books by their chapters."""
    li = read_table(spark, d, "lineitem")
    k = F.col("l_partkey")
    notes = li.select(F.col("l_orderkey").cast("string").alias("batch_id"), F.when(k % 7 != 0, k.cast("string")).alias("key"), F.when(k % 2 == 0, "s").alias("picked_slug"), F.when(k % 5 == 0, "skipped").alias("status"), F.lit(None).cast("boolean").alias("flag"), F.lit(None).cast("string").alias("recommended_action"))
    cards = catalogues.review_cards(notes).groupBy(F.concat_ws(" ", F.lit("card"), "status", F.col("flag").cast("string"), "recommended_action").alias("what")).agg(F.count("*").alias("n"))
    members = li.select(F.col("l_orderkey").alias("topic"), F.lit("q").alias("subquestion"), F.lit("book").alias("kind"), F.concat(F.when(k % 29 == 0, "Bad ").otherwise("b-"), (k % 50).cast("string")).alias("slug"))
    have = li.where("l_partkey % 3 = 0").select(F.lit("book").alias("kind"), F.concat(F.lit("b-"), (k % 50).cast("string")).alias("slug"))
    topics = catalogues.topic_projection(members, have).groupBy(F.concat(F.lit("member "), F.col("present").cast("string")).alias("what")).agg(F.count("*").alias("n"))
    chapters = li.select(F.col("l_orderkey").alias("book"), F.col("l_linenumber").alias("slot")).distinct()
    books = catalogues.book_status(chapters, li.where("l_returnflag = 'N'").select(F.col("l_orderkey").alias("book"), F.col("l_linenumber").alias("slot")))
    done = books.groupBy(F.when(F.col("done") == F.col("chapters"), "book whole").otherwise("book open").alias("what")).agg(F.count("*").alias("n"))
    return cards.unionByName(topics).unionByName(done)


def listed_sources(spark: SparkSession, d: str) -> DataFrame:
    """Parts as paths of a listing: kinds and slugs, a PDF as both kinds where neither is known."""
    k = F.col("p_partkey")
    slug = F.floor(k / 3).cast("string")
    path = F.when(k % 3 == 0, F.concat(F.lit("x/vault/books/s"), slug, F.lit("/00.md"))).when(k % 3 == 1, F.concat(F.lit("sources/pdfs/"), F.when(k % 2 == 0, "s").otherwise("t"), slug, F.lit(".pdf"))).otherwise(F.concat(F.lit("vault/papers/p"), slug, F.lit(".md")))
    return worklist.distinct_sources(read_table(spark, d, "part").select(path.alias("path")))


QUERIES = {
    f.__name__: f
    for f in (
        sniffed_identifiers, outline_sections, deeper_headings, subtitle_cues, spoken_cues, cue_paragraphs, page_ranges, contents_levels, best_engines, paper_records, catalogue_answers, plain_words, header_fields, proved_texts, reviewed_topics, listed_sources,
    )
}

_LINES = """
b AS (SELECT p_partkey AS doc, p_partkey % 2 = 0 AS intro, p_partkey % 3 = 0 AS two, p_name, p_type FROM part),
h AS (SELECT *, CASE WHEN intro THEN 1 ELSE 0 END AS o FROM b)"""

ORACLE_SQL = {
    "sniffed_identifiers": """WITH p AS (SELECT p_partkey AS k, lpad(CAST(p_partkey AS VARCHAR), 9, '0') AS n FROM part)
SELECT k AS p_partkey, CASE k % 3 WHEN 0 THEN '978' || n || 'X' WHEN 1 THEN n || 'X' END AS isbn, '10.1234/Ab_c.' || k AS first, '10.1234/ab_c.' || k || ' 10.99999/x(' || k AS "all" FROM p""",
    "outline_sections": f"""WITH {_LINES}, s AS (SELECT doc, o, two, NULL AS heading, 0 AS level, 1 AS start_line FROM h WHERE intro UNION ALL SELECT doc, o, two, p_name, 1, 1 + o FROM h UNION ALL SELECT doc, o, two, 'Two', 2, 6 + o FROM h WHERE two)
SELECT doc, CAST(row_number() OVER w - 1 AS INTEGER) AS idx, heading, level, start_line, coalesce(lead(start_line) OVER w - 1, 7 + o + CASE WHEN two THEN 2 ELSE 0 END) AS end_line FROM s WINDOW w AS (PARTITION BY doc ORDER BY start_line)""",
    "deeper_headings": """SELECT p_partkey AS doc, CASE WHEN p_partkey % 2 = 0 THEN 'intro' || chr(10) ELSE '' END || '### ' || p_name || ' #' || chr(10) || 'text' || chr(10) || '```' || chr(10) || '# not one' || chr(10) || '```' || chr(10)
 || CASE WHEN p_partkey % 3 = 0 THEN '#### Two' || chr(10) || chr(10) ELSE '' END || '##### ' || p_type || chr(10) || 'end' AS text, CASE WHEN p_partkey % 3 = 0 THEN '1,2,3' ELSE '1,3' END AS levels, 1 AS drift FROM part""",
    "subtitle_cues": """WITH c AS (SELECT conv_id AS doc, turn, role FROM conversations WHERE turn % 3 <> 2)
SELECT doc, CAST(row_number() OVER (PARTITION BY doc ORDER BY turn) - 1 AS INTEGER) AS idx, round(turn * 70 + (turn % 1000) / 1000, 3) AS start, round(turn * 70 + 60 + (turn % 1000) / 1000, 3) AS "end", role || ' says ' || turn AS text FROM c""",
    "spoken_cues": """WITH t AS (SELECT user_id AS talk, event_id AS pos, event_type, (epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-01')) // 1000 AS a, (epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-01')) // 1000 + event_id % 60000 AS b FROM events WHERE event_type <> 'error'),
g AS (SELECT *, CASE WHEN a - lag(b) OVER (PARTITION BY talk ORDER BY pos) <= 3600000 THEN 0 ELSE 1 END AS new FROM t),
i AS (SELECT *, CAST(sum(new) OVER (PARTITION BY talk ORDER BY pos) AS BIGINT) - 1 AS idx FROM g)
SELECT talk, idx, round(arg_min(a, pos) / 1000, 3) AS start, round(arg_max(b, pos) / 1000, 3) AS "end", string_agg(event_type, ' ' ORDER BY pos) AS text FROM i GROUP BY talk, idx""",
    "cue_paragraphs": """WITH n AS (SELECT l_orderkey AS talk, count(*) * 3 AS n FROM lineitem GROUP BY 1), c AS (SELECT talk, unnest(range(n)) AS idx FROM n), s AS (SELECT *, idx * 1000 AS s, idx * 10 + 10 AS e FROM c)
SELECT talk, idx, idx // 5 AS paragraph, CASE WHEN s >= 3600 THEN (s // 3600) || ':' ELSE '' END || lpad(CAST(s // 60 % 60 AS VARCHAR), 2, '0') || ':' || lpad(CAST(s % 60 AS VARCHAR), 2, '0') AS shown,
  lpad(CAST(e // 3600 AS VARCHAR), 2, '0') || ':' || lpad(CAST(e // 60 % 60 AS VARCHAR), 2, '0') || ':' || lpad(CAST(e % 60 AS VARCHAR), 2, '0') || ',000' AS srt FROM s""",
    "page_ranges": """WITH p AS (SELECT l_orderkey AS book, l_linenumber AS page, min(l_returnflag) AS t FROM lineitem GROUP BY 1, 2), s AS (SELECT * FROM (VALUES ('one', 1, 3), ('two', 3, 9)) v(title, start, e))
SELECT book, title, start, string_agg(t, chr(10) ORDER BY page) AS text FROM p JOIN s ON page BETWEEN start AND e GROUP BY book, title, start""",
    "contents_levels": """WITH l AS (SELECT DISTINCT l_orderkey AS book, l_linenumber AS pos FROM lineitem), g AS (SELECT *, sum(pos % 2) OVER (PARTITION BY book ORDER BY pos) AS g, max(pos % 2) OVER (PARTITION BY book) AS odd FROM l), b AS (SELECT *, row_number() OVER (PARTITION BY book, g ORDER BY pos) AS r FROM g)
SELECT book, pos, CASE WHEN odd = 0 THEN 1 ELSE CAST(least(4, r) AS INTEGER) END AS level, CAST(greatest(1, least(20, pos * 6 - 1)) AS INTEGER) AS original, CAST(greatest(1, least(20, pos * 6)) AS INTEGER) AS translated, pos AS slot FROM b""",
    "best_engines": """WITH r AS (SELECT user_id AS talk, event_id % 5 AS e, count(*) FILTER (WHERE event_type <> 'view') AS n FROM events GROUP BY 1, 2)
SELECT talk, ['soniox', 'whisper', 'apple', 'parakeet', 'other'][min(CASE e WHEN 3 THEN 1 WHEN 2 THEN 2 WHEN 1 THEN 3 WHEN 0 THEN 4 ELSE 5 END)] AS engine FROM r WHERE n > 0 GROUP BY talk""",
    "paper_records": """WITH p AS (SELECT p_partkey AS k, p_partkey // 2 AS w, p_brand FROM part)
SELECT min(k) AS cluster, arg_max('T' || k, length('T' || k) * 10 - k % 2) AS title, CAST(arg_min(CASE WHEN k % 2 = 0 THEN 1990 ELSE 2000 END, k) AS INTEGER) AS year, 'v' || max(k % 2) AS venue, arg_min(p_brand, k) AS publisher, count(*) AS n_sources,
  CAST(CASE WHEN count(*) = 2 THEN 1 ELSE 0 END + CASE WHEN count(DISTINCT p_brand) > 1 THEN 1 ELSE 0 END AS BIGINT) AS conflicts FROM p GROUP BY w""",
    "catalogue_answers": """WITH p AS (SELECT p_partkey AS k, p_partkey % 4 AS m, CAST(p_partkey AS VARCHAR) AS id, * FROM part)
SELECT ['works', 'registry', 'library', 'volumes'][m + 1] AS catalogue, p_name || CASE WHEN m = 1 THEN ' & co' ELSE '' END AS title, CASE WHEN m = 1 THEN 'Ann ' ELSE '' END || p_brand AS authors, CAST(CASE m WHEN 0 THEN 1999 WHEN 1 THEN 2001 WHEN 2 THEN 1980 ELSE CASE WHEN k % 8 = 3 THEN 2010 END END AS INTEGER) AS year,
  CASE m WHEN 0 THEN '10.1/x' || id WHEN 1 THEN '10.1/y' || id END AS doi, CASE WHEN m = 0 THEN 'a b a' END AS abstract, CASE WHEN m = 1 THEN p_type END AS venue, CASE m WHEN 0 THEN NULL WHEN 2 THEN 'P / Q' ELSE 'P' END AS publisher,
  CASE m WHEN 2 THEN '978' || lpad(id, 10, '0') WHEN 3 THEN id END AS isbn_13, CASE WHEN m = 2 THEN '0822373785' END AS isbn_10, CASE WHEN m = 1 THEN '3-4' END AS pages, CASE WHEN m = 3 THEN repeat('d', 300) END AS description FROM p""",
    "plain_words": """WITH c AS (SELECT *, lower(c_name) AS n, regexp_replace(lower(c_name) || ': 中文 & the very long rest of a heading', '[^a-z0-9一-鿿]+', '-', 'g') AS s FROM customer)
SELECT c_custkey, 'A B|' || c_name AS people, regexp_replace(s[1:40], '-+$', '') AS slug, c_name || '!' AS clean, 'interest pre-' || chr(10) || 'and co' || lower(c_mktsegment) AS joined, CAST(TIMESTAMP '1970-01-01' + to_days(CAST(c_custkey AS INTEGER)) AS DATE) AS day,
  sha256('{"c_custkey":' || c_custkey || ',"c_mktsegment":"' || c_mktsegment || '"}') AS digest, c_custkey % 2 = 1 AS valid FROM c""",
    "header_fields": """SELECT p_partkey, CASE WHEN p_partkey % 5 > 1 THEN p_name || ': x' END AS title, CASE WHEN p_partkey % 5 > 1 THEN CAST(p_size AS VARCHAR) END AS size, CASE WHEN p_partkey % 5 > 1 THEN 'int' END AS kind,
  CASE WHEN p_partkey % 5 = 0 THEN 'no header' ELSE 'body' END AS body, CASE p_partkey % 5 WHEN 0 THEN 'missing_header' WHEN 1 THEN 'malformed' END AS error FROM part""",
    "proved_texts": "SELECT p_partkey, p_partkey % 4 <> 1 AS proved, p_partkey % 4 = 0 AS article, round(CAST(2 AS DOUBLE) / 3, 6) AS recall FROM part",
    "reviewed_topics": """WITH l AS (SELECT *, l_partkey AS k FROM lineitem), bad AS (SELECT DISTINCT l_orderkey AS o FROM l WHERE k % 29 = 0), have AS (SELECT DISTINCT k % 50 AS s FROM l WHERE k % 3 = 0),
done AS (SELECT l_orderkey AS o, count(DISTINCT l_linenumber) AS c, count(DISTINCT l_linenumber) FILTER (WHERE l_returnflag = 'N') AS d FROM l GROUP BY 1)
SELECT CASE WHEN k % 5 = 0 THEN 'card skipped true search' WHEN k % 2 = 0 THEN 'card matched false accept' ELSE 'card unresolved true search' END AS what, count(*) AS n FROM l WHERE k % 7 <> 0 GROUP BY 1
UNION ALL SELECT 'member ' || (k % 50 IN (SELECT s FROM have)), count(*) FROM l WHERE l_orderkey NOT IN (SELECT o FROM bad) GROUP BY 1 UNION ALL SELECT CASE WHEN c = d THEN 'book whole' ELSE 'book open' END, count(*) FROM done GROUP BY 1""",
    "listed_sources": """WITH p AS (SELECT p_partkey AS k, p_partkey // 3 AS s FROM part), books AS (SELECT 's' || s AS slug FROM p WHERE k % 3 = 0), pdf AS (SELECT CASE WHEN k % 2 = 0 THEN 's' ELSE 't' END || s AS slug FROM p WHERE k % 3 = 1)
SELECT 'book' AS kind, slug FROM books UNION SELECT 'paper', 'p' || s FROM p WHERE k % 3 = 2 UNION SELECT unnest(['book', 'paper']), slug FROM pdf WHERE slug NOT IN (SELECT slug FROM books)""",
}

"""Answers of catalogues as flat records; localised editions; proof that a text is the work asked for; review and topic tables."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType

from lectern.functions.html import unescape
from lectern.functions.identifiers import doi, isbn13, valid_slug
from lectern.functions.text import cjk_dominant, collapse, content_tokens, inverted_index_text, STOP, normal_title, people, strip


def first_isbn(isbns: Column, digits: int) -> Column:
    """The first ISBN of so many digits."""
    return F.get(F.filter(F.transform(isbns, lambda i: F.regexp_replace(F.upper(i), "[^0-9X]", "")), lambda i: F.length(i) == digits), F.lit(0))


def scholarly_works(raw: DataFrame) -> DataFrame:
    """Works (id, title, authorships array<struct<name>>, publication_year, doi, cited_by_count, abstract_inverted_index map<string,array<int>>) as paper records."""
    return raw.select(
        F.col("id").alias("source_id"), F.col("title"), F.transform("authorships", lambda a: a["name"]).alias("authors"), F.col("publication_year").alias("year"),
        doi(F.col("doi")).alias("doi"), F.col("cited_by_count"), inverted_index_text(F.col("abstract_inverted_index")).alias("abstract"),
    )


def registered_works(raw: DataFrame) -> DataFrame:
    """Registry entries (doi, title array, author array<struct<given,family>>, container_title array, issued_year, publisher, volume, issue, page) as paper records."""
    name = lambda a: F.trim(F.concat_ws(" ", a["given"], a["family"]))
    return raw.select(
        doi(F.col("doi")).alias("doi"), unescape(F.get("title", F.lit(0))).alias("title"), F.filter(F.transform("author", name), lambda n: n != "").alias("authors"),
        unescape(F.get("container_title", F.lit(0))).alias("venue"), F.col("issued_year").alias("year"), "publisher", "volume", "issue", F.col("page").alias("pages"),
    )


def library_editions(raw: DataFrame) -> DataFrame:
    """Library answers (key, title, author_name, first_publish_year, publisher array, isbn array) as book records."""
    return raw.select(
        F.col("key").alias("source_id"), "title", F.col("author_name").alias("authors"), F.col("first_publish_year").alias("year"), F.array_join("publisher", " / ").alias("publisher"),
        first_isbn(F.col("isbn"), 13).alias("isbn_13"), first_isbn(F.col("isbn"), 10).alias("isbn_10"),
    )


def volumes(raw: DataFrame) -> DataFrame:
    """Volumes (id, title, subtitle, authors, published_date, publisher, description, page_count, identifiers array<struct<type,identifier>>) as book records."""
    ids = F.map_from_entries(F.transform("identifiers", lambda i: F.struct(i["type"], i["identifier"])))
    year = F.regexp_extract("published_date", "^([0-9]{4})", 1)
    return raw.select(
        F.col("id").alias("source_id"), "title", "subtitle", "authors", F.when(year != "", year.cast("int")).alias("year"), "publisher", F.substring("description", 1, 300).alias("description"),
        "page_count", F.element_at(ids, "ISBN_13").alias("isbn_13"), F.element_at(ids, "ISBN_10").alias("isbn_10"),
    )


CHINESE_ISBN = "^(9787|978957|978962|978986|978988)"
ASIAN_ISBN = "^(9784|97811|978604|97889)"
KANA_HANGUL = "[\\x{3040}-\\x{30FF}\\x{1100}-\\x{11FF}\\x{3130}-\\x{318F}\\x{AC00}-\\x{D7AF}]"
HAN = "[\\x{4E00}-\\x{9FFF}]"


def is_chinese_edition(isbn: Column, title: Column, publisher: Column, translators: Column | None = None) -> Column:
    """By the first rule that holds: an ISBN of China, Taiwan or Hong Kong; of Japan, Korea or Vietnam; kana or hangul; CJK in publisher, translators or title.

    Authors don't count, as their names are often given in Chinese for English editions too.
    """
    key = F.coalesce(F.regexp_replace(isbn, "[^0-9]", ""), F.lit(""))
    words = F.concat_ws(" ", title, publisher, F.lit("") if translators is None else F.array_join(translators, " "))
    return F.when(key.rlike(CHINESE_ISBN), True).when(key.rlike(ASIAN_ISBN), False).when(words.rlike(KANA_HANGUL), False).otherwise(words.rlike(HAN))


#: Columns of a scraped book, and what each catalogue calls those that it calls otherwise.
BOOK_COLUMNS = (
    "title authors translators year publisher isbn_13 isbn_10 page_count description cover_url preview_link categories original_title ratings_count ratings_average source_id"
).split()
_LISTS = ("authors", "translators", "categories")
_WORDS = ("title", "publisher", "description", "preview_link", "original_title")
SCRAPED: dict[str, dict[str, tuple[str, ...]]] = {
    "amazon": {"preview_link": ("url",), "ratings_average": ("amazon_rating",), "source_id": ("asin",), "description": (), "categories": (), "translators": (), "original_title": ()},
    "douban_cn": {"ratings_average": ("douban_rating",), "source_id": ("douban_subject_id",), "preview_link": ("douban_url", "preview_link"), "page_count": (), "description": (), "cover_url": (), "categories": ()},
    "goodreads": {"preview_link": ("url",), "ratings_average": ("avg_rating",), "source_id": ("goodreads_id",), "translators": (), "original_title": ()},
    "scholar": {
        "preview_link": ("url",), "description": ("abstract",), "source_id": ("url",),
        **{c: () for c in "translators publisher isbn_13 isbn_10 page_count cover_url categories original_title ratings_count ratings_average".split()},
    },
    "storygraph": {
        "translators": ("translator",), "categories": ("categories", "genres"), "source_id": ("storygraph_id",),
        **{c: () for c in "publisher isbn_13 isbn_10 description original_title ratings_count ratings_average".split()},
    },
}


def scraped_books(raw: DataFrame, source: str) -> DataFrame:
    """What a catalogue's pages gave, as book records: BOOK_COLUMNS, language and source.

    Columns that `raw` lacks are null, missing words '', missing lists empty. A single translator makes a list; marks like
    [BOOK] go from titles found by a search for scholars; Chinese editions have the language zh.
    """
    types = dict(raw.dtypes)

    def value(name: str) -> Column:
        names = [n for n in SCRAPED[source].get(name, (name,)) if n in types]
        found = [F.col(f"`{n}`") for n in names]
        if name in _LISTS:
            found = [c if types[n].startswith("array") else F.when(F.coalesce(c, F.lit("")) != "", F.array(c)) for n, c in zip(names, found, strict=True)]
            filled = [F.when(F.size(c) > 0, c) for c in found]
            return F.coalesce(*filled, F.array().cast("array<string>"))
        if name in _WORDS:
            return F.coalesce(*[F.when(c != "", c) for c in found], F.lit(""))
        if name == "source_id":
            return F.coalesce(*[F.when(c.cast("string") != "", c.cast("string")) for c in found], F.lit(None).cast("string"))
        kind = {"year": "int", "page_count": "int", "ratings_count": "long", "ratings_average": "double"}.get(name, "string")
        return F.coalesce(*[c.cast(kind) for c in found], F.lit(None).cast(kind))

    out = raw.select(*[value(c).alias(c) for c in BOOK_COLUMNS])
    if source == "scholar":
        out = out.withColumn("title", without_marks(F.col("title")))
    zh = is_chinese_edition(F.coalesce("isbn_13", "isbn_10"), F.col("title"), F.col("publisher"), F.col("translators")) if source == "douban_cn" else F.lit(False)
    return out.withColumns({"language": F.when(zh, "zh"), "source": F.lit(source)})


def without_marks(title: Column) -> Column:
    return strip(F.regexp_replace(title, "\\[(BOOK|PDF|HTML|CITATION)\\]", ""))


def scraped_papers(raw: DataFrame) -> DataFrame:
    """Papers that a search for scholars gave (title, authors, year, doi, url, abstract) as paper records."""
    words = lambda c: F.coalesce(F.col(c), F.lit(""))
    title = strip(F.regexp_replace("title", "\\[(PDF|HTML|CITATION)\\]", ""))
    return raw.select(
        title.alias("title"), F.coalesce("authors", F.array().cast("array<string>")).alias("authors"), "year", "doi", words("url").alias("url"), words("abstract").alias("abstract"),
        F.lit("article").alias("type"), F.when(F.col("url") != "", F.col("url")).alias("source_id"), F.lit("scholar").alias("source"),
    )


def has_han(value: Column) -> Column:
    """Whether a text has a letter of the CJK block."""
    return F.coalesce(value.rlike(HAN), F.lit(False))


def looks_chinese(title: Column, translators: Column, publisher: Column) -> Column:
    """Whether title, translators or publisher are in Chinese letters; authors don't count."""
    return has_han(title) | has_han(F.array_join(translators, " ")) | has_han(publisher)


def asks_for_chinese(subject: Column) -> Column:
    return F.coalesce(F.lower(subject).isin("chinese", "cn", "cndouban", "translation", "translations", "zh"), F.lit(False))


def edition_candidates(books: DataFrame) -> DataFrame:
    """Book records that look Chinese and have a source_id, the first row of each by `pos`, as candidates of an edition."""
    from pyspark.sql import Window

    joined = lambda c: F.array_join(F.filter(c, lambda n: n != ""), " / ")
    rows = books.where(F.col("source_id").isNotNull() & looks_chinese(F.col("title"), F.col("translators"), F.col("publisher")))
    rows = rows.withColumn("__n", F.row_number().over(Window.partitionBy("source_id").orderBy("pos"))).where("__n = 1")
    return rows.select(
        F.concat(F.lit("douban_cn:"), "source_id").alias("id"), "title", "authors", joined("authors").alias("author"), "translators", joined("translators").alias("translator"), "publisher", "year",
        F.coalesce("isbn_13", "isbn_10").alias("isbn"), "original_title", "ratings_count", F.col("preview_link").alias("url"),
    )


def candidate_id(douban_id: Column, source_id: Column, id_: Column) -> Column:
    """A candidate's number: its own, its source's, or that in an id like douban_cn:123; null for none."""
    full = lambda c: F.when(c != "", c)
    return F.coalesce(full(douban_id), full(source_id), full(F.regexp_extract(id_, "^douban_cn:([0-9]+)$", 1)))


def normal_candidates(raw: DataFrame) -> DataFrame:
    """Candidates (douban_id, source_id, id, title, author, authors, translator, translators, publisher, year, isbn, isbn_13, isbn_10) as they are kept; those without a number go."""
    people_of = lambda many, one: F.when(F.size(F.col(many)) > 0, F.filter(F.transform(many, strip), lambda p: p != "")).otherwise(F.coalesce(people(F.col(one)), F.array().cast("array<string>")))
    shown = lambda many, one: F.coalesce(F.when(F.col(one) != "", F.col(one)), F.array_join(people_of(many, one), " / "))
    isbn = isbn13(F.coalesce(*[F.when(F.col(c) != "", F.col(c)) for c in ("isbn", "isbn_13", "isbn_10")]))
    number = candidate_id(F.col("douban_id"), F.col("source_id"), F.col("id"))
    rows = raw.select(
        number.alias("douban_id"), "title", shown("authors", "author").alias("author"), people_of("authors", "author").alias("authors"), shown("translators", "translator").alias("translator"),
        people_of("translators", "translator").alias("translators"), "publisher", "year", isbn.alias("isbn"),
    )
    return rows.where("douban_id is not null")


def query_variants(title: Column, author: Column, query: Column, isbn: Column) -> Column:
    """Searches to try, in order and without repeats: the quoted title alone and with words for its translation, its part before a colon too, then with the author; else the query; else the ISBN."""
    plain = lambda c: F.coalesce(collapse(strip(c)), F.lit(""))
    quoted = lambda c: F.when(F.replace(c, F.lit('"'), F.lit("")) != "", F.concat(F.lit('"'), collapse(F.replace(c, F.lit('"'), F.lit(""))), F.lit('"'))).otherwise("")
    t, a, q, i = plain(title), plain(author), plain(query), plain(isbn)
    head = plain(F.element_at(F.split(t, "[:：]"), 1))
    hinted = lambda c: [quoted(c), F.concat(quoted(c), F.lit(" 原作名")), F.concat(quoted(c), F.lit(" 译者"))]
    only = lambda holds, cs: [F.when(holds, c).otherwise("") for c in cs]
    tail = F.element_at(F.split(a, " "), -1)
    named = [F.concat_ws(" ", quoted(t), quoted(a)), F.concat_ws(" ", quoted(t), tail), F.concat_ws(" ", t, a), quoted(a), a]
    by_title = F.array(*hinted(t), *only((head != "") & (head != t), hinted(head)), *only(a != "", named))
    out = F.when(t != "", by_title).when(q != "", F.array(quoted(q), F.concat(quoted(q), F.lit(" 原作名")), q)).otherwise(F.array(i))
    return F.array_distinct(F.filter(F.transform(out, collapse), lambda v: v != ""))


def localisations(records: DataFrame) -> DataFrame:
    """Chinese editions among records (rid, source_id, title, isbn_13, publisher), the first of each source_id."""
    rows = records.where("source_id is not null").where(is_chinese_edition(F.col("isbn_13"), F.col("title"), F.col("publisher"), F.col("translators") if "translators" in records.columns else None))
    return rows.groupBy("source_id").agg(F.min_by(F.struct("rid", "title", "isbn_13", "publisher"), "rid").alias("r")).select("source_id", "r.*").withColumn("dominant", cjk_dominant(F.col("title")))


def proves_identity(text: Column, title: Column, surname: Column, doi_: Column) -> Column:
    """Whether a text is the work: its DOI is in it, or its whole title as words in a row together with the author; true where nothing is to be proved or there is no text."""
    bare = F.concat(F.lit(" "), normal_title(text), F.lit(" "))
    asked = normal_title(title)
    has_title = bare.contains(F.concat(F.lit(" "), asked, F.lit(" ")))
    has_author = F.coalesce(surname == "", F.lit(True)) | bare.contains(F.concat(F.lit(" "), normal_title(surname), F.lit(" ")))
    nothing = (F.coalesce(doi_, F.lit("")) == "") & (asked == "")
    no_text = F.coalesce(strip(text), F.lit("")) == ""
    return F.when(nothing | no_text, True).when(F.coalesce(F.lower(text).contains(doi(doi_)), F.lit(False)), True).otherwise((asked != "") & has_title & has_author)


def looks_like_article(text: Column, title: Column, surname: Column, least: int = 500) -> Column:
    """Long enough, of that title, and with a part that articles have."""
    part = F.lower(text).rlike("\\b(abstract|introduction|references|bibliography|conclusion|keywords)\\b")
    return F.coalesce((F.length(text) >= least) & part & proves_identity(text, title, surname, F.lit(None).cast("string")), F.lit(False))


def title_recall(asked: Column, found: Column) -> Column:
    """Share of the asked title's content words that the found one has."""
    return F.when(F.size(content_tokens(asked)) == 0, 0.0).otherwise(F.size(F.array_intersect(content_tokens(asked), content_tokens(found))) / F.size(content_tokens(asked)))


def review_cards(notes: DataFrame) -> DataFrame:
    """Notes (batch_id, key, picked_slug, status, flag, recommended_action) with defaults; notes without a key go.

    The status is matched with a picked slug, else unresolved; unresolved ones are flagged and to be searched for.
    """
    status = F.coalesce(F.when(F.col("status") != "", F.col("status")), F.when(F.coalesce("picked_slug", F.lit("")) != "", "matched").otherwise("unresolved"))
    flag = F.coalesce(F.col("flag"), status != "matched")
    action = F.coalesce("recommended_action", F.when(status == "matched", "accept").otherwise("search"))
    return notes.where("coalesce(key, '') <> ''").select("batch_id", "key", "picked_slug", status.alias("status"), flag.alias("flag"), action.alias("recommended_action"))


def topic_projection(members: DataFrame, artifacts: DataFrame) -> DataFrame:
    """(topic, subquestion, kind, slug, present) of members (topic, subquestion, kind, slug); a topic with any invalid slug has no rows."""
    from lectern.operators.validate import all_or_nothing

    a = artifacts.select(F.col("kind").alias("_k"), F.col("slug").alias("_s")).distinct()
    rows = all_or_nothing(members, "topic", valid_slug(F.col("slug")))
    return rows.join(a, (rows["kind"] == F.col("_k")) & (rows["slug"] == F.col("_s")), "left").select("topic", "subquestion", "kind", "slug", F.col("_s").isNotNull().alias("present"))


def book_status(chapters: DataFrame, outputs: DataFrame) -> DataFrame:
    """(book, chapters, done, missing): expected chapters (book, slot) against outputs (book, slot); the first missing slots in order."""
    o = outputs.select(F.col("book").alias("_b"), F.col("slot").alias("_s")).distinct()
    j = chapters.join(o, (chapters["book"] == F.col("_b")) & (chapters["slot"] == F.col("_s")), "left")
    return j.groupBy("book").agg(F.count("*").alias("chapters"), F.count("_s").alias("done"), F.sort_array(F.collect_list(F.when(F.col("_s").isNull(), F.col("slot")))).alias("missing"))


ROLES = ("context", "evidence", "method", "theory")


def topic_state(members: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(members, assignments) of a topic's projected members (topic, pos, subq, kind, slug, role, usable, path).

    Of usable ones each (kind, slug) is a member once, the first by pos; those with a role are assigned to their question.
    """
    from lectern.operators.reconcile import keep_first

    some = members.where("usable")
    first = keep_first(some.withColumn("__key", F.struct("topic", "kind", "slug")), "__key", "pos").select("topic", "kind", "slug", "path")
    return first, some.where("role is not null").select("topic", F.concat_ws(":", "kind", "slug").alias("member"), "subq", "role")


def assigned(members: DataFrame, items: DataFrame) -> DataFrame:
    """(topic, member, subq, role) of new questions' items (topic, subq, kind, slug, role) that are members and have a known role."""
    m = members.select(F.col("topic").alias("__t"), F.col("kind").alias("__k"), F.col("slug").alias("__s")).distinct()
    met = items.join(m, (F.col("topic") == F.col("__t")) & (F.col("kind") == F.col("__k")) & (F.col("slug") == F.col("__s")))
    return met.where(F.col("role").isin(*ROLES)).select("topic", F.concat_ws(":", "kind", "slug").alias("member"), "subq", "role")


def identity(fields: Column) -> Column:
    """A header's title, authors, name and year, as far as it has them."""
    return F.map_filter(fields, lambda k, v: k.isin("title", "authors", "name", "year"))


def pages_cohere(snapshot: Column, snapshot_at: Column, canonical: Column, canonical_at: Column) -> Column:
    """Whether a page's analysis fits its snapshot: it has an identity and a time, and where there is a snapshot both agree."""
    known = canonical.isNotNull() & canonical_at.isNotNull()
    return known & (snapshot.isNull() | (snapshot.eqNullSafe(canonical) & snapshot_at.eqNullSafe(canonical_at)))


def valid_text(value: Column, low: int, high: int) -> Column:
    """Without blanks around it or control characters, and of a length between both."""
    return F.coalesce((value == strip(value)) & F.length(value).between(low, high) & ~value.rlike("[\\x{00}-\\x{1F}\\x{7F}-\\x{9F}]"), F.lit(False))


def valid_authors(names: Column) -> Column:
    """1 to 32 names of 1 to 200 characters."""
    return F.coalesce(F.size(names).between(1, 32) & F.forall(names, lambda n: valid_text(n, 1, 200)), F.lit(False))


@F.pandas_udf(BooleanType())
def same_json(a: pd.Series, b: pd.Series) -> pd.Series:
    """Whether two JSON texts are the same value: objects by their keys in any order, arrays in theirs; true isn't 1, but 1.0 is."""
    import json

    def same(x, y) -> bool:
        if isinstance(x, bool) or isinstance(y, bool):
            return x is y
        if isinstance(x, list) or isinstance(y, list):
            return isinstance(x, list) and isinstance(y, list) and len(x) == len(y) and all(map(same, x, y))
        if isinstance(x, dict) and isinstance(y, dict):
            return x.keys() == y.keys() and all(same(v, y[k]) for k, v in x.items())
        return x == y

    return pd.Series([same(json.loads(x) if x is not None else None, json.loads(y) if y is not None else None) for x, y in zip(a, b, strict=True)])


def page_signals(text: Column) -> Column:
    """struct(pages, text_pages) of a text with form feeds between its pages; one page without any; null for no text."""
    parts = F.split(F.regexp_replace(text, "\\f$", ""), "\\f")
    some = F.size(F.filter(parts, lambda p: strip(p) != ""))
    whole = F.when(F.coalesce(text, F.lit("")) == "", None)
    return F.struct(whole.when(text.contains("\f"), F.size(parts)).otherwise(1).alias("pages"), whole.when(text.contains("\f"), some).otherwise(1).alias("text_pages"))


START, END, HEADING = "<!-- proofread:start -->", "<!-- proofread:end -->", "## 校对记录（审完整段删除）"


def with_records(text: Column) -> Column:
    """A draft with an empty block for records at its end, unless it has one."""
    block = F.concat(text, F.when(F.endswith(text, F.lit("\n")), "").otherwise("\n"), F.lit(f"\n\n{START}\n{HEADING}\n\n{END}\n"))
    return F.when(text.contains(START) & text.contains(END), text).otherwise(block)


def without_records(text: Column) -> Column:
    """A draft without its block for records; without an end all behind its begin goes. Ends in a line feed then."""
    at = F.locate(START, text)
    before = F.regexp_replace(F.substring(text, F.lit(1), at - 1), "\\s+$", "")
    rest = F.substring(text, at, F.length(text))
    end = F.locate(END, rest)
    joined = F.concat(before, F.regexp_replace(F.substring(rest, end + len(END), F.length(rest)), "^\\s+", ""))
    closed = F.when(F.endswith(joined, F.lit("\n")), joined).otherwise(F.concat(joined, F.lit("\n")))
    return F.when(at == 0, text).when(end == 0, F.concat(before, F.lit("\n"))).otherwise(closed)


def expanded(template: Column, values: Column) -> Column:
    """A template with {name} replaced by values (map<string,string>); null if it names one that isn't there."""
    names = F.regexp_extract_all(template, F.lit("\\{([A-Za-z][A-Za-z0-9]*)\\}"), 1)
    parts = F.split(template, "\\{[A-Za-z][A-Za-z0-9]*\\}")
    filled = F.transform(names, lambda n: F.element_at(values, n))
    joined = F.array_join(F.transform(parts, lambda p, i: F.concat(p, F.coalesce(F.get(filled, i), F.lit("")))), "")
    return F.when(F.exists(filled, lambda v: v.isNull()), None).otherwise(joined)


def slug_parts(slug: Column) -> Column:
    """struct(title, author, year) of author-title-year: the first word is the author, four digits at the end the year."""
    parts = F.split(slug, "-")
    dated = F.element_at(parts, -1).rlike("^[0-9]{4}$")
    rest = F.when(dated, F.slice(parts, F.lit(1), F.size(parts) - 1)).otherwise(parts)
    return F.struct(
        F.array_join(F.slice(rest, F.lit(2), F.greatest(F.size(rest) - 1, F.lit(0))), " ").alias("title"), F.coalesce(F.get(rest, F.lit(0)), F.lit("")).alias("author"), F.when(dated, F.element_at(parts, -1).cast("int")).alias("year"),
    )


def author_match(surname: Column, names: Column) -> Column:
    """Whether the names hold the surname, in any case; true for none."""
    return (F.coalesce(surname, F.lit("")) == "") | F.lower(F.coalesce(names, F.lit(""))).contains(F.lower(F.trim(surname)))


def title_match(a: Column, b: Column, least: float = 0.5, stop: tuple[str, ...] = ()) -> Column:
    """Whether at least so much of the smaller side's content words is shared; false where either has none."""
    more = ("book", "books", "edition", "first", "new", "revised", "second", "third")
    x, y = (content_tokens(c, (*STOP, *more, *stop)) for c in (a, b))
    return F.coalesce(F.size(F.array_intersect(x, y)) / F.when(F.least(F.size(x), F.size(y)) > 0, F.least(F.size(x), F.size(y))) >= least, F.lit(False))


def read_cache(spark, path: str) -> dict:
    """A cache file's object with its two maps; an empty cache where there is none or it is broken. It is read on the driver and small."""
    import json

    empty = {"version": 1, "by_isbn": {}, "by_douban_id": {}}
    try:
        data = json.loads("\n".join(r[0] for r in spark.read.text(path, wholetext=True).collect()))
    except Exception as e:  # a missing file is Spark's own error
        if isinstance(e, ValueError) or "PATH_NOT_FOUND" in str(e):
            return empty
        raise
    data = {**empty, **data} if isinstance(data, dict) else empty
    return data if isinstance(data["by_isbn"], dict) and isinstance(data["by_douban_id"], dict) else empty

"""Texts cut to parts: boundaries, slots, page ranges, headings, sections, sessions."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lectern.functions.text import strip

CHAPTER_NUMBER = ("^([0-9]+)\\.\\s", "(?i)^chapter\\s+([0-9]+)\\b", "^CH\\s*([0-9]+)\\b", "^第([0-9]+)章")
#: Titles of what surrounds a book's text, in lower case.
FURNITURE = frozenset(
    """index|cover|contents|copyright|dedication|epigraph|figures|series|illustrations|contributors|title page|half title|copyright page|acknowledgments|
    acknowledgements|table of contents|list of tables|list of figures|list of illustrations|list of abbreviations|list of contributors|notes on contributors|about the author|
    about the authors|about the book|about the publisher|author biographies|editorial board|目录|封面|版权页|作者简介|出版说明""".replace("\n    ", "").split("|")
)


def is_furniture(title: Column) -> Column:
    """Titles of covers, indexes and the like, and of parts of a book."""
    t = strip(F.coalesce(title, F.lit("")))
    return F.lower(t).isin(*sorted(FURNITURE)) | t.rlike("(?i)^(part\\s+[ivxlcdm0-9]+\\b|frontmatter$)")


def chapter_number(title: Column) -> Column:
    t = strip(title)
    return F.coalesce(*[F.when(t.rlike(p), F.regexp_extract(t, p, 1).cast("int")) for p in CHAPTER_NUMBER])


def letters(n: Column) -> Column:
    """0 as a, 25 as z, 26 as aa, and so on."""
    code = lambda x: F.char(x + 97)
    return F.when(n < 26, code(n)).otherwise(F.concat(code(F.floor((n - 26) / 26)), code(F.pmod(n - 26, F.lit(26)))))


def assign_slots(entries: DataFrame, book: str = "book", pos: str = "pos") -> DataFrame:
    """The entries (book, pos, title, ...) with their slot.

    Numbered chapters have their number; entries before the first 00a, 00b ..., after the last 99a ...,
    between chapters the chapter's number with b, c ...; with fewer than two numbered ones all count from 01.
    Equal numbers give equal slots.
    """
    n = chapter_number(F.col("title"))
    whole = Window.partitionBy(book)
    order = Window.partitionBy(book).orderBy(pos)
    rows = entries.withColumn("__n", n).withColumn("__many", F.count("__n").over(whole))
    has = F.col("__n").isNotNull()
    rows = rows.withColumn("__first", F.min(F.when(has, F.col(pos))).over(whole)).withColumn("__last", F.max(F.when(has, F.col(pos))).over(whole))
    rows = rows.withColumn("__seq", F.row_number().over(order)).withColumn("__chapter", F.last("__n", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    rows = rows.withColumn("__group", F.sum(F.when(has, 1).otherwise(0)).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    rows = rows.withColumn("__phase", F.when(has, 1).when(F.col(pos) < F.col("__first"), 0).when(F.col(pos) > F.col("__last"), 3).otherwise(2))
    rows = rows.withColumn("__idx", F.row_number().over(Window.partitionBy(book, "__phase", "__group").orderBy(pos)) - 1)
    two = lambda c: F.lpad(c.cast("string"), 2, "0")
    wide = lambda c: F.when(F.length(c.cast("string")) >= 2, c.cast("string")).otherwise(two(c))
    slot = (
        F.when(F.col("__many") < 2, wide(F.col("__seq")))
        .when(has, wide(F.col("__n")))
        .when(F.col("__phase") == 0, F.concat(F.lit("00"), letters(F.col("__idx"))))
        .when(F.col("__phase") == 3, F.concat(F.lit("99"), letters(F.col("__idx"))))
        .otherwise(F.concat(wide(F.col("__chapter")), letters(F.col("__idx") + 1)))
    )
    return rows.withColumn("slot", slot).drop(*[c for c in rows.columns if c.startswith("__")])


def slot_order(slot: Column) -> Column:
    """Numeric order of slots, unknown ones last."""
    digits = F.regexp_extract(slot, "^([0-9]+)", 1)
    return F.coalesce(F.when(F.length(digits).between(1, 6), digits.try_cast("int")), F.lit(1 << 30))


def page_ends(toc: DataFrame, last: str = "n_pages") -> DataFrame:
    """(book, start, ...) with end: the page before the next start, the book's last for the last entry."""
    after = F.lead("start").over(Window.partitionBy("book").orderBy("start", "pos"))
    return toc.withColumn("end", F.greatest("start", F.coalesce(after - 1, F.col(last))))


def pages_in_ranges(pages: DataFrame, specs: DataFrame) -> DataFrame:
    """(book, title, text): pages (book, page, text) of each range (book, title, start, end), in order."""
    hit = pages.join(specs, "book").where(F.col("page").between(F.col("start"), F.col("end")))
    return hit.groupBy("book", "title", "start").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("page", "text"))), lambda p: p["text"]), "\n").alias("text"))


def islands(lines: DataFrame, doc: str, pos: str, is_start: Column) -> DataFrame:
    """Lines with the number of the part they are in: 0 before the first start, then one more at each."""
    w = Window.partitionBy(doc).orderBy(pos).rowsBetween(Window.unboundedPreceding, 0)
    return lines.withColumn("part", F.sum(F.when(is_start, 1).otherwise(0)).over(w))


def sessions(events: DataFrame, key: str, ts: str, gap_seconds: int) -> DataFrame:
    """Events with their session's number: a new one after a gap of more than `gap_seconds`."""
    order = Window.partitionBy(key).orderBy(ts, *[c for c in ("event_id",) if c in events.columns])
    gap = F.unix_micros(F.col(ts).cast("timestamp")) - F.unix_micros(F.lag(ts).over(order).cast("timestamp"))
    rows = events.withColumn("__new", F.when(gap > gap_seconds * 1_000_000, 1).otherwise(0))
    return rows.withColumn("session", F.sum("__new").over(order.rowsBetween(Window.unboundedPreceding, 0))).drop("__new")


_FENCE = re.compile(r"^\x20{0,3}([`]{3,}|[~]{3,})(.*)$")
HEADINGS = T.ArrayType(T.StructType([T.StructField("line", T.IntegerType()), T.StructField("level", T.IntegerType()), T.StructField("title", T.StringType())]))
_HEADING = re.compile(r"^([#]{1,6})[ \t]+(.*?)[ \t]*#*[ \t]*$")


def outside_fences(text: str) -> Iterator[tuple[int, str, bool]]:
    """(line number from 1, line, whether it is outside fenced code) of a Markdown text."""
    mark = ""
    for n, line in enumerate(text.split("\n"), 1):
        m = _FENCE.match(line)
        if mark:
            yield n, line, False
            if m and m[1][0] == mark[0] and len(m[1]) >= len(mark) and not m[2].strip():
                mark = ""
        elif m and not (m[1][0] == "`" and "`" in m[2]):
            mark = m[1]
            yield n, line, False
        else:
            yield n, line, True


@F.pandas_udf(HEADINGS)
def headings(text: pd.Series) -> pd.Series:
    """Headings outside fenced code; a text is one state machine, so this is no built-in expression."""
    out = []
    for t in text:
        rows = []
        for n, line, plain in outside_fences(t or ""):
            m = _HEADING.match(line) if plain else None
            if m:
                rows.append({"line": n, "level": len(m[1]), "title": m[2]})
        out.append(rows)
    return pd.Series(out)


@F.pandas_udf(T.StringType())
def nested_headings(text: pd.Series) -> pd.Series:
    """Headings two levels down, the sixth at most, outside fenced code."""

    def nest(t: str | None) -> str | None:
        if t is None:
            return None
        lines = []
        for _, line, plain in outside_fences(t):
            m = _HEADING.match(line) if plain else None
            lines.append("#" * min(6, len(m[1]) + 2) + line[len(m[1]) :] if m else line)
        return "\n".join(lines)

    return text.map(nest)


def sections(docs: DataFrame, depth: int = 2) -> DataFrame:
    """(doc, idx, heading, level, start_line, end_line) of (doc, text): a heading of `depth` or less begins one; what is before the first is one without a heading."""
    total = F.size(F.split("text", "\n"))
    found = docs.select("doc", total.alias("n"), F.filter(headings(F.col("text")), lambda h: h["level"] <= depth).alias("h"))
    first = F.coalesce(F.get("h", F.lit(0))["line"], F.col("n") + 1)
    lead = F.when(first > 1, F.array(F.struct(F.lit(1).alias("line"), F.lit(0).alias("level"), F.lit(None).cast("string").alias("title")))).otherwise(F.array().cast("array<struct<line:int,level:int,title:string>>"))
    rows = found.select("doc", "n", F.posexplode(F.concat(lead, "h")).alias("idx", "s"))
    after = F.lead("s.line").over(Window.partitionBy("doc").orderBy("idx"))
    return rows.select("doc", "idx", F.col("s.title").alias("heading"), F.col("s.level").alias("level"), F.col("s.line").alias("start_line"), F.coalesce(after - 1, F.col("n")).alias("end_line"))


def level_drift(levels: Column) -> Column:
    """How far the least heading level is from 2, where no heading has level 2; else null."""
    return F.when((F.size(levels) > 0) & ~F.array_contains(levels, 2), F.array_min(levels) - 2)


BLOCKS = (("bullet-list", "^[-*]\\s+"), ("numbered-list", "^[0-9]+\\.\\s+"), ("table", "^\\|.*\\|$"), ("blockquote-list", "^>"), ("definition-list", "^\\*\\*[^*]{2,40}\\*\\*[:：]"))


def block_kind(line: Column) -> Column:
    out = F.when(line.rlike(BLOCKS[0][1]), BLOCKS[0][0])
    for name, pattern in BLOCKS[1:]:
        out = out.when(line.rlike(pattern), name)
    return out.otherwise("paragraph")


def modal(rows: DataFrame, key: str, value: str, pos: str, least: float = 0.6) -> DataFrame:
    """(key, kind, n, total): the most frequent value of each key, the one seen first on ties; 'mixed' under `least` of all."""
    counts = rows.groupBy(key, value).agg(F.count("*").alias("n"), F.min(pos).alias("first"))
    best = counts.groupBy(key).agg(F.min_by(F.struct(value, "n"), F.struct((-F.col("n")).alias("n"), "first")).alias("b"), F.sum("n").alias("total"))
    return best.select(key, F.when(F.col("b.n") / F.col("total") < least, "mixed").otherwise(F.col(f"b.{value}")).alias("kind"), F.col("b.n").alias("n"), "total")


def weighted_median(rows: DataFrame, key: str, value: str, weight: str) -> DataFrame:
    """(key, median): the least value at which half of the key's weight is reached."""
    by = rows.groupBy(key, value).agg(F.sum(weight).alias("w"))
    run = F.sum("w").over(Window.partitionBy(key).orderBy(value).rowsBetween(Window.unboundedPreceding, 0))
    total = F.sum("w").over(Window.partitionBy(key))
    return by.select(key, value, run.alias("run"), total.alias("total")).where("run >= total / 2").groupBy(key).agg(F.min(value).alias("median"))


def toc_levels(toc: DataFrame) -> DataFrame:
    """(book, pos, level, ...) with a table of contents' levels from 1 on, none more than one below the one before it.

    So the n-th level is the least of n and, over the entries up to it, of an entry's own level plus the places since: n
    plus a running minimum, in one window.
    """
    order = Window.partitionBy("book").orderBy(F.col("pos").asc_nulls_last())
    n = F.row_number().over(order)
    base = F.min("level").over(Window.partitionBy("book"))
    rows = toc.withColumns({"__n": n, "__base": base})
    least = F.min(F.col("level") - F.col("__base") + 1 - F.col("__n")).over(order.rowsBetween(Window.unboundedPreceding, 0))
    adjusted = (F.col("__n") + F.least(F.lit(0), least)).cast(toc.schema["level"].dataType)
    return rows.withColumn("level", adjusted).select(*toc.columns)


def split_page(page: Column, n_out: Column, translated: bool = False) -> Column:
    """A page's number where originals and translations take turns, within 1 .. n_out."""
    return F.greatest(F.lit(1), F.least(n_out, page * 2 - (0 if translated else 1)))

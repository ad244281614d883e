"""Titles, names and plain text as column expressions."""

from __future__ import annotations

import sys
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

ARTICLES = "^(the|a|an)\\s+"
CJK = "[\\x{3400}-\\x{9FFF}]"


def strip(text: Column) -> Column:
    """Without leading and trailing white space of any kind."""
    return F.regexp_replace(text, "^\\s+|\\s+$", "")


def collapse(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, "\\s+", " "))


def normal_title(text: Column) -> Column:
    """Lower case, characters other than letters, digits and _ as blanks, single blanks; null as ''."""
    return collapse(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), "(?U)[^\\w\\s]", " "))


def title_tokens(text: Column) -> Column:
    """The distinct words of the normal title."""
    return F.array_distinct(F.filter(F.split(normal_title(text), " "), lambda w: w != ""))


def title_keys(text: Column) -> Column:
    """The whole title and what is before its first colon, each normal and without a leading article; distinct, '' left out."""
    both = F.array(text, F.element_at(F.split(text, "[:：]", 2), 1))
    keys = F.transform(both, lambda t: F.regexp_replace(normal_title(t), ARTICLES, ""))
    return F.when(text.isNull(), F.array().cast("array<string>")).otherwise(F.array_distinct(F.filter(keys, lambda k: k != "")))


def surnames(authors: Column) -> Column:
    """Lower-case surnames: the last word before a comma, or of the whole name."""
    last = lambda a: F.element_at(F.split(collapse(F.regexp_replace(F.element_at(F.split(a, ","), 1), "(?U)[^\\w\\s]+", " ")), " "), -1)
    return F.array_distinct(F.filter(F.transform(F.filter(authors, lambda a: a.isNotNull()), lambda a: F.lower(last(a))), lambda s: s != ""))


def jaccard_title(a: Column, b: Column) -> Column:
    """Shared share of the distinct title words; 1 where one title's words are all in the other's; 0 where either has none."""
    x, y = title_tokens(a), title_tokens(b)
    both = F.size(F.array_intersect(x, y))
    return token_jaccard(both, F.size(x), F.size(y))


def token_jaccard(both: Column, n_a: Column, n_b: Column) -> Column:
    """`jaccard_title` from the numbers of shared words and of each side's."""
    ratio = F.when(both == F.least(n_a, n_b), 1.0).otherwise(both / (n_a + n_b - both))
    return F.when((n_a == 0) | (n_b == 0), 0.0).otherwise(ratio)


STOP = ("about", "and", "are", "edition", "for", "from", "into", "that", "the", "this", "with")


def content_tokens(text: Column, stop: tuple[str, ...] = STOP) -> Column:
    """Distinct ASCII words of at least three letters or digits, without stop words."""
    words = F.split(collapse(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), "[^a-z0-9\\s]", " ")), " ")
    return F.array_except(F.array_distinct(F.filter(words, lambda w: F.length(w) > 2)), F.array(*[F.lit(s) for s in stop]))


def overlap(a: Column, b: Column) -> Column:
    """Shared share of the smaller side's content words."""
    x, y = content_tokens(a), content_tokens(b)
    least = F.least(F.size(x), F.size(y))
    return F.when(least == 0, 0.0).otherwise(F.size(F.array_intersect(x, y)) / least)


def _combining() -> str:
    """A pattern for the characters with a combining class."""
    marks = [i for i in range(sys.maxunicode + 1) if unicodedata.combining(chr(i))]
    begins = [i for n, i in enumerate(marks) if not n or marks[n - 1] != i - 1]
    ends = [i for n, i in enumerate(marks) if n + 1 == len(marks) or marks[n + 1] != i + 1]
    # most characters are told by their category, so that they needn't be held against all ranges
    return "[[\\p{M}\\p{Cn}]&&[" + "".join(f"\\x{{{a:X}}}-\\x{{{b:X}}}" for a, b in zip(begins, ends, strict=True)) + "]]"


COMBINING = _combining()


def without_accents(text: Column) -> Column:
    """Decomposed (NFKD), without combining marks, by the ICU library that Spark brings; plain ASCII stays as it is."""
    whole = F.java_method(F.lit("com.ibm.icu.text.Normalizer"), F.lit("decompose"), text, F.lit(True))
    return F.when(text.rlike("[^\\x00-\\x7F]"), F.regexp_replace(whole, COMBINING, "")).otherwise(text)


def surname_slug(name: Column) -> Column:
    """Lower case, no accents or apostrophes, words joined by hyphens, ASCII letters and digits only."""
    bare = F.regexp_replace(without_accents(strip(name)), "['’`]", "")
    return F.lower(F.regexp_replace(F.regexp_replace(bare, "\\s+", "-"), "[^0-9A-Za-z-]", ""))


def author_parts(raw: Column) -> Column:
    """struct(first, slug, others, et_al, is_cjk) of a citation's authors; a CJK surname is its own slug."""
    et_al = "(?i)\\bet\\s*\\.?\\s*al\\b\\.?"
    work = F.regexp_replace(F.regexp_replace(F.regexp_replace(raw, et_al, ""), "\\s+", " "), "^[ .,，]+|[ .,，]+$", "")
    parts = F.filter(F.transform(F.split(work, "\\s*(?:&|\\band\\b|与)\\s*"), lambda p: F.trim(p)), lambda p: p != "")
    first = F.when(F.size(parts) > 0, F.get(parts, F.lit(0))).otherwise(work)
    cjk = first.rlike(CJK)
    return F.struct(
        first.alias("first"),
        F.when(cjk, first).otherwise(surname_slug(first)).alias("slug"),
        F.slice(parts, 2, 1000).alias("others"),
        raw.rlike(et_al).alias("et_al"),
        cjk.alias("is_cjk"),
    )


def latin_letters(text: Column) -> Column:
    return F.length(F.regexp_replace(text, "[^A-Za-z]", ""))


def han_letters(text: Column) -> Column:
    return F.length(F.regexp_replace(text, "[^\\x{4E00}-\\x{9FFF}]", ""))


def cjk_dominant(text: Column) -> Column:
    return han_letters(text) > latin_letters(text)


def clean_text(text: Column) -> Column:
    """Without terminal colour codes, control and format characters."""
    return F.regexp_replace(F.regexp_replace(text, "\\x1b\\[[0-9;?]*[ -/]*[@-~]", ""), "[\\p{Cc}\\p{Cf}]", "")


def join_hyphenated(text: Column) -> Column:
    """Words broken by a hyphen at a line's end put together, unless an 'or', 'and', 'to', 'but' or 'nor' follows."""
    return F.regexp_replace(text, "-\\n(?!(?:and|but|nor|or|to)\\b)([a-z]+)", "$1")


def heading_slug(text: Column, most: int = 40) -> Column:
    """Lower case; runs of other characters than letters, digits and CJK as one hyphen; at most `most` characters."""
    s = F.regexp_replace(F.lower(text), "[^a-z0-9\\x{4E00}-\\x{9FFF}]+", "-")
    return F.regexp_replace(F.substring(F.regexp_replace(s, "^-+|-+$", ""), 1, most), "-+$", "")


def year_in(value: Column) -> Column:
    """A whole number or four digits from 1500 to 2030, else null."""
    n = F.when(strip(value.cast("string")).rlike("^[0-9]{4}$"), strip(value.cast("string")).cast("int"))
    return F.when(n.between(1500, 2030), n)


def stars(text: Column) -> Column:
    """The number of ★, if it is 1 to 5."""
    n = F.length(text) - F.length(F.replace(text, F.lit("★"), F.lit("")))
    return F.when(n.between(1, 5), n)


def people(value: Column) -> Column:
    """Names parted by slashes."""
    return F.filter(F.transform(F.split(value, "/"), strip), lambda p: p != "")


def inverted_index_text(index: Column) -> Column:
    """map(word, positions) as the text that it stands for."""
    entries = F.flatten(F.transform(F.map_entries(index), lambda e: F.transform(e["value"], lambda p: F.struct(p.alias("at"), e["key"].alias("word")))))
    return F.array_join(F.transform(F.array_sort(entries), lambda e: e["word"]), " ")


def word_positions(rows: DataFrame, key: str, words: str) -> DataFrame:
    """(key, index map<string,array<int>>) of rows with a list of words: each word's places, without any shuffle. A null list has an empty index."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(1).fill_null([])
            flat = lists.flatten()
            row = np.repeat(np.arange(len(lists)), pc.list_value_length(lists).to_numpy(zero_copy_only=False))
            coded = flat.dictionary_encode()
            many = max(1, len(coded.dictionary))
            word = row * many + coded.indices.to_numpy(zero_copy_only=False)
            order = np.argsort(word, kind="stable")
            first = np.flatnonzero(np.concatenate([[True], np.diff(word[order]) != 0])) if len(word) else np.empty(0, np.int64)
            begin = np.searchsorted(row, np.arange(len(lists)))
            places = (np.arange(len(row)) - begin[row])[order].astype(np.int32)
            entries = pa.ListArray.from_arrays(pa.array(np.append(first, len(word)).astype(np.int32)), pa.array(places))
            kinds = word[order][first]
            of = np.searchsorted(kinds // many, np.arange(len(lists) + 1)).astype(np.int32)
            index = pa.MapArray.from_arrays(pa.array(of), coded.dictionary.take(pa.array(kinds % many)), entries)
            yield pa.RecordBatch.from_arrays([batch.column(0), index], [key, "index"])

    out = T.StructType([rows.schema[key], T.StructField("index", T.MapType(T.StringType(), T.ArrayType(T.IntegerType())))])
    return rows.select(key, words).mapInArrow(run, out)


YEAR = "\\b((?:19|20)[0-9]{2})\\b"


def year_signals(text: Column) -> Column:
    """struct(first_published, copyright_year, original_year, other_years, best_guess) of a title page's text.

    The first of first_published, copyright_year and the largest year; where that is the copyright year and a
    later one up to two years on is in the text, that one.
    """
    pick = lambda *ps: F.coalesce(*[F.when(F.regexp_extract(text, p, 1) != "", F.regexp_extract(text, p, 1).cast("int")) for p in ps])
    first = pick("(?i)first\\s+(?:published|edition)[^0-9]{0,40}((?:19|20)[0-9]{2})", "(?i)published\\s+in\\s+((?:19|20)[0-9]{2})")
    copyright_ = pick("(?i)copyright[^0-9]{0,40}((?:19|20)[0-9]{2})", "©[^0-9]{0,40}((?:19|20)[0-9]{2})")
    original = pick("(?i)originally\\s+published[^0-9]{0,80}((?:19|20)[0-9]{2})")
    years = F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(YEAR), 1), lambda y: y.cast("int")))
    guess = F.coalesce(first, copyright_)
    later = F.get(F.filter(years, lambda y: (y > copyright_) & (y <= copyright_ + 2) & ~y.eqNullSafe(original)), F.lit(0))
    best = F.when(guess == copyright_, F.coalesce(later, guess)).otherwise(F.coalesce(guess, F.array_max(years)))
    return F.struct(first.alias("first_published"), copyright_.alias("copyright_year"), original.alias("original_year"), years.alias("other_years"), best.alias("best_guess"))

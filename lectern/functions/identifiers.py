"""Identifiers, addresses and keys as column expressions."""

from __future__ import annotations

import re
from urllib.parse import urlsplit

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from lectern.functions.text import strip


def isbn_digits(value: Column) -> Column:
    """The first ISBN-like token's digits (and X), if they are 10 or 13; else null."""
    token = F.regexp_extract(value.cast("string"), "((?:[0-9][\\s-]?){9,12}[0-9Xx])", 1)
    raw = F.regexp_replace(F.upper(token), "[^0-9X]", "")
    return F.when(F.length(raw).isin(10, 13), raw)


def isbn13_check(twelve: Column) -> Column:
    """The check digit of twelve digits."""
    total = F.aggregate(F.sequence(F.lit(1), F.lit(12)), F.lit(0), lambda s, i: s + F.substring(twelve, i, F.lit(1)).cast("int") * F.when(i % 2 == 1, 1).otherwise(3))
    return F.pmod(10 - total % 10, F.lit(10)).cast("string")


def isbn13(value: Column) -> Column:
    """The ISBN-13 of an ISBN-10 or ISBN-13 in any spelling; null for anything else. Check digits given aren't tested."""
    raw = F.regexp_replace(F.upper(value.cast("string")), "[^0-9X]", "")
    body = F.concat(F.lit("978"), F.substring(raw, 1, 9))
    return F.when(raw.rlike("^[0-9]{13}$"), raw).when(raw.rlike("^[0-9]{9}[0-9X]$"), F.concat(body, isbn13_check(body)))


def doi(value: Column) -> Column:
    """A DOI in lower case without resolver address or 'doi:'; null for an empty one."""
    text = F.regexp_replace(F.regexp_replace(F.lower(strip(value)), "^(https?://)?(dx\\.)?doi\\.org/", ""), "^doi:\\s*", "")
    return F.when(text != "", text)


def first_doi(text: Column) -> Column:
    found = F.regexp_extract(text, "(?i)\\b(10\\.[0-9]{4,9}/[a-z0-9:/()._;-]+)\\b", 1)
    return F.when(found != "", found)


def dois_in(text: Column) -> Column:
    """All distinct DOIs of a text, in lower case, without punctuation at their end."""
    found = F.regexp_extract_all(text, F.lit("(?i)\\b(10\\.[0-9]{4,9}/[^\\s\"<>]+)"), 1)
    return F.array_distinct(F.transform(found, lambda d: F.lower(F.regexp_replace(d, "[.,;:)\\]]+$", ""))))


_URL = "^([A-Za-z][A-Za-z0-9+.-]*)://([^/?#]*)([^?#]*)(\\?[^#]*)?"


def web_url(raw: Column) -> Column:
    """The one spelling by which web addresses are compared; null for what isn't one.

    Scheme and host in lower case, no default port, no fragment, "/" for an empty path, the query kept.
    Addresses with credentials, control characters, a bad port or another scheme than http(s) are refused.
    """
    scheme, authority = F.lower(F.regexp_extract(raw, _URL, 1)), F.regexp_extract(raw, _URL, 2)
    host, port = F.lower(F.regexp_extract(authority, "^(\\[[^\\]]*\\]|[^:]*)", 1)), F.regexp_extract(authority, ":([0-9]*)$", 1)
    path, query = F.regexp_extract(raw, _URL, 3), F.regexp_extract(raw, _URL, 4)
    default = (port == "") | ((scheme == "http") & (port == "80")) | ((scheme == "https") & (port == "443"))
    good = scheme.isin("http", "https") & ~authority.contains("@") & (host != "") & ~raw.rlike("[\\x00-\\x1f\\x7f]")
    good = good & authority.rlike("^(\\[[^\\]]*\\]|[^:]*)(:[0-9]{0,5})?$") & ((port == "") | (port.cast("int") <= 65535))
    full = F.concat(scheme, F.lit("://"), host, F.when(default, "").otherwise(F.concat(F.lit(":"), port)), F.when(path == "", "/").otherwise(path), F.when(query == "?", "").otherwise(query))
    return F.when(good, full)


def collision_slug(base: Column, url: Column) -> Column:
    """A slug made unlike others by eight hexadecimal digits of its address; at most 80 characters."""
    return F.concat(F.regexp_replace(F.substring(base, 1, 71), "-+$", ""), F.lit("-"), F.substring(F.sha2(url, 256), 1, 8))


def valid_slug(value: Column) -> Column:
    return F.coalesce(value.rlike("^[0-9a-z][0-9a-z-]*$") & F.length(value).between(2, 80), F.lit(False))


def slug_year(slug: Column) -> Column:
    """struct(body, year) of a slug that ends in a year; the year is null for others."""
    year = F.regexp_extract(slug, "-([0-9]{4})$", 1)
    return F.struct(F.regexp_replace(slug, "-[0-9]{4}$", "").alias("body"), F.when(year != "", year.cast("int")).alias("year"))


def author_prefixes(body: Column) -> Column:
    """The first one, two and three parts of a hyphenated slug; distinct."""
    parts = F.split(body, "-")
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.least(F.lit(3), F.size(parts))), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "-")))


def language_tag(value: Column) -> Column:
    """The language in lower case, parts of two letters behind it in capitals, others in lower case; zh-CN as zh. Null for what is no tag."""
    shaped = F.transform(F.split(value, "-"), lambda p, i: F.when((i > 0) & p.rlike("^[A-Za-z]{2}$"), F.upper(p)).otherwise(F.lower(p)))
    tag = F.array_join(shaped, "-")
    return F.when(value.rlike("^[A-Za-z]{2,8}(-[A-Za-z0-9]{2,8}){0,3}$"), F.when(tag == "zh-CN", "zh").otherwise(tag))


_ADDRESS = re.compile(r"https?://[^\s<>\"']+")
_SECRET = re.compile(r"(?i)\b(bearer|cookie|authorization|token|api[_-]?key)(\s*[:=]\s*|\s+)[^\s,;]+")
HIDDEN = "<redacted>"


def _bare_address(found: re.Match) -> str:
    raw = found[0].rstrip(".,);]")
    try:
        u = urlsplit(raw)
        place = (u.hostname or "") + (f":{u.port}" if u.port else "")
    except ValueError:
        return f"<redacted-url>{found[0][len(raw) :]}"
    more = f"?{HIDDEN}" if u.query or u.fragment or u.username or u.password else ""
    return f"{u.scheme}://{place}{u.path}{more}{found[0][len(raw) :]}"


def redacted(text: str, secrets: tuple[str, ...] = (), most: int = 4000) -> str:
    for s in sorted(filter(None, secrets), key=len, reverse=True):
        text = text.replace(s, HIDDEN)
    return _SECRET.sub(lambda m: m[1] + m[2] + HIDDEN, _ADDRESS.sub(_bare_address, text))[:most]


def redact(text: Column, secrets: tuple[str, ...] = (), most: int = 4000) -> Column:
    """Given secrets, what web addresses carry besides host and path, and values behind names of secrets as <redacted>; at most `most` characters.

    Hosts are put in lower case, which no pattern's replacement can do, so this is a Python function over Arrow batches.
    """

    @F.pandas_udf(StringType())
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: None if t is None else redacted(t, secrets, most))

    return run(text)


_LINK = "\\[\\[([^\\]|]+)(?:\\|([^\\]]+))?\\]\\]"


def wikilink_slug(value: Column) -> Column:
    """What a value that begins with a wiki link points to; '' for others."""
    return F.coalesce(F.regexp_extract(strip(value), f"^{_LINK}", 1), F.lit(""))


def wikilink_display(value: Column) -> Column:
    """How a wiki link is shown, or the value without double quotes around it."""
    v = F.coalesce(strip(value), F.lit(""))
    shown = F.regexp_extract(v, f"^{_LINK}", 2)
    return F.when(wikilink_slug(v) != "", F.when(shown != "", shown).otherwise(wikilink_slug(v))).otherwise(F.regexp_replace(v, '^"+|"+$', ""))


def without_wikilinks(value: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(value, "\\[\\[[^\\]|]+\\|([^\\]]+)\\]\\]", "$1"), "\\[\\[([^\\]]+)\\]\\]", "$1")


def clean_authors(names: Column) -> Column:
    """Names without wiki links, blanks and quotes around them; empty ones left out."""
    bare = lambda n: strip(F.regexp_replace(strip(without_wikilinks(n)), "^['\"]+|['\"]+$", ""))
    return F.coalesce(F.filter(F.transform(names, bare), lambda n: n != ""), F.array().cast("array<string>"))


def clean_title(title: Column, authors: Column) -> Column:
    """A title without wiki links and stars, its first author and a comma before it, and the words for an overview behind it."""
    t = F.regexp_replace(without_wikilinks(F.coalesce(strip(title), F.lit(""))), "\\*+([^*]+)\\*+", "$1")
    first = F.coalesce(F.get(authors, F.lit(0)), F.lit(""))
    led = (first != "") & F.startswith(F.lower(t), F.concat(F.lower(first), F.lit(",")))
    t = F.when(led, F.regexp_replace(F.substring(t, F.length(first) + 2, F.length(t)), "^\\s+", "")).otherwise(t)
    return strip(F.regexp_replace(t, "\\s*(?:\\([0-9]{4}\\)\\s*)?[—-]\\s*书籍?概览\\s*$", ""))


def before_colon(title: Column) -> Column:
    """What is before a title's first colon; null without one."""
    return F.when(title.contains(":"), strip(F.element_at(F.split(title, ":"), 1)))


def last_name(author: Column) -> Column:
    return F.coalesce(F.element_at(F.split(strip(author), "\\s+"), -1), F.lit(""))


def pick_isbn(isbns: Column) -> Column:
    """The first ISBN of 13 digits, else the first one's digits and X; null for none."""
    long_ = F.filter(F.transform(isbns, lambda i: F.regexp_replace(i, "[^0-9]", "")), lambda d: F.length(d) == 13)
    first = F.regexp_replace(F.upper(F.get(isbns, F.lit(0))), "[^0-9X]", "")
    return F.coalesce(F.get(long_, F.lit(0)), F.when(first != "", first))


def fingerprint(*columns: Column) -> Column:
    """SHA-256 of the values as JSON with sorted names; nulls count."""
    named = sorted(columns, key=lambda c: c._jc.toString())
    return F.sha2(F.to_json(F.struct(*named), {"ignoreNullFields": "false"}), 256)


def epoch_ms_date(ms: Column) -> Column:
    return F.timestamp_millis(ms.cast("long")).cast("date")


def subject_url(raw: Column) -> Column:
    """The one spelling of a subject's address, by its number; null for its child pages and others."""
    pattern = "^https?://book\\.douban\\.com/subject/([0-9]+)/*(?:[?][^#]*)?(?:#.*)?$"
    number = F.regexp_extract(strip(raw), pattern, 1)
    return F.when(number != "", F.concat(F.lit("https://book.douban.com/subject/"), number, F.lit("/")))


def whole_second_utc(ts: Column) -> Column:
    """A timestamp as UTC to the second, with a Z."""
    return F.date_format(F.to_utc_timestamp(ts, F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss'Z'")


def file_name(slot: Column, title: Column, ext: str = "txt") -> Column:
    """slot_title.ext, the title cut to 50 characters of letters, digits, blanks and hyphens, blanks as underscores."""
    safe = F.substring(F.regexp_replace(F.coalesce(title, F.lit("")), "(?U)[^\\w\\s-]", ""), 1, 50)
    return F.concat(slot, F.lit("_"), F.regexp_replace(F.regexp_replace(safe, "\\s+", "_"), "^_+|_+$", ""), F.lit(f".{ext}"))


def chapter_slug(slot: Column, title: Column) -> Column:
    """A chapter's slug: its title without the chapter's number, in ASCII; section-slot where nothing is left; at most 60 characters, cut at a hyphen."""
    from lectern.functions.text import without_accents
    from lectern.operators.segment import CHAPTER_NUMBER

    t = F.coalesce(strip(title), F.lit(""))
    rest = t
    for p in reversed(CHAPTER_NUMBER):
        rest = F.when(t.rlike(p), F.regexp_replace(t, p, "")).otherwise(rest)
    rest = F.regexp_replace(rest, "^[ :：.—–\\t-]+|[ :：.—–\\t-]+$", "")
    base = F.when(rest.rlike("(?U)\\w"), rest).otherwise(t)
    hyphens = lambda c: F.lower(F.regexp_replace(F.regexp_replace(c, "[^A-Za-z0-9]+", "-"), "^-+|-+$", ""))
    plain = hyphens(F.regexp_replace(without_accents(base), "[^\\x00-\\x7f]", ""))
    bare = hyphens(F.lower(slot))
    s = F.when(plain != "", plain).otherwise(F.concat(F.lit("section-"), F.when(bare != "", bare).otherwise("00")))
    cut = F.regexp_extract(F.substring(s, 1, 60), "^(.*)-[^-]*$", 1)
    return F.regexp_replace(F.when(F.length(s) > 60, F.when(cut != "", cut).otherwise(F.substring(s, 1, 60))).otherwise(s), "^-+|-+$", "")


def filter_signature() -> str:
    """A digest of the titles that are left out of books; it changes with any of them."""
    import hashlib
    import json

    from lectern.operators.segment import FURNITURE

    return hashlib.sha256(json.dumps(sorted(FURNITURE), ensure_ascii=False).encode()).hexdigest()

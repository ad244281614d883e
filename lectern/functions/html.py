"""HTML as text, by expressions alone."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

ENTITIES = {"&nbsp;": " ", "&lt;": "<", "&gt;": ">", "&quot;": '"', "&#39;": "'", "&apos;": "'", "&mdash;": "—", "&ndash;": "–", "&hellip;": "…", "&amp;": "&"}


def unescape(text: Column) -> Column:
    """The usual named entities; & last, so that nothing is decoded twice."""
    return reduce(lambda c, e: F.replace(c, F.lit(e[0]), F.lit(e[1])), ENTITIES.items(), text)


def html_text(html: Column) -> Column:
    """Without scripts, styles, comments and tags; blocks end lines; lines stripped, blank ones left out."""
    out = F.regexp_replace(html, "(?is)<(script|style|noscript)\\b.*?</\\1\\s*>", " ")
    out = F.regexp_replace(F.regexp_replace(out, "(?s)<!--.*?-->", " "), "(?i)<(?:br|/p|/div|/li|/h[1-6]|/tr|/title)\\b[^>]*>", "\n")
    out = F.regexp_replace(unescape(F.regexp_replace(out, "(?s)<[^>]*>", " ")), "[ \\t\\r\\x{A0}]+", " ")
    return F.regexp_replace(F.regexp_replace(out, " *\\n[ \\n]*", "\n"), "^[ \\n]+|[ \\n]+$", "")


def html_title(html: Column) -> Column:
    """The title's text with single blanks; null where there is none."""
    found = F.trim(F.regexp_replace(unescape(F.regexp_extract(html, "(?is)<title[^>]*>(.*?)</title", 1)), "\\s+", " "))
    return F.when(found != "", found)


def html_site(html: Column, url: Column) -> Column:
    """The site's name from its meta tag, else the address's host."""
    found = F.regexp_extract(html, "(?is)<meta\\s[^>]*property=[\"']og:site_name[\"'][^>]*content=[\"']([^\"']*)", 1)
    return F.when(found != "", unescape(found)).otherwise(F.lower(F.regexp_extract(url, "^[A-Za-z][A-Za-z0-9+.-]*://([^/?#:]*)", 1)))

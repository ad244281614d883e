"""URL filters: a trie over reversed host labels and path segments, with the longest match deciding.

An entry is `host` or `host/path`: it covers the host and all hosts below it, and there the path and
all paths below it. Of the entries that cover a URL the one with most host labels decides, of these
the one with most path segments; where the same place is both allowed and blocked, the block holds.

Plan: one scan, no shuffle. The entries' size is measured; up to TRIE_BYTES a trie of them goes to
the tasks by broadcast, and each distinct URL prefix costs a walk of its labels. Beyond that the URLs'
prefixes (labels times segments) are joined to the entries by an ordinary equi-join and the longest
match is taken by an aggregate; both ways give the same rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lectern.llm._tables import read_table
from lectern.llm._text import lean

#: Size of all entries' text up to which they are broadcast (a trie takes some 20 times that).
TRIE_BYTES = 8 << 20
SPAM = ("adult-x", "casino-win", "cheap-pills", "free-bets", "spam-farm", "ads-track")
#: (entry, rule): the policy that op1_url_filter applies.
POLICY = [
    *[(f"{name}.example.{top}", "block") for name in SPAM for top in ("com", "net", "org")],
    ("ads-track.example.com/en", "allow"),
    ("ads-track.example.net/en", "allow"),
    ("ads-track.example.org/en", "allow"),
    ("m.ads-track.example.com/en/private", "block"),
    ("blog.adult-x.example.net/de", "allow"),
    ("example.net/private", "block"),
    ("example.org/login", "block"),
]
_URL = re.compile(r"^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:]*)(?::[0-9]*)?([^?#]*)", re.S)


def parts(url: str | None) -> tuple[list[str], list[str]] | None:
    """Reversed host labels and path segments; None for what is no absolute URL with a host.

    Scheme, user, port, query and fragment don't count; hosts are in lower case without a closing
    dot; empty path segments are left out; paths keep their case.
    """
    m = _URL.match(url) if url else None
    host = m.group(1).lower().removesuffix(".") if m else ""
    if not host or ".." in host or host.startswith("."):
        return None
    return host.split(".")[::-1], [s for s in m.group(2).split("/") if s]


class UrlTrie:
    """Nodes are dictionaries by host label; under "/" hangs a host's trie of path segments; under "" a node's rules."""

    def __init__(self, entries: list[tuple[str | None, str | None]]):
        self.root: dict = {}
        for entry, rule in entries:
            got = parts("x://" + entry) if entry else None
            if got is None or rule not in ("allow", "block"):
                continue
            node = self.root
            for label in got[0]:
                node = node.setdefault(label, {})
            node = node.setdefault("/", {})
            for segment in got[1]:
                node = node.setdefault("s" + segment, {})
            if node.get("", ("",))[0] != "block":
                node[""] = (rule, ".".join(got[0][::-1]) + "".join("/" + s for s in got[1]))

    def match(self, url: str | None) -> tuple[str, str] | None:
        """(rule, entry) of the longest match."""
        got = parts(url)
        if got is None:
            return None
        node, best = self.root, None
        for label in got[0]:
            node = node.get(label)
            if node is None:
                break
            at = node.get("/")
            if at is None:
                continue
            here = at.get("")
            for segment in got[1]:
                at = at.get("s" + segment)
                if at is None:
                    break
                here = at.get("", here)
            best = here or best
        return best


def _matcher(shared, column: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie = None
        for batch in batches:
            trie = trie or UrlTrie(shared.value)
            found = [trie.match(u) or (None, None) for u in batch.column(column).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.string())], [*batch.schema.names, "rule", "entry"])

    return run


def _split(url):
    """(labels of the host, segments of the path) as columns, both null where `parts` gives None."""
    host = F.regexp_replace(F.lower(F.regexp_extract(url, _URL.pattern.replace(r"\-", "-"), 1)), "\\.$", "")
    good = (host != "") & ~host.contains("..") & ~host.startswith(".")
    path = F.regexp_extract(url, _URL.pattern.replace(r"\-", "-"), 2)
    return F.when(good, F.split(host, "\\.")), F.when(good, F.filter(F.split(path, "/"), lambda s: s != ""))


def _by_join(urls: DataFrame, entries: DataFrame) -> DataFrame:
    """(url, rule, entry) of the distinct urls that any entry covers."""
    labels, segments = _split(F.concat(F.lit("x://"), F.col("entry")))
    rules = entries.where("rule in ('allow', 'block')").select(labels.alias("l"), segments.alias("s"), "rule").where("l is not null")
    join = lambda l, s: F.concat(F.array_join(l, "."), F.when(F.size(s) > 0, F.concat(F.lit("/"), F.array_join(s, "/"))).otherwise(""))  # noqa: E731, E741
    most_l, most_s = rules.agg(F.max(F.size("l")), F.max(F.size("s"))).first()  # longer prefixes are no entry
    rules = rules.select(join(F.col("l"), F.col("s")).alias("entry"), "rule").groupBy("entry").agg(F.max("rule").alias("rule"))
    labels, segments = _split(F.col("url"))
    u = urls.select("url", labels.alias("l"), segments.alias("s")).where("l is not null")
    u = u.select("url", "l", "s", F.explode(F.sequence(F.lit(1), F.least(F.size("l"), F.lit(most_l or 1)))).alias("n_l"))
    u = u.select("url", "l", "s", "n_l", F.explode(F.sequence(F.lit(0), F.least(F.size("s"), F.lit(most_s or 0)))).alias("n_s"))
    u = u.select("url", "n_l", "n_s", join(F.expr("slice(l, size(l) - n_l + 1, n_l)"), F.expr("slice(s, 1, n_s)")).alias("entry"))
    return u.join(rules, "entry").groupBy("url").agg(F.max_by(F.struct("rule", "entry"), F.struct("n_l", "n_s")).alias("m")).select("url", "m.rule", "m.entry")


def apply_policy(pages: DataFrame, entries: DataFrame, url: str = "url", trie_bytes: int = TRIE_BYTES) -> DataFrame:
    """The pages' columns and rule ('allow', 'block', null for none), entry (the one that decided) and kept (not blocked).

    `entries` has the columns entry and rule. Null, empty or relative URLs match nothing and are kept;
    null or malformed entries and rules other than 'allow' and 'block' are left out; repeated entries
    and rows change nothing for others. Empty tables are no special case. Columns of the pages named
    rule, entry or kept are replaced, others pass through.
    """
    spark = pages.sparkSession
    pages = pages.drop("rule", "entry", "kept")
    entries = entries.select(F.col("entry").cast("string"), F.col("rule").cast("string"))
    size = entries.agg(F.sum(F.coalesce(F.octet_length("entry"), F.lit(0)) + 16)).first()[0] or 0
    if size <= trie_bytes:
        shared = spark.sparkContext.broadcast([tuple(r) for r in entries.collect()])
        schema = T.StructType([*pages.schema.fields, T.StructField("rule", T.StringType()), T.StructField("entry", T.StringType())])
        out = pages.mapInArrow(lean(_matcher(shared, pages.columns.index(url))), schema)
    else:
        found = _by_join(pages.select(F.col(f"`{url}`").alias("url")).distinct(), entries).withColumnRenamed("url", "_lectern_url")
        out = pages.join(found, pages[url] == found["_lectern_url"], "left").drop("_lectern_url")
    return out.withColumn("kept", F.coalesce(F.col("rule") != "block", F.lit(True)))


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's URL with the entry that decides on it and whether the page stays."""
    entries = spark.createDataFrame(POLICY, "entry string, rule string")
    return apply_policy(read_table(spark, sf_dir, "pages").select("page_id", "url"), entries)


_VALUES = ", ".join(f"('{e}', '{r}')" for e, r in POLICY)
_RE = r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)(?::[0-9]*)?([^?#]*)"
ORACLE_SQL = f"""
WITH policy(entry, rule) AS (VALUES {_VALUES}),
u AS (SELECT page_id, url, string_split(lower(regexp_extract(url, '{_RE}', 1)), '.') AS l,
        list_filter(string_split(regexp_extract(url, '{_RE}', 2), '/'), lambda x: x <> '') AS s FROM pages),
p AS (SELECT page_id, a.i AS i, b.j AS j,
        array_to_string(l[len(l) - a.i + 1:], '.') || CASE WHEN b.j > 0 THEN '/' || array_to_string(s[1:b.j], '/') ELSE '' END AS entry
      FROM u, unnest(range(1, len(l) + 1)) a(i), unnest(range(0, len(s) + 1)) b(j)),
m AS (SELECT p.page_id, policy.rule, policy.entry, row_number() OVER (PARTITION BY p.page_id ORDER BY i DESC, j DESC, policy.rule DESC) AS r
      FROM p JOIN policy USING (entry))
SELECT u.page_id, u.url, m.rule, m.entry, coalesce(m.rule <> 'block', true) AS kept FROM u LEFT JOIN m ON u.page_id = m.page_id AND m.r = 1
"""

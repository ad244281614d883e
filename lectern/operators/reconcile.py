"""Records of several sources reconciled: match, cluster, merge, conflicts, order.

Records have (rid, src, src_ord, pos, title, authors, year, publisher, isbn_13, isbn_10, doi, ...), of
which those a kind lacks are left out. Input order is (src_ord, pos).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.functions.text import title_tokens, token_jaccard
from lectern.operators.components import components
from lectern.sources.tables import keep, spread

SIMILAR = 0.85
#: A word of more titles than this is frequent.
HOT = 20_000


@dataclass(frozen=True)
class Kind:
    """What identifies a kind of record, whose word counts for a field, and which fields may conflict."""

    keys: tuple[str, ...]
    priority: dict[str, tuple[str, ...]]
    conflicts: tuple[str, ...]
    order: tuple[str, ...] = field(default=())


def is_empty(c: Column, kind: str = "string") -> Column:
    """Null, '' or an empty collection; 0 and false aren't empty."""
    if kind.startswith(("array", "map")):
        return c.isNull() | (F.size(c) == 0)
    return c.isNull() | (c == "") if kind == "string" else c.isNull()


def title_pairs(records: DataFrame, similar: float = SIMILAR) -> DataFrame:
    """(a, b), a < b: alike in title, with years at most one apart.

    Each title is looked up by its rarest words alone, as many as must hold one that a similar title has
    (and its rarest, for a title that holds all of its words), so frequent words make no blocks.
    """
    known = records.where("coalesce(year, 0) <> 0").select("rid", "year", title_tokens(F.col("title")).alias("words"))
    words = known.select("rid", "year", F.explode("words").alias("word"))
    rows = records.count()
    rank = keep(words.groupBy("word").agg(F.count("*").alias("n")), "words")
    # words of very many titles would lie in one task of a join; they are few, so they are sent to all
    hot = rank.where(F.col("n") > HOT).select(F.col("word").alias("__w"), F.col("n").alias("__n"))
    counted = words.join(F.broadcast(hot), F.col("word") == F.col("__w"), "left")
    often = counted.where("__n is not null").select("rid", "year", "word", F.col("__n").alias("n"))
    seldom = spread(counted.where("__n is null").select("rid", "year", "word"), rows, "word").join(spread(rank.where(F.col("n") <= HOT), rows, "word"), "word")
    by_rarity = F.transform(F.array_sort(F.collect_list(F.struct("n", "word"))), lambda w: w["word"])
    titles = spread(often.unionByName(seldom), rows, "rid", "year").groupBy("rid", "year").agg(by_rarity.alias("words"))
    prefix = F.slice("words", F.lit(1), F.size("words") - F.ceil(F.size("words") * similar).cast("int") + 1)
    probe = titles.select("rid", "words", F.explode(prefix).alias("word"), F.col("year").alias("y")).withColumn("year", F.explode(F.array(F.col("y") - 1, F.col("y"), F.col("y") + 1)))
    index = titles.select(F.col("rid").alias("other"), F.col("words").alias("others"), F.explode("words").alias("word"), "year")
    both = F.size(F.array_intersect("words", "others"))
    met = spread(probe, rows * 2, "word", "year").join(spread(index, rows * 2, "word", "year"), ["word", "year"]).where("rid <> other").where(token_jaccard(both, F.size("words"), F.size("others")) >= similar)
    return spread(met.select(F.least("rid", "other").alias("a"), F.greatest("rid", "other").alias("b")), rows, "a", "b").distinct()


def match_pairs(records: DataFrame, keys: tuple[str, ...], similar: float = SIMILAR) -> DataFrame:
    """(a, b), a < b: equal in some key, or a pair of `title_pairs`.

    A union of equi-joins, as one join over an OR would compare all pairs. Of a key that many records share
    each is paired with the first in input order and with the one before it, which keeps components whole.
    Null, 0 years and empty keys match nothing.
    """
    out = title_pairs(records, similar)
    for k in keys:
        w = Window.partitionBy(k).orderBy("src_ord", "pos")
        known = records.where(~is_empty(F.col(k))).select(F.first("rid").over(w).alias("head"), F.lag("rid").over(w).alias("before"), "rid")
        pairs = known.select("rid", F.explode(F.array("head", "before")).alias("other")).where("other is not null and other <> rid")
        out = out.union(pairs.select(F.least("rid", "other"), F.greatest("rid", "other")))
    return out.distinct()


def min_labels(nodes: DataFrame, pairs: DataFrame) -> DataFrame:
    """(rid, component): the least rid that pairs lead to."""
    found = components(pairs.select("a", "b")).select(F.col("node").alias("__node"), "root")
    return nodes.select("rid").join(found, F.col("rid") == F.col("__node"), "left").select("rid", F.coalesce("root", "rid").alias("component"))


def _first_fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (component, rid, src, matches) by component and input order to (rid, cluster).

    A record goes to the first cluster that holds a match of it; a source's second record there is dropped. Clusters
    are found through the records placed so far, so a record costs its matches, however many clusters there are.
    """
    here, placed, clusters = None, {}, []

    def done() -> Iterator[pa.RecordBatch]:
        rows = [(rid, min(c.values())) for c in clusters for rid in c.values()]
        for i in range(0, len(rows), 50_000):
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*rows[i : i + 50_000], strict=True)], ["rid", "cluster"])

    for batch in batches:
        for component, rid, src, matches in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
            if component != here:
                yield from done()
                here, placed, clusters = component, {}, []
            at = min((placed[m] for m in matches or () if m in placed), default=None)
            if at is None:
                at = len(clusters)
                clusters.append({})
            if src not in clusters[at]:
                clusters[at][src] = rid
                placed[rid] = at
    yield from done()


def greedy_clusters(records: DataFrame, pairs: DataFrame) -> DataFrame:
    """(rid, cluster): first-fit clusters by input order, one record a source; records dropped from a cluster are left out.

    A cluster never reaches over a connected component, so the order-dependent pass streams over components that lie
    sorted in their partition; records that match nothing are clusters of their own and need no pass.
    """
    pairs = keep(pairs, "pairs")
    both = keep(pairs.union(pairs.select("b", "a")).toDF("rid", "other").groupBy("rid").agg(F.collect_list("other").alias("matches")), "matches")
    ids = records.select("rid", "src", "src_ord", "pos")
    alone = ids.join(both, "rid", "left_anti").select("rid", F.col("rid").alias("cluster"))
    rows = ids.join(both, "rid").join(min_labels(both, pairs), "rid").repartition("component").sortWithinPartitions("component", "src_ord", "pos")
    return rows.select("component", "rid", "src", "matches").mapInArrow(_first_fit, "rid long, cluster long").unionByName(alone)


def by_priority(value: Column, src: Column, order: Column, sources: tuple[str, ...]) -> Column:
    """Aggregate: the value of the first source listed that has one, else of the first in input order."""
    rank = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for i, s in enumerate(sources) for x in (s, i)]), src), F.lit(len(sources))) if sources else F.lit(0)
    return F.min_by(F.when(value.isNotNull(), F.struct(value.alias("value"), src.alias("src"))), F.when(value.isNotNull(), F.struct(rank.alias("r"), order.alias("o"))))


def merge_clusters(records: DataFrame, clusters: DataFrame, kind: Kind) -> tuple[DataFrame, DataFrame]:
    """(merged, conflicts): one record a cluster with each field's source, and where sources disagree.

    The longest title wins, on ties the earlier source; fields with priorities go by them, others to the
    first source that has a value. A conflict is a field in which at least two values differ.
    """
    rows = records.join(clusters, "rid")
    types = dict(records.dtypes)
    order = F.struct("src_ord", "pos")
    fields = [c for c in records.columns if c not in ("rid", "src", "src_ord", "pos", "title", "source_ids")]
    full = {c: F.when(~is_empty(F.col(c), types[c]), F.col(c)) for c in fields}
    aggs = [F.max_by(F.struct(F.col("title").alias("value"), F.col("src").alias("src")), F.struct(F.length(F.coalesce("title", F.lit(""))).alias("n"), (-F.col("src_ord")).alias("o"), (-F.col("pos")).alias("p"))).alias("title")]
    aggs += [by_priority(full[c], F.col("src"), order, kind.priority.get(c, ())).alias(c) for c in fields]
    aggs.append(F.transform(F.array_sort(F.collect_list(F.struct("src_ord", "src"))), lambda x: x["src"]).alias("sources"))
    merged = rows.groupBy("cluster").agg(*aggs)
    picked = [*[F.col(f"{c}.value").alias(c) for c in ("title", *fields)], F.map_filter(F.create_map(*[x for c in ("title", *fields) for x in (F.lit(c), F.col(f"{c}.src"))]), lambda k, v: v.isNotNull()).alias("field_src")]
    result = merged.select("cluster", *picked, "sources")
    values = rows.select("cluster", "src", "src_ord", F.explode(F.array(*[F.struct(F.lit(c).alias("field"), full[c].cast("string").alias("value")) for c in kind.conflicts if c in fields])).alias("f"))
    told = values.where("f.value is not null").groupBy("cluster", F.col("f.field").alias("field"))
    conflicts = told.agg(F.countDistinct("f.value").alias("n_values"), F.transform(F.array_sort(F.collect_list(F.struct("src_ord", "src", "f.value"))), lambda x: F.concat(x["src"], F.lit("="), x["value"])).alias("evidence"))
    return result, conflicts.where("n_values >= 2")


def reconcile(records: DataFrame, kind: Kind) -> tuple[DataFrame, DataFrame]:
    """Match, cluster and merge in one go."""
    return merge_clusters(records, greedy_clusters(records, match_pairs(records, kind.keys)), kind)


BOOK = Kind(
    keys=("isbn_13", "isbn_10"),
    priority={
        "year": tuple("goodreads amazon googlebooks openlibrary storygraph".split()),
        "publisher": tuple("goodreads amazon openlibrary googlebooks storygraph".split()),
        "isbn_13": tuple("goodreads amazon openlibrary storygraph".split()),
        "isbn_10": tuple("goodreads amazon openlibrary storygraph".split()),
    },
    conflicts=("authors", "isbn_13", "page_count", "publisher", "year"),
)
PAPER = Kind(keys=("doi",), priority={"year": ("openalex", "crossref"), "publisher": ("openalex", "crossref"), "venue": ("crossref", "openalex")}, conflicts=("authors", "publisher", "year"))


def ranked(merged: DataFrame, kind: str, top: int | None = None) -> DataFrame:
    """Books by sources, ratings and citations, papers by citations and year, all falling; the first `top`."""
    names = ("ratings_count", "cited_by_count") if kind == "book" else ("cited_by_count", "year")
    order = [F.coalesce(F.col(c), F.lit(0)).desc() for c in names if c in merged.columns]
    out = merged.orderBy(*([F.size("sources").desc()] if kind == "book" else []), *order, "cluster")
    return out if top is None else out.limit(top)


def keep_first(rows: DataFrame, key: Column | str, *order: Column | str) -> DataFrame:
    """The first row of each key by the order given."""
    w = Window.partitionBy(key).orderBy(*order)
    return rows.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


EDITION_POINTS = {"isbn_13": 20, "page_count": 15, "publisher": 15, "isbn_10": 10, "year": 5}


def best_edition(editions: DataFrame, key: str, idx: str = "idx") -> DataFrame:
    """The most complete edition of each key, by the points below; the first on ties. Empty texts and 0 give none."""
    full = lambda c: F.coalesce(~F.col(c).cast("string").isin("", "0"), F.lit(False))
    points = sum(F.when(full(c), p).otherwise(0) for c, p in EDITION_POINTS.items())
    return keep_first(editions.withColumn("score", points), key, F.col("score").desc(), idx)

"""Work lists: keep-first distinct, semi- and anti-joins, and a loop that runs until nothing is left."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.operators.reconcile import keep_first


def open_work(demands: DataFrame, gaps: DataFrame, seen: DataFrame, assigned: DataFrame, target: str, order: Column | str) -> DataFrame:
    """The first demand for each target that has a gap, hasn't been seen and isn't assigned."""
    return keep_first(demands, target, order).join(gaps, target, "left_semi").join(seen, target, "left_anti").join(assigned, target, "left_anti")


def until_done(state: DataFrame, step: Callable[[DataFrame], DataFrame], pending: Callable[[DataFrame], DataFrame], rounds: int) -> DataFrame:
    """The state after `step`s while anything is pending, `rounds` at most; each round's state is checkpointed."""
    for _ in range(rounds):
        if pending(state).isEmpty():
            break
        state = step(state).checkpoint()
    return state


def distinct_sources(listing: DataFrame) -> DataFrame:
    """(kind, slug) of a listing (path): the part of the path after vault/ or sources/ names the kind; a PDF counts as paper and as book unless either is known."""
    p = listing.select(F.regexp_extract("path", "(?:^|/)(vault|sources)/([a-z]+)s/([^/.]+)", 1).alias("area"), F.regexp_extract("path", "(?:^|/)(?:vault|sources)/([a-z]+)s/([^/.]+)", 1).alias("kind"), F.regexp_extract("path", "(?:^|/)(?:vault|sources)/[a-z]+s/([^/.]+)", 1).alias("slug"))
    known = p.where("slug <> '' and kind <> 'pdf'").select("kind", "slug").distinct()
    loose = p.where("slug <> '' and kind = 'pdf'").select("slug").distinct().join(known.where("kind in ('paper', 'book')").select("slug"), "slug", "left_anti")
    return known.unionByName(loose.select(F.explode(F.array(F.lit("paper"), F.lit("book"))).alias("kind"), "slug")).distinct()


def integrity(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """(side, key) of keys that just one side has."""
    a = left.select(key).distinct().join(right.select(key), key, "left_anti").select(F.lit("left").alias("side"), key)
    return a.unionByName(right.select(key).distinct().join(left.select(key), key, "left_anti").select(F.lit("right").alias("side"), key))

"""Works looked up in a corpus: by slug, then identifier, then title with author; ambiguity is refused."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lectern.functions.text import surnames, title_keys


def identifier_owners(corpus: DataFrame, key: str) -> DataFrame:
    """(key, slug): of items that share an identifier the first by path."""
    return corpus.where(F.col(key).isNotNull()).groupBy(key).agg(F.min_by("slug", "path").alias("slug"))


def title_index(corpus: DataFrame) -> DataFrame:
    """(key, slug, who, is_stem) of title keys that just one entry has."""
    keys = corpus.select("slug", surnames(F.col("authors")).alias("who"), F.posexplode(title_keys(F.col("title"))).alias("at", "key"))
    n = F.count("*").over(Window.partitionBy("key"))
    return keys.withColumn("n", n).where("n = 1").select("key", "slug", "who", (F.col("at") > 0).alias("is_stem"))


def title_hits(items: DataFrame, corpus: DataFrame) -> DataFrame:
    """(rid, slug): one entry has the title key, a surname agrees, and not both sides lost a subtitle; the whole title goes before its stem."""
    asked = items.select("rid", surnames(F.col("authors")).alias("asked"), F.posexplode(title_keys(F.col("title"))).alias("at", "key"))
    hit = asked.join(title_index(corpus), "key").where(F.arrays_overlap("asked", "who") & ~((F.col("at") > 0) & F.col("is_stem")))
    return hit.groupBy("rid").agg(F.min_by("slug", "at").alias("slug"))


def resolve(items: DataFrame, corpus: DataFrame, key: str = "isbn") -> DataFrame:
    """(rid, slug, match) of each item (rid, slug, <key>, title, authors); match is path, identifier, title or null."""
    paths = corpus.select(F.col("slug").alias("by_path")).distinct()
    owners = identifier_owners(corpus, key).select(F.col(key).alias("__key"), F.col("slug").alias("by_key"))
    titles = title_hits(items, corpus).select("rid", F.col("slug").alias("by_title"))
    out = items.join(paths, items["slug"] == F.col("by_path"), "left").join(owners, F.col(key) == F.col("__key"), "left").join(titles, "rid", "left")
    match = F.when(F.col("by_path").isNotNull(), "path").when(F.col("by_key").isNotNull(), "identifier").when(F.col("by_title").isNotNull(), "title")
    return out.select("rid", F.coalesce("by_path", "by_key", "by_title").alias("slug"), match.alias("match"))


def url_owners(pages: DataFrame) -> DataFrame:
    """(url, slug, n_owners, status): owned once, ambiguous, by the corpus's pages (slug, url)."""
    out = pages.groupBy("url").agg(F.min("slug").alias("slug"), F.countDistinct("slug").alias("n_owners"))
    return out.withColumn("status", F.when(F.col("n_owners") > 1, "ambiguous").otherwise("owned"))

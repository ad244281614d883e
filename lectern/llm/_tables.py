"""Tables kept between steps, and columns worked out once."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.sources.tables import keep, read_table, shared_path

__all__ = ["by_ids", "keep", "once", "read_table", "shared_path", "with_ids"]

#: Bits of a Bloom filter for each id, and 64-bit words that it has at most (16 MB), so what is broadcast is bounded.
BITS_AN_ID = 16
WORDS = 1 << 21


def once(df: DataFrame, name: str, value: Column) -> DataFrame:
    """df with one more column, worked out once a row.

    Spark puts a column's expression wherever it is used, above all into filters that it moves down, so an
    expensive one would be worked out several times. It doesn't look through the explode of one element.
    """
    return df.select("*", F.explode(F.array(value)).alias(name))


def _bloom(ids: DataFrame, words: int) -> np.ndarray:
    bit = F.explode(F.array(*_bits(F.col("id"), words)))
    rows = ids.select(bit.alias("bit")).groupBy(F.shiftright("bit", 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(bit & 63 as int))")).alias("bits")).toArrow()
    table = np.zeros(words, np.int64)
    table[rows.column("word").to_numpy()] = rows.column("bits").to_numpy()
    return table


def _bits(value: Column, words: int) -> list[Column]:
    h = F.xxhash64(value)
    mask = F.lit(words * 64 - 1).cast("long")
    return [h.bitwiseAND(mask), F.shiftrightunsigned(h, 32).bitwiseAND(mask)]


def by_ids(docs: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows whose doc_id may be among ids, the other rows): the first hold all of ids and few others, the second none.

    A Bloom filter of the ids, of bounded size, decides in the scan, so that texts which nothing is to be
    joined to aren't shuffled. Ids too many for its size make it pass more, never fewer. ids has one column
    and should be cheap to read twice. A null doc_id is among no ids.
    """
    ids = ids.toDF("id").where("id is not null").select(F.col("id").cast("long"))
    n = ids.count()
    words = min(WORDS, 1 << max(4, (n * BITS_AN_ID // 64).bit_length()))
    table = pa.table({"_lectern_zero": pa.array([0], pa.int32()), "_lectern_bloom": pa.array([_bloom(ids, words)], pa.list_(pa.int64()))})
    one = docs.sparkSession.createDataFrame(table)
    tested = docs.join(F.broadcast(one), F.pmod(F.hash(docs["doc_id"]), F.lit(1)) == one["_lectern_zero"])
    bits = _bits(docs["doc_id"].cast("long"), words)
    may = F.lit(True)
    for b in bits:
        may = may & (F.call_function("shiftright", F.get("_lectern_bloom", F.shiftright(b, 6).cast("int")), b.bitwiseAND(F.lit(63).cast("long")).cast("int")).bitwiseAND(F.lit(1).cast("long")) == 1)
    may = may & docs["doc_id"].isNotNull()
    columns = [docs[f"`{c}`"] for c in docs.columns]
    return tested.where(may).select(columns), tested.where(~may).select(columns)


def with_ids(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """The rows whose doc_id may be among ids; see `by_ids`."""
    return by_ids(docs, ids)[0]

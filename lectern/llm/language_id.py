"""Language identification by hyperdimensional profiles.

Each letter (a character of any script in lower case, runs of other characters than letters and digits
as one space) has a random vector of D entries +1 or -1, drawn from a hash of its code point. Three letters in a row are bound to one vector: the
first permuted twice (rolled by 2), the second once, the third not at all, multiplied entry by entry.
A document is the bundle (sum) of its n-gram vectors; a language's prototype the bundle of its sample's
documents, each at the same length. A document gets the language of the prototype of largest cosine.

Plan: the sample is bounded (PER_LANGUAGE documents a language, those of least hash), found by a
window over (lang, hash) alone and cut out of the scan by one literal threshold a language, so text
is never shuffled; prototypes are bundled on the executors. Scoring is one scan without a shuffle: a
span of documents is a matrix of n-gram counts times the matrix of the span's n-gram vectors.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lectern.llm import _text as T
from lectern.llm._tables import read_table

D = 1024
PER_LANGUAGE = 500
#: Entries of a normalised document are kept as whole numbers of this fraction, so sums don't depend on their order.
UNIT = 1 << 20
IDENTIFIED = "doc_id long, language string, cosine double, margin double"

def letter_vectors(points: np.ndarray) -> np.ndarray:
    """[points, D] of +1 and -1: the bits of D / 64 hashes of each code point."""
    words = T.mix64(T.mix64(points.astype(np.uint64) * T.GOLDEN + T.U64(8128))[:, None] + np.arange(1, D // 64 + 1, dtype=np.uint64) * T._BASE)
    bits = words[:, :, None] >> np.arange(64, dtype=np.uint64) & T.U64(1)
    return (bits.reshape(len(points), D).astype(np.int8) * 2 - 1).astype(np.int8)


def bundles(texts: pa.LargeStringArray) -> np.ndarray:
    """The documents' vectors [documents, D], exact sums of n-gram vectors; zeros for fewer than three letters."""
    points, at = T.fold(texts)
    docs, n = len(texts), len(points) - 2
    if n <= 0:
        return np.zeros((docs, D), np.float32)
    doc = np.repeat(np.arange(docs), np.diff(at))[:n]
    inside = np.arange(n) + 3 <= at[doc + 1]
    seen = np.bincount(points, minlength=1).astype(bool)
    letters = np.flatnonzero(seen)
    rank = (np.cumsum(seen) - 1)[points]
    many = len(letters)
    rank = rank.astype(np.int32 if many < 1290 else np.int64)  # three ranks fit
    gram = ((rank[:-2] * many + rank[1:-1]) * many + rank[2:])[inside]
    kinds, which = np.unique(gram, return_inverse=True)
    plain = letter_vectors(letters)
    twice, once = np.roll(plain, 2, axis=1), np.roll(plain, 1, axis=1)
    vectors = (twice[kinds // many // many] * once[kinds // many % many] * plain[kinds % many]).astype(np.float32)
    counts = np.bincount(doc[inside] * len(kinds) + which, minlength=docs * len(kinds)).reshape(docs, -1)
    return counts.astype(np.float32) @ vectors


def _normal(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.float64)
    return x / np.maximum(np.sqrt((x * x).sum(axis=1, keepdims=True)), 1e-12)


def _partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, bundle) for each language of a partition."""
    sums: dict[str, np.ndarray] = {}
    for batch in batches:
        langs, texts = np.array(batch.column(0).to_pylist(), object), T.strings(batch.column(1))
        for lo, hi in T.spans(texts, 1 << 19):
            v = np.rint(_normal(bundles(texts.slice(lo, hi - lo))) * UNIT).astype(np.int64)
            for lang in set(langs[lo:hi]):
                sums[lang] = sums.get(lang, 0) + v[langs[lo:hi] == lang].sum(axis=0)
    if sums:
        yield pa.RecordBatch.from_arrays([pa.array(list(sums)), pa.array([v.tobytes() for v in sums.values()], pa.binary())], ["lang", "bundle"])


def _total(table: pa.Table) -> pa.Table:
    total = sum(np.frombuffer(b, np.int64) for b in table.column("bundle").to_pylist())
    return pa.table({"lang": table.column("lang").slice(0, 1), "bundle": pa.array([total.tobytes()], pa.binary())})


def prototypes(docs: DataFrame, per_language: int = PER_LANGUAGE) -> tuple[list[str], np.ndarray]:
    """Languages in alphabetical order and their prototypes, of length one (zero where a sample has no n-gram)."""
    known = docs.where("lang is not null and doc_id is not null")
    order = F.xxhash64("doc_id")
    ranked = known.select("lang", order.alias("h")).withColumn("r", F.row_number().over(Window.partitionBy("lang").orderBy("h"))).where(F.col("r") <= per_language)
    most = {r["lang"]: r["h"] for r in ranked.groupBy("lang").agg(F.max("h").alias("h")).collect()}  # one row a language
    if not most:
        return [], np.zeros((0, D))
    limit = F.create_map(*[F.lit(x) for pair in most.items() for x in pair])
    sample = known.where(order <= F.element_at(limit, F.col("lang"))).select("lang", "text")
    rows = sample.mapInArrow(T.lean(_partial), "lang string, bundle binary").groupBy("lang").applyInArrow(_total, "lang string, bundle binary").collect()
    rows = sorted(rows, key=lambda r: r["lang"])
    return [r["lang"] for r in rows], _normal(np.stack([np.frombuffer(r["bundle"], np.int64) for r in rows]))


def identify(docs: DataFrame, languages: list[str], profiles: np.ndarray) -> DataFrame:
    """(doc_id, language, cosine, margin) of every document; margin is the lead on the second language.

    Null and empty texts, texts of fewer than three letters and, without any prototype, all have a null
    language, cosine and margin; with one prototype alone the margin is null. On a tie the language first
    in the alphabet is given. Repeated rows are each identified, a null doc_id too. An empty table gives an
    empty one; other columns aren't looked at.
    """
    shared = docs.sparkSession.sparkContext.broadcast((languages, profiles))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, p = shared.value
        for batch in batches:
            texts = T.strings(batch.column(1))
            for lo, hi in T.spans(texts, 1 << 19):
                v = bundles(texts.slice(lo, hi - lo))
                none = ~v.any(axis=1) if len(names) else np.ones(hi - lo, bool)
                cosine = np.round(_normal(v) @ p.T, 9) if len(names) else np.zeros((hi - lo, 1))
                best = cosine.argmax(axis=1)
                ranked = np.sort(cosine, axis=1)
                margin = np.round(ranked[:, -1] - ranked[:, -2], 9) if len(names) > 1 else np.full(hi - lo, np.nan)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(lo, hi - lo),
                        pa.array([None if x else names[i] for x, i in zip(none, best, strict=True)], pa.string()),
                        pa.array(ranked[:, -1], mask=none),
                        pa.array(margin, mask=none | np.isnan(margin)),
                    ],
                    ["doc_id", "language", "cosine", "margin"],
                )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(T.lean(run), IDENTIFIED)


def identify_languages(docs: DataFrame, per_language: int = PER_LANGUAGE) -> DataFrame:
    """Every document's language by prototypes of the documents' own column lang; see `identify`. Rows with a null lang or doc_id are in no sample."""
    return identify(docs, *prototypes(docs, per_language))


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of all documents, by profiles of a sample of each labelled language."""
    return identify_languages(read_table(spark, sf_dir, "documents"))

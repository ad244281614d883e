"""Toxicity by subword-bag embeddings averaged into a linear softmax.

A word is the bag of its character n-grams (LENGTHS, with marks for its begin and end) and itself,
each hashed to one of BUCKETS vectors; a word's vector is their mean, a document's the mean of its
words'. On it sits a softmax over (clean, toxic). Vectors and softmax are trained together, in numpy,
by gradient descent, so a misspelling never seen shares most n-grams with the word.

Plan: the sample is bounded (MAX_TOXIC and MAX_CLEAN labelled documents, those of least hash), so it
and the model (fixed size) fit the driver at any scale. As the score is linear in the vectors, the
model sent to the tasks is one number a bucket. Scoring is one scan without a shuffle; a span of
documents scores each distinct word once.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lectern.llm import _text as T
from lectern.llm._tables import read_table

MAX_TOXIC = 1500
MAX_CLEAN = 2500
LENGTHS = (3, 4, 5, 6)
BUCKET_BITS = 18
DIMENSIONS = 8
LEAST_DOCS = 5
LEAST_CHI2 = 12
SPREAD = 6
BATCH = 64
EPOCHS = 6
RATE = 0.05
DECAY = 1e-4
#: Score from which a document counts as toxic.
THRESHOLD = 0.8

SCORED = "doc_id long, score double, toxic boolean"


@dataclass
class Bags:
    """Documents as counts of distinct words, and these as n-gram buckets; both in compressed rows."""

    docs: int
    doc: np.ndarray
    word: np.ndarray
    count: np.ndarray
    tokens: np.ndarray
    gram_word: np.ndarray
    bucket: np.ndarray
    grams: np.ndarray


def bags(texts: pa.LargeStringArray) -> Bags:
    t = T.tokenize(texts)
    docs = len(texts)
    words, at, which = np.unique(t.hash, return_index=True, return_inverse=True)
    many = len(words)
    pair, count = np.unique(t.doc.astype(np.int64) * max(many, 1) + which, return_counts=True)
    # the words in a row, each between 0x01 and 0x02, which occur in no token
    start, size = t.start[at], (t.end - t.start)[at]
    begin = np.concatenate([[0], np.cumsum(size + 2)]).astype(np.int64)
    line = np.zeros(begin[-1], np.uint8)
    line[begin[:-1]] = 1
    line[begin[1:] - 1] = 2
    inner = np.repeat(begin[:-1] + 1, size) + np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
    line[inner] = t.data[np.repeat(start, size) + np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)]
    up, down = T.powers(len(line) + 1)
    total = np.zeros(len(line) + 1, np.uint64)
    np.cumsum(T._BYTE_VALUE[line] * up[: len(line)], out=total[1:])
    owner = np.repeat(np.arange(many), size + 2)
    grams, owners = [words], [np.arange(many)]
    for n in LENGTHS:
        i = np.arange(max(0, len(line) - n + 1))
        i = i[i + n <= begin[owner[i] + 1]]
        grams.append(T.mix64((total[i + n] - total[i]) * down[i] + T.U64(n * int(T.GOLDEN) % (1 << 64))))
        owners.append(owner[i])
    owners, grams = np.concatenate(owners), np.concatenate(grams)
    order = np.argsort(owners, kind="stable")
    bucket = (grams >> T.U64(64 - BUCKET_BITS)).astype(np.int64)[order]
    return Bags(docs, pair // max(many, 1), pair % max(many, 1), count.astype(np.float32), np.diff(t.first), owners[order], bucket, np.bincount(owners, minlength=many))


def _sums(values: np.ndarray, row: np.ndarray, rows: int) -> np.ndarray:
    """Sums of values by row, row ascending."""
    out = np.zeros((rows, *values.shape[1:]), values.dtype)
    if len(row):
        first = np.flatnonzero(np.concatenate([[True], row[1:] != row[:-1]]))
        out[row[first]] = np.add.reduceat(values, first, axis=0)
    return out


@dataclass
class Model:
    """The score of each bucket and the bias, both as toxic less clean."""

    weight: np.ndarray
    bias: float

    def scores(self, texts: pa.LargeStringArray) -> np.ndarray:
        b = bags(texts)
        word = _sums(self.weight[b.bucket], b.gram_word, len(b.grams)) / np.maximum(b.grams, 1)
        total = _sums(word[b.word] * b.count, b.doc, b.docs)
        logit = total / np.maximum(b.tokens, 1) + self.bias
        return np.where(b.tokens > 0, 1 / (1 + np.exp(-np.clip(logit, -60, 60))), np.nan)


def _rows(texts: pa.LargeStringArray) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    """For spans of documents lo .. hi: (document, bucket, its share of the document) for each n-gram that a document holds."""
    for lo, hi in T.spans(texts, 1 << 18):
        b = bags(texts.slice(lo, hi - lo))
        grams = b.grams[b.word]
        begin = np.cumsum(b.grams) - b.grams
        gram = np.repeat(begin[b.word] - np.cumsum(grams) + grams, grams) + np.arange(grams.sum())
        share = np.repeat(b.count / np.maximum(b.tokens, 1)[b.doc] / grams, grams)
        key, at = np.unique(np.repeat(b.doc, grams) << BUCKET_BITS | b.bucket[gram], return_inverse=True)
        yield lo, hi, key >> BUCKET_BITS, key & ((1 << BUCKET_BITS) - 1), np.bincount(at, share, len(key))


def fit(texts: pa.LargeStringArray, toxic: np.ndarray) -> Model | None:
    """The trained model; None unless there are both toxic and clean texts with words. Classes weigh the same.

    Buckets that tell the classes apart by a chi-square over LEAST_CHI2 take part; that leaves too few
    parameters to learn the sample by heart. Their vectors begin along one direction by the bucket's
    log-odds, with small random values in the others; then vectors and softmax are trained together by
    gradient descent with adaptive rates, in batches of BATCH documents.
    """
    y = np.asarray(toxic, bool)
    buckets = 1 << BUCKET_BITS
    some = np.zeros(len(y), bool)
    with_ = np.zeros((2, buckets))
    for lo, _, doc, bucket, _ in _rows(texts):
        some[lo + np.unique(doc)] = True
        for c in (0, 1):
            with_[c] += np.bincount(bucket[y[lo + doc] == c], minlength=buckets)
    n = np.array([(some & ~y).sum(), (some & y).sum()], float)
    if not n.all():
        return None
    both = with_.sum(axis=0)
    expected = both * n[1] / n.sum()
    chi2 = (with_[1] - expected) ** 2 / np.maximum(expected * (n[0] / n.sum()) * (1 - both / n.sum()), 1e-9)
    used = np.flatnonzero((both >= LEAST_DOCS) & (chi2 > LEAST_CHI2))
    if not len(used):
        return Model(np.zeros(buckets), float(np.log(n[1] / n[0])))
    odds = np.log((with_[1] + 3 * n[1] / n.sum()) / (n[1] + 3)) - np.log((with_[0] + 3 * n[0] / n.sum()) / (n[0] + 3))
    place = np.full(buckets, -1)
    place[used] = np.arange(len(used))
    parts = []
    for lo, _, doc, bucket, share in _rows(texts):
        mine = place[bucket] >= 0
        parts.append(((lo + doc[mine]).astype(np.int32), place[bucket[mine]].astype(np.int32), share[mine].astype(np.float32)))
    doc, bucket, share = (np.concatenate(x) for x in zip(*parts, strict=True))
    first = np.searchsorted(doc, np.arange(len(y) + 1))

    rng = np.random.default_rng(11)
    vectors = rng.normal(0, 0.1, (len(used), DIMENSIONS)).astype(np.float32)
    softmax = rng.normal(0, 0.1, (DIMENSIONS, 2)).astype(np.float32)
    begin = np.bincount(doc, share * odds[used][bucket], len(y))
    means = begin[some & ~y].mean(), begin[some & y].mean()
    scale = SPREAD / max(means[1] - means[0], 1e-9)
    vectors[:, 0] = odds[used] * scale
    softmax[0] = -0.5, 0.5
    bias = np.array([1, -1], np.float32) * np.float32(sum(means) / 4 * scale)
    held = [np.full(p.shape, 1e-12, np.float32) for p in (vectors, softmax, bias)]
    importance = np.where(y, 0.5 / n[1], 0.5 / n[0]) * n.sum()
    goal = np.stack([~y, y], axis=1)
    order = np.flatnonzero(some)
    for _ in range(EPOCHS):
        rng.shuffle(order)
        for at in range(0, len(order), BATCH):
            mine = order[at : at + BATCH]
            size = first[mine + 1] - first[mine]
            entry = np.repeat(first[mine] - np.cumsum(size) + size, size) + np.arange(size.sum())
            touched, local = np.unique(bucket[entry], return_inverse=True)
            cell = np.repeat(np.arange(len(mine)), size) * len(touched) + local
            bag = np.bincount(cell, share[entry], len(mine) * len(touched)).reshape(len(mine), -1).astype(np.float32)
            mean = bag @ vectors[touched]
            z = mean @ softmax + bias
            z = np.exp(z - z.max(axis=1, keepdims=True))
            d = ((z / z.sum(axis=1, keepdims=True) - goal[mine]) * importance[mine, None] / len(mine)).astype(np.float32)
            steps = (bag.T @ (d @ softmax.T) + DECAY * vectors[touched], mean.T @ d, d.sum(axis=0))
            for one, sum_, g, where in zip((vectors, softmax, bias), held, steps, (touched, slice(None), slice(None)), strict=True):
                sum_[where] += g * g
                one[where] -= RATE * g / np.sqrt(sum_[where])
    weight = np.zeros(buckets)
    weight[used] = vectors.astype(np.float64) @ (softmax[:, 1] - softmax[:, 0]).astype(np.float64)
    return Model(weight, float(bias[1] - bias[0]))


def labelled_sample(docs: DataFrame, labels: DataFrame, max_toxic: int = MAX_TOXIC, max_clean: int = MAX_CLEAN) -> DataFrame:
    """(text, toxic) of at most so many labelled documents, those whose doc_id has the least hash; a document labelled both ways is toxic."""
    known = labels.where("doc_id is not null and toxic in (0, 1)").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("toxic").alias("toxic"))
    order = Window.partitionBy("toxic").orderBy(F.xxhash64("doc_id"), "doc_id")
    most = F.when(F.col("toxic") == 1, max_toxic).otherwise(max_clean)
    ids = known.withColumn("_lectern_r", F.row_number().over(order)).where(F.col("_lectern_r") <= max(max_toxic, max_clean)).where(F.col("_lectern_r") <= most).select(F.col("doc_id").alias("_lectern_id"), "toxic")
    # at most max_toxic + max_clean rows
    return docs.select("doc_id", "text").join(F.broadcast(ids), F.col("doc_id").cast("long") == F.col("_lectern_id")).select("_lectern_id", "text", "toxic")


def train(docs: DataFrame, labels: DataFrame) -> Model | None:
    rows = labelled_sample(docs, labels).toArrow().sort_by([("_lectern_id", "ascending"), ("text", "ascending")])
    return fit(T.strings(rows.column("text")), rows.column("toxic").to_numpy() == 1)


def score_toxicity(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, score, toxic) of every document; score is the softmax's share for toxic, toxic whether it reaches the threshold.

    `labels` has the columns doc_id and toxic (1, 0; anything else counts as no label). Null and empty
    texts, and texts without letters and digits, have a null score and aren't toxic; so have all where
    labels of either class are missing. Repeated rows are each scored, a null doc_id too. An empty table
    gives an empty one; other columns aren't looked at.
    """
    model = train(docs, labels)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = T.strings(batch.column(1))
            scores = [np.full(0, np.nan)]
            for lo, hi in T.spans(texts, 1 << 21):
                scores.append(shared.value.scores(texts.slice(lo, hi - lo)) if shared.value else np.full(hi - lo, np.nan))
            score = np.concatenate(scores)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(score, from_pandas=True), pa.array(np.nan_to_num(score, nan=-1) >= threshold)], ["doc_id", "score", "toxic"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(T.lean(run), SCORED)


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The toxicity of all documents, by a model of the labelled ones."""
    return score_toxicity(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))

"""Benchmark decontamination by q-gram filtering in diagonal bands and banded alignment.

A benchmark item of n characters is found in a document if some stretch of the document is within
e = floor(EDITS * n) edits of the whole item. By the q-gram lemma such a stretch shares at least
n + 1 - q(e + 1) q-grams with the item, and as an alignment with e edits wanders over at most e + 1
diagonals (place in the document less place in the item), they lie within one band of that width.
Bands 2w wide that begin every w >= e + 1 diagonals overlap so that each such band is inside one.
Bands with enough shared q-grams are verified by an alignment confined to them, which decides. The
q-grams are of one byte a character, so letters of other scripts may be taken for each other there, which
only lets more bands pass; the alignment compares the characters themselves.

Plan: one scan, no shuffle. The items' q-grams, sorted, go to the tasks by broadcast. Their size is
measured first; items beyond ITEM_BYTES are split into portions, each with a scan of its own, so what
a task holds is bounded while every document still meets every item. Looking up a document costs a
few vectorised passes over its bytes: a bitmap of 2**22 bits sorts out nearly all q-grams.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.llm import _text as T
from lectern.llm._tables import read_table

Q = 10
EDITS = 0.08
ITEM_BYTES = 8 << 20
_BITS = 22
_FAR = 1 << 20
OUTSIDE = np.uint32(0xFFFFFFFF)

FOUND = "doc_id long, item_id long, edits int, item_chars int, found_at int, found_end int"


def qgrams(text: np.ndarray) -> np.ndarray:
    """One 64-bit value for each Q characters in a row, of a byte each: eight as they are, mixed with the last two."""
    text = T.low_bytes(text)
    n = len(text) - Q + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    head = np.zeros(n, np.uint64)
    for i in range(8):
        head |= text[i : i + n].astype(np.uint64) << T.U64(8 * i)
    tail = text[8 : 8 + n].astype(np.uint64) | (text[9 : 9 + n].astype(np.uint64) << T.U64(8))
    return (head ^ (tail * T.GOLDEN)) * T.U64(0xBF58476D1CE4E5B9)


def edit_budget(n: int, rate: float = EDITS) -> int:
    """Edits allowed in an item of n characters: as many of floor(rate * n) as leave the lemma at least one q-gram."""
    return max(0, min(int(rate * n), (n - Q) // Q))


class Items:
    """The q-gram index of some benchmark items."""

    def __init__(self, ids: list[int], texts: list[str], rate: float = EDITS):
        data, at = T.fold(T.strings(pa.array(texts, pa.large_string())))
        rows = [data[at[i] : at[i + 1]] for i in range(len(texts))]
        rows = [r[:-1] if len(r) else r for r in rows]  # without the closing space
        use = [i for i, r in enumerate(rows) if len(r) >= Q]
        self.ids = [ids[i] for i in use]
        self.rows = [rows[i] for i in use]
        self.n = np.array([len(r) for r in self.rows], np.int64)
        self.e = np.array([edit_budget(int(n), rate) for n in self.n], np.int64)
        self.least = self.n + 1 - Q * (self.e + 1)
        self.width = np.maximum(self.e + 1, 16)
        grams = [qgrams(r) for r in self.rows]
        key = np.concatenate([np.empty(0, np.uint64), *grams])
        item = np.repeat(np.arange(len(use)), [len(g) for g in grams])
        place = np.concatenate([np.empty(0, np.int64), *[np.arange(len(g)) for g in grams]])
        order = np.argsort(key, kind="stable")
        self.key, self.item, self.place = key[order], item[order], place[order]
        self.bits = np.zeros(1 << _BITS, bool)
        self.bits[self.key >> T.U64(64 - _BITS)] = True

    def hits(self, text: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(place in text, item, place in item) of all shared q-grams."""
        g = qgrams(text)
        at = np.flatnonzero(self.bits[g >> T.U64(64 - _BITS)])
        g = g[at]
        lo, hi = np.searchsorted(self.key, g, "left"), np.searchsorted(self.key, g, "right")
        n = hi - lo
        some = n > 0
        at, lo, n = at[some], lo[some], n[some]
        where = np.repeat(lo - np.cumsum(n) + n, n) + np.arange(n.sum())
        return np.repeat(at, n), self.item[where], self.place[where]

    def candidates(self, text: np.ndarray, row_at: np.ndarray) -> np.ndarray:
        """Rows (document, item, first diagonal) of the bands that reach their item's count; diagonals are relative to the document."""
        at, item, place = self.hits(text)
        if not len(at):
            return np.empty((0, 3), np.int64)
        doc = np.searchsorted(row_at, at, side="right") - 1
        inside = at + Q <= row_at[doc + 1]
        at, item, place, doc = at[inside], item[inside], place[inside], doc[inside]
        # items begin up to their length before the document's first character
        diagonal = at - row_at[doc] - place + self.n[item]
        band = diagonal // self.width[item]
        rows = np.stack([np.tile(doc, 2), np.tile(item, 2), np.concatenate([band, band - 1])], axis=1)
        order = np.lexsort((rows[:, 2], rows[:, 1], rows[:, 0]))
        rows = rows[order]
        new = np.ones(len(rows), bool)
        new[1:] = (rows[1:] != rows[:-1]).any(axis=1)
        first = np.flatnonzero(new)
        count = np.diff([*first, len(rows)])
        rows = rows[first][count >= self.least[rows[first, 1]]]
        rows[:, 2] = rows[:, 2] * self.width[rows[:, 1]] - self.n[rows[:, 1]]
        return rows


def banded_alignment(item: np.ndarray, e: int, texts: list[np.ndarray], first: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Least edits between the whole item and a stretch of each text, with the stretch's begin and end.

    Just the cells on diagonals first - e .. first + width + e are computed, for all texts at once:
    a column j of row i stands for the text's place i + first - e + j. A number over e stands for more.
    """
    many, span = len(texts), width + 2 * e + 1
    n = len(item)
    low = first - e
    cost = np.full((many, span), _FAR, np.int64)
    place = low[:, None] + np.arange(span)
    size = np.array([len(x) for x in texts])
    cost[(place >= 0) & (place <= size[:, None])] = 0
    begin = place.copy()
    # the texts' characters along the band, OUTSIDE before and after them
    reach = span + n
    line = np.full((many, reach), OUTSIDE, np.uint32)
    for r, x in enumerate(texts):
        a, b = max(0, low[r]), min(len(x), low[r] + reach)
        if a < b:
            line[r, a - low[r] : b - low[r]] = x[a:b]
    steps = np.arange(span)
    for i in range(n):
        # diagonal: item[i] against the text's character at place i + low + j; up: item[i] dropped
        diagonal = cost + (line[:, i : i + span] != item[i])
        diagonal[line[:, i : i + span] == OUTSIDE] = _FAR
        up = np.full_like(cost, _FAR)
        up[:, :-1] = cost[:, 1:] + 1
        up_begin = np.zeros_like(begin)
        up_begin[:, :-1] = begin[:, 1:]
        here = np.minimum(diagonal, up)
        here_begin = np.where(diagonal <= up, begin, up_begin)
        at = i + 1 + place
        here[(at < 0) | (at > size[:, None])] = _FAR
        # insertions run along the row: cost j from k is here[k] + j - k
        shifted = here - steps
        best = np.minimum.accumulate(shifted, axis=1)
        took = np.maximum.accumulate(np.where(shifted == best, steps, 0), axis=1)
        cost = np.minimum(best + steps, _FAR)
        cost[(at < 0) | (at > size[:, None])] = _FAR
        begin = np.take_along_axis(here_begin, took, axis=1)
    j = cost.argmin(axis=1)
    rows = np.arange(many)
    return cost[rows, j], begin[rows, j], n + low + j


def find_items(items: Items, texts: pa.LargeStringArray) -> list[tuple[int, int, int, int, int]]:
    """(row, item, edits, begin, end) of the best place of each item found in each text, in folded characters."""
    out: dict[tuple[int, int], tuple[int, int, int]] = {}
    for lo, hi in T.spans(texts):
        data, row_at = T.fold(texts.slice(lo, hi - lo))
        found = items.candidates(data, row_at)
        for k in np.unique(found[:, 1]):
            mine = found[found[:, 1] == k]
            n, e, w = int(items.n[k]), int(items.e[k]), int(2 * items.width[k])
            docs = [data[row_at[d] : row_at[d + 1]] for d in mine[:, 0]]
            for a in range(0, len(mine), 512):
                first = mine[a : a + 512, 2]
                cost, begin, end = banded_alignment(items.rows[k], e, docs[a : a + 512], first, w)
                for d, c, b, f in zip(mine[a : a + 512, 0], cost, begin, end, strict=True):
                    if c <= e:
                        new = (int(c), int(b), int(f))
                        key = (lo + int(d), int(k))
                        out[key] = min(out.get(key, new), new)
    return [(r, k, *v) for (r, k), v in sorted(out.items())]


def _finder(shared) -> object:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items = None
        for batch in batches:
            items = items or Items(*shared.value)
            rows = find_items(items, T.strings(batch.column(1)))
            if rows:
                r, k, cost, begin, end = (np.array(x, np.int64) for x in zip(*rows, strict=True))
                ids = batch.column(0).take(pa.array(r))
                small = [pa.array(x.astype(np.int32)) for x in (cost, items.n[k], begin, end)]
                yield pa.RecordBatch.from_arrays([ids, pa.array([items.ids[i] for i in k], pa.int64()), *small], ["doc_id", "item_id", "edits", "item_chars", "found_at", "found_end"])

    return run


def _portions(benchmark: DataFrame, item_bytes: int) -> Iterator[tuple[list[int], list[str]]]:
    """The items (ids, texts), in as many portions of about item_bytes as they need."""
    sized = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text", F.octet_length("text").alias("size")).where("text is not null")
    portions = max(1, -(-(sized.agg(F.sum("size")).first()[0] or 0) // item_bytes))
    for p in range(portions):
        mine = sized if portions == 1 else sized.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(portions)) == p)
        rows = mine.select("item_id", "text").collect()  # one portion: at most about item_bytes
        yield [r[0] for r in rows], [r[1] for r in rows]


def find_benchmark(docs: DataFrame, benchmark: DataFrame, rate: float = EDITS, item_bytes: int = ITEM_BYTES) -> DataFrame:
    """One row for each document and each benchmark item that it holds, with the place and number of edits of the best match.

    Texts are compared in lower case, character by character, runs of other characters than letters and
    digits (of any script) as one space; places and lengths count characters after that. On ties of edits the first place is reported. Items of
    fewer than Q characters hold no q-gram and are never reported, nor null ones; a null item_id is reported as such. Null and empty
    documents match nothing. Rows with a null doc_id are reported with a null doc_id. Repeated documents
    and repeated items are each reported. Empty tables give an empty result; other columns aren't looked at.
    """
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    out = None
    for ids, items in _portions(benchmark, item_bytes):
        shared = docs.sparkSession.sparkContext.broadcast((ids, items, rate))
        part = texts.mapInArrow(T.lean(_finder(shared)), FOUND)
        out = part if out is None else out.unionByName(part)
    return out


def _dropper(shared, at: int) -> object:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items = None
        for batch in batches:
            items = items or Items(*shared.value)
            clean = np.ones(batch.num_rows, bool)
            clean[[r[0] for r in find_items(items, T.strings(batch.column(at)))]] = False
            yield batch.filter(pa.array(clean))

    return run


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, rate: float = EDITS, item_bytes: int = ITEM_BYTES) -> DataFrame:
    """The documents, with their columns, that hold no benchmark item; see `find_benchmark`.

    Decided row by row in the scan, without any join or shuffle: each portion of the items drops what it
    finds from what the one before left.
    """
    for ids, items in _portions(benchmark, item_bytes):
        shared = docs.sparkSession.sparkContext.broadcast((ids, items, rate))
        docs = docs.mapInArrow(T.lean(_dropper(shared, docs.columns.index("text"))), docs.schema)
    return docs


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The benchmark items found in the documents."""
    return find_benchmark(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))



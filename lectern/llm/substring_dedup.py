"""Repeated passages by seed and extend over winnowed anchors.

Texts are sequences of tokens. An anchor is a run of K = MIN_TOKENS // 2 tokens whose hash is the
least of some window of MIN_TOKENS - K + 1 such runs in a row (winnowing), so any MIN_TOKENS tokens
that two places share hold an anchor that both have chosen. Plan:

1. One scan gives each document's anchors and a 128-bit hash of its tokens. Of equal token sequences
   one goes on; the others are whole repeats of it. Anchors met once are dropped (a count whose
   partial sums are made before the shuffle).
2. The documents' texts are joined once to the places of their repeated anchors, and each place goes,
   with the hashes of the MIN_TOKENS - K tokens on its either side, to its anchor's bucket.
3. In a bucket a place repeats an earlier document's if some MIN_TOKENS tokens around the anchor are the
   same. For each number t of tokens to the left that is an equality of one key, so partners are found
   by sorting, never by comparing all pairs; each is then extended both ways, token by token.
   Buckets over HOT places are split by these keys in Spark's own aggregation instead.
4. Stretches of one pair of documents on one diagonal that touch are joined. A stretch that reaches the
   end of all contexts, because the next tokens have another first holder, is open there: the texts of
   these pairs alone meet, and prefix hashes find by bisection how far the match goes on.
5. A match inside a longer one of the same two documents is left out.

So each row is a maximal repeat of two places: neither side can be extended. Every window of MIN_TOKENS
tokens that stands elsewhere too is in a row of each document that holds it, told of the first other
document with it (the first holder itself of the second one), so thousands of holders give as many rows,
not pairs. A window that no other document has is told of the nearest place before it in its own one,
the first of them of the next: the places of a periodic run are then on one diagonal and join to one repeat.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lectern.llm import _text as T
from lectern.llm._tables import keep, read_table, with_ids

MIN_TOKENS = 50
HOT = 100_000
#: Pairs of one source whose stretches a task extends; more are spread over salts.
PER_TASK = 2048
REPEATS = "doc_id long, source_id long, diagonal long, begin long, end long, low int, high int"
MATCHES = "doc_id long, source_id long, diagonal long, begin long, end long"
PLACES = "anchor long, doc_id long, pos int, context binary"
_A, _B = T.U64(0x9FB21C651E98DF25), T.U64(0xC2B2AE3D27D4EB4F)


def run_hashes(t: T.Tokens, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The hash of the k tokens from each token on, and whether they are all of its document."""
    n = len(t.hash)
    up, down = T.powers(n + 1)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(t.hash * up[:n], out=total[1:])
    whole = np.zeros(n, bool)
    h = np.full(n, ~T.U64(0))
    if n >= k:
        i = np.arange(n - k + 1)
        whole[: n - k + 1] = i + k <= t.first[t.doc[i] + 1]
        h[: n - k + 1] = T.mix64((total[k:] - total[: n - k + 1]) * down[: n - k + 1]) >> T.U64(1)
    return h, whole


def winnow(t: T.Tokens, k: int, window: int) -> tuple[np.ndarray, np.ndarray]:
    """(token, hash) of the runs that are least in some `window` of runs of one document; all of them on ties."""
    h, whole = run_hashes(t, k)
    n = len(h) - window + 1
    if n <= 0:
        return np.empty(0, np.int64), np.empty(0, np.uint64)

    def slide(x: np.ndarray, pick) -> np.ndarray:
        size = 1
        while size * 2 <= window:
            x = pick(x[:-size], x[size:])
            size *= 2
        return pick(x[: len(x) - (window - size)], x[window - size :]) if window > size else x

    low = slide(h, np.minimum)
    low[~(whole[:n] & whole[window - 1 :] & (t.doc[:n] == t.doc[window - 1 :]))] = 0
    pad = np.zeros(window - 1, np.uint64)
    best = slide(np.concatenate([pad, low, pad]), np.maximum)
    at = np.flatnonzero((h == best) & whole & (best > 0))
    return at, h[at]


def _anchors(min_tokens: int):
    k = min_tokens // 2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = T.strings(batch.column(1))
            for lo, hi in T.spans(texts, 1 << 20):
                t = T.tokenize(texts.slice(lo, hi - lo))
                one, two = T.document_hashes(t, hi - lo)
                at, h = winnow(t, k, min_tokens - k + 1)
                edge = np.searchsorted(at, t.first)
                n = np.diff(t.first)
                some = n >= min_tokens
                # anchors lie in documents of min_tokens at least, so these hold all of them
                rows = np.concatenate([[0], np.cumsum(np.diff(edge)[some])]).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(lo, hi - lo).filter(pa.array(some)),
                        pa.array(one[some].view(np.int64)),
                        pa.array(two[some].view(np.int64)),
                        pa.array(n[some].astype(np.int64)),
                        pa.ListArray.from_arrays(pa.array(rows), pa.array(h.view(np.int64))),
                        pa.ListArray.from_arrays(pa.array(rows), pa.array((at - t.first[t.doc[at]]).astype(np.int32))),
                    ],
                    ["doc_id", "fp1", "fp2", "n", "anchors", "places"],
                )

    return run


def _contexts(min_tokens: int):
    """Rows (doc_id, text, places) to one row a place, with the hashes of the tokens to its left, nearest first, then to its right, 0 outside, and over how many runs to either side its own is the least."""
    k = min_tokens // 2
    c = min_tokens - k

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = T.strings(batch.column(1))
            places = batch.column(2)
            for lo, hi in T.spans(texts, 1 << 19):
                t = T.tokenize(texts.slice(lo, hi - lo))
                if not len(t.hash):
                    continue
                mine = places.slice(lo, hi - lo)
                size = np.diff(mine.offsets.to_numpy())
                doc = np.repeat(np.arange(hi - lo), size)
                pos = mine.flatten().to_numpy().astype(np.int64)
                at = t.first[doc] + pos
                h, _ = run_hashes(t, k)
                small = (t.hash >> T.U64(32)).astype(np.uint32) | np.uint32(1)
                steps = np.concatenate([-1 - np.arange(c), k + np.arange(c)])
                where = at[:, None] + steps
                inside = (where >= t.first[doc][:, None]) & (where < t.first[doc + 1][:, None])
                least = [(h[np.clip(at[:, None] + side, 0, len(h) - 1)] >= h[at][:, None]).cumprod(axis=1).sum(axis=1) for side in (-1 - np.arange(c), 1 + np.arange(c))]
                context = np.empty((len(at), 2 * c + 1), np.uint32)
                context[:, : 2 * c] = np.where(inside, small[np.clip(where, 0, len(small) - 1)], np.uint32(0))
                context[:, 2 * c] = least[0] << 16 | least[1]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(h[at].view(np.int64)),
                        batch.column(0).slice(lo, hi - lo).take(pa.array(doc)),
                        pa.array(pos.astype(np.int32)),
                        pa.Array.from_buffers(pa.binary(), len(at), [None, pa.py_buffer((np.arange(len(at) + 1) * 4 * (2 * c + 1)).astype(np.int32)), pa.py_buffer(np.ascontiguousarray(context))]),
                    ],
                    ["anchor", "doc_id", "pos", "context"],
                )

    return run


def _table(batch: pa.RecordBatch, c: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    anchor, doc, pos = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(3))
    column = batch.column(3)
    width = 4 * (2 * c + 1)
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)[column.offset * width :][: len(column) * width]
    return anchor, doc, pos.astype(np.int64), data.view(np.uint32).reshape(len(column), 2 * c + 1)


def window_keys(anchor: np.ndarray, context: np.ndarray, c: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For t = 0 .. c: (rows, key) of the c tokens around the anchor, t of them left, for rows that have so many and whose anchor is the least run among them.

    So a window is looked up by its least run alone, which all of its places have chosen.
    """
    sides = []
    for side in (context[:, :c], context[:, c : 2 * c]):
        x, all_ = np.zeros(len(anchor), np.uint64), [np.zeros(len(anchor), np.uint64)]
        for j in range(c):
            x = T.mix64(x * T.GOLDEN + side[:, j].astype(np.uint64))
            all_.append(x)
        sides.append((all_, np.concatenate([(side != 0).cumprod(axis=1).sum(axis=1)])))
    (left, n_left), (right, n_right) = sides
    own = anchor.view(np.uint64)
    n_left, n_right = np.minimum(n_left, context[:, 2 * c] >> 16), np.minimum(n_right, context[:, 2 * c] & 0xFFFF)
    for t in range(c + 1):
        rows = np.flatnonzero((n_left >= t) & (n_right >= c - t))
        yield rows, T.mix64(own[rows] + left[t][rows] * _A + right[c - t][rows] * _B + T.U64(t))


def partners(which: np.ndarray, groups: int, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, partner) for rows by (doc, place) in groups `which`: the first row of another document, else the neighbour in the same one."""
    order = np.argsort(which, kind="stable")
    edge = np.searchsorted(which[order], np.arange(groups))
    first = order[edge]
    other = doc[first[which]] != doc
    second = np.full(groups, -1)
    found, at = np.unique(which[other], return_index=True)
    second[found] = np.flatnonzero(other)[at]
    partner = np.where(other, first[which], second[which])
    here = order[1:][which[order[1:]] == which[order[:-1]]]
    before = order[:-1][which[order[1:]] == which[order[:-1]]]
    alone = second[which[here]] < 0
    here, before = here[alone], before[alone]
    partner[here] = before
    head = partner[before] < 0  # the first place looks ahead
    partner[before[head]] = here[head]
    rows = np.flatnonzero(partner >= 0)
    return rows, partner[rows]


def match_places(anchor: np.ndarray, doc: np.ndarray, pos: np.ndarray, context: np.ndarray, c: int, k: int, most: int = 50_000) -> Iterator[np.ndarray]:
    """Rows (doc, source, diagonal, begin, end, low, high) of whole buckets, given by (anchor, doc, pos), of `most` pairs at a time; low and high: whether the match may go on there."""
    new = np.ones(len(anchor), bool)  # a row that repeats a doc_id has its places again
    new[1:] = (anchor[1:] != anchor[:-1]) | (doc[1:] != doc[:-1]) | (pos[1:] != pos[:-1])
    anchor, doc, pos, context = anchor[new], doc[new], pos[new], context[new]
    found = []
    for rows, key in window_keys(anchor, context, c):
        keys, which, n = np.unique(key, return_inverse=True, return_counts=True)
        met = n[which] > 1
        rows = rows[met]
        number = np.cumsum(n > 1) - 1
        mine, partner = partners(number[which[met]], int((n > 1).sum()), doc[rows])
        found.append(rows[mine] * len(anchor) + rows[partner])
    pairs = np.unique(np.concatenate(found))
    for at in range(0, len(pairs), most):
        i, s = pairs[at : at + most] // len(anchor), pairs[at : at + most] % len(anchor)
        reach = [((context[i, a : a + c] == context[s, a : a + c]) & (context[i, a : a + c] != 0)).cumprod(axis=1).sum(axis=1) for a in (0, c)]
        yield np.stack([doc[i], doc[s], pos[i] - pos[s], pos[i] - reach[0], pos[i] + k + reach[1], reach[0] == c, reach[1] == c], axis=1)


def touching(x: np.ndarray) -> np.ndarray:
    """Rows of match_places with those of one pair and diagonal that touch as one, as joined_stretches does it over all tasks.

    A periodic run has a place each period in one bucket, so most of its stretches end here and aren't shuffled.
    """
    if len(x) < 2:
        return x
    y = x.view(np.uint64)
    pair = T.mix64(y[:, 0] * T.GOLDEN + T.mix64(y[:, 1] * _A + T.mix64(y[:, 2] * _B)))
    x = x[np.lexsort((x[:, 5], x[:, 3], pair))]
    other = np.ones(len(x), bool)
    other[1:] = (x[1:, :3] != x[:-1, :3]).any(axis=1)
    group = np.cumsum(other)
    # the furthest end so far in the group: groups are set apart by more than any end
    step = int(x[:, 4].max()) + 1
    reached = np.maximum.accumulate(group * step + x[:, 4]) - group * step
    new = other.copy()
    new[1:] |= x[1:, 3] > reached[:-1]
    head = np.flatnonzero(new)
    out = x[head]
    out[:, 4] = np.maximum.reduceat(x[:, 4], head)
    # open at the end only if all that reach it are
    last = x[:, 4] == out[np.cumsum(new) - 1, 4]
    out[:, 6] = np.minimum.reduceat(np.where(last, x[:, 6], 1), head)
    return out


def _match(min_tokens: int):
    k = min_tokens // 2
    c = min_tokens - k

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []

        def done(parts: list[tuple]) -> Iterator[pa.RecordBatch]:
            if parts:
                for part in map(touching, match_places(*(np.concatenate(p) for p in zip(*parts, strict=True)), c, k)):
                    columns = [pa.array(part[:, j].copy(), pa.int64() if j < 5 else pa.int32()) for j in range(7)]
                    yield pa.RecordBatch.from_arrays(columns, ["doc_id", "source_id", "diagonal", "begin", "end", "low", "high"])

        for batch in batches:
            new = _table(batch, c)
            if not len(new[0]):
                continue
            cut = int(np.searchsorted(new[0], new[0][-1]))  # the last bucket may go on
            if held and held[-1][0][-1] != new[0][0] or cut:
                yield from done([*held, tuple(x[:cut] for x in new)] if cut else held)
                held = []
            held.append(tuple(x[cut:].copy() for x in new))
        yield from done(held)

    return run


def _keys(min_tokens: int):
    k = min_tokens // 2
    c = min_tokens - k

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            anchor, doc, pos, context = _table(batch, c)
            for t, (rows, key) in enumerate(window_keys(anchor, context, c)):
                yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(doc[rows]), pa.array(pos[rows] - t)], ["key", "doc_id", "begin"])

    return run


def _hot_matches(places: DataFrame, min_tokens: int) -> DataFrame:
    """What `_match` finds, by keys in Spark's aggregation: partial minima, no bucket in one task."""
    keys = keep(places.mapInArrow(T.lean(_keys(min_tokens)), "key long, doc_id long, begin long").distinct(), "keys")
    # the first place of each document, then of all of them the first two documents
    by_doc = keep(keys.groupBy("key", "doc_id").agg(F.min("begin").alias("begin"), F.count("*").alias("n")), "firsts")
    first = by_doc.groupBy("key").agg(F.min(F.struct("doc_id", "begin")).alias("one"), F.count("*").alias("docs"), F.sum("n").alias("n")).where("n > 1")
    second = by_doc.join(first.where("docs > 1"), "key").where("doc_id <> one.doc_id").groupBy("key").agg(F.min(F.struct("doc_id", "begin")).alias("two"))
    met = keys.join(first.join(second, "key", "left"), "key")
    row = lambda source, start: [F.col("doc_id"), source.alias("source_id"), (F.col("begin") - start).alias("diagonal"), F.col("begin")]
    partner = F.when(F.col("one.doc_id") != F.col("doc_id"), F.col("one")).otherwise(F.col("two"))
    rows = met.where("docs > 1").select("doc_id", "begin", partner.alias("p")).select(row(F.col("p.doc_id"), F.col("p.begin")))
    w = Window.partitionBy("key", "doc_id").orderBy("begin")
    same = met.where("docs = 1").select("doc_id", "begin", F.coalesce(F.lag("begin").over(w), F.lead("begin").over(w)).alias("near"))
    rows = rows.unionByName(same.select(row(F.col("doc_id"), F.col("near"))))
    return rows.withColumns({"end": F.col("begin") + min_tokens, "low": F.lit(1), "high": F.lit(1)})


def joined_stretches(rows: DataFrame) -> DataFrame:
    """Touching stretches (doc_id, source_id, diagonal, begin, end, low, high) as one."""
    w = Window.partitionBy("doc_id", "source_id", "diagonal").orderBy("begin", "end")
    before = F.max("end").over(w.rowsBetween(Window.unboundedPreceding, -1))
    rows = rows.repartition("doc_id", "source_id").withColumn("new", F.when(F.col("begin") <= before, 0).otherwise(1))
    rows = rows.withColumn("island", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    ends = F.min(F.struct("begin", "low")).alias("a"), F.max(F.struct("end", (-F.col("high")).alias("high"))).alias("b")
    rows = rows.groupBy("doc_id", "source_id", "diagonal", "island").agg(*ends)
    return rows.select("doc_id", "source_id", "diagonal", F.col("a.begin").alias("begin"), F.col("b.end").alias("end"), F.col("a.low").alias("low"), (-F.col("b.high")).alias("high"))


def common(total: np.ndarray, a: np.ndarray, b: np.ndarray, most: np.ndarray, back: bool) -> np.ndarray:
    """How many tokens, `most` at the most, are equal from a and b on (back: before them), by bisection over the prefix hashes `total`."""
    _, down = T.powers(len(total))
    low, high = np.zeros_like(most), np.maximum(most, 0)
    while (todo := low < high).any():
        n = np.where(todo, (low + high + 1) // 2, low)
        x, y = (a - n, b - n) if back else (a, b)
        same = (total[x + n] - total[x]) * down[x] == (total[y + n] - total[y]) * down[y]
        low, high = np.where(todo & same, n, low), np.where(todo & ~same, n - 1, high)
    return low


def _extend(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows by (source_id, salt, role): the source's text, then its partners' with their open stretches. Gives the maximal matches."""
    held = np.empty(0, np.uint64)
    for batch in batches:
        texts = T.strings(batch.column(2))
        docs, role, sources = (batch.column(i).to_numpy(zero_copy_only=False) for i in (1, 3, 0))
        lists = batch.column(5)
        for lo, hi in T.spans(texts):
            t = T.tokenize(texts.slice(lo, hi - lo))
            hashes = np.concatenate([held, t.hash])
            up, _ = T.powers(len(hashes) + 1)
            total = np.zeros(len(hashes) + 1, np.uint64)
            np.cumsum(hashes * up[: len(hashes)], out=total[1:])
            first, size = len(held) + t.first[:-1], np.diff(t.first)
            heads = np.flatnonzero(role[lo:hi] == 0)
            at = np.searchsorted(heads, np.arange(hi - lo), side="right") - 1  # the head before a row, or the one held
            mine = lists.slice(lo, hi - lo)
            row = np.repeat(np.arange(hi - lo), np.diff(mine.offsets.to_numpy()))
            diagonal, begin, end = (x.to_numpy(zero_copy_only=False) for x in mine.flatten().flatten())
            if len(heads):
                src_first = np.where(at[row] < 0, 0, first[heads[np.maximum(at[row], 0)]])
                src_size = np.where(at[row] < 0, len(held), size[heads[np.maximum(at[row], 0)]])
            else:
                src_first, src_size = np.zeros(len(row), np.int64), np.full(len(row), len(held))
            a, b = first[row], src_first - diagonal
            more = common(total, a + end, b + end, np.minimum(size[row] - end, src_size - (end - diagonal)), False)
            less = common(total, a + begin, b + begin, np.minimum(begin, begin - diagonal), True)
            if len(row):
                columns = [docs[lo:hi][row], sources[lo:hi][row], diagonal, begin - less, end + more]
                yield pa.RecordBatch.from_arrays([pa.array(x.astype(np.int64)) for x in columns], ["doc_id", "source_id", "diagonal", "begin", "end"])
            if len(heads):
                h = heads[-1]
                held = t.hash[t.first[h] : t.first[h + 1]].copy()


def extended(texts: DataFrame, rows: DataFrame) -> DataFrame:
    """The stretches (doc_id, source_id, diagonal, begin, end) as far as they go on both ways; each of two texts is met once a pair."""
    pairs = keep(rows.groupBy("source_id", "doc_id").agg(F.collect_list(F.struct("diagonal", "begin", "end")).alias("open")), "open")
    salts = pairs.groupBy("source_id").agg(F.ceil(F.count("*") / PER_TASK).cast("int").alias("salts"))
    none = F.array().cast("array<struct<diagonal:bigint,begin:bigint,end:bigint>>")
    heads = salts.select("source_id", F.col("source_id").alias("doc_id"), F.lit(0).alias("role"), F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), none.alias("open"))
    rest = pairs.join(salts, "source_id").select("source_id", "doc_id", F.lit(1).alias("role"), F.pmod(F.xxhash64("doc_id"), F.col("salts")).cast("int").alias("salt"), "open")
    wanted = heads.unionByName(rest)
    rows = with_ids(texts, wanted.select("doc_id")).join(wanted.hint("merge"), "doc_id").select("source_id", "doc_id", "text", "role", "salt", "open")
    return rows.repartition("source_id", "salt").sortWithinPartitions("source_id", "salt", "role").mapInArrow(T.lean(_extend), MATCHES)


def repeated_passages(docs: DataFrame, min_tokens: int = MIN_TOKENS, hot: int = HOT) -> DataFrame:
    """(doc_id, begin, end, n_tokens, source_id, source_begin): tokens begin .. end of a document are those from source_begin on of another, or the same, one.

    Each row is a maximal repeat of two places. All holders of a passage have rows, the earliest too; which
    place a passage is told of is said above: the first by (doc_id, place) in another document, else the nearest
    in the same one, which the repeat may overlap. Tokens are runs of letters and digits in
    lower case, where all characters beyond ASCII count as letters; ASCII punctuation, case and white space
    don't count. Of documents equal as token sequences the first is told of the second, and the others, as one
    whole repeat, of the first; passages shared with others are then told of the first alone. Null, empty and
    short texts (under min_tokens) repeat nothing, rows with a null doc_id aren't looked at, nor other columns.
    doc_id is taken to be unique; rows that repeat one in full count once. An empty table gives an empty one.
    """
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where("doc_id is not null")
    signed = keep(texts.mapInArrow(T.lean(_anchors(min_tokens)), "doc_id long, fp1 long, fp2 long, n long, anchors array<long>, places array<int>"), "anchors")
    reps = signed.groupBy("fp1", "fp2").agg(F.min("doc_id").alias("rep"), F.count("*").alias("copies")).where("copies > 1")
    copies = keep(signed.select("doc_id", "fp1", "fp2", "n").join(reps, ["fp1", "fp2"]).where("doc_id <> rep").select("doc_id", "rep", "n").distinct(), "copies")
    single = signed.join(copies.select("doc_id").hint("merge"), "doc_id", "left_anti").select("doc_id", F.explode(F.arrays_zip("anchors", "places")).alias("a")).select("doc_id", F.col("a.anchors").alias("anchor"), F.col("a.places").alias("pos"))
    often = keep(single.groupBy("anchor").agg(F.count("*").alias("n")).where("n > 1"), "often")
    mine = keep(single.join(often.select("anchor").hint("merge"), "anchor").groupBy("doc_id").agg(F.array_sort(F.collect_set("pos")).alias("places")), "mine")
    places = with_ids(texts, mine.select("doc_id")).join(mine.hint("merge"), "doc_id").select("doc_id", "text", "places").mapInArrow(T.lean(_contexts(min_tokens)), PLACES)
    crowded = often.where(F.col("n") > hot).select("anchor")
    if crowded.isEmpty():
        rows = places.repartition("anchor").sortWithinPartitions("anchor", "doc_id", "pos").mapInArrow(T.lean(_match(min_tokens)), REPEATS)
    else:
        places = keep(places, "places")
        few = places.join(crowded, "anchor", "left_anti")
        rows = few.repartition("anchor").sortWithinPartitions("anchor", "doc_id", "pos").mapInArrow(T.lean(_match(min_tokens)), REPEATS)
        rows = rows.unionByName(_hot_matches(places.join(crowded, "anchor", "left_semi").select("anchor", "doc_id", "pos", "context"), min_tokens))
    found = keep(joined_stretches(rows), "stretches")
    plain = ["doc_id", "source_id", "diagonal", "begin", "end"]
    all_ = found.where("low = 0 and high = 0").select(plain).unionByName(extended(texts, found.where("low = 1 or high = 1").select(plain)))
    # within the matches of two documents, by their begins, one that ends no later than one before lies inside it
    w = Window.partitionBy("doc_id", "source_id").orderBy("begin", F.desc("end"), F.abs("diagonal"), "diagonal").rowsBetween(Window.unboundedPreceding, -1)
    all_ = all_.withColumn("reached", F.max("end").over(w)).where("reached is null or end > reached")
    found = all_.select("doc_id", "begin", "end", (F.col("end") - F.col("begin")).alias("n_tokens"), "source_id", (F.col("begin") - F.col("diagonal")).alias("source_begin"))
    zero = F.lit(0).cast("long")
    firsts = copies.groupBy(F.col("rep").alias("doc_id"), "n").agg(F.min("doc_id").alias("rep"))
    whole = copies.unionByName(firsts).select("doc_id", zero.alias("begin"), F.col("n").alias("end"), F.col("n").alias("n_tokens"), F.col("rep").alias("source_id"), zero.alias("source_begin"))
    return found.unionByName(whole)


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All repeated passages of the documents, those within one document too."""
    return repeated_passages(read_table(spark, sf_dir, "documents"))

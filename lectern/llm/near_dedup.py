"""Near-duplicate documents by SuperMinHash (Ertl, 2017), banding, verification and union-find.

Plan, for n documents:

1. One scan turns each text into the 64-bit hashes of its runs of SHINGLE tokens, the SuperMinHash
   signature of that set, BANDS band keys, and a 128-bit hash of the token sequence. Texts of equal
   token sequence are equal sets, so one representative of each goes on (a map-side-combined
   aggregate; thousands of copies cost one row a partition).
2. Band keys met once are dropped. The others' rows, each with its signature cut to a byte a register,
   are sorted by bucket, one over BLOCK rows in several blocks. A task holds a bucket's leaders alone: a
   row is a candidate with the first row if their estimate reaches THRESHOLD + ABOVE, else with the leader
   of most equal registers, if that estimate reaches THRESHOLD - BELOW, and then becomes a leader itself
   unless it reaches THRESHOLD + ABOVE. So a bucket of k gives at most k - 1 pairs, not k(k - 1)/2, and
   most of each group is found.
3. Candidates are verified by the exact Jaccard similarity of the shingle sets. The texts are shuffled
   once to meet their pairs, then lie sorted behind their leader, so a task holds one leader's set
   and one batch, however many partners there are; leaders with many partners are salted.
4. Verified pairs are grouped by union-find. Buckets that hold rows of several groups are read again,
   and every pair of rows of two groups whose estimate reaches THRESHOLD - BELOW is verified too. So
   each pair that meets in a bucket with such an estimate is either verified or in one group already.
   Buckets over BLOCK rows are dealt out as pairs of blocks.
5. All verified pairs are grouped; with them come the exact copies.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.llm import _text as T
from lectern.llm._tables import by_ids, keep, read_table, with_ids
from lectern.operators.components import components

SHINGLE = 3
BANDS = 32
ROWS = 4
THRESHOLD = 0.5
#: An estimate over BANDS * ROWS registers has a standard deviation of at most 0.045.
BELOW = 0.1
ABOVE = 0.05
#: Partners of one leader that a task verifies; more are spread over salts.
PER_TASK = 4096
#: Rows of one bucket that are compared with each other in one piece.
BLOCK = 4096

_UNSET = T.U64(0xFFFFFFFFFFFFFFFF)
SIGNED = "doc_id long, fp1 long, fp2 long, n long, bands array<long>, sig binary"


def superminhash(elements: np.ndarray, doc: np.ndarray, docs: int, m: int) -> np.ndarray:
    """SuperMinHash signatures [docs, m] of the sets of 64-bit `elements`, `doc` ascending.

    Element e visits the m registers in the order of its own random permutation p: at step j it
    offers register p[j] the value j + r[j], r[j] uniform in [0, 1). Registers keep the least value,
    so an element is done once j exceeds the integer part of its document's largest register.
    A value is held as one integer: j in the top byte, r in the 56 bits below. Repeated elements
    change nothing; a document without elements keeps unset registers. m is at most 255.
    """
    regs = np.full(docs * m, _UNSET, np.uint64)
    state = T.mix64(elements + T.GOLDEN)
    doc = np.asarray(doc, np.int64)
    drawn: list[np.ndarray] = []
    perm = None
    for j in range(m):
        state = T.mix64(state + T.GOLDEN)
        k = j + (((state & T.U64(0xFFFFFFFF)) * T.U64(m - j)) >> T.U64(32)).astype(np.int64)
        r = T.mix64(state ^ T.U64(0xA5A5A5A5A5A5A5A5)) >> T.U64(8)
        if perm is None and j < 4:  # few have drawn much: follow the swaps back
            out = k.copy()
            for i in range(j - 1, -1, -1):
                out[drawn[i] == out] = i
            drawn.append(k)
        else:
            if perm is None:
                perm = np.broadcast_to(np.arange(m, dtype=np.int16), (len(k), m)).copy()
                rows = np.arange(len(k))
                for i, d in enumerate(drawn):
                    x = perm[rows, i].copy()
                    perm[rows, i] = perm[rows, d]
                    perm[rows, d] = x
            rows = np.arange(len(k))
            out = perm[rows, k].astype(np.int64)
            perm[rows, k] = perm[rows, j]
            perm[rows, j] = out
        np.minimum.at(regs, doc * m + out, (T.U64(j) << T.U64(56)) | r)
        most = (regs.reshape(docs, m).max(axis=1) >> T.U64(56)).astype(np.int64)
        live = most[doc] > j
        if not live.any():
            break
        if not live.all():
            state, doc = state[live], doc[live]
            if perm is None:
                drawn = [d[live] for d in drawn]
            else:
                perm = perm[live]
    return regs.reshape(docs, m)


def band_keys(signatures: np.ndarray, bands: int, rows: int) -> np.ndarray:
    parts = signatures.reshape(len(signatures), bands, rows)
    key = np.zeros(parts.shape[:2], np.uint64)
    for i in range(rows):
        key = T.mix64(key * T.GOLDEN + parts[:, :, i])
    return T.mix64(key + np.arange(bands, dtype=np.uint64) * T._BASE)


def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = T.strings(batch.column(1))
        for lo, hi in T.spans(texts):
            t = T.tokenize(texts.slice(lo, hi - lo))
            doc, grams = T.ngram_hashes(t, SHINGLE)
            docs = hi - lo
            signatures = superminhash(grams, doc, docs, BANDS * ROWS)
            keys = band_keys(signatures, BANDS, ROWS).view(np.int64)
            one, two = T.document_hashes(t, docs)
            n = np.diff(t.first)
            some = n > 0
            lists = pa.ListArray.from_arrays(pa.array(np.arange(some.sum() + 1, dtype=np.int32) * BANDS), pa.array(keys[some].ravel()))
            small = (T.mix64(signatures[some]) >> T.U64(56)).astype(np.uint8)
            ends = (np.arange(len(small) + 1) * BANDS * ROWS).astype(np.int32)
            sig = pa.Array.from_buffers(pa.binary(), len(small), [None, pa.py_buffer(ends), pa.py_buffer(small)])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).slice(lo, docs).filter(pa.array(some)), pa.array(one[some].view(np.int64)), pa.array(two[some].view(np.int64)), pa.array(n[some]), lists, sig],
                ["doc_id", "fp1", "fp2", "n", "bands", "sig"],
            )


def _equal_registers(estimate: float) -> int:
    """Registers cut to a byte agree by chance in one of 256."""
    return int(np.ceil(BANDS * ROWS * (estimate + (1 - estimate) / 256)))


def _signatures(column: pa.BinaryArray) -> np.ndarray:
    m = BANDS * ROWS
    return np.frombuffer(column.buffers()[2] or b"", np.uint8)[column.offset * m :][: len(column) * m].reshape(-1, m)


def _pair(threshold: float):
    """Rows (key, block, doc_id, sig) by key, block and doc_id to candidates (leader, member)."""
    m = BANDS * ROWS
    least, joins = _equal_registers(threshold - BELOW), _equal_registers(threshold + ABOVE)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, head_sig, head_id = None, np.zeros(m, np.uint8), 0
        leaders, ids, n = np.empty((16, m), np.uint8), [], 0  # of the bucket read last, without its first row
        for batch in batches:
            keys, blocks, docs = (batch.column(i).to_numpy() for i in range(3))
            rows = _signatures(batch.column(3))
            if not len(keys):
                continue
            new = np.ones(len(keys), bool)
            new[1:] = (keys[1:] != keys[:-1]) | (blocks[1:] != blocks[:-1])
            new[0] = place != (keys[0], blocks[0])
            bucket = np.cumsum(new) - 1  # -1: goes on from the last batch
            first = np.flatnonzero(new)
            heads, head_ids = np.concatenate([rows[first], head_sig[None]]), np.append(docs[first], head_id)
            equal = np.count_nonzero(rows == heads[bucket], axis=1)
            out = [np.stack([head_ids[bucket], docs], axis=1)[(equal >= joins) & ~new]]
            # the few unlike their bucket's first row meet its other leaders one by one
            here = -1
            for i in np.flatnonzero((equal < joins) & ~new):
                if bucket[i] != here:
                    here, ids, n = bucket[i], [], 0
                best, at = int(equal[i]), -1
                if n:
                    alike = np.count_nonzero(leaders[:n] == rows[i], axis=1)
                    k = int(alike.argmax())
                    if alike[k] > best:
                        best, at = int(alike[k]), k
                if best >= least:
                    out.append(np.array([[ids[at] if at >= 0 else head_ids[bucket[i]], docs[i]]]))
                if best < joins:
                    if n == len(leaders):
                        leaders = np.concatenate([leaders, np.empty_like(leaders)])
                    leaders[n] = rows[i]
                    ids.append(int(docs[i]))
                    n += 1
            if bucket[-1] != here and bucket[-1] >= 0:
                ids, n = [], 0
            place, head_sig, head_id = (keys[-1], blocks[-1]), heads[bucket[-1]].copy(), int(head_ids[bucket[-1]])
            pairs = np.unique(np.concatenate(out), axis=0)
            if len(pairs):
                yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0].copy()), pa.array(pairs[:, 1].copy())], ["leader", "member"])

    return run


def _across(threshold: float):
    """Rows (key, cell, side, doc_id, root, sig) by key, cell and side to all candidates of different roots: those of side 0 with each other and with those of side 1."""
    m = BANDS * ROWS
    least = _equal_registers(threshold - BELOW)

    def pairs(a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], ["leader", "member"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, n = None, 0
        held, ids, roots = np.empty((16, m), np.uint8), np.empty(16, np.int64), np.empty(16, np.int64)
        for batch in batches:
            keys, cells, side, docs, root = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(5))
            rows = _signatures(batch.column(5))
            if not len(keys):
                continue
            edge = np.flatnonzero((keys[1:] != keys[:-1]) | (cells[1:] != cells[:-1])) + 1
            begin, end = np.concatenate([[0], edge]), np.append(edge, len(keys))
            # cells of two rows, most of all, at once; the batch's first and last may go on in others
            two = np.flatnonzero((end - begin == 2) & (begin > 0) & (end < len(keys)))
            a, b = begin[two], begin[two] + 1
            hit = (root[a] != root[b]) & (docs[a] != docs[b]) & (side[a] == 0) & (np.count_nonzero(rows[a] == rows[b], axis=1) >= least)
            if hit.any():
                yield pairs(docs[a[hit]], docs[b[hit]])
            for g in np.setdiff1d(np.flatnonzero((end - begin > 1) | (begin == 0) | (end == len(keys))), two):
                here = (keys[begin[g]], cells[begin[g]])
                if here != place:
                    place, n = here, 0
                for i in range(begin[g], end[g]):
                    if n:
                        other = np.flatnonzero(roots[:n] != root[i])
                        met = ids[other[np.count_nonzero(held[other] == rows[i], axis=1) >= least]]
                        met = met[met != docs[i]]
                        if len(met):
                            yield pairs(met, np.full(len(met), docs[i]))
                    if side[i] == 0:
                        if n == len(ids):
                            held, ids, roots = (np.concatenate([x, np.empty_like(x)]) for x in (held, ids, roots))
                        held[n], ids[n], roots[n] = rows[i], docs[i], root[i]
                        n += 1

    return run


def _dealt(rows: DataFrame, block: int) -> DataFrame:
    """Rows (key, doc_id, root, n), n rows a key, with (cell, side): any two rows of a key are in one cell, one of them on side 0."""
    blocks = F.ceil(F.col("n") / block).cast("long")
    mine = F.pmod(F.xxhash64("doc_id"), F.col("blocks"))
    rows = rows.withColumn("blocks", blocks).withColumn("mine", mine)
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    # a cell (i, j), i < j, compares block i, on side 0, with block j; a cell (i, i) block i with itself
    cell = F.least("mine", "other") * F.col("blocks") + F.greatest("mine", "other")
    return rows.select("key", cell.alias("cell"), F.when(F.col("mine") > F.col("other"), 1).otherwise(0).alias("side"), "doc_id", "root")


def _sets(texts: pa.LargeStringArray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (document, shingle), by document then shingle."""
    doc, grams = T.ngram_hashes(T.tokenize(texts), SHINGLE)
    order = np.lexsort((grams, doc))
    doc, grams = doc[order], grams[order]
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (grams[1:] != grams[:-1])
    return doc[new], grams[new]


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows by (leader, salt, role): the leader's text, then its partners'. Gives the exact Jaccard similarities."""
    leader, own = None, np.empty(0, np.uint64)
    for batch in batches:
        leaders, docs, role = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1, 3))
        texts = T.strings(batch.column(2))
        out_leader, out_doc, out_j = [], [], []
        for lo, hi in T.spans(texts):
            doc, grams = _sets(texts.slice(lo, hi - lo))
            first = np.searchsorted(doc, np.arange(hi - lo + 1))
            run = np.flatnonzero(np.concatenate([[True], (leaders[lo + 1 : hi] != leaders[lo : hi - 1]) | (role[lo + 1 : hi] == 0)]))
            for a, b in zip(run, [*run[1:], hi - lo], strict=True):
                if role[lo + a] == 0:
                    leader, own = leaders[lo + a], grams[first[a] : first[a + 1]]
                    a += 1
                if a == b:
                    continue
                assert leader == leaders[lo + a], "a partner came without its leader"
                g = grams[first[a] : first[b]]
                at = np.searchsorted(own, g)
                hit = np.zeros(len(g) + 1, np.int64)
                if len(own):
                    np.cumsum(own[np.minimum(at, len(own) - 1)] == g, out=hit[1:])
                edge = first[a : b + 1] - first[a]
                both = hit[edge[1:]] - hit[edge[:-1]]
                union = len(own) + np.diff(edge) - both
                out_leader.append(leaders[lo + a : lo + b])
                out_doc.append(docs[lo + a : lo + b])
                out_j.append(both / np.maximum(union, 1))
        if out_doc:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in (out_leader, out_doc, out_j)], ["leader", "member", "jaccard"])


def verify_pairs(texts: DataFrame, pairs: DataFrame) -> DataFrame:
    """(leader, member, jaccard) of distinct pairs (leader, member) over (doc_id, text)."""
    salts = pairs.groupBy("leader").agg(F.ceil(F.count("*") / PER_TASK).cast("int").alias("salts"))
    heads = salts.select("leader", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), F.col("leader").alias("doc_id"), F.lit(0).alias("role"))
    rest = pairs.join(salts, "leader").select("leader", F.pmod(F.xxhash64("member"), F.col("salts")).cast("int").alias("salt"), F.col("member").alias("doc_id"), F.lit(1).alias("role"))
    # the hint keeps one plan at every size; Spark would else broadcast small sides alone
    texts = with_ids(texts, pairs.select(F.explode(F.array("leader", "member"))).distinct())
    rows = texts.join(heads.union(rest).hint("merge"), "doc_id").select("leader", "doc_id", "text", "role", "salt")
    rows = rows.repartition("leader", "salt").sortWithinPartitions("leader", "salt", "role")
    return rows.mapInArrow(T.lean(_verify), "leader long, member long, jaccard double")


def near_pairs(docs: DataFrame, threshold: float = THRESHOLD, block: int = BLOCK) -> tuple[DataFrame, DataFrame]:
    """Verified pairs (leader, member, jaccard) of representatives, and (doc_id, rep) of all exact copies but the representative."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where("doc_id is not null")
    signed = keep(texts.mapInArrow(T.lean(_sign), SIGNED), "signed")
    reps = keep(signed.groupBy("fp1", "fp2").agg(F.min("doc_id").alias("rep"), F.count("*").alias("copies"), F.first("bands").alias("bands"), F.first("sig").alias("sig")), "reps")
    copies = signed.select("doc_id", "fp1", "fp2").join(reps.where("copies > 1").select("fp1", "fp2", "rep"), ["fp1", "fp2"]).where("doc_id <> rep").select("doc_id", "rep")
    rows = reps.select(F.col("rep").alias("doc_id"), F.explode("bands").alias("key"))
    shared = rows.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    sigs = reps.select(F.col("rep").alias("doc_id"), "sig")
    # a large bucket is read in blocks, in as many tasks; step 4 compares the blocks
    part = F.pmod(F.xxhash64("doc_id"), F.ceil(F.col("n") / block)).alias("block")
    met = rows.join(shared.hint("merge"), "key").select("key", part, "doc_id").join(sigs, "doc_id").select("key", "block", "doc_id", "sig")
    met = met.repartition("key", "block").sortWithinPartitions("key", "block", "doc_id")
    todo = keep(met.mapInArrow(T.lean(_pair(threshold)), "leader long, member long").where("leader <> member").distinct(), "candidates")
    pairs = keep(verify_pairs(texts, todo).where(F.col("jaccard") >= threshold), "pairs")
    roots = components(pairs.select(F.col("member").alias("node"), F.col("leader").alias("root"))).withColumnRenamed("node", "doc_id")
    rows = rows.join(roots.hint("merge"), "doc_id", "left").select("key", "doc_id", F.coalesce("root", "doc_id").alias("root"))
    rows = keep(rows, "rooted")
    mixed = rows.groupBy("key").agg(F.count("*").alias("n"), F.min("root").alias("low"), F.max("root").alias("high")).where("low < high").select("key", "n")
    apart = _dealt(rows.join(mixed.hint("merge"), "key"), block).join(sigs.hint("merge"), "doc_id").select("key", "cell", "side", "doc_id", "root", "sig")
    apart = apart.repartition("key", "cell").sortWithinPartitions("key", "cell", "side")
    more = apart.mapInArrow(T.lean(_across(threshold)), "leader long, member long").distinct()
    more = keep(_by_partners(more.join(todo.hint("merge"), ["leader", "member"], "left_anti")), "more")
    return pairs.unionByName(verify_pairs(texts, more).where(F.col("jaccard") >= threshold)), copies


def _by_partners(pairs: DataFrame) -> DataFrame:
    """Pairs (leader, member), each led by its end of more pairs, so the text of a document with many partners goes out once a salt."""
    pairs = keep(pairs, "apart")
    ends = pairs.select(F.col("leader").alias("doc")).union(pairs.select("member")).groupBy("doc").agg(F.count("*").alias("n"))
    both = pairs.join(ends.select(F.col("doc").alias("leader"), F.col("n").alias("a")).hint("merge"), "leader").join(ends.select(F.col("doc").alias("member"), F.col("n").alias("b")).hint("merge"), "member")
    swap = F.col("a") < F.col("b")
    return both.select(F.when(swap, F.col("member")).otherwise(F.col("leader")).alias("leader"), F.when(swap, F.col("leader")).otherwise(F.col("member")).alias("member"))


def near_groups(docs: DataFrame, threshold: float = THRESHOLD, block: int = BLOCK) -> DataFrame:
    """(doc_id, keep_id) for each document that repeats another one; keep_id is its group's least doc_id.

    Two documents are near copies if their sets of 3-token runs (the whole token sequence, if it is
    shorter) have a Jaccard similarity of at least `threshold`; groups are the connected components of the
    pairs found, which are those that share a band and have an estimate of at least threshold - BELOW: at
    similarity 0.5 a pair is missed with probability 0.13, at 0.6 with 0.01. Tokens are runs of letters and
    digits in lower case, where all characters beyond ASCII count as letters, typographic quotes and dashes
    too; case, ASCII punctuation and white space don't count. Documents without tokens (null, empty, punctuation
    only) and rows with a null doc_id are in no group. Rows that repeat a doc_id count once. Other
    columns are not looked at. An empty table gives an empty one.
    """
    pairs, copies = near_pairs(docs, threshold, block)
    edges = pairs.select(F.col("member").alias("node"), F.col("leader").alias("root")).union(copies)
    return components(edges).select(F.col("node").alias("doc_id"), F.col("root").alias("keep_id"))


def drop_near_duplicates(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The documents, with their columns, of which each group keeps that of least doc_id."""
    gone = keep(near_groups(docs, threshold).select(F.col("doc_id").alias("_lectern_gone")).distinct(), "gone")
    some, others = by_ids(docs, gone)
    return others.unionByName(some.join(gone.hint("merge"), docs["doc_id"] == gone["_lectern_gone"], "left_anti"))


def op3_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row a group of near copies: the document kept, how many there are, and all their ids."""
    groups = near_groups(read_table(spark, sf_dir, "documents"))
    lists = groups.groupBy("keep_id").agg(F.collect_set("doc_id").alias("ids"))
    all_ids = F.sort_array(F.concat(F.array("keep_id"), "ids"))
    return lists.select("keep_id", F.size(all_ids).cast("long").alias("n_docs"), all_ids.alias("doc_ids"))

"""Incremental, reversible line deduplication: sharded cuckoo filters over exact reference tables.

A store is a folder of the shared file system. It has

* refs (k1, k2, batch, doc_id, line_no): one row for each line of each document, the exact reference counts.
  A batch adds a table of its own; tables are never written again but by `compact`;
* gone (doc_id, before): documents deleted, whose references of batches under `before` don't count;
* filters (shard, keys, filter): one cuckoo filter a shard over the keys of refs (Fan and others,
  2014): four 16-bit fingerprints a bucket, two buckets a key, deletion by removing a fingerprint;
* meta: the number of batches and shards and the tables that make up this version.

An inserted batch probes the filters first. A line that they reject is new for certain, so only what
they pass is joined to the exact table: at 1 % to 20 % repeated lines most of a batch never meets it.
Deleting documents makes their references void; keys left without any go from the filters too. So
insert followed by delete of the same documents gives the counts before, and the line of a deleted
document is owned by the next document that holds it.

The keys are two 64-bit hashes; shards go by the first, and a shard is the unit of memory (some
20 bytes a key). Where a batch brings more than SHARD_LINES keys a shard, the shards are doubled until
they hold no more, and their filters built again.
"""

from __future__ import annotations

import json

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.llm import _text as T
from lectern.llm._tables import by_ids, keep, once, read_table, shared_path

SHARD_LINES = 250_000
#: Insertions into which the query and the pipeline divide a table, by its doc_id.
BATCHES = 2
REFS = "k1 long, k2 long, batch int, doc_id long, line_no int"
GONE = "doc_id long, before int"
FILTERS = "shard int, keys long, filter binary"


class CuckooFilter:
    """Buckets of four 16-bit fingerprints; insertion, lookup and deletion of many keys at once.

    A key's second bucket is the first xor a hash of its fingerprint, so it can move without the key.
    Where a cycle of moves finds no place the filter doubles from the fingerprints' keys, which the
    caller holds: `insert` then returns false and leaves the filter unchanged.
    """

    KICKS = 500

    def __init__(self, capacity: int):
        need = max(1, int(np.ceil(capacity / (4 * 0.84))))
        self.table = np.zeros((1 << int(need - 1).bit_length(), 4), np.uint16)

    @classmethod
    def of(cls, blob: bytes) -> CuckooFilter:
        new = cls(1)
        new.table = np.frombuffer(blob, np.uint16).reshape(-1, 4).copy()
        return new

    def blob(self) -> bytes:
        return self.table.tobytes()

    def _places(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        h = T.mix64(np.asarray(keys).view(np.uint64) + T.GOLDEN)
        fp = (h >> T.U64(48)).astype(np.uint16)
        fp[fp == 0] = 1
        mask = len(self.table) - 1
        one = (h & T.U64(mask)).astype(np.int64)
        return fp, one, self._other(one, fp)

    def _other(self, place: np.ndarray, fp: np.ndarray) -> np.ndarray:
        return place ^ (T.mix64(np.asarray(fp, np.uint64) * T.GOLDEN) & T.U64(len(self.table) - 1)).astype(np.int64)

    def contains(self, keys: np.ndarray) -> np.ndarray:
        fp, one, two = self._places(keys)
        return ((self.table[one] == fp[:, None]) | (self.table[two] == fp[:, None])).any(axis=1)

    def insert(self, keys: np.ndarray) -> bool:
        """Adds distinct keys that aren't in it."""
        before = self.table.copy()
        fp, one, two = self._places(keys)
        todo = np.arange(len(fp))
        for place in (one, two):
            for slot in range(4):
                if not len(todo):
                    return True
                free = todo[self.table[place[todo], slot] == 0]
                at, pick = np.unique(place[free], return_index=True)  # one key a slot
                self.table[at, slot] = fp[free[pick]]
                todo = np.setdiff1d(todo, free[pick], assume_unique=True)
        rng = np.random.default_rng(1)
        for i in todo:  # both buckets are taken: move others on
            f, place = fp[i], int(one[i])
            for _ in range(self.KICKS):
                free = np.flatnonzero(self.table[place] == 0)
                if len(free):
                    self.table[place, free[0]] = f
                    break
                slot = int(rng.integers(4))
                f, self.table[place, slot] = self.table[place, slot], f
                place = int(self._other(np.array([place]), np.array([f]))[0])
            else:
                self.table = before
                return False
        return True

    def delete(self, keys: np.ndarray) -> None:
        """Removes distinct keys that are in it."""
        fp, one, two = self._places(keys)
        todo = np.arange(len(fp))
        for place in (one, two):
            for slot in range(4):
                mine = todo[self.table[place[todo], slot] == fp[todo]]
                at, pick = np.unique(place[mine], return_index=True)  # a slot holds one key
                self.table[at, slot] = 0
                todo = np.setdiff1d(todo, mine[pick], assume_unique=True)


def _built(keys: np.ndarray) -> CuckooFilter:
    size = max(len(keys), 4)
    while True:
        made = CuckooFilter(size)
        if made.insert(keys):
            return made
        size *= 2


def _row(shard: int, keys: int, made: CuckooFilter) -> pa.Table:
    return pa.table({"shard": pa.array([shard], pa.int32()), "keys": pa.array([keys], pa.int64()), "filter": pa.array([made.blob()], pa.binary())})


def _build(table: pa.Table) -> pa.Table:
    """One shard's keys (shard, k1) to its filter."""
    k = np.unique(table.column("k1").to_numpy())
    return _row(table.column("shard")[0].as_py(), len(k), _built(k))


def _probe(lines: pa.Table, old: pa.Table) -> pa.Table:
    """One shard's distinct keys (shard, k1, k2) that its filter may hold."""
    if not lines.num_rows or not old.num_rows:
        return lines.slice(0, 0)
    return lines.filter(pa.array(CuckooFilter.of(old.column("filter")[0].as_py()).contains(lines.column("k1").to_numpy())))


def _update(change: pa.Table, old: pa.Table) -> pa.Table:
    """One shard's filter after the keys (shard, k1, add) came or went."""
    shard = (change if change.num_rows else old).column("shard")[0].as_py()
    k1, add = change.column("k1").to_numpy(), change.column("add").to_numpy(zero_copy_only=False)
    if old.num_rows:
        made, n = CuckooFilter.of(old.column("filter")[0].as_py()), old.column("keys")[0].as_py()
    else:
        made, n = CuckooFilter(max(4, int(add.sum()))), 0
    gone, new = np.unique(k1[~add]), np.unique(k1[add])
    made.delete(gone)
    if not made.insert(new):
        return _row(shard, -1, CuckooFilter(1))  # full: the caller builds it again from refs
    return _row(shard, n - len(gone) + len(new), made)


def trimmed(line: Column) -> Column:
    return F.regexp_replace(line, "^[ \\t\\r]+|[ \\t\\r]+$", "")


def split_lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n")


def line_keys(docs: DataFrame) -> DataFrame:
    """(k1, k2, doc_id, line_no) of each line that isn't blank; lines count from 0."""
    lines = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.posexplode(split_lines(F.col("text"))).alias("line_no", "line"))
    lines = lines.select("doc_id", "line_no", trimmed(F.col("line")).alias("line")).where("line <> '' and doc_id is not null")
    return lines.select(F.xxhash64("line").alias("k1"), F.xxhash64(F.lit("second"), "line").alias("k2"), "doc_id", "line_no")


class LineStore:
    """The lines of all documents inserted so far. Every change makes a new version; `path` names the newest, from which it can be opened again."""

    def __init__(self, spark: SparkSession, path: str | None = None, lasting: bool = True):
        self.spark, self.path, self.lasting = spark, path, lasting
        self.batch, self.shards, self.tables = 0, 1, {"refs": [], "ids": [], "gone": []}
        if path:
            meta = json.loads(spark.read.text(f"{path}/meta").first()[0])
            self.batch, self.shards, self.tables = meta["batch"], meta["shards"], meta["tables"]

    def _read(self, name: str, schema: str) -> DataFrame:
        paths = self.tables[name]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def _save(self, path: str, **added: str) -> None:
        """The next version: this one's tables and the added ones."""
        self.tables = {k: [*v, *([added[k]] if k in added else [])] for k, v in self.tables.items()}
        self.batch += 1
        self.path = path
        meta = json.dumps({"batch": self.batch, "shards": self.shards, "tables": self.tables})
        self.spark.createDataFrame([(meta,)], "value string").coalesce(1).write.text(f"{path}/meta")

    def _alive(self, rows: DataFrame) -> DataFrame:
        """Those of the rows (batch, doc_id, ...) that no later deletion took away."""
        if not self.tables["gone"]:
            return rows
        gone = self._read("gone", GONE).groupBy(F.col("doc_id").alias("_doc")).agg(F.max("before").alias("_before"))
        return rows.join(gone, (F.col("doc_id") == F.col("_doc")) & (F.col("batch") < F.col("_before")), "left_anti")

    def refs(self) -> DataFrame:
        return self._alive(self._read("refs", REFS))

    def ids(self) -> DataFrame:
        """The documents of the store that have lines."""
        return self._alive(self._read("ids", "doc_id long, batch int")).select("doc_id").distinct()

    def filters(self) -> DataFrame:
        return self.spark.read.schema(FILTERS).parquet(f"{self.path}/filters") if self.path else self.spark.createDataFrame([], FILTERS)

    def counts(self) -> DataFrame:
        """(k1, k2, docs, occurrences): the exact reference counts."""
        return self.refs().groupBy("k1", "k2").agg(F.countDistinct("doc_id").alias("docs"), F.count("*").alias("occurrences"))

    def _shard(self) -> Column:
        return F.pmod("k1", F.lit(self.shards)).cast("int").alias("shard")

    def _known(self, keys: DataFrame) -> DataFrame:
        """Those of the distinct keys (k1, k2) that the store holds: of what its shard's filter passes, what the exact table has."""
        maybe = keys.select(self._shard(), "k1", "k2").groupBy("shard").cogroup(self.filters().groupBy("shard")).applyInArrow(_probe, "shard int, k1 long, k2 long")
        return maybe.select("k1", "k2").hint("merge").join(self.refs().select("k1", "k2"), ["k1", "k2"], "left_semi")

    def insert(self, docs: DataFrame) -> DataFrame:
        """Adds the lines of documents (doc_id, text); see `insert_lines`. Null texts have no lines; rows with a null doc_id are left out."""
        return self.insert_lines(line_keys(docs))

    def insert_lines(self, lines: DataFrame) -> DataFrame:
        """Adds lines (k1, k2, doc_id, line_no); returns (doc_id, line_no) of those that repeat an earlier line.

        Earlier is what an earlier insertion brought, or in this one the line of the least (doc_id, line_no).
        Documents that the store holds already are left out, so to insert one twice changes and returns nothing;
        a document deleted before is inserted as a new one, behind those that came meanwhile.
        """
        path = shared_path(self.spark, "lines", self.lasting)
        if self.path:
            lines = lines.join(self.ids(), "doc_id", "left_anti")
        lines.select("k1", "k2", F.lit(self.batch).alias("batch"), "doc_id", "line_no").write.parquet(f"{path}/refs")
        new = self.spark.read.schema(REFS).parquet(f"{path}/refs")
        new.select("doc_id", "batch").distinct().write.parquet(f"{path}/ids")
        state = new.groupBy("k1", "k2").agg(F.min(F.struct("doc_id", "line_no")).alias("own"), F.count("*").alias("n"))
        if self.path:
            state = keep(state, "state")
            known = self._known(state.select("k1", "k2")).withColumn("old", F.lit(True))
            state = state.join(known.hint("merge"), ["k1", "k2"], "left").withColumn("old", F.coalesce("old", F.lit(False)))
        else:
            state = state.withColumn("old", F.lit(False))
        state = keep(state, "state")
        self._grow(new, state.where("not old"), path)
        self._save(path, refs=f"{path}/refs", ids=f"{path}/ids")
        again = state.where("old or n > 1").select("k1", "k2", F.when(~F.col("old"), F.col("own")).alias("own"))
        lines = new.join(again.hint("merge"), ["k1", "k2"])
        return lines.where("own is null or own.doc_id <> doc_id or own.line_no <> line_no").select("doc_id", "line_no")

    def _grow(self, new: DataFrame, added: DataFrame, path: str) -> None:
        """Filters with the keys of `added`, in more shards if these would get too full."""
        keys = (self.filters().agg(F.sum("keys")).first()[0] or 0) + added.count()
        if self.path and keys <= self.shards * SHARD_LINES:
            self._write_filters(added.select("k1", F.lit(True).alias("add")), self.refs().select("k1").union(new.select("k1")), path)
            return
        while keys > self.shards * SHARD_LINES or self.shards < 8:
            self.shards *= 2
        all_ = added.select("k1") if not self.path else self.refs().select("k1").union(new.select("k1"))
        all_.select(self._shard(), "k1").distinct().groupBy("shard").applyInArrow(_build, FILTERS).write.parquet(f"{path}/filters")

    def delete(self, ids: DataFrame) -> None:
        """Removes the documents named in the column doc_id; ids that the store doesn't hold change nothing."""
        path = shared_path(self.spark, "lines", self.lasting)
        before = keep(self.refs().join(ids.select("doc_id").distinct(), "doc_id", "left_semi").select("k1", "k2").distinct(), "touched")
        ids.select(F.col("doc_id").cast("long").alias("doc_id")).where("doc_id is not null").distinct().withColumn("before", F.lit(self.batch)).write.parquet(f"{path}/gone")
        filters = self.filters()
        self.tables["gone"] = [*self.tables["gone"], f"{path}/gone"]
        left = self.refs()
        # two keys that share k1 share their fingerprint: it goes with the last of them
        gone = before.select("k1").distinct().join(left, "k1", "left_anti")
        self._write_filters(gone.select("k1", F.lit(False).alias("add")), left.select("k1"), path, filters)
        self._save(path)

    def _write_filters(self, change: DataFrame, keys: DataFrame, path: str, filters: DataFrame | None = None) -> None:
        old = self.filters() if filters is None else filters
        out = change.select(self._shard(), "k1", "add").groupBy("shard").cogroup(old.groupBy("shard")).applyInArrow(_update, FILTERS)
        out.write.parquet(f"{path}/filters-tried")
        tried = self.spark.read.schema(FILTERS).parquet(f"{path}/filters-tried")
        full = keys.select(self._shard(), "k1").join(tried.where("keys < 0").select("shard"), "shard", "left_semi").distinct()
        tried.where("keys >= 0").unionByName(full.groupBy("shard").applyInArrow(_build, FILTERS)).write.parquet(f"{path}/filters")

    def compact(self) -> None:
        """Writes the references that count to one table, and forgets deletions."""
        path = shared_path(self.spark, "lines", self.lasting)
        self.refs().select("k1", "k2", "batch", "doc_id", "line_no").write.parquet(f"{path}/refs")
        self._alive(self._read("ids", "doc_id long, batch int")).select("doc_id", "batch").write.parquet(f"{path}/ids")
        self.filters().write.parquet(f"{path}/filters")
        self.tables = {"refs": [], "ids": [], "gone": []}
        self._save(path, refs=f"{path}/refs", ids=f"{path}/ids")

    def clean(self, docs: DataFrame) -> DataFrame:
        """Documents of the store without the lines of which an earlier document of the store, or an earlier line of theirs, is the owner.

        Earlier is by (batch, doc_id, line_no).
        """
        own = self.refs().groupBy("k1", "k2").agg(F.min(F.struct("batch", "doc_id", "line_no")).alias("own"), F.count("*").alias("n")).where("n > 1")
        lines = line_keys(docs).join(own, ["k1", "k2"])
        return without_lines(docs, lines.where("own.doc_id <> doc_id or own.line_no <> line_no").select("doc_id", "line_no"))


def without_lines(docs: DataFrame, gone: DataFrame) -> DataFrame:
    """The documents' columns, `text` without the lines (doc_id, line_no), and n_lines, n_removed and n_left (lines that aren't blank).

    Only the texts of documents that lose lines, and few others, are shuffled.
    """
    docs = docs.drop("n_lines", "n_removed", "n_left")
    by_doc = keep(gone.groupBy(F.col("doc_id").alias("_lectern_doc")).agg(F.collect_set("line_no").alias("_lectern_gone")), "lines_gone")
    some, others = by_ids(docs, by_doc.select("_lectern_doc"))
    joined = some.join(by_doc.hint("merge"), docs["doc_id"] == by_doc["_lectern_doc"], "left")
    return _cut(joined, docs.columns).unionByName(_cut(others.withColumn("_lectern_gone", F.lit(None).cast("array<int>")), docs.columns))


def _cut(rows: DataFrame, names: list[str]) -> DataFrame:
    at = F.array_except(F.sequence(F.lit(0), F.size("_lectern_lines") - 1), F.col("_lectern_gone"))
    some = F.col("_lectern_gone").isNotNull()
    out = once(rows, "_lectern_lines", split_lines(F.col("text")))
    out = once(out, "_lectern_left", F.when(some, F.transform(at, lambda i: F.element_at("_lectern_lines", i + 1))).otherwise(F.col("_lectern_lines")))
    text = F.when(some, F.array_join("_lectern_left", "\n")).otherwise(F.col("text"))
    out = out.withColumns({"_lectern_text": text, "n_lines": F.size("_lectern_lines").cast("long"), "n_removed": F.coalesce(F.size("_lectern_gone"), F.lit(0)).cast("long")})
    out = out.withColumn("n_left", F.size(F.filter("_lectern_left", lambda x: trimmed(x) != "")).cast("long"))
    return out.select(*[F.col("_lectern_text").alias("text") if c == "text" else F.col(f"`{c}`") for c in names], "n_lines", "n_removed", "n_left")


def batched(lines: DataFrame, batches: int) -> list[DataFrame]:
    """The lines in so many parts of about one size, those of lower doc_id first."""
    bounds = sorted(set(lines.approxQuantile("doc_id", [i / batches for i in range(1, batches)], 0.01))) if batches > 1 else []
    edges = [None, *bounds, None]
    parts = []
    for lo, hi in zip(edges, edges[1:], strict=False):
        low = F.lit(True) if lo is None else F.col("doc_id") > int(lo)
        parts.append(lines.where(low if hi is None else low & (F.col("doc_id") <= int(hi))))
    return parts


def dedup_lines(docs: DataFrame, batches: int = BATCHES) -> DataFrame:
    """Documents without the lines that repeat an earlier line of the table; see `without_lines` for the columns.

    The lines are inserted into an empty store in `batches` batches, those of lower doc_id first; each but the
    first meets the ones before through the filters. The number of batches doesn't change the result.
    Lines are compared without leading and trailing blanks, tabs and carriage returns. Of equal lines
    that of the least doc_id, and in it the first, stays; blank lines always stay. A null text stays
    null, an empty one empty, a row with a null doc_id as it is. doc_id is taken to be unique: where
    rows repeat one, each loses the lines that any of them has to lose. An empty table gives an empty one.
    """
    lines = keep(line_keys(docs), "line_keys")
    store = LineStore(docs.sparkSession, lasting=False)
    gone = None
    for part in batched(lines, batches):
        again = store.insert_lines(part)
        gone = again if gone is None else gone.union(again)
    return without_lines(docs, gone)


def line_dedup_filter(docs: DataFrame) -> DataFrame:
    """The documents with their columns; those that removal left without a line go."""
    out = dedup_lines(docs).where("n_removed = 0 or n_left > 0").select(*docs.columns)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, their text without repeated lines, and the numbers of lines before, removed and left."""
    return dedup_lines(read_table(spark, sf_dir, "documents")).select("doc_id", "text", "n_lines", "n_removed", "n_left")


ORACLE_SQL = """
WITH raw AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
l AS (SELECT doc_id, unnest(lines) AS line, generate_subscripts(lines, 1) AS i FROM raw),
k AS (SELECT *, regexp_replace(line, '^[ \\t\\r]+|[ \\t\\r]+$', '', 'g') AS key FROM l),
r AS (SELECT *, key <> '' AND row_number() OVER (PARTITION BY key ORDER BY doc_id, i) > 1 AS gone FROM k)
SELECT doc_id, coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT gone), '') AS text, count(*) AS n_lines,
       count(*) FILTER (WHERE gone) AS n_removed, count(*) FILTER (WHERE NOT gone AND key <> '') AS n_left
FROM r GROUP BY doc_id
"""

"""Byte-level BPE encoding with content-defined chunk reuse, and decoding.

A rolling hash over WINDOW bytes cuts each text where the hash of what precedes has its top bits
zero, so passages that texts share fall into equal chunks wherever they stand. A chunk met before is
not encoded again. What it means to cut anywhere is repaired at the joins: tokens next to a cut may
differ from those of the whole text, so from each chunk just the middle is taken, between the first
and the last place where its own tokens and the whole text's provably agree; what lies between two
middles is encoded anew over the join, reaching into further chunks until such a place is found.

Such an agreement is a place after a character that isn't white space and before a space or line
feed: no piece of the tokenizer's pattern crosses it, what follows is matched from there on as at a
beginning, and what precedes ends in no white space whose match looks ahead. The result therefore
equals the encoding of the whole text, which the tests check against the tokenizer itself.

Plan: one scan, no shuffle. The vocabulary (fixed size, below 1 MB) goes to the tasks by broadcast.
A worker keeps the chunks it encoded in two generations of CACHE_CHARS each, across tasks; a chunk
dropped from there is encoded again when it is met again.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as ST

from lectern.llm import _text as T
from lectern.llm._tables import read_table

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Contractions, then letters, digits or other characters with at most one space before, then white space.
PATTERN = r"'(?:s|t|re|ve|m|ll|d)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
WINDOW = 24
#: A cut on average every 2**BITS bytes, never under LEAST nor over MOST of them after the last.
BITS = 9
LEAST = 128
MOST = 4096
CACHE_CHARS = 6_000_000

_FIRST = re.compile(r"(?<=\S)(?=[ \n])")
_LAST = re.compile(r".*\S(?=[ \n])", re.S)


def cuts(data: np.ndarray, row_at: np.ndarray) -> list[list[int]]:
    """For each row the places of its cuts, its begin and end among them; all at the begin of a character."""
    n = len(data)
    up, down = T.powers(n + 1)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(T._BYTE_VALUE[data] * up[:n], out=total[1:])
    at = np.empty(0, np.int64)
    if n > WINDOW:
        h = T.mix64((total[WINDOW:] - total[:-WINDOW]) * down[: n + 1 - WINDOW])
        at = np.flatnonzero(h >> T.U64(64 - BITS) == 0) + WINDOW
        at = at[at < n]
        at = at[(data[at] & 0xC0) != 0x80]
    lo = np.searchsorted(at, row_at[:-1] + WINDOW)
    hi = np.searchsorted(at, row_at[1:])
    out = []
    for i in range(len(row_at) - 1):
        last, end = int(row_at[i]), int(row_at[i + 1])
        mine = [last]
        for c in [*at[lo[i] : hi[i]].tolist(), end]:
            while c - last > MOST:
                last += MOST
                while data[last] & 0xC0 == 0x80:
                    last -= 1
                mine.append(last)
            if c - last >= LEAST or c == end:
                last = c
                mine.append(last)
        out.append(mine)
    return out


class Encoder:
    """Encodes whole texts; keeps the middles of chunks."""

    def __init__(self, vocabulary: list[tuple[bytes, int]], cache_chars: int = CACHE_CHARS):
        import tiktoken

        self.ranks = dict(vocabulary)
        self.tokenizer = tiktoken.Encoding("vocabulary", pat_str=PATTERN, mergeable_ranks=self.ranks, special_tokens={})
        size = max(self.ranks.values()) + 1
        pieces = [b""] * size
        for piece, rank in self.ranks.items():
            pieces[rank] = piece
        self.pieces = pa.array(pieces, pa.large_binary())
        self.new: dict[str, tuple] = {}
        self.old: dict[str, tuple] = {}
        self.chars, self.most = 0, cache_chars
        self.encoded = self.reused = 0

    def plain(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode_ordinary(text), np.int32)

    def chunk(self, text: str) -> tuple[int, int, np.ndarray | None]:
        """(begin, end, ids) of the middle; begin is -1 where the chunk has no agreeing place."""
        got = self.new.get(text)
        if got is not None:
            self.reused += 1
            return got
        got = self.old.get(text)
        if got is None:
            self.encoded += 1
            first = _FIRST.search(text)
            if first is None:
                got = (-1, -1, None)
            else:
                a, b = first.start(), _LAST.match(text).end()
                got = (a, b, self.plain(text[a:b]))
        else:
            self.reused += 1
        if self.chars > self.most:
            self.old, self.new, self.chars = self.new, {}, 0
        self.new[text] = got
        self.chars += len(text)
        return got

    def encode(self, chunks: list[str]) -> np.ndarray:
        """The ids of the text of which these are the chunks."""
        parts, open_ = [], []
        for c in chunks:
            a, b, ids = self.chunk(c)
            if a < 0:
                open_.append(c)
                continue
            open_.append(c[:a])
            if any(open_):
                parts.append(self.plain("".join(open_)))
            parts.append(ids)
            open_ = [c[b:]]
        if any(open_):
            parts.append(self.plain("".join(open_)))
        return np.concatenate(parts) if parts else np.empty(0, np.int32)

    def encode_all(self, texts: pa.LargeStringArray) -> list[np.ndarray]:
        data, at = T.raw(texts)
        whole = data.tobytes()
        return [self.encode([whole[a:b].decode() for a, b in zip(c, c[1:], strict=False)]) for c in cuts(data, at)]

    def decode_all(self, ids: np.ndarray, row_at: np.ndarray) -> pa.LargeBinaryArray:
        """The bytes of each run row_at[i] .. row_at[i + 1] of ids; raises for ids outside the vocabulary."""
        if len(ids) and (ids.min() < 0 or ids.max() >= len(self.pieces)):
            raise ValueError("an id outside the vocabulary")
        flat = self.pieces.take(pa.array(ids))
        at = T.offsets(flat) if len(flat) else np.zeros(1, np.int64)
        ends = np.ascontiguousarray(at[row_at])
        return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(row_at) - 1, [None, pa.py_buffer(ends), flat.buffers()[2] or pa.py_buffer(b"")])


def read_vocabulary(path: str = VOCABULARY) -> list[tuple[bytes, int]]:
    with open(path, "rb") as f:
        return [(base64.b64decode(a), int(b)) for a, b in map(bytes.split, f)]


@lru_cache(maxsize=1)
def _encoder(key: int, shared) -> Encoder:
    return Encoder(shared.value)


def _flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all rows, and where rows begin; a null row is empty."""
    sizes = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False)
    return column.flatten().to_numpy(zero_copy_only=False), np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)


def _batches(batch: pa.RecordBatch, make) -> Iterator[pa.RecordBatch]:
    text = batch.column(batch.schema.get_field_index("text"))
    texts = T.strings(text)
    for lo, hi in T.spans(texts):
        yield make(batch.slice(lo, hi - lo), texts.slice(lo, hi - lo), text.slice(lo, hi - lo))


def encode_documents(docs: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """The documents' columns and ids (array of int), n_tokens, and exact: the ids decode to the text's bytes.

    A null text has null ids and n_tokens and is not exact; an empty one has no ids. Further columns pass
    through, but ones named ids, n_tokens or exact are replaced. Repeated rows are each encoded. An
    empty table gives an empty one. Whole texts are encoded, whatever their length.
    """
    docs = docs.drop("ids", "n_tokens", "exact")
    shared = docs.sparkSession.sparkContext.broadcast(read_vocabulary(vocabulary))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = _encoder(shared.id if hasattr(shared, "id") else id(shared), shared)

        def make(rows: pa.RecordBatch, texts: pa.LargeStringArray, given: pa.Array) -> pa.RecordBatch:
            ids = enc.encode_all(texts)
            size = np.array([len(x) for x in ids], np.int64)
            row_at = np.concatenate([[0], np.cumsum(size)])
            flat = np.concatenate(ids) if ids else np.empty(0, np.int32)
            null = given.is_null()
            back = enc.decode_all(flat, row_at)
            exact = pc.and_(pc.equal(back, texts.cast(pa.large_binary())), pc.invert(null))
            lists = pa.ListArray.from_arrays(pa.array(row_at.astype(np.int32)), pa.array(flat), mask=null)
            n = pc.if_else(null, pa.scalar(None, pa.int64()), pa.array(size))
            return pa.RecordBatch.from_arrays([*rows.columns, lists, n, exact], [*rows.schema.names, "ids", "n_tokens", "exact"])

        for batch in batches:
            yield from _batches(batch, make)

    extra = [ST.StructField("ids", ST.ArrayType(ST.IntegerType())), ST.StructField("n_tokens", ST.LongType()), ST.StructField("exact", ST.BooleanType())]
    return docs.mapInArrow(T.lean(run), ST.StructType([*_nullable(docs.schema), *extra]))


def _nullable(schema: ST.StructType) -> list[ST.StructField]:
    return [ST.StructField(f.name, f.dataType, True) for f in schema.fields]


def decode_documents(encoded: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """The columns of `encoded` with text, decoded from ids, in the place of any text there is.

    Null ids give a null text, none an empty one; ids that don't end at a character's end give U+FFFD
    there; an id outside the vocabulary, or a null one, is an error.
    """
    encoded = encoded.drop("text")
    shared = encoded.sparkSession.sparkContext.broadcast(read_vocabulary(vocabulary))
    at = encoded.columns.index("ids")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = _encoder(shared.id if hasattr(shared, "id") else id(shared), shared)
        for batch in batches:
            column = batch.column(at)
            if column.flatten().null_count:
                raise ValueError("a null id")
            data = enc.decode_all(*_flat(column))
            text = pa.array([x.decode("utf-8", "replace") for x in data.to_pylist()], pa.large_string()).cast(pa.string())
            text = pc.if_else(column.is_null(), pa.scalar(None, pa.string()), text)
            yield pa.RecordBatch.from_arrays([*batch.columns, text], [*batch.schema.names, "text"])

    return encoded.mapInArrow(T.lean(run), ST.StructType([*_nullable(encoded.schema), ST.StructField("text", ST.StringType())]))


def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents as token ids, with the round trip's result."""
    return encode_documents(read_table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "ids", "n_tokens", "exact")

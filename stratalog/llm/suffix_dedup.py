"""Suffix-array deduplication with run-length indexes.

Every byte that is covered by a `length`-byte string which also starts elsewhere is removed.  To find those strings:

1. Each `length`-byte window picks as its anchor the `gram`-byte string in it with the least hash, so equal windows pick
   equal anchors.  Anchors are counted; those that occur twice or more go into a Bloom filter, of which the size is
   bounded (a fuller filter costs work, not results).
2. Each place of such an anchor is dealt out by the anchor, with the bytes around it that its windows span.  Equal
   surroundings mark each other at once.  Different ones become the text of a run-length index: the run-compressed
   Burrows-Wheeler transform with samples at run ends, from which matching statistics are streamed; a window is
   repeated where its match is long enough.
3. The marked bytes are joined with their documents and cut out.

Windows are judged on the input, at all places, and never cross documents.  Surroundings are read sorted by anchor and
content, equal ones are not held; an index is built for every `index_symbols` symbols, or for all the different
surroundings of one anchor.  Anchors are matched by 64-bit hashes, all other bytes by content.

Defined results: null or empty texts have no bytes and nothing removed; a text shorter than `length` is left whole;
repeated rows remove each other's bytes, if long enough.  The result has the id column and those named below.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stratalog.llm.common import cut, flat_bytes, mix, prefix_hash, sized_chunks, span_hash, spark_of
from stratalog.llm.run_index import RunIndex

LENGTH = 200
GRAM = 112
_LOCAL = 21  # bits of a place within a piece of text
_BLOCK_BITS = 1 << 15
#: Blocks of the Bloom filter at most: 64 MB.
MOST_BLOCKS = 1 << 14


def _sliding_least(x: np.ndarray, width: int) -> np.ndarray:
    """Least of each `width` values in a row."""
    span = 1
    while 2 * span <= width:
        x = np.minimum(x[:-span], x[span:])
        span *= 2
    rest = width - span
    return np.minimum(x[: len(x) - rest], x[rest:]) if rest else x


def anchors(flat: np.ndarray, offsets: np.ndarray, length: int, gram: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Anchors of all windows, in pieces: hash, place in flat, first and last window start that picks it, row."""
    piece = (1 << _LOCAL) - length
    for base in range(0, max(1, len(flat) - length + 1), piece):
        part = flat[base : base + piece + length - 1]
        m = len(part) - length + 1
        if m <= 0:
            continue
        starts = np.arange(len(part) - gram + 1)
        h = span_hash(prefix_hash(part), starts, starts + gram)
        low = np.uint64((1 << _LOCAL) - 1)
        least = _sliding_least((h & ~low) | starts.astype(np.uint64), length - gram + 1)
        rows = np.searchsorted(offsets, base + np.arange(m), side="right") - 1
        valid = base + np.arange(m) + length <= offsets[rows + 1]
        at = np.flatnonzero(valid)
        if not len(at):
            continue
        place = (least[at] & low).astype(np.int64)
        owner = rows[at]
        new = np.ones(len(at), bool)
        new[1:] = (place[1:] != place[:-1]) | (owner[1:] != owner[:-1])
        begin = np.flatnonzero(new)
        end = np.concatenate((begin[1:], [len(at)])) - 1
        yield h[place[begin]], base + place[begin], base + at[begin], base + at[end], owner[begin]


def _bits(keys: np.ndarray, blocks: int) -> tuple[np.ndarray, list[np.ndarray]]:
    """The filter block of each key and its four bits in there."""
    h = mix(keys)
    low = np.uint64(_BLOCK_BITS - 1)
    return (h % np.uint64(blocks)).astype(np.int64), [((mix(h + np.uint64(9)) >> np.uint64(15 * k)) & low).astype(np.int64) for k in range(4)]


def _filter(docs: DataFrame, length: int, gram: int) -> np.ndarray:
    """A Bloom filter (blocks by bits) of the anchors that occur twice or more."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sized_chunks(batches, "t"):
            flat, offsets = flat_bytes(batch.column("t"))
            for h, *_ in anchors(flat, offsets, length, gram):
                key, n = np.unique(h, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(np.minimum(n, 2).astype(np.int32))], names=["key", "n"])

    counted = docs.select("t").mapInArrow(each, "key long, n int").groupBy("key").agg(F.sum("n").alias("n"))
    shared = cut(counted.where("n > 1").select("key"))
    blocks = max(1, min(MOST_BLOCKS, shared.count() * 12 // _BLOCK_BITS + 1))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            key = batch.column("key").to_numpy()
            block, _ = _bits(key.view(np.uint64), blocks)
            yield pa.RecordBatch.from_arrays([pa.array(block), batch.column("key")], names=["block", "key"])

    def fill(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.zeros(_BLOCK_BITS, bool)
        for batch in batches:
            for own in _bits(batch.column("key").to_numpy().view(np.uint64), blocks)[1]:
                bits[own] = True
        yield pa.RecordBatch.from_arrays([pa.array([key[0].as_py()]), pa.array([np.packbits(bits).tobytes()], pa.binary())], names=["block", "bits"])

    out = np.zeros((blocks, _BLOCK_BITS // 8), np.uint8)
    filled = shared.mapInArrow(place, "block long, key long").groupBy("block").applyInArrow(fill, "block long, bits binary")
    for row in filled.toLocalIterator():
        out[row.block] = np.frombuffer(bytes(row.bits), np.uint8)
    return out


def _passes(table: np.ndarray, keys: np.ndarray) -> np.ndarray:
    block, bits = _bits(keys, len(table))
    ok = np.ones(len(keys), bool)
    for own in bits:
        ok &= (table[block, own >> 3] >> (7 - (own & 7)).astype(np.uint8)) & 1 == 1
    return ok


_PLACES = "key long, around binary, left int, row long, start int"


def _surroundings(docs: DataFrame, table: np.ndarray, length: int, gram: int) -> DataFrame:
    """For each place of an anchor that may be shared: the bytes that its windows span before and after it, without itself."""
    shared = spark_of(docs).sparkContext.broadcast(table)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sized_chunks(batches, "t"):
            flat, offsets = flat_bytes(batch.column("t"))
            names = batch.column("row").to_numpy()
            for h, place, first, last, owner in anchors(flat, offsets, length, gram):
                ok = _passes(shared.value, h)
                h, place, first, last, owner = h[ok], place[ok], first[ok], last[ok], owner[ok]
                if not len(h):
                    continue
                left = place - first
                size = left + (last + length - place - gram)
                ends = np.cumsum(size)
                within = np.arange(ends[-1]) - np.repeat(ends - size, size)
                at = np.repeat(first, size) + within + np.where(within >= np.repeat(left, size), gram, 0)
                around = pa.BinaryArray.from_buffers(pa.binary(), len(h), [None, pa.py_buffer(np.concatenate(([0], ends)).astype(np.int32)), pa.py_buffer(flat[at])])
                yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), around, pa.array(left.astype(np.int32)), pa.array(names[owner]), pa.array((first - offsets[owner]).astype(np.int32))], names=["key", "around", "left", "row", "start"])

    return docs.select("t", "row").mapInArrow(each, _PLACES)


def _runs(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    edge = np.flatnonzero(np.diff(np.concatenate(([False], mask, [False])).view(np.int8)))
    return edge[::2], edge[1::2]


class _Marker:
    """Takes places in the order of anchor and surroundings, and gives the byte ranges of repeated windows."""

    def __init__(self, length: int, gram: int, most: int):
        self.length, self.most = length, most
        self.symbols = length - gram + 1  # of a window: its bytes around the anchor, and the anchor as one
        self._clear()

    def _clear(self) -> None:
        self.keys: list[int] = []
        self.around: list[bytes] = []
        self.left: list[int] = []
        self.single: list[tuple[int, int] | None] = []
        self.held = 0

    def take(self, key: int, around: bytes, left: int, places: list[tuple[int, int]], repeated: bool) -> Iterator[tuple[int, int, int]]:
        """One surrounding with its places (row, start).  `repeated`: it has more places than these."""
        if self.held >= self.most and self.keys and self.keys[-1] != key:
            yield from self.flush()
        alone = not repeated and len(places) == 1
        if not alone:
            for row, start in places:
                yield row, start, start + len(around) + self.length - self.symbols + 1
        self.keys.append(key)
        self.around.append(around)
        self.left.append(left)
        self.single.append(places[0] if alone else None)
        self.held += len(around) + 2

    def flush(self) -> Iterator[tuple[int, int, int]]:
        live = self._with_company()
        if live:
            yield from self._marked(live)
        self._clear()

    def _with_company(self) -> list[int]:
        """Surroundings whose anchor has others, in groups that hold one with a single place."""
        out, i = [], 0
        while i < len(self.keys):
            j = i + 1
            while j < len(self.keys) and self.keys[j] == self.keys[i]:
                j += 1
            if j - i > 1 and any(x is not None for x in self.single[i:j]):
                out.extend(range(i, j))
            i = j
        return out

    def _marked(self, live: list[int]) -> Iterator[tuple[int, int, int]]:
        sizes = np.array([len(self.around[i]) for i in live])
        left = np.array([self.left[i] for i in live])
        _, group = np.unique(np.array([self.keys[i] for i in live]), return_inverse=True)
        begins = np.cumsum(sizes + 2) - (sizes + 2)
        text = np.empty(int((sizes + 2).sum()), np.int64)
        # Bytes, the anchor by its number, and an end mark of its own for each surrounding.
        body = np.ones(len(text), bool)
        body[begins + left] = body[begins + sizes + 1] = False
        text[body] = np.frombuffer(b"".join(self.around[i] for i in live), np.uint8)
        text[begins + left] = 256 + group
        text[begins + sizes + 1] = 256 + len(live) + np.arange(len(live))
        repeated = RunIndex(text).statistics() >= self.symbols
        for k, i in enumerate(live):
            if self.single[i] is not None:
                row, start = self.single[i]
                for a, b in zip(*_runs(repeated[begins[k] : begins[k] + sizes[k] + 1]), strict=True):
                    yield row, start + int(a), start + int(b) - 1 + self.length


def _marks(places: DataFrame, length: int, gram: int, most: int) -> DataFrame:
    """Byte ranges (row, lo, hi) that repeated windows cover; places sorted by anchor and surroundings."""

    def batch_of(found: list[tuple[int, int, int]]) -> pa.RecordBatch:
        row, lo, hi = zip(*found, strict=True)
        return pa.RecordBatch.from_arrays([pa.array(row, pa.int64()), pa.array(lo, pa.int32()), pa.array(hi, pa.int32())], names=["row", "lo", "hi"])

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        marker = _Marker(length, gram, most)
        same: tuple | None = None
        at: list[tuple[int, int]] = []
        told = False  # part of the places of `same` was given out before
        found: list[tuple[int, int, int]] = []
        for batch in batches:
            for key, around, left, row, start in zip(*(batch.column(c).to_pylist() for c in ("key", "around", "left", "row", "start")), strict=True):
                now = (key, around, left)
                if now != same:
                    if same is not None and at:
                        found.extend(marker.take(*same, at, told))
                    same, at, told = now, [], False
                at.append((row, start))
                if len(at) > 10_000:  # equal surroundings without end: given out as they come
                    found.extend((r, s, s + len(around) + gram) for r, s in at[:-1])
                    at, told = at[-1:], True
            if len(found) > 100_000:
                yield batch_of(found)
                found = []
        if same is not None and at:
            found.extend(marker.take(*same, at, told))
        found.extend(marker.flush())
        if found:
            yield batch_of(found)

    return places.mapInArrow(each, "row long, lo int, hi int")


def dedup_substrings(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", length: int = LENGTH, gram: int = GRAM, index_symbols: int = 1 << 19, keep_text: bool = False) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans (maximal removed runs), kept_sha256, and with keep_text `kept`, the bytes left."""
    source = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text).cast("binary"), F.lit(b"")).alias("t")).withColumn("row", F.xxhash64("doc_id", "t"))
    long = source.where(F.length("t") >= length)
    places = _surroundings(long, _filter(long, length, gram), length, gram)
    sorted_ = places.repartition("key").sortWithinPartitions("key", "around", "left")
    marks = _marks(sorted_, length, gram, index_symbols).groupBy("row").agg(F.collect_list(F.struct("lo", "hi")).alias("spans"))
    joined = source.join(marks, "row", "left").select("doc_id", "t", "spans.lo", "spans.hi")
    fields = [docs.select(F.col(doc_id).alias("doc_id")).schema["doc_id"], *[T.StructField(c, T.LongType()) for c in ("n_bytes", "n_removed", "n_spans")], T.StructField("kept_sha256", T.StringType())]
    if keep_text:
        fields.append(T.StructField("kept", T.BinaryType()))
    schema = T.StructType(fields)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sized_chunks(batches, "t", 4 << 20):
            n, removed, spans, kept = [], [], [], []
            for t, lo, hi in zip(batch.column("t").to_pylist(), batch.column("lo"), batch.column("hi"), strict=True):
                n.append(len(t))
                if lo.is_valid:
                    edge = np.zeros(len(t) + 1, np.int64)
                    np.add.at(edge, lo.values.to_numpy(), 1)
                    np.add.at(edge, hi.values.to_numpy(), -1)
                    gone = np.cumsum(edge[:-1]) > 0
                    kept.append(np.frombuffer(t, np.uint8)[~gone].tobytes())
                    removed.append(int(gone.sum()))
                    spans.append(len(_runs(gone)[0]))
                else:
                    kept.append(t)
                    removed.append(0)
                    spans.append(0)
            arrays = [batch.column("doc_id"), *[pa.array(x, pa.int64()) for x in (n, removed, spans)], pa.array([hashlib.sha256(k).hexdigest() for k in kept])]
            yield pa.RecordBatch.from_arrays(arrays + [pa.array(kept, pa.binary())] * keep_text, names=schema.names)

    return joined.mapInArrow(each, schema)

"""Benchmark decontamination with a generalised suffix automaton of the normalised test items.

Items and documents are lower-cased (A-Z) and cut into words of digits, a-z and non-ASCII characters.  Each document's
words run through the automaton, which tracks the longest match that ends at each word; a match of `window` words, or
of a whole shorter item, is a hit.  Spans of `span_limit` hit words or more, and those that hold a whole shorter item, are
removed, and a document of which a larger share than `coverage_limit` is hit is marked over_limit.

The items, a test set, are dealt into blocks of at most `block_words` words, each with an automaton of its own.  One block,
the usual case, takes one pass over the documents and no shuffle.  More blocks take a pass each, one after the other, which
writes the hits (by a 128-bit hash of the text) of the documents that have any; in the end these are joined with the
documents.  A task holds one automaton at a time, so memory is bounded by block_words however many items there are.

Defined results: a null text has no words and stays null; an item that is null or has no words never occurs; items
that share an id count as one; an empty benchmark leaves all documents clean.  Repeated rows are judged alike.  Further
columns pass through, whatever their names, unless they bear one that is added (n_words, n_hit, items, over_limit), which is
replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stratalog.llm.common import cut, map_batches, others, quoted, sized_chunks, small_batches, spark_of, unused

WINDOW = 10
ADDED = ("n_words", "n_hit", "items", "over_limit")
#: Bit of a word that is hit by a whole item shorter than the window.
WHOLE = 2

#: Every byte as a word byte (A-Z lower-cased) or as a blank.
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def words(text: bytes) -> list[bytes]:
    return text.translate(_FOLD).split()


class Automaton:
    """Generalised suffix automaton over word numbers; edges are keyed by state * (number of words) + word."""

    def __init__(self, items: list[tuple[str, list[bytes]]], window: int):
        self.window = window
        self.vocabulary: dict[bytes, int] = {}
        for _, item in items:
            for w in item:
                self.vocabulary.setdefault(w, len(self.vocabulary))
        self.size = max(1, len(self.vocabulary))
        self.edges: dict[int, int] = {}
        self.out: list[list[int]] = [[]]  # the words that leave each state, while building
        self.link, self.length = [-1], [0]
        numbered = [(name, [self.vocabulary[w] for w in item]) for name, item in items if item]
        for _, item in numbered:
            last = 0
            for w in item:
                last = self._extend(last, w)
        self.least = min([window, *(len(item) for _, item in numbered)])
        del self.out
        self._label(numbered)

    def _new(self, length: int, link: int, words_out: list[int]) -> int:
        self.length.append(length)
        self.link.append(link)
        self.out.append(words_out)
        return len(self.length) - 1

    def _split(self, p: int, w: int, q: int) -> int:
        """A copy of q for the strings of length(p) + 1 and less."""
        size, edges = self.size, self.edges
        copy = self._new(self.length[p] + 1, self.link[q], list(self.out[q]))
        for x in self.out[q]:
            edges[copy * size + x] = edges[q * size + x]
        self.link[q] = copy
        while p >= 0 and edges.get(p * size + w) == q:
            edges[p * size + w] = copy
            p = self.link[p]
        return copy

    def _extend(self, last: int, w: int) -> int:
        size, edges = self.size, self.edges
        q = edges.get(last * size + w)
        if q is not None:
            return q if self.length[q] == self.length[last] + 1 else self._split(last, w, q)
        state, p = self._new(self.length[last] + 1, 0, []), last
        while p >= 0 and p * size + w not in edges:
            edges[p * size + w] = state
            self.out[p].append(w)
            p = self.link[p]
        if p >= 0:
            q = edges[p * size + w]
            self.link[state] = q if self.length[q] == self.length[p] + 1 else self._split(p, w, q)
        return state

    def _label(self, items: list[tuple[str, list[int]]]) -> None:
        """For each state: the ancestor that holds its last `window` words, the items there, and shorter items that end there."""
        n = len(self.length)
        self.at_window = [-1] * n
        self.found: dict[int, set[str]] = {}
        self.short: dict[int, list[tuple[int, str]]] = {}
        own: dict[int, list[tuple[int, str]]] = {}
        order = sorted(range(1, n), key=self.length.__getitem__)
        for v in order:
            up = self.link[v]
            if self.length[v] >= self.window:
                self.at_window[v] = self.at_window[up] if self.length[up] >= self.window else v
        for name, item in items:
            v = 0
            for w in item:
                v = self.edges[v * self.size + w]
                if self.at_window[v] >= 0:
                    self.found.setdefault(self.at_window[v], set()).add(name)
            if len(item) < self.window:
                own.setdefault(v, []).append((len(item), name))
        if own:
            for v in order:
                if ends := own.get(v, []) + self.short.get(self.link[v], []):
                    self.short[v] = ends

    def hits(self, text: bytes) -> tuple[int, np.ndarray | None, set[str]]:
        """The number of words, which of them are hit (1; WHOLE: by a whole item shorter than the window; None: none), and the items found."""
        ws = words(text)
        if len(ws) < self.least or not self.vocabulary:
            return len(ws), None, set()
        ids = np.fromiter(map(self.vocabulary.get, ws, repeat(-1)), np.int64, len(ws))
        # Only runs of known words that are long enough can hold a match.
        edge = np.flatnonzero(np.diff(np.concatenate(([False], ids >= 0, [False])).view(np.int8)))
        mask, found = None, set()
        edges, link, length, size, window = self.edges, self.link, self.length, self.size, self.window
        for begin, end in zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True):
            if end - begin < self.least:
                continue
            state = matched = 0
            for i, w in enumerate(ids[begin:end].tolist(), begin):
                while (to := edges.get(state * size + w)) is None and state:
                    state = link[state]
                    matched = length[state]
                if to is not None:
                    state, matched = to, matched + 1
                most = whole = 0
                if matched >= window:
                    most = window
                    found |= self.found[self.at_window[state]]
                if self.short:
                    for m, name in self.short.get(state, ()):
                        if m <= matched:
                            whole = max(whole, m)
                            found.add(name)
                if most or whole:
                    if mask is None:
                        mask = np.zeros(len(ws), np.uint8)
                    mask[i + 1 - most : i + 1] |= 1
                    mask[i + 1 - whole : i + 1] |= WHOLE
        return len(ws), mask, found


def _runs(mask: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.diff(np.concatenate(([False], mask, [False])).view(np.int8)))


def _without(text: bytes, mask: np.ndarray, least: int) -> bytes:
    """text without the hit spans of `least` words or more, or that hold a whole short item."""
    folded = np.frombuffer(text.translate(_FOLD), np.uint8) != 32
    edge = np.flatnonzero(np.diff(np.concatenate(([False], folded, [False])).view(np.int8)))
    kept, at = [], 0
    runs = _runs(mask > 0)
    for a, b in zip(runs[::2].tolist(), runs[1::2].tolist(), strict=True):
        if b - a >= least or (mask[a:b] & WHOLE).any():
            kept.append(text[at : edge[2 * a]])
            at = int(edge[2 * b - 1])
    return b"".join([*kept, text[at:]])


def _blocks(benchmark: DataFrame, item_id: str, text: str, block_words: int) -> Iterator[list[tuple[str, list[bytes]]]]:
    """Items by blocks of at most block_words words (or one item), read to the driver one after another in the order of ids."""
    rows = benchmark.select(F.coalesce(quoted(item_id).cast("string"), F.lit("")).alias("i"), quoted(text).cast("binary").alias("t")).where("t is not null")
    block, held = [], 0
    for row in rows.orderBy("i", "t").toLocalIterator():
        ws = words(bytes(row.t))
        if block and held + len(ws) > block_words:
            yield block
            block, held = [], 0
        if ws:
            block.append((row.i, ws))
            held += len(ws)
    yield block


def _hits(docs: DataFrame, text: str, block: list[tuple[str, list[bytes]]], window: int) -> DataFrame:
    """key (the text's hash), mask and items of the documents that one block hits, once for each text."""
    shared = spark_of(docs).sparkContext.broadcast(Automaton(block, window))

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sized_chunks(batches, "t", 2 << 20):
            rows = [(k, mask.tobytes(), sorted(found)) for k, t in zip(batch.column("key").to_pylist(), batch.column("t"), strict=True) for _, mask, found in [shared.value.hits(t.as_py())] if mask is not None]
            if rows:
                yield pa.RecordBatch.from_pylist([dict(zip(("key", "mask", "items"), r, strict=True)) for r in rows], schema=pa.schema([("key", pa.string()), ("mask", pa.binary()), ("items", pa.list_(pa.string()))]))

    rows = docs.select(F.md5(quoted(text).cast("binary")).alias("key"), quoted(text).cast("binary").alias("t")).where("t is not null")
    return cut(rows.mapInArrow(each, "key string, mask binary, items array<string>").dropDuplicates(["key"]))


def decontaminate(docs: DataFrame, benchmark: DataFrame, *, text: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = WINDOW, span_limit: int = WINDOW, coverage_limit: float = 0.5, clean: bool = True, block_words: int = 200_000) -> DataFrame:
    """docs with n_words, n_hit, items (ids, sorted as strings), over_limit and, if `clean`, `text` without the hit spans."""
    spark = spark_of(docs)
    small_batches(spark)
    columns = others(docs, *ADDED)
    source = docs.select(*map(quoted, columns))
    schema = T.StructType([*source.schema.fields, T.StructField("n_words", T.LongType()), T.StructField("n_hit", T.LongType()), T.StructField("items", T.ArrayType(T.StringType())), T.StructField("over_limit", T.BooleanType())])

    def finished(batch: pa.RecordBatch, counts: list[int], masks: list[np.ndarray | None], items: list[list[str]]) -> pa.RecordBatch:
        hit = [0 if m is None else int(np.count_nonzero(m)) for m in masks]
        over = [h > coverage_limit * n for h, n in zip(hit, counts, strict=True)]
        carried = {c: batch.column(c) for c in columns}
        if clean and any(hit):
            kind = batch.column(text).type
            old = batch.column(text).cast(pa.binary()).to_pylist()
            carried[text] = pa.array([t if m is None else _without(t, m, span_limit) for t, m in zip(old, masks, strict=True)], pa.binary()).cast(kind)
        return pa.RecordBatch.from_arrays([*carried.values(), pa.array(counts, pa.int64()), pa.array(hit, pa.int64()), pa.array(items, pa.list_(pa.string())), pa.array(over, pa.bool_())], names=[*columns, *ADDED])

    blocks = _blocks(benchmark, item_id, item_text, block_words)
    block = next(blocks)
    following = next(blocks, None)
    if following is None:
        shared = spark.sparkContext.broadcast(Automaton(block, window))

        def single(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in sized_chunks(batches, text, 2 << 20):
                found = [shared.value.hits(t.as_py() or b"") for t in batch.column(text).cast(pa.binary())]
                yield finished(batch, [n for n, _, _ in found], [m for _, m, _ in found], [sorted(i) for _, _, i in found])

        return map_batches(source, single, schema)

    hits = None
    while block is not None:
        own = _hits(source, text, block, window)
        hits = own if hits is None else hits.union(own)
        block, following = following, next(blocks, None) if following is not None else None
    key, found = unused(source, "_key", "_found")
    merged = hits.groupBy(F.col("key").alias(key)).agg(F.collect_list(F.struct("mask", "items")).alias(found))  # a row for each block at most
    joined = source.withColumn(key, F.md5(quoted(text).cast("binary"))).join(merged, key, "left").drop(key)

    def several(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sized_chunks(batches, text, 2 << 20):
            counts = [len(words(t.as_py() or b"")) for t in batch.column(text).cast(pa.binary())]
            masks: list[np.ndarray | None] = []
            items = []
            for parts in batch.column(found).to_pylist():
                masks.append(np.bitwise_or.reduce([np.frombuffer(x["mask"], np.uint8) for x in parts]) if parts else None)
                items.append(sorted({i for x in parts or () for i in x["items"]}))
            yield finished(batch, counts, masks, items)

    return map_batches(joined, several, schema)

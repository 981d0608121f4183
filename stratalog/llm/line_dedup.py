"""Line deduplication on levelled sorted runs of line hashes.

`LineRuns` keeps line keys (with the number of documents that hold them and the largest such doc_id) as levelled runs in
the shared folder, bucketed and sorted by key hash.  Each batch of documents is merge-anti-joined with the runs: keys that
none holds are added as a run of their own, so a key stands in one run only; keys that came again are set aside.  When a
level holds `fanout` runs they are compacted into one run of the next level.  A key's documents are those of its run and
those set aside; keys that came in one batch only, nearly all, are never summed up again.

A line's key is the line stripped of white space at both ends and lower-cased (A-Z); keys are compared by 128-bit
hashes.  Keys are combined inside each task before they are shuffled, so a line that every document holds is no burden.

Defined results: a null or empty text is one empty line, which is never dropped; a null text stays null unless it is
asked for as "".  Each row counts as one document; rows that repeat a doc_id all keep a line of which that id is the
largest holder.  Further columns pass through, except `n_lines` and `n_dropped`, which are replaced.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stratalog.llm.common import cut, drop_folder, map_batches, new_folder, others, quoted, sized_chunks, small_batches, spark_of, unused

LEAST_CHARS, LEAST_DOCS = 40, 5
_NO_ID = -(1 << 63)  # stands for a null doc_id, below all others

_KEYS = "h1 long, h2 long, n_docs long, max_doc long, batch int"
#: Keys to drop that may be broadcast (24 bytes each); more are joined by a shuffle.
BROADCAST_KEYS = 1_000_000


def _id(doc_id: str) -> Column:
    return F.coalesce(quoted(doc_id).cast("long"), F.lit(_NO_ID)).alias("d")


def _digests(text: bytes, least: int) -> list[bytes | None]:
    """For each line its key's hash, or None if the key is shorter than `least` code points."""
    out: list[bytes | None] = []
    for line in text.split(b"\n"):
        key = line.strip().lower()
        n = len(key)
        long = n >= least and (n >= 4 * least or key.isascii() or n - sum(0x80 <= b < 0xC0 for b in key) >= least)
        out.append(xxhash.xxh3_128_digest(key) if long else None)
    return out


def _halves(digests: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(digests), dtype=">i8").reshape(-1, 2).astype(np.int64)


def line_keys(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", least_chars: int = LEAST_CHARS, batches: int = 1) -> DataFrame:
    """Per key and batch (of documents, dealt by their id) the number of documents that hold it and the largest; partly combined."""
    small_batches(spark_of(docs))
    source = docs.select(_id(doc_id), quoted(text).cast("binary").alias("t"), F.pmod(F.xxhash64(quoted(doc_id)), F.lit(batches)).cast("int").alias("b"))

    def each(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in sized_chunks(parts, "t", 2 << 20):
            held: dict[tuple[int, bytes], list[int]] = {}
            for d, t, b in zip(part.column("d").to_pylist(), part.column("t"), part.column("b").to_pylist(), strict=True):
                for h in {*_digests(t.as_py() or b"", least_chars)} - {None}:
                    x = held.setdefault((b, h), [0, d])
                    x[0] += 1
                    x[1] = max(x[1], d)
            if held:
                h = _halves([k[1] for k in held])
                v = np.array(list(held.values()), dtype=np.int64)
                yield pa.RecordBatch.from_arrays([*map(pa.array, (h[:, 0].copy(), h[:, 1].copy(), v[:, 0].copy(), v[:, 1].copy())), pa.array([k[0] for k in held], pa.int32())], names=["h1", "h2", "n_docs", "max_doc", "batch"])

    return source.mapInArrow(each, _KEYS)


def _merged(keys: DataFrame) -> DataFrame:
    return keys.groupBy("h1", "h2").agg(F.sum("n_docs").alias("n_docs"), F.max("max_doc").alias("max_doc"))


class LineRuns:
    """Levels of sorted runs, bucketed tables by (h1, h2) in a folder that all executors share, so merges need no exchange.

    No two runs hold the same key: a run has the keys of its batch that no earlier run holds.  The others go to `again`.
    """

    def __init__(self, spark: SparkSession, *, fanout: int = 3, buckets: int | None = None):
        self.spark, self.fanout = spark, fanout
        self.buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.folder, self.name = new_folder(spark, "line-runs"), f"line_run_{uuid.uuid4().hex}"
        self.levels: list[list[str]] = []
        self.again: list[str] = []
        self.written = 0

    def _write(self, keys: DataFrame) -> str:
        """keys as a bucketed table with sorted buckets; its name."""
        name, self.written = f"{self.name}_{self.written}", self.written + 1
        keys.write.bucketBy(self.buckets, "h1", "h2").sortBy("h1", "h2").option("path", f"{self.folder}/{name}").saveAsTable(name)
        return name

    def _forget(self, name: str) -> None:
        self.spark.sql(f"DROP TABLE {name}")
        drop_folder(self.spark, f"{self.folder}/{name}")

    def _runs(self) -> list[DataFrame]:
        return [self.spark.table(x) for level in self.levels for x in level]

    def unseen(self, keys: DataFrame) -> DataFrame:
        """Those keys that no run holds: merge-anti-joins with one run after the other."""
        for run in self._runs():
            keys = keys.join(run.select("h1", "h2"), ["h1", "h2"], "left_anti")
        return keys

    def add(self, keys: DataFrame) -> None:
        """Adds a batch of keys (h1, h2, n_docs, max_doc): those unseen as a run of its own, the rest to `again`."""
        own = self._write(_merged(keys).repartition(self.buckets, "h1", "h2"))
        if self.levels:
            batch = self.spark.table(own)
            fresh = self._write(self.unseen(batch))
            self.again.append(self._write(batch.join(self.spark.table(fresh).select("h1", "h2"), ["h1", "h2"], "left_anti")))
            self._forget(own)
            own = fresh
        else:
            self.levels.append([])
        self.levels[0].append(own)
        level = 0
        while level < len(self.levels) and len(self.levels[level]) >= self.fanout:
            self._compact(level)
            level += 1

    def _compact(self, level: int) -> None:
        """The runs of a level, which share no key, as one run of the next."""
        old = self.levels[level]
        one = self.spark.table(old[0])
        for name in old[1:]:
            one = one.union(self.spark.table(name))
        if len(self.levels) == level + 1:
            self.levels.append([])
        self.levels[level + 1].append(self._write(one))
        self.levels[level] = []
        for name in old:
            self._forget(name)

    def frequent(self, least_docs: int) -> DataFrame:
        """Keys in at least so many documents and the largest of these.  Only keys that came again are summed up."""
        again = None
        for name in self.again:
            rows = self.spark.table(name)
            again = rows if again is None else again.union(rows)
        found = None
        for run in self._runs():
            if again is not None:
                more = _merged(again).withColumnsRenamed({"n_docs": "_n", "max_doc": "_max"})
                run = run.join(more, ["h1", "h2"], "left").select("h1", "h2", (F.col("n_docs") + F.coalesce("_n", F.lit(0))).alias("n_docs"), F.greatest("max_doc", "_max").alias("max_doc"))
            rows = run.where(F.col("n_docs") >= least_docs).select("h1", "h2", "max_doc")
            found = rows if found is None else found.union(rows)
        return cut(found)

    def drop(self) -> None:
        for name in [*(x for level in self.levels for x in level), *self.again]:
            self._forget(name)
        drop_folder(self.spark, self.folder)


def frequent_lines(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", least_chars: int = LEAST_CHARS, least_docs: int = LEAST_DOCS, batches: int = 4, fanout: int = 3) -> DataFrame:
    """Hashes (h1, h2) of the keys that at least `least_docs` documents hold, and the largest such document (max_doc)."""
    spark = spark_of(docs)
    folder = new_folder(spark, "line-keys")
    line_keys(docs, doc_id=doc_id, text=text, least_chars=least_chars, batches=batches).write.parquet(folder)
    keys = spark.read.schema(_KEYS).parquet(folder)
    runs = LineRuns(spark, fanout=fanout)
    for b in range(batches):
        runs.add(keys.where(F.col("batch") == b).drop("batch"))
    found = runs.frequent(least_docs)
    runs.drop()
    drop_folder(spark, folder)
    return found


def _join_lines(lines: list[bytes], keep: list[bool]) -> bytes:
    return b"\n".join(x for x, k in zip(lines, keep, strict=True) if k)


def dedup_lines(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", least_chars: int = LEAST_CHARS, least_docs: int = LEAST_DOCS, batches: int = 4, broadcast_keys: int = BROADCAST_KEYS) -> DataFrame:
    """docs without the lines that other documents hold too, with n_lines (before) and n_dropped."""
    spark = spark_of(docs)
    columns = others(docs, "n_lines", "n_dropped")
    source = docs.select(*map(quoted, columns))
    found = frequent_lines(docs, doc_id=doc_id, text=text, least_chars=least_chars, least_docs=least_docs, batches=batches)
    schema = T.StructType([*source.schema.fields, T.StructField("n_lines", T.LongType()), T.StructField("n_dropped", T.LongType())])

    def rebuilt(part: pa.RecordBatch, drops: list[set[int]], lines: list[list[bytes]]) -> pa.RecordBatch:
        old = part.column(text)
        new = old
        if any(drops):
            texts = [None if v is None else v if not x else _join_lines(ls, [k not in x for k in range(len(ls))]) for v, x, ls in zip(old.cast(pa.binary()).to_pylist(), drops, lines, strict=True)]
            new = pa.array(texts, pa.binary()).cast(old.type)
        arrays = [new if c == text else part.column(c) for c in columns]
        return pa.RecordBatch.from_arrays([*arrays, pa.array(map(len, lines), pa.int64()), pa.array(map(len, drops), pa.int64())], names=schema.names)

    if found.count() <= broadcast_keys:
        rows = found.orderBy("h1", "h2").toArrow()
        shared = spark.sparkContext.broadcast([rows.column(c).to_numpy() for c in ("h1", "h2", "max_doc")])

        def each(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            h1, h2, most = shared.value
            for part in sized_chunks(parts, text, 2 << 20):
                texts = [t or b"" for t in part.column(text).cast(pa.binary()).to_pylist()]
                ids = [_NO_ID if d is None else d for d in part.column(doc_id).to_pylist()]
                drops: list[set[int]] = [set() for _ in texts]
                at, digests = [], []
                for i, t in enumerate(texts):
                    for k, h in enumerate(_digests(t, least_chars)):
                        if h is not None:
                            at.append((i, k))
                            digests.append(h)
                if digests and len(h1):
                    mine = _halves(digests)
                    # Keys that share h1 stand side by side; almost always there is one.
                    p = np.searchsorted(h1, mine[:, 0])
                    live = np.flatnonzero((p < len(h1)) & (h1[np.minimum(p, len(h1) - 1)] == mine[:, 0]))
                    for j in live.tolist():
                        q = int(p[j])
                        while q < len(h1) and h1[q] == mine[j, 0]:
                            i, k = at[j]
                            if h2[q] == mine[j, 1] and most[q] != ids[i]:
                                drops[i].add(k)
                            q += 1
                yield rebuilt(part, drops, [t.split(b"\n") for t in texts])

        return map_batches(source, each, schema)

    # Too many keys to broadcast: line places are joined with the keys, and the places to drop with their documents.
    def places(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in sized_chunks(parts, "t", 2 << 20):
            where, digests = [], []
            for d, r, t in zip(part.column("d").to_pylist(), part.column("r").to_pylist(), part.column("t").to_pylist(), strict=True):
                for k, h in enumerate(_digests(t or b"", least_chars)):
                    if h is not None:
                        where.append((d, r, k))
                        digests.append(h)
            if digests:
                h = _halves(digests)
                d, r, k = zip(*where, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(h[:, 0].copy()), pa.array(h[:, 1].copy()), pa.array(d, pa.int64()), pa.array(r, pa.int64()), pa.array(k, pa.int64())], names=["h1", "h2", "d", "r", "k"])

    key = [_id(doc_id), F.xxhash64(quoted(text)).alias("r")]
    lines = docs.select(*key, quoted(text).cast("binary").alias("t")).mapInArrow(places, "h1 long, h2 long, d long, r long, k long")
    drop, d, r = unused(source, "_drop", "_d", "_r")
    dropped = lines.join(found, ["h1", "h2"]).where(F.col("d") != F.col("max_doc")).groupBy(F.col("d").alias(d), F.col("r").alias(r)).agg(F.collect_set("k").alias(drop))
    joined = source.withColumns({d: key[0], r: key[1]}).join(dropped, [d, r], "left").select(*map(quoted, columns), drop)

    def remove(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in sized_chunks(parts, text, 2 << 20):
            drops = [set(x or ()) for x in part.column(drop).to_pylist()]
            yield rebuilt(part, drops, [(t or b"").split(b"\n") for t in part.column(text).cast(pa.binary()).to_pylist()])

    return map_batches(joined, remove, schema)

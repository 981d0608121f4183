"""Helpers the corpus operators share: the shared folder, bounded Arrow chunks, vectorised words."""

from __future__ import annotations

import gc
import re
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: White space of the word contracts, as a Java regex class body and as a set to trim.
SPACE_CLASS = r"\x20\x09-\x0D"
SPACE_CHARS = " \t\n\x0b\x0c\r"

#: Bytes of text that one step inside a task handles together.
CHUNK_BYTES = 1 << 20

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE_WORD = np.ones(256, dtype=bool)
_SPACE_WORD[[9, 10, 11, 12, 13, 32]] = False


def ascii_lower(c: Column) -> Column:
    """Lower-cases A-Z and nothing else."""
    return F.translate(c, UPPER, LOWER)


def spark_of(df: DataFrame) -> SparkSession:
    return df.sparkSession


def unused(df: DataFrame, *names: str) -> list[str]:
    """Names like these that no column of df bears, whatever the case, for columns an operator adds and drops again."""
    held = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in held:
            name += "_"
        held.add(name.lower())
        out.append(name)
    return out


def quoted(name: str) -> Column:
    """The column of that name, whatever characters it has."""
    return F.col("`" + name.replace("`", "``") + "`")


def others(df: DataFrame, *names: str) -> list[str]:
    """Columns of df but those that bear one of these names, whatever the case."""
    gone = {x.lower() for x in names}
    return [c for c in df.columns if c.lower() not in gone]


def map_batches(rows: DataFrame, each: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: T.StructType) -> DataFrame:
    """rows.mapInArrow(each, schema) for rows with columns of any name, those with dots too."""
    names = rows.columns

    def named(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return each(batch.rename_columns(names) for batch in batches)

    return rows.toDF(*[f"c{k}" for k in range(len(names))]).mapInArrow(named, schema)


def small_batches(spark: SparkSession, most: int = 4 << 20) -> None:
    """Bounds the bytes of each batch that this session passes to Python, unless they are bounded lower already."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if int(spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(key))) > most:
        spark.conf.set(key, str(most))


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir; a temporary one where none is set and the master is local (tests)."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        found = tempfile.mkdtemp(prefix="spark-checkpoint-")
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(found)
    return found


def new_folder(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def drop_folder(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def cut(df: DataFrame) -> DataFrame:
    """Materialises df in the shared folder and cuts its lineage."""
    shared_dir(spark_of(df))
    return df.checkpoint()


def release(spark: SparkSession) -> None:
    """Has the driver drop what it no longer refers to, so that shuffle files and checkpoints of steps that are over go from disk."""
    gc.collect()
    spark._jvm.System.gc()


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet").select(*columns)


def sized_chunks(batches: Iterable[pa.RecordBatch], column: str, most: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices batches so that each slice holds at most `most` bytes of `column`, or one row."""
    for batch in batches:
        values = batch.column(column)
        if len(values) == 0:
            continue
        ends = np.cumsum(_lengths(values))
        start = 0
        while start < len(values):
            base = ends[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, base + most, side="right")))
            yield batch.slice(start, stop - start)
            start = stop


def _offsets(values: pa.Array) -> np.ndarray:
    wide = pa.types.is_large_binary(values.type) or pa.types.is_large_string(values.type)
    kind = np.int64 if wide else np.int32
    return np.frombuffer(values.buffers()[1], dtype=kind)[values.offset : values.offset + len(values) + 1].astype(np.int64)


def _lengths(values: pa.Array) -> np.ndarray:
    return np.diff(_offsets(values))


def flat_bytes(values: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string or binary array end to end, and the offset at which each row starts (one more at the end)."""
    offsets = _offsets(values)
    data = values.buffers()[2]
    flat = np.frombuffer(data, dtype=np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.zeros(0, np.uint8)
    return flat, offsets - offsets[0]


def word_spans(flat: np.ndarray, offsets: np.ndarray, inside: np.ndarray = _SPACE_WORD) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words (maximal runs of bytes that `inside` allows, never across rows) and each word's row."""
    size = len(flat)
    if not size:
        none = np.zeros(0, np.int64)
        return none, none, none
    word = inside[flat]
    before = np.empty(size, bool)
    before[0], before[1:] = False, word[:-1]
    after = np.empty(size, bool)
    after[-1], after[:-1] = False, word[1:]
    before[offsets[offsets < size]] = False
    after[offsets[1:] - 1] = False
    starts = np.flatnonzero(word & ~before)
    ends = np.flatnonzero(word & ~after) + 1
    return starts, ends, np.searchsorted(offsets, starts, side="right") - 1


_BASE = np.uint64(0x9E3779B97F4A7C15)  # odd, so it has an inverse modulo 2**64
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_powers: dict[str, np.ndarray] = {}


def _power(base: np.uint64, name: str, size: int) -> np.ndarray:
    have = _powers.get(name)
    if have is None or len(have) < size:
        steps = np.full(max(size, CHUNK_BYTES + 1), base, dtype=np.uint64)
        steps[0] = 1
        _powers[name] = have = np.cumprod(steps, dtype=np.uint64)
    return have[:size]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit values."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_BYTE_CODES = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def prefix_hash(flat: np.ndarray) -> np.ndarray:
    """Sums from which span_hash gets the hash of any span of `flat`."""
    sums = np.zeros(len(flat) + 1, np.uint64)
    np.cumsum(_BYTE_CODES[flat] * _power(_BASE, "up", len(flat)), dtype=np.uint64, out=sums[1:])
    return sums


def span_hash(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit polynomial hashes of byte spans, alike wherever the bytes stand."""
    down = _power(_INVERSE, "down", len(sums))
    return mix((sums[ends] - sums[starts]) * down[starts])


def lowered(flat: np.ndarray) -> np.ndarray:
    return _LOWER[flat]


def words_of(values: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the white-space separated, A-Z lower-cased words of all rows in order, and each word's row."""
    flat, offsets = flat_bytes(values)
    flat = lowered(flat)
    starts, ends, rows = word_spans(flat, offsets)
    return span_hash(prefix_hash(flat), starts, ends), rows

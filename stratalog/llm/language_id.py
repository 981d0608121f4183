"""Language identification with language-bitmask n-gram filters.

Bit-sliced Bloom filters: one table of cells, each a bit mask with a bit for every language (as many 64-bit words as that
takes).  An n-gram's languages are the AND of its two cells.  Per text and language the n-grams that hit are counted (a
popcount per bit), corrected for the filter's false positives, and the largest count decides; its share of all corrected
counts is the score.  The languages' shares of the training rows count as one n-gram in all, so a text of which no n-gram
hits gets the commonest language.

N-grams are windows of 3 and 4 bytes of the text, lower-cased (A-Z), with every run of anything but letters as one blank
and a blank at both ends.  A language's filter gets all n-grams (by a hash into `WIDTH` counters) that are `lift` times
as frequent in it as in the languages on average.  The counts behind that come from all training rows: tasks add up counters by
language and pass on those that are not zero, a grouping adds them up and picks each counter's languages.  Only the
finished table (`CELLS` masks) is broadcast; its size depends on the number of languages alone.

Languages are the distinct non-null lang values of the training rows, in code point order, however many.

Defined results: a text that is null or has no letter is `und` with score 0, as is every text when nothing was learned.
Ties go to the language first in order.  Repeated rows are judged alike.  Further columns pass through, whatever their
names, except lang_pred and score, which are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stratalog.llm.common import cut, flat_bytes, lowered, map_batches, mix, others, quoted, sized_chunks, small_batches, spark_of

UNKNOWN = "und"
SIZES = (3, 4)
WIDTH = 1 << 18
CELLS = 1 << 19
#: Times the mean rate over languages from which on an n-gram is in a language's filter.
LIFT = 1.25
#: Languages of which a task holds counters at a time.
HELD = 16

_LETTER = regex.compile(r"\p{L}")
#: Bytes that are part of letters: A-Z lower-cased, and all of multi-byte characters.
_BLANK = np.ones(256, bool)
_BLANK[97:123] = False
_BLANK[128:] = False


def gram_codes(values: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Codes of all n-grams of all rows (the bytes and the size in one integer), and each one's row.  Null rows have none."""
    flat, offsets = flat_bytes(values)
    rows = np.repeat(np.arange(len(values)), np.diff(offsets))
    folded = lowered(flat)
    blank = _BLANK[folded]
    folded = np.where(blank, np.uint8(32), folded)
    # Runs of blanks shrink to one.
    keep = ~blank
    keep[1:] |= ~blank[:-1]
    keep[1:] |= rows[1:] != rows[:-1]
    # A blank at both ends of each row that has any byte.
    folded, rows = folded[keep], rows[keep]
    edge = np.flatnonzero(rows[1:] != rows[:-1]) + 1
    edges = np.concatenate(([0], edge)) if len(rows) else edge
    ends = np.concatenate((edge, [len(rows)])) if len(rows) else edge
    at = np.concatenate((edges, ends))
    folded = np.insert(folded, at, np.uint8(32)).astype(np.uint32)
    rows = np.insert(rows, at, np.concatenate((rows[edges], rows[ends - 1])))
    codes, owners = [], []
    for n in SIZES:
        m = len(folded) - n + 1
        if m <= 0:
            continue
        code = np.zeros(m, np.uint64)
        for k in range(n):
            code |= folded[k : k + m].astype(np.uint64) << np.uint64(8 * k)
        whole = rows[:m] == rows[n - 1 :]
        codes.append(code[whole] | np.uint64(n << 40))
        owners.append(rows[:m][whole])
    if not codes:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    return np.concatenate(codes), np.concatenate(owners)


@dataclass
class Filters:
    """languages by bit; priors: their shares of the training rows; masks: words of a cell each; false_rate: per language the share of foreign n-grams that hit."""

    languages: list[str]
    priors: np.ndarray
    masks: np.ndarray
    false_rate: np.ndarray

    def counts(self, counters: np.ndarray, owners: np.ndarray, n: int) -> np.ndarray:
        """Per row and language the n-grams that hit, corrected for false positives."""
        one, two = _cells(counters)
        total = np.bincount(owners, minlength=n)
        hits = np.empty((n, len(self.languages)))
        for word in range(self.masks.shape[1]):
            found = self.masks[one, word] & self.masks[two, word]
            for bit in range(64 * word, min(len(self.languages), 64 * word + 64)):
                hits[:, bit] = np.bincount(owners[(found >> np.uint64(bit % 64)) & np.uint64(1) == 1], minlength=n)
        f = self.false_rate
        return np.maximum(0, (hits - total[:, None] * f) / (1 - f))


def _counters(codes: np.ndarray) -> np.ndarray:
    return (mix(codes) % np.uint64(WIDTH)).astype(np.int64)


def _cells(counters: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    h = mix(counters.astype(np.uint64) + np.uint64(1 << 50))
    return (h % np.uint64(CELLS)).astype(np.int64), ((h >> np.uint64(32)) % np.uint64(CELLS)).astype(np.int64)


def _counted(rows: DataFrame, languages: list[str]) -> DataFrame:
    """no (a language's number), counter, n: n-grams of all rows, summed in part."""
    number = {name: i for i, name in enumerate(languages)}

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}

        def told() -> Iterator[pa.RecordBatch]:
            for no, own in sums.items():
                at = np.flatnonzero(own)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), no, np.int32)), pa.array(at.astype(np.int32)), pa.array(own[at])], names=["no", "counter", "n"])
            sums.clear()

        for batch in sized_chunks(batches, "text"):
            codes, owners = gram_codes(batch.column("text"))
            counters = _counters(codes)
            own = np.array([number[x] for x in batch.column("lang").to_pylist()], np.int64)[owners]
            for no in np.unique(own).tolist():
                if no not in sums and len(sums) == HELD:
                    yield from told()
                sums[no] = sums.get(no, 0) + np.bincount(counters[own == no], minlength=WIDTH)
        yield from told()

    return rows.mapInArrow(count, "no int, counter int, n long").groupBy("no", "counter").agg(F.sum("n").alias("n"))


def learn(labelled: DataFrame, *, text: str = "text", lang: str = "lang", lift: float = LIFT) -> Filters | None:
    """Filters from labelled rows (text, lang); None if there are none."""
    spark = spark_of(labelled)
    small_batches(spark)
    rows = labelled.select(quoted(text).cast("binary").alias("text"), quoted(lang).alias("lang")).where("text is not null and lang is not null")
    found = {r.lang: r.n for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    languages = sorted(found, key=lambda x: x.encode())
    if not languages:
        return None
    counted = cut(_counted(rows, languages))
    totals = counted.groupBy("no").agg(F.sum("n").alias("total"))
    rates = counted.join(F.broadcast(totals), "no").withColumn("rate", F.col("n") / F.col("total"))
    mean = rates.groupBy("counter").agg((F.sum("rate") / len(languages)).alias("mean"))
    chosen = rates.join(mean, "counter").where((F.col("rate") > lift * F.col("mean")) | F.lit(len(languages) == 1))
    bit = F.lit(1).cast("long")
    words = chosen.groupBy("counter", F.floor(F.col("no") / 64).cast("int").alias("word")).agg(F.bit_or(F.call_function("shiftleft", bit, F.col("no") % 64)).alias("mask"))
    picked = words.toArrow()
    masks = np.zeros((CELLS, -(-len(languages) // 64)), np.uint64)
    word, own = picked.column("word").to_numpy(), picked.column("mask").to_numpy().view(np.uint64)
    for at in _cells(picked.column("counter").to_numpy()):
        np.bitwise_or.at(masks, (at, word), own)
    filled = np.array([np.mean((masks[:, k // 64] >> np.uint64(k % 64)) & np.uint64(1)) for k in range(len(languages))])
    priors = np.array([found[x] for x in languages], float)
    return Filters(languages, priors / priors.sum(), masks, filled**2)


def identify(docs: DataFrame, filters: Filters | None, *, text: str = "text") -> DataFrame:
    """docs with lang_pred and score (0 to 1)."""
    small_batches(spark_of(docs))
    columns = others(docs, "lang_pred", "score")
    source = docs.select(*map(quoted, columns))
    schema = T.StructType([*source.schema.fields, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    shared = spark_of(docs).sparkContext.broadcast(filters)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in sized_chunks(batches, text):
            values = batch.column(text)
            n = len(values)
            names, scores = [UNKNOWN] * n, np.zeros(n)
            if own is not None:
                codes, owners = gram_codes(values.cast(pa.binary()))
                counts = own.counts(_counters(codes), owners, n) + own.priors
                best, top, all_ = counts.argmax(axis=1), counts.max(axis=1), counts.sum(axis=1)
                letter = [x is not None and _LETTER.search(x) is not None for x in values.to_pylist()]
                for i in np.flatnonzero(letter).tolist():
                    names[i], scores[i] = own.languages[best[i]], top[i] / all_[i]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in columns], pa.array(names, pa.string()), pa.array(scores)], names=schema.names)

    return map_batches(source, each, schema)


def fold(doc_id: Column) -> Column:
    """crc32 of the id as text modulo 3; rows of fold 1 are held out."""
    return F.crc32(doc_id.cast("string")) % 3


def train_and_identify(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """docs with lang_pred and score, learned from the rows that are not held out."""
    training = docs.where(F.coalesce(fold(quoted(doc_id)) != 1, F.lit(True)))
    return identify(docs, learn(training, text=text, lang=lang), text=text)

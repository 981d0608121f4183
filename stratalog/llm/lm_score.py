"""Language-model scoring with an Elias-Fano n-gram trie.

A bigram model of words.  With u before w:

    p(w | u) = (c(u, w) + m p(w)) / (c(u) + m)

Words that occur often enough in the training texts have a number (at most `most_words`, so that their table may be
broadcast: the threshold is the least count that not more words reach); all others go by their hash, and have contexts
and successors of their own just the same.  Bigram counts are dealt by the second word, frequent ones over several
shards.  Each word has one word before it, so a shard's counts of a rare word add up to c(w).  Each shard's bigrams
become two tries, one of numbered words and one with the shard's own vocabulary of hashes: first level, monotone
pointers and second level in Elias-Fano form, and smoothed log probabilities quantised to 8 bits.  To score, the texts'
bigrams go to their shard, are looked up there in the memory-mapped tries, and come back as a sum per text.  Where u is
rare, log(c(u) + m) is taken off in a join of rare words' counts with their texts.  So nothing that grows with the
corpus is broadcast, and every count covers all training texts.

A bigram's probability is 0.03 in log10 from exact at most (quantisation over the shard's range of values).

Defined results: a null or empty text is its end token alone; words never seen get the unseen share; texts without a
doc_id train and are not held out; repeated rows score alike; with no training text, base_score is 0.
"""

from __future__ import annotations

import tempfile
from collections.abc import Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratalog.llm.common import cut, mix, sized_chunks, spark_of, words_of
from stratalog.llm.elias_fano import Trie

MOST_WORDS = 1 << 18
PRIOR = 300.0
#: Tokens that a task combines before it passes counts on; tokens to a shard.
HELD_TOKENS, SHARD_TOKENS = 3_000_000, 6_000_000
#: Shards at least, so that small inputs use many cores too.
LEAST_SHARDS = 16
ADD = 0.1

_END = mix(np.array([0xE0D], np.uint64))[0]
_WIDE, _PLACE = 20, 24  # bits of a class number; of a place that is sorted along with two of them
_RARE = np.uint64(1 << 63)
_ZSTD = pa.Codec("zstd", compression_level=1)


def fold(doc_id):
    """crc32 of the id as text modulo 10; fold 0 is held out."""
    return F.crc32(doc_id.cast("string")) % 10


def tokens_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words and, after each row's words, its end; and each token's row."""
    hashes, rows = words_of(texts)
    n, m = len(hashes), len(texts)
    ends = np.cumsum(np.bincount(rows, minlength=m)) + np.arange(m)
    out, owner = np.empty(n + m, np.uint64), np.empty(n + m, np.int64)
    at = np.arange(n) + rows
    out[at], owner[at] = hashes, rows
    out[ends], owner[ends] = _END, np.arange(m)
    return out, owner


def _pieces(batches: Iterator[pa.RecordBatch], most: int = HELD_TOKENS) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Tokens, their rows, and the rows' names and training flags, of about `most` tokens a time."""
    held, n, m = [], 0, 0

    def join() -> tuple:
        out = tuple(np.concatenate(x) for x in zip(*held, strict=True))
        held.clear()  # nor does this hold what it yields
        return out

    for batch in sized_chunks(batches, "t"):
        tokens, owner = tokens_of(batch.column("t"))
        held.append((tokens, owner + m, batch.column("row").to_numpy(), batch.column("train").to_numpy(zero_copy_only=False)))
        n, m = n + len(tokens), m + len(batch)
        if n >= most or m >= 60_000:
            yield join()
            n, m = 0, 0
    if held:
        yield join()


def _word_counts(source: DataFrame) -> DataFrame:
    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for tokens, *rest in _pieces(batches):
            del rest
            h, n = np.unique(tokens, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(n)], names=["h", "n"])

    return source.where("train").mapInArrow(each, "h long, n long").groupBy("h").agg(F.sum("n").alias("c"))


class Classes:
    """Numbers: 1 the start of a text, from 2 on the frequent words by hash; rare words are their hash with the top bit set.  Counts."""

    def __init__(self, hashes: np.ndarray, counts: np.ndarray, texts: int, total: int, distinct: int, shards: int):
        self.hashes, self.shards = hashes, shards
        self.total, self.distinct = total, distinct
        self.count = np.concatenate(([0, texts], counts)).astype(np.float64)
        self.spread = np.ceil(self.count / (SHARD_TOKENS / 4)).astype(np.int64).clip(1)

    @cached_property
    def places(self) -> tuple[np.uint64, np.ndarray]:
        """By the top bits of a hash the first place from which it may stand; about four times as many as words.  Not broadcast."""
        bits = max(1, (4 * len(self.hashes)).bit_length())
        shift = np.uint64(64 - bits)
        first = np.searchsorted(self.hashes, np.arange(1 << bits, dtype=np.uint64) << shift)
        return shift, np.minimum(first, len(self.hashes) - 1).astype(np.int32)

    def of(self, tokens: np.ndarray) -> np.ndarray:
        rare = tokens | _RARE
        if not len(self.hashes):
            return rare
        shift, first = self.places
        at = first[tokens >> shift]
        held = self.hashes[at]
        live = np.flatnonzero(held < tokens)
        while len(live):
            at[live] += 1
            live = live[at[live] < len(self.hashes)]
            held[live] = self.hashes[at[live]]
            live = live[held[live] < tokens[live]]
        return np.where(held == tokens, at.astype(np.uint64) + np.uint64(2), rare)

    def bigrams(self, ids: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Each token and the one before it."""
        before = np.empty_like(ids)
        before[0], before[1:] = 1, ids[:-1]
        before[1:][owner[1:] != owner[:-1]] = 1
        return ids, before

    def shard(self, w: np.ndarray, u: np.ndarray) -> np.ndarray:
        often = w < _RARE
        own = w[often]
        part = u[often]
        part %= self.spread.astype(np.uint64)[own.view(np.int64)]
        own <<= np.uint64(_WIDE)
        own |= part
        key = w.copy()
        key[often] = own
        del own, part
        key = mix(key)
        key %= np.uint64(self.shards)
        return key.astype(np.uint16 if self.shards <= 1 << 15 else np.int64)

    def p(self, counts):
        return (counts + ADD) / (self.total + ADD * (self.distinct + 1))

    def smoothed(self, keys: np.ndarray, counts) -> np.ndarray:
        """Of numbered words, keys w << _WIDE | u."""
        w, u = keys >> _WIDE, keys & ((1 << _WIDE) - 1)
        return np.log10((counts + PRIOR * self.p(self.count[w])) / (self.count[u] + PRIOR))

    def follows(self, w: np.ndarray, counts, rare_counts: np.ndarray) -> np.ndarray:
        """log10(c(u, w) + m p(w)), c(w) of rare words as given."""
        often = w < _RARE
        c = rare_counts.astype(np.float64)
        c[often] = self.count[w[often].astype(np.int64)]
        return np.log10(counts + PRIOR * self.p(c))


class Hashed:
    """A trie of bigrams with rare words, over the words' places in a sorted vocabulary, with counts of its rare words."""

    def __init__(self, data: np.ndarray):
        n = int(data[:8].view("<i8")[0])
        self.words, self.counts = data[8 : 8 + 8 * n].view("<u8"), data[8 + 8 * n : 8 + 16 * n].view("<i8")
        self.trie = Trie(data[8 + 16 * n :])

    @staticmethod
    def pack(w: np.ndarray, u: np.ndarray, n: np.ndarray, classes: Classes) -> bytes:
        """From distinct bigrams sorted by (w, u)."""
        words = np.unique(np.concatenate((w, u)))
        first, second = np.searchsorted(words, w), np.searchsorted(words, u)
        counts = np.bincount(first, weights=n, minlength=len(words)).astype("<i8")
        values = classes.follows(w, n, counts[first])
        return np.array([len(words)], "<i8").tobytes() + words.tobytes() + counts.tobytes() + Trie.pack(first, second, values)

    def values(self, w: np.ndarray, u: np.ndarray, classes: Classes) -> np.ndarray:
        if not len(self.words):
            return classes.follows(w, 0.0, np.zeros(len(w)))
        first, second = (np.minimum(np.searchsorted(self.words, x), len(self.words) - 1) for x in (w, u))
        has = self.words[first] == w
        out = classes.follows(w, 0.0, np.where(has, self.counts[first], 0))
        both = np.flatnonzero(has & (self.words[second] == u))
        held, found = self.trie.find(first[both], second[both])
        out[both[held]] = found
        return out


def _squeeze(x: np.ndarray) -> bytes:
    """Integers compressed by byte planes."""
    planes = np.ascontiguousarray(x).view(np.uint8).reshape(len(x), x.itemsize).T.tobytes()
    return np.array([len(planes)], "<i8").tobytes() + _ZSTD.compress(planes, asbytes=True)


def _expand(data: bytes, kind: str) -> np.ndarray:
    size = int(np.frombuffer(data[:8], "<i8")[0])
    width = np.dtype(kind).itemsize
    planes = np.frombuffer(_ZSTD.decompress(data[8:], decompressed_size=size, asbytes=True), np.uint8) if size else np.zeros(0, np.uint8)
    return np.ascontiguousarray(planes.reshape(width, size // width).T).reshape(-1).view(kind)


def _rises(sorted_: np.ndarray) -> bytes:
    return _squeeze(np.diff(sorted_, prepend=0).astype("<i8"))


def _falls(data: bytes) -> np.ndarray:
    return np.cumsum(_expand(data, "<i8"))


def _by_shard(classes: Classes, w: np.ndarray, u: np.ndarray) -> Iterator[tuple[int, np.ndarray, bytes, bytes, bytes]]:
    """For each shard the places of its bigrams, numbered words first, and these packed: keys of the numbered, w and u of the others.

    w and u are sorted as _sorted does.
    """
    shard = classes.shard(w, u)
    cuts = np.concatenate(([0], np.cumsum(np.bincount(shard, minlength=classes.shards))))
    mixed = (w | u) >= _RARE
    shard <<= 1
    shard |= mixed
    order = np.argsort(shard, kind="stable")
    del shard
    for s in range(classes.shards):
        if cuts[s] < cuts[s + 1]:
            at = order[cuts[s] : cuts[s + 1]]
            k = len(at) - int(mixed[at].sum())
            plain, other = at[:k], at[k:]
            yield s, at, _rises(((w[plain] << np.uint64(_WIDE)) | u[plain]).astype(np.int64)), _rises(w[other].view(np.int64)), _squeeze(u[other])


def _order(w: np.ndarray, u: np.ndarray) -> np.ndarray:
    """The order by (w, u), numbered words before the others."""
    mixed = (w | u) >= _RARE
    plain, other = np.flatnonzero(~mixed), np.flatnonzero(mixed)
    keys = w[plain]
    keys <<= np.uint64(_WIDE)
    keys |= u[plain]
    if len(plain) < 1 << _PLACE:  # keys and places in one number sort much faster than places by keys
        keys <<= np.uint64(_PLACE)
        keys |= np.arange(len(plain), dtype=np.uint64)
        keys.sort()
        keys &= np.uint64((1 << _PLACE) - 1)
        plain = plain[keys.view(np.int64)]
    else:
        plain = plain[np.argsort(keys, kind="stable")]
    del keys
    return np.concatenate((plain, other[np.lexsort((u[other], w[other]))]))


def _sorted(w: np.ndarray, u: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """That order, and which are new in it."""
    order = _order(w, u)
    new = np.zeros(len(w), bool)
    new[:1] = True
    for x in (w, u):
        x = x[order]
        new[1:] |= x[1:] != x[:-1]
    return order, new


_SHARDED = "shard int, kind int, a binary, b binary, c binary, w binary, u binary"


def _sharded(rows: list[tuple]) -> pa.RecordBatch:
    shard, kind, *rest = zip(*rows, strict=True)
    return pa.RecordBatch.from_arrays([pa.array(shard, pa.int32()), pa.array(kind, pa.int32()), *[pa.array(x, pa.binary()) for x in rest]], names=["shard", "kind", "a", "b", "c", "w", "u"])


def _tries(source: DataFrame, shared) -> DataFrame:
    """The model: a row for each shard, with its tries in `a` and `w`."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        classes = shared.value
        for tokens, owner, _, _ in _pieces(batches):
            w, u = classes.bigrams(classes.of(tokens), owner)
            del tokens, owner
            order, new = _sorted(w, u)
            first = np.flatnonzero(new)
            n = np.diff(np.concatenate((first, [len(w)])))
            order = order[first]
            w, u = w[order], u[order]
            del order, new, first
            for s, at, keys, w_, u_ in _by_shard(classes, w, u):
                yield _sharded([(s, 0, keys, _squeeze(n[at].astype("<i4")), None, w_, u_)])
            del w, u, n, at

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        classes, now, keys, counts, others = shared.value, None, [], [], []

        def merge() -> None:
            k, inverse = np.unique(np.concatenate(keys), return_inverse=True)
            n = np.bincount(inverse, weights=np.concatenate(counts), minlength=len(k))
            keys[:], counts[:] = [k], [n]
            w, u, n = (np.concatenate(x) for x in zip(*others, strict=True))
            order, new = _sorted(w, u)
            others[:] = [(w[order][new], u[order][new], np.add.reduceat(n[order], np.flatnonzero(new)) if len(n) else n)]

        def trie() -> pa.RecordBatch:
            merge()
            k = keys[0]
            return _sharded([(now, 0, Trie.pack(k >> _WIDE, k & ((1 << _WIDE) - 1), classes.smoothed(k, counts[0])), None, None, Hashed.pack(*others[0], classes), None)])

        for batch in batches:
            for s, a, b, w, u in zip(*(batch.column(c).to_pylist() for c in ("shard", "a", "b", "w", "u")), strict=True):
                if now is not None and s != now:
                    yield trie()
                    keys, counts, others = [], [], []
                now = s
                keys.append(_falls(a))
                n = _expand(b, "<i4").astype(np.float64)
                k = len(keys[-1])
                counts.append(n[:k])
                others.append((_falls(w).view(np.uint64), _expand(u, "<u8"), n[k:]))
                if len(keys) > 16:
                    merge()
        if keys:
            yield trie()

    dealt = source.where("train").mapInArrow(count, _SHARDED)
    return cut(dealt.repartition("shard").sortWithinPartitions("shard").mapInArrow(build, _SHARDED))


def _bigram_scores(source: DataFrame, model: DataFrame, shared) -> DataFrame:
    """row, s: parts of the summed log10 probabilities of each text, but for log10(c(u) + m) of rare u."""

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        classes = shared.value
        for tokens, owner, names, _ in _pieces(batches):
            w, u = classes.bigrams(classes.of(tokens), owner)
            del tokens
            order = _order(w, u)
            owner = owner[order].astype(np.int32)
            w = w[order]
            u = u[order]
            del order
            for s, at, keys, w_, u_ in _by_shard(classes, w, u):
                texts, own = np.unique(owner[at], return_inverse=True)
                yield _sharded([(s, 1, keys, _squeeze(own.astype("<u4")), _squeeze(names[texts].astype("<i8")), w_, u_)])
            del w, u, owner, at, own

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        classes, now, trie, hashed = shared.value, None, None, None
        empty = Hashed.pack(*[np.zeros(0, np.uint64)] * 2, np.zeros(0), classes)
        with tempfile.TemporaryFile() as file, tempfile.TemporaryFile() as more:
            for batch in batches:
                for i in range(len(batch)):
                    s, kind = batch.column("shard")[i].as_py(), batch.column("kind")[i].as_py()
                    a = batch.column("a")[i].as_buffer()
                    if kind == 0:
                        for f, data in ((file, a), (more, batch.column("w")[i].as_buffer())):
                            f.seek(0)
                            f.truncate()
                            f.write(data)
                            f.flush()
                        now, trie, hashed = s, Trie(np.asarray(np.memmap(file, np.uint8, "r"))), Hashed(np.asarray(np.memmap(more, np.uint8, "r")))
                        continue
                    keys = _falls(a.to_pybytes())
                    texts = _expand(batch.column("c")[i].as_py(), "<i8")
                    own = _expand(batch.column("b")[i].as_py(), "<u4")
                    w, u = _falls(batch.column("w")[i].as_py()).view(np.uint64), _expand(batch.column("u")[i].as_py(), "<u8")
                    new = np.ones(len(keys), bool)
                    new[1:] = keys[1:] != keys[:-1]
                    single, which = keys[new], np.cumsum(new) - 1
                    value = classes.smoothed(single, 0.0)
                    if trie is not None and now == s:
                        held, found = trie.find(single >> _WIDE, single & ((1 << _WIDE) - 1))
                        value[held] = found
                    other = (hashed if now == s else Hashed(np.frombuffer(empty, np.uint8))).values(w, u, classes)
                    often = u < _RARE
                    other[often] -= np.log10(classes.count[u[often].astype(np.int64)] + PRIOR)
                    values = np.concatenate((value[which], other))
                    yield pa.RecordBatch.from_arrays([pa.array(texts), pa.array(np.bincount(own, weights=values, minlength=len(texts)))], names=["row", "s"])

    asked = source.mapInArrow(ask, _SHARDED).union(model)
    return asked.repartition("shard").sortWithinPartitions("shard", "kind").mapInArrow(answer, "row long, s double")


def _word_scores(source: DataFrame, counts: DataFrame, shared, rare_least: int) -> DataFrame:
    """Per text: tokens, known tokens, base score, and what the score lacks for rare words that others follow."""
    classes: Classes = shared.value
    all_ = classes.total + ADD * (classes.distinct + 1)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        classes = shared.value
        base = np.log10((classes.count + ADD) / all_)
        for tokens, owner, names, _ in _pieces(batches):
            ids, m = classes.of(tokens), len(names)
            rare = ids >= _RARE
            frequent = np.bincount(owner[~rare], minlength=m)
            sums = np.bincount(owner[~rare], weights=base[ids[~rare].astype(np.int64)], minlength=m)
            total = np.bincount(owner, minlength=m)
            # A row for each text, and one for each of its rare words.
            h, own = tokens[rare], owner[rare]
            del tokens, owner, ids, rare
            order = np.lexsort((h, own))
            h, own = h[order], own[order]
            new = np.ones(len(h), bool)
            new[1:] = (h[1:] != h[:-1]) | (own[1:] != own[:-1])
            at = np.flatnonzero(new)
            n = np.diff(np.concatenate((at, [len(h)])))
            k, zeros = len(at), np.zeros(len(at), np.int64)
            columns = [
                np.concatenate((names, h[at].view(np.int64))),
                np.concatenate((names, names[own[at]])),
                np.concatenate((np.zeros(m, np.int64), n)),
                np.concatenate((np.ones(m, np.int64), zeros)),
                np.concatenate((total, zeros)),
                np.concatenate((frequent, zeros)),
                np.concatenate((sums, np.zeros(k))),
            ]
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in columns], names=["h", "row", "n", "texts", "n_tokens", "known", "base"])

    rows = source.mapInArrow(each, "h long, row long, n long, texts long, n_tokens long, known long, base double")
    rare = counts.where(F.col("c") < rare_least).withColumnRenamed("h", "_h")
    joined = rows.join(rare, (rows["h"] == rare["_h"]) & (rows["n"] > 0), "left")
    c = F.coalesce("c", F.lit(0))
    # The end of a text is followed by nothing.
    before = (F.col("n") > 0) & (rows["h"] != int(_END.view(np.int64)))
    return joined.groupBy("row").agg(
        F.sum("texts").alias("texts"),
        F.sum("n_tokens").alias("n_tokens"),
        F.sum(F.col("known") + F.when(c > 0, F.col("n")).otherwise(0)).alias("known"),
        F.sum(F.col("base") + F.when(F.col("n") > 0, F.col("n") * F.log10((c + ADD) / F.lit(all_))).otherwise(0.0)).alias("base"),
        F.sum(F.when(before, -F.col("n") * F.log10(c + PRIOR)).otherwise(0.0)).alias("before"),
    )


def score(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", most_words: int = MOST_WORDS) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score for each row of docs."""
    source = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text).cast("binary"), F.lit(b"")).alias("t"))
    source = source.withColumns({"row": F.xxhash64("doc_id", "t"), "held_out": F.coalesce(fold(F.col("doc_id")) == 0, F.lit(False))})
    named = source.select("t", "row", (~F.col("held_out")).alias("train"))
    counts = cut(_word_counts(named))
    total, distinct = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()

    # The least count that no more than most_words words reach: from a histogram of counts by powers of two, then of
    # the counts within the power that is over the limit.
    def reaching(rows: DataFrame, by: str, held: int) -> tuple[int | None, int]:
        """The first value of `by`, from above, with which more than most_words words are held; how many without it."""
        for r in rows.groupBy(F.expr(by).alias("k")).agg(F.count("*").alias("n")).orderBy(F.desc("k")).toLocalIterator():
            if held + r.n > most_words:
                return r.k, held
            held += r.n
        return None, held

    power, above = reaching(counts, "cast(floor(log2(c)) as int)", 0)
    least = 1
    if power is not None:
        over, _ = reaching(counts.where(F.expr("cast(floor(log2(c)) as int)") == power), "c", above)
        least = over + 1
    frequent = counts.where((F.col("c") >= least) | (F.col("h") == int(_END.view(np.int64)))).toArrow()
    h, c = frequent.column("h").to_numpy().view(np.uint64), frequent.column("c").to_numpy()
    order = np.argsort(h)
    texts = named.where("train").count()
    classes = Classes(h[order], c[order], texts, total, distinct, max(LEAST_SHARDS, -(-total // SHARD_TOKENS)))
    shared = spark_of(docs).sparkContext.broadcast(classes)

    model = _tries(named, shared)
    bigrams = _bigram_scores(named, model, shared).groupBy("row").agg(F.sum("s").alias("bigram"))
    words = _word_scores(named, counts, shared, least)
    found = source.select("doc_id", "held_out", "row").join(words, "row").join(bigrams, "row")
    whole = lambda x: (F.col(x) / F.col("texts")).cast("long")
    return found.select(
        "doc_id",
        "held_out",
        whole("n_tokens").alias("n_tokens"),
        whole("known").alias("n_known"),
        F.lit(total).cast("long").alias("train_tokens"),
        (F.col("base") / F.col("texts")).alias("base_score"),
        ((F.col("bigram") + F.col("before")) / F.col("texts")).alias("score"),
    )

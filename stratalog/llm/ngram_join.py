"""N-gram Jaccard join: size-aware, with heavy and light sets.

A document's set holds its distinct 5-word shingles as 64-bit hashes.  Documents with equal sets form a class, and all
that follows works on classes, so copies cost one row each.  Two classes link when their Jaccard similarity reaches
the threshold.

- Light sets (up to `boundary` shingles) enumerate their subsets of those fixed sizes that a linked light set must share.
- Heavy sets scan inverted lists.  Lists hold a set's rarest shingles only, as many as the threshold calls for (the
  smaller set of a pair by its index prefix, the larger by its longer probe prefix); light sets that a heavy one can
  reach are listed too.  Rareness comes from counters over hashed shingles, of all documents; any order gives the same
  links, a good one gives short lists.
- The boundary is where the summed cost (rows enumerated, against prefix rows times the mean length of their lists) is
  least, by the histogram of set sizes.

List entries are shuffled packed: a task sorts its entries, and each shard of them is a row with compressed arrays.  The
shard's task keeps the entries whose key different classes hold and of which the sizes are near enough, less than an
eighth.  Keys that the counters show to be in very many sets are spread over shards of their own and kept unseen, so no
list meets in one task.

Lists are not turned into all pairs.  First each member is checked against its list's leader, and what the links found
connect gets one label; then the same with other leaders, among members of different labels; in the end only pairs of
different labels are checked.  So a group of thousands of near copies takes a few checks a member, and no link between
different components is missed.

Each hash stands for its shingle: sets err with a probability of about (shingles compared)**2 / 2**65.

Defined results: a text with fewer words than a shingle is one shingle, its whole sequence; a text without words, or
null, has an empty set, is linked with nothing and is its own component.  Repeated rows are documents of their own.
Sets of any size are handled whole.  A document without doc_id gets its component's least id, if any.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stratalog.llm.common import CHUNK_BYTES, cut, mix, quoted, release, sized_chunks, small_batches, spark_of, unused, words_of
from stratalog.llm.graph import components
from stratalog.llm.packing import expand, falls, rises, squeeze

SHINGLE = 5
#: Jaccard similarity in percent.
PERCENT = 75
#: Shingle counters, and how many of them one row holds.
WIDTH, PART = 1 << 22, 1 << 17
_COUNTER = np.uint64(64 - 22)
#: 64-bit words of a set's parity sketch.
SKETCH_WORDS = 8
LARGEST_BOUNDARY = 12
#: Documents whose ids may be broadcast to pick their texts; more are joined by a shuffle.
BROADCAST_IDS = 1_000_000
#: Rounds of checks against leaders, as long as they find links.
STAR_ROUNDS = 3
#: Entries that a task packs together, and entries of a shard.
PIECE, SHARD = 1 << 20, 1 << 20
#: A key is spread if its counter has more than this and 8 times the mean.
COMMON = 20_000

_FACTORS = mix(np.arange(101, 101 + 2 * SHINGLE, dtype=np.uint64))


def shingle_sets(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of all rows, sorted within each row, and the row of each."""
    hashes, rows = words_of(texts)
    n = len(hashes)
    counts = np.bincount(rows, minlength=len(texts))
    firsts = np.cumsum(counts) - counts
    parts, owners = [], []
    if n >= SHINGLE:
        m = n - SHINGLE + 1
        total = np.zeros(m, np.uint64)
        for k in range(SHINGLE):
            total += hashes[k : k + m] * _FACTORS[k]
        whole = rows[:m] == rows[SHINGLE - 1 :]
        parts.append(mix(total[whole]))
        owners.append(rows[:m][whole])
    short = np.flatnonzero((counts > 0) & (counts < SHINGLE))
    if len(short):
        total = counts[short].astype(np.uint64) * _FACTORS[-1]
        for k in range(SHINGLE - 1):
            have = counts[short] > k
            total[have] += hashes[firsts[short[have]] + k] * _FACTORS[SHINGLE + k]
        parts.append(mix(total))
        owners.append(short)
    if not parts:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    h, r = np.concatenate(parts), np.concatenate(owners)
    by_hash = np.argsort(h)
    order = by_hash[np.argsort(_narrow(r[by_hash], len(texts)), kind="stable")]
    h, r = h[order], r[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (r[1:] != r[:-1])
    return h[new], r[new]


def _narrow(rows: np.ndarray, n: int) -> np.ndarray:
    return rows.astype(np.uint16) if n <= 1 << 16 else rows


def set_classes(h: np.ndarray, rows: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Per row the size of its set and its class: a hash of the set, whatever the order."""
    sizes = np.bincount(rows, minlength=n)
    sums = np.zeros(len(h) + 1, np.uint64)
    np.cumsum(mix(h ^ np.uint64(0xA5A5A5A55A5A5A5A)), dtype=np.uint64, out=sums[1:])
    ends = np.cumsum(sizes)
    return sizes, mix(sums[ends] - sums[ends - sizes] + sizes.astype(np.uint64)).view(np.int64)


def needed(s: int, t: int, percent: int = PERCENT) -> int:
    """The least overlap of linked sets of s and t elements: percent of the union."""
    return -(-percent * (s + t) // (100 + percent))


def probe_length(n, percent: int = PERCENT):
    """Prefix of a set that meets smaller ones: all but (least overlap with any linked set) - 1."""
    return n + (-percent * n // 100) + 1


def index_length(n, percent: int = PERCENT):
    """Prefix of a set that meets larger or equal ones."""
    return n + (-2 * percent * n // (100 + percent)) + 1


def subset_sizes(s: int, boundary: int, percent: int = PERCENT) -> list[int]:
    """Sizes of the subsets that a light set of s elements enumerates: overlaps that linked light sets must share."""
    partners = range(-(-percent * s // 100), min(boundary, 100 * s // percent) + 1)
    return sorted({needed(s, t, percent) for t in partners if needed(s, t, percent) <= min(s, t)})


def choose_boundary(histogram: dict[int, int], list_length: float, percent: int = PERCENT) -> int:
    """The boundary of least cost; histogram: how many sets have so many elements."""

    def cost(boundary: int) -> float:
        light = sum(histogram.get(s, 0) * sum(comb(s, c) for c in subset_sizes(s, boundary, percent)) for s in range(1, boundary + 1))
        reach = -(-percent * (boundary + 1) // 100)
        listed = sum(histogram.get(s, 0) * index_length(s, percent) for s in range(reach, boundary + 1))
        heavy = sum(k * probe_length(s, percent) * (1 + list_length) for s, k in histogram.items() if s > boundary)
        return light + listed + heavy

    return min(range(LARGEST_BOUNDARY + 1), key=cost)


def sketches(h: np.ndarray, rows: np.ndarray, n: int) -> np.ndarray:
    """Parity of the set's elements in each of 64 * SKETCH_WORDS cells: where the sketches of two sets differ, so do the sets."""
    cells = 64 * SKETCH_WORDS
    odd = np.bincount(rows * cells + (mix(h + np.uint64(77)) % np.uint64(cells)).astype(np.int64), minlength=n * cells) & 1
    return np.packbits(odd.astype(np.uint8).reshape(n, cells), axis=1, bitorder="little").view("<i8")


def _packed(part: np.ndarray) -> bytes:
    return pa.compress(part.tobytes(), codec="zstd", asbytes=True)


def _unpacked(data: pa.Buffer) -> np.ndarray:
    return np.frombuffer(pa.decompress(data, decompressed_size=4 * PART, codec="zstd"), np.uint32)


def _scan(docs: DataFrame) -> DataFrame:
    """Rows of two kinds: kind 0, a document each (doc_id, hash of the text, class, set size); kind 1, parts of a task's shingle counters."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counters = np.zeros(WIDTH, np.uint32)
        for batch in sized_chunks(batches, "t"):
            n = len(batch)
            h, rows = shingle_sets(batch.column("t"))
            sizes, classes = set_classes(h, rows, n)
            np.add.at(counters, (h >> _COUNTER).astype(np.int64), np.uint32(1))
            yield pa.RecordBatch.from_arrays([pa.array(np.zeros(n, np.int32)), batch.column("d"), batch.column("th"), pa.array(classes), pa.array(sizes), pa.nulls(n, pa.binary())], names=["kind", "d", "th", "cls", "n", "counts"])
        live = np.flatnonzero(counters.reshape(-1, PART).any(axis=1))
        if len(live):
            m = len(live)
            blobs = [_packed(counters[k * PART : (k + 1) * PART]) for k in live.tolist()]
            yield pa.RecordBatch.from_arrays([pa.array(np.ones(m, np.int32)), pa.nulls(m, pa.int64()), pa.nulls(m, pa.int64()), pa.array(live), pa.nulls(m, pa.int64()), pa.array(blobs, pa.binary())], names=["kind", "d", "th", "cls", "n", "counts"])

    return docs.mapInArrow(each, "kind int, d long, th long, cls long, n long, counts binary")


def _counters(scanned: DataFrame) -> tuple[np.ndarray, float, float]:
    """The counters of all tasks together (none over 65535), WIDTH of them however many documents there are; their sum and sum of squares."""

    def total(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros(PART, np.int64)
        for batch in batches:
            for x in batch.column("counts"):
                sums += _unpacked(x.as_buffer())
        values = [[key[0].as_py()], [float(sums.sum())], [float((sums.astype(float) ** 2).sum())]]
        yield pa.RecordBatch.from_arrays([*map(pa.array, values), pa.array([np.minimum(sums, 65535).astype("<u2").tobytes()], pa.binary())], names=["cls", "one", "two", "counts"])

    out, one, two = np.zeros(WIDTH, np.uint16), 0.0, 0.0
    for row in scanned.where("kind = 1").select("cls", "counts").groupBy("cls").applyInArrow(total, "cls long, one double, two double, counts binary").collect():
        out[row.cls * PART : (row.cls + 1) * PART] = np.frombuffer(row.counts, "<u2")
        one, two = one + row.one, two + row.two
    return out, one, two


_PACKED = "shard int, h binary, cls binary, n binary, pos binary"


def _entries(h: np.ndarray, rows: np.ndarray, sizes: np.ndarray, counts: np.ndarray, boundary: int) -> tuple[np.ndarray, ...]:
    """Key, row, place (or minus the size of a subset) and the key's counter of all list entries; rows: of each h, sorted."""
    reach = -(-PERCENT * (boundary + 1) // 100)
    starts = np.cumsum(sizes) - sizes
    out = []
    for s in range(1, boundary + 1):
        mine = np.flatnonzero(sizes == s)
        if len(mine):
            own = mix(h[starts[mine][:, None] + np.arange(s)])
            for c in subset_sizes(s, boundary):
                pick = np.array(list(combinations(range(s), c)))
                keys = mix(own[:, pick].sum(axis=2, dtype=np.uint64) * np.uint64(2 * c + 1))
                # A subset is in no more sets than its rarest element.
                rare = counts[(h[starts[mine][:, None] + np.arange(s)] >> _COUNTER).astype(np.int64)][:, pick].min(axis=2)
                out.append((keys.ravel(), np.repeat(mine, len(pick)), np.full(keys.size, -c), rare.ravel()))
    # Rarest first, then by hash: place within the set.
    held = counts[(h >> _COUNTER).astype(np.int64)]
    by = np.lexsort((held, _narrow(rows, len(sizes))))
    ranked, owner = h[by], rows[by]
    pos = np.arange(len(by)) - starts[owner]
    limit = np.where(sizes > boundary, probe_length(sizes), np.where(sizes >= reach, index_length(sizes), 0))
    keep = pos < limit[owner]
    out.append((ranked[keep], owner[keep], pos[keep], held[by][keep]))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def _packed_lists(docs: DataFrame, counters: np.ndarray, boundary: int, shards: int, common: float) -> DataFrame:
    """Entries by shard, sorted by key; keys in more than `common` sets by class, in shards from `shards` on."""
    shared = spark_of(docs).sparkContext.broadcast(counters)

    def packed(held: list[tuple[np.ndarray, ...]]) -> Iterator[pa.RecordBatch]:
        keys, cls, n, pos, count = (np.concatenate(x) for x in zip(*held, strict=True))
        shard = (keys % np.uint64(shards)).astype(np.int32)
        often = count > common
        shard[often] = shards + (mix(cls[often].view(np.uint64) ^ keys[often]) % np.uint64(shards)).astype(np.int32)
        by = np.lexsort((keys, shard))
        keys, cls, n, pos, shard = keys[by], cls[by], n[by], pos[by], shard[by]
        cuts = np.flatnonzero(np.diff(shard, prepend=-1))
        rows = []
        for a, b in zip(cuts.tolist(), [*cuts[1:].tolist(), len(shard)], strict=True):
            own, at = np.unique(cls[a:b], return_inverse=True)
            which = squeeze(own) + squeeze(at.astype("<i4"))
            rows.append((int(shard[a]), rises(keys[a:b].view(np.int64)), which, squeeze(n[a:b].astype("<i4")), squeeze(pos[a:b].astype("<i4"))))
        yield pa.RecordBatch.from_arrays([pa.array(x, pa.int32() if k == 0 else pa.binary()) for k, x in enumerate(zip(*rows, strict=True))], names=["shard", "h", "cls", "n", "pos"])

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, held, size, seen = shared.value, [], 0, np.zeros(0, np.int64)
        for batch in sized_chunks(batches, "t"):
            h, rows = shingle_sets(batch.column("t"))
            sizes, classes = set_classes(h, rows, len(batch))
            # Each class once a piece.
            first = np.zeros(len(batch), bool)
            first[np.unique(classes, return_index=True)[1]] = True
            first &= (sizes > 0) & ~np.isin(classes, seen)
            live = first[rows]
            if not live.any():
                continue
            keys, owner, pos, count = _entries(h[live], rows[live], np.where(first, sizes, 0), counts, boundary)
            held.append((keys, classes[owner], sizes[owner], pos, count))
            seen, size = np.concatenate((seen, classes[first])), size + len(keys)
            if size >= PIECE:
                yield from packed(held)
                held, size, seen = [], 0, seen[:0]
        if held:
            yield from packed(held)

    return docs.select("t").mapInArrow(each, _PACKED)


def _in_reach(h: np.ndarray, n: np.ndarray, pos: np.ndarray) -> np.ndarray:
    """Which of some entries, sorted by key and size, another one of their key may link with: by the nearest sizes, and of keys with two entries by their places, too."""
    n, pos = n.astype(np.int64), pos.astype(np.int64)
    near = (h[1:] == h[:-1]) & (100 * n[:-1] >= PERCENT * n[1:])
    begin = np.flatnonzero(np.concatenate(([True], h[1:] != h[:-1])))
    x = begin[np.diff(np.concatenate((begin, [len(h)]))) == 2]
    y = x + 1
    overlap = -(-PERCENT * (n[x] + n[y]) // (100 + PERCENT))
    in_lists = (pos[x] <= n[x] - overlap) & (pos[y] <= n[y] - overlap) & (np.minimum(pos[x], pos[y]) + 1 + np.minimum(n[x] - pos[x], n[y] - pos[y]) - 1 >= overlap)
    near[x] &= np.where(pos[x] < 0, overlap == -pos[x], in_lists)
    keep = np.zeros(len(h), bool)
    keep[1:] |= near
    keep[:-1] |= near
    return keep


def _shared_lists(packed: DataFrame, shards: int) -> DataFrame:
    """h, cls, n, pos of the entries whose key different classes hold, if one of those may link with them, and of all common keys."""

    def entries(held: list[tuple], whole: bool) -> Iterator[pa.RecordBatch]:
        h = np.concatenate([falls(x[0]) for x in held])
        n, pos = (np.concatenate([expand(x[k], "<i4") for x in held]) for k in (2, 3))
        cls = np.concatenate([_named(x[1]) for x in held])
        by = np.argsort(h, kind="stable")
        h, cls, n, pos = h[by], cls[by], n[by], pos[by]
        if not whole and len(h):
            begin = np.flatnonzero(np.diff(h, prepend=h[0] - 1))
            mixed = np.minimum.reduceat(cls, begin) < np.maximum.reduceat(cls, begin)
            keep = np.repeat(mixed, np.diff(np.concatenate((begin, [len(h)]))))
            h, cls, n, pos = h[keep], cls[keep], n[keep], pos[keep]
        # What several pieces told of one class stays once.
        by = np.lexsort((pos, cls, h))
        h, cls, n, pos = h[by], cls[by], n[by], pos[by]
        new = np.ones(len(h), bool)
        new[1:] = (h[1:] != h[:-1]) | (cls[1:] != cls[:-1]) | (pos[1:] != pos[:-1])
        h, cls, n, pos = h[new], cls[new], n[new], pos[new]
        if not whole and len(h):
            by = np.lexsort((n, h))
            by = by[_in_reach(h[by], n[by], pos[by])]
            h, cls, n, pos = h[by], cls[by], n[by], pos[by]
        for at in np.array_split(np.arange(len(h)), len(h) // 50_000 + 1):
            yield pa.RecordBatch.from_arrays([pa.array(x[at]) for x in (h, cls, n, pos)], names=["h", "cls", "n", "pos"])

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []
        for batch in batches:
            for shard, *row in zip(*(batch.column(c).to_pylist() for c in ("shard", "h", "cls", "n", "pos")), strict=True):
                if held and shard != now:
                    yield from entries(held, now >= shards)
                    held = []
                now = shard
                held.append(row)
        if held:
            yield from entries(held, now >= shards)

    return packed.repartition("shard").sortWithinPartitions("shard").mapInArrow(each, "h long, cls long, n int, pos int")


def _named(data: bytes) -> np.ndarray:
    own, rest = expand(data, "<i8", more=True)
    return own[expand(rest, "<i4")]


def _may_link(n: Column, pos: Column, m: Column, at: Column) -> Column:
    """Whether sets of n and m elements that share an entry at these places can reach the threshold."""
    overlap = _least_overlap(n + m)
    # Prefixes of the lengths that this pair needs share an entry; what stands after it, and all before, may be shared.
    in_lists = (pos <= n - overlap) & (at <= m - overlap) & (F.least(pos, at) + 1 + F.least(n - pos - 1, m - at - 1) >= overlap)
    return (100 * F.least(n, m) >= PERCENT * F.greatest(n, m)) & F.when(pos < 0, overlap == -pos).otherwise(in_lists)


def _least_overlap(total: Column) -> Column:
    return F.ceil(PERCENT * total / (100 + PERCENT))


def _sketches_allow(n: Column, m: Column, mark: str = "_") -> Column:
    """Whether the sketches (s0, s1, ... and those with a mark) differ in no more places than linked sets may differ in elements."""
    differ = F.lit(0)
    for k in range(SKETCH_WORDS):
        differ = differ + F.bit_count(F.col(f"s{k}").bitwiseXOR(F.col(f"s{k}{mark}")))
    return differ <= n + m - 2 * _least_overlap(n + m)


def _texts_of(classes: DataFrame, docs: DataFrame, known: DataFrame) -> tuple[DataFrame, DataFrame]:
    """One document's text for each of the classes, and the classes with that document."""
    # Picked by a hash of id and text, as all documents of a class may lack an id; one that clashes falls out by its class.
    pick = F.xxhash64("d", "th")
    chosen = cut(known.where("n > 0").join(classes, "cls", "left_semi").groupBy("cls").agg(F.min(pick).alias("k")))
    ids = chosen.select("k").distinct()
    if chosen.count() <= BROADCAST_IDS:
        ids = F.broadcast(ids)
    return docs.withColumn("k", pick).join(ids, "k", "left_semi").select("t"), chosen.select("cls")


def _sketched(lists: DataFrame, docs: DataFrame, known: DataFrame) -> DataFrame:
    """cls and sketch of the classes that stand in lists."""
    texts, classes = _texts_of(lists.select("cls").distinct(), docs, known)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sized_chunks(batches, "t"):
            h, rows = shingle_sets(batch.column("t"))
            sizes, classes = set_classes(h, rows, len(batch))
            own = sketches(h, rows, len(batch))
            yield pa.RecordBatch.from_arrays([pa.array(classes), pa.array(sizes), *[pa.array(np.ascontiguousarray(own[:, k])) for k in range(SKETCH_WORDS)]], names=names)

    names = ["cls", "size", *[f"s{k}" for k in range(SKETCH_WORDS)]]
    return cut(texts.mapInArrow(each, ", ".join(f"{c} long" for c in names)).join(classes, "cls", "left_semi").dropDuplicates(["cls"]))


def _plausible(pairs: DataFrame, sketched: DataFrame) -> DataFrame:
    """Without the pairs of which the sketches differ in more places than linked sets may differ in elements."""
    x = sketched.withColumnsRenamed({"cls": "a", "size": "n"})
    y = sketched.select(F.col("cls").alias("b"), F.col("size").alias("m"), *[F.col(f"s{k}").alias(f"s{k}_") for k in range(SKETCH_WORDS)])
    return pairs.join(x, "a").join(y, "b").where(_sketches_allow(F.col("n"), F.col("m"))).select("a", "b")


def _shared(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Of texts in pairs (the first with the second, and so on): sizes of all sets, and the overlap of each pair."""
    h, rows = shingle_sets(pa.array(texts, pa.binary()))
    sizes = np.bincount(rows, minlength=len(texts))
    pair = rows >> 1
    order = np.lexsort((h, pair))
    h, pair = h[order], pair[order]
    # Elements are distinct within a set, so what a pair holds twice is shared.
    twice = (h[1:] == h[:-1]) & (pair[1:] == pair[:-1])
    return sizes.reshape(-1, 2), np.bincount(pair[1:][twice], minlength=len(texts) // 2)


def _verified(pairs: DataFrame, docs: DataFrame, known: DataFrame) -> DataFrame:
    """Those pairs (a, b) of classes whose sets reach the threshold, checked on the whole sets.

    Compressed texts are shuffled, a fraction of the size of their shingles' hashes, and the sets are made where a pair meets.
    """
    texts, classes = _texts_of(pairs.select(F.col("a").alias("cls")).union(pairs.select(F.col("b").alias("cls"))).distinct(), docs, known)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sized_chunks(batches, "t"):
            own = batch.column("t")
            _, found = set_classes(*shingle_sets(own), len(batch))
            data = [x.as_buffer() for x in own]
            sizes = np.array([x.size for x in data], np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(sizes), pa.array([pa.compress(x, codec="zstd", asbytes=True) for x in data], pa.binary())], names=["cls", "size", "z"])

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = np.stack([batch.column(c).to_numpy() for c in ("x_size", "y_size")], axis=1)
            ends, start = np.cumsum(sizes.sum(axis=1)), 0
            while start < len(batch):
                base = ends[start - 1] if start else 0
                stop = max(start + 1, int(np.searchsorted(ends, base + CHUNK_BYTES, side="right")))
                part = batch.slice(start, stop - start)
                packed = zip(part.column("x").to_pylist(), part.column("y").to_pylist(), sizes[start:stop].tolist(), strict=True)
                n, both = _shared([pa.decompress(z, decompressed_size=k, codec="zstd", asbytes=True) for x, y, (k, m) in packed for z, k in ((x, k), (y, m))])
                yield part.select(["a", "b"]).filter(pa.array(100 * both >= PERCENT * (n.sum(axis=1) - both)))
                start = stop

    packed = texts.mapInArrow(pack, "cls long, size long, z binary").join(classes, "cls", "left_semi").dropDuplicates(["cls"])
    left = pairs.join(packed.withColumnsRenamed({"cls": "a", "size": "x_size", "z": "x"}), "a")
    both = left.join(packed.withColumnsRenamed({"cls": "b", "size": "y_size", "z": "y"}), "b")
    return both.select("a", "b", "x_size", "y_size", "x", "y").mapInArrow(judge, "a long, b long").distinct()


def _labels(links: DataFrame) -> DataFrame:
    """node, root: for each class that links to a lesser one, another that links connect it with, the lesser the better; not always the component's least."""
    up = links.groupBy(F.col("b").alias("node")).agg(F.min("a").alias("root"))
    for _ in range(2):
        on = up.select(F.col("node").alias("_n"), F.col("root").alias("_r"))
        up = up.join(on, up["root"] == on["_n"], "left").select("node", F.coalesce("_r", "root").alias("root"))
    return cut(up)


def linked_components(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id, class_id (alike where the sets are equal) and text_hash for each row of docs, and
    first: whether the row has the least id of its component, and of rows with that id the least text_hash."""
    small_batches(spark_of(docs))
    source = docs.select(quoted(doc_id).cast("long").alias("d"), F.coalesce(quoted(text).cast("binary"), F.lit(b"")).alias("t")).withColumn("th", F.xxhash64("t"))
    scanned = cut(_scan(source))
    known = scanned.where("kind = 0").select("d", "th", "cls", "n")
    counters, summed, squares = _counters(scanned)
    histogram = {r.n: r.k for r in known.where("n > 0").groupBy(F.least("n", F.lit(LARGEST_BOUNDARY + 1)).alias("n")).agg(F.count_distinct("cls").alias("k")).collect()}
    length = squares / summed - summed / WIDTH if summed else 0.0
    boundary = choose_boundary(histogram, max(0.0, length))

    shards = max(16, int(summed) // 4 // SHARD)  # about a quarter of all shingles are entries
    lists = cut(_shared_lists(_packed_lists(source, counters, boundary, shards, COMMON + 8 * summed / WIDTH), shards))
    del counters

    sketched = _sketched(lists, source, known)
    release(spark_of(docs))

    links: DataFrame | None = None
    roots: DataFrame | None = None
    tested: DataFrame | None = None
    turn, stars = 0, True
    while stars is not None:
        members = lists.withColumn("c", F.col("cls")) if roots is None else lists.join(roots, lists["cls"] == roots["node"], "left").select("h", "cls", "n", "pos", F.coalesce("root", "cls").alias("c"))
        last = not stars
        if stars:
            # Each member against its list's leader: the same one in all lists first, then by another order in each list.
            rank = F.struct((F.col("c") if turn == 0 else F.xxhash64("c", "h", F.lit(turn))).alias("r"), "cls", "n", "pos", "c")
            leaders = members.groupBy("h").agg(F.min(rank).alias("l"), F.min("c").alias("lo"), F.max("c").alias("hi")).where("lo < hi").select("h", "l")
            met = members.join(leaders, "h").where((F.col("c") != F.col("l.c")) & _may_link(F.col("n"), F.col("pos"), F.col("l.n"), F.col("l.pos")))
            pairs = met.select(F.least("cls", "l.cls").alias("a"), F.greatest("cls", "l.cls").alias("b"))
        else:
            mixed = members.groupBy("h").agg(F.min("c").alias("lo"), F.max("c").alias("hi")).where("lo < hi").select("h")
            left = cut(members.join(mixed, "h", "left_semi").join(sketched.drop("size"), "cls"))
            other = left.select("h", *[F.col(x).alias(f"{x}_") for x in left.columns if x != "h"])
            meet = (F.col("cls") < F.col("cls_")) & (F.col("c") != F.col("c_")) & _may_link(F.col("n"), F.col("pos"), F.col("n_"), F.col("pos_"))
            met = left.join(other, "h").where(meet & _sketches_allow(F.col("n"), F.col("n_")))
            pairs = met.select(F.col("cls").alias("a"), F.col("cls_").alias("b"))
        pairs = pairs.distinct()
        if tested is not None:
            pairs = pairs.join(tested, ["a", "b"], "left_anti")
        pairs = cut(pairs)
        likely = cut(_plausible(pairs, sketched))
        fresh = not likely.isEmpty()
        if fresh:
            found = cut(_verified(likely, source, known))
            fresh = not found.isEmpty()
        if fresh:
            links = found if links is None else links.union(found)
        tested = pairs if tested is None else tested.union(pairs)
        turn += 1
        # Leaders as long as they find links, then what is left once, in full.
        stars = None if last else fresh and turn < STAR_ROUNDS
        if links is not None and (fresh or not last):
            roots = _labels(links) if stars else components(links)
        del pairs, likely
        release(spark_of(docs))

    if roots is None:
        joined = known.withColumn("c", F.col("cls"))
    else:
        joined = known.join(roots, known["cls"] == roots["node"], "left").select("d", "th", "cls", "n", F.coalesce("root", "cls").alias("c"))
    joined = cut(joined)
    by_id = F.struct(F.coalesce("d", F.lit((1 << 63) - 1)), "th")
    least = joined.where("n > 0").groupBy("c").agg(F.min(by_id).alias("least"), F.min("d").alias("component_id")).withColumnRenamed("c", "_c")
    named = joined.join(least, (joined["c"] == least["_c"]) & (joined["n"] > 0), "left")
    return named.select(
        F.col("d").alias("doc_id"),
        F.col("n").alias("n_shingles"),
        F.coalesce("component_id", "d").alias("component_id"),
        F.col("cls").alias("class_id"),
        F.col("th").alias("text_hash"),
        F.coalesce(by_id == F.col("least"), F.lit(True)).alias("first"),
    )


def one_per_component(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """docs with one row of each component: that of the least id.  Of rows that are alike in id and text one stays, too, if they have words."""
    groups = cut(linked_components(docs, doc_id=doc_id, text=text).where("n_shingles > 0"))
    d, th, i, h = unused(docs, "_d", "_th", "_i", "_h")
    keyed = docs.withColumns({d: quoted(doc_id).cast("long"), th: F.xxhash64(F.coalesce(quoted(text).cast("binary"), F.lit(b"")))})

    def ids(rows: DataFrame) -> DataFrame:
        few = rows.select(F.col("doc_id").alias(i), F.col("text_hash").alias(h)).distinct()
        return F.broadcast(few) if rows.count() <= BROADCAST_IDS else few

    same = lambda right: keyed[d].eqNullSafe(right[i]) & (keyed[th] == right[h])
    others = ids(groups.where(~F.col("first")))
    kept = keyed.join(others, same(others), "left_anti")
    repeated = groups.where("first").groupBy("doc_id", "text_hash").agg(F.count("*").alias("k")).where("k > 1")
    if not repeated.isEmpty():
        twice = ids(repeated)
        kept = kept.join(twice, same(twice), "left_anti").union(kept.join(twice, same(twice), "left_semi").dropDuplicates([d, th]))
    return kept.drop(d, th)

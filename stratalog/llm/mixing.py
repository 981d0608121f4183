"""Mixing sources to target weights.

Each source's words are packed, document after document, into blocks of `block_words` words.  A source's target is its
weight's share of all words, stopped at `most_repeats` times its size, the excess going to the others by weight; in
blocks, that is its number of slots.

1. The mix has as many slots as all sources together, dealt into output shards of `shard_slots`.  Every slot of a shard
   draws its source by a seeded hash, with chances as the sources' slots: a shard's counts by source are a multinomial
   draw.
2. The slots that a source drew are numbered through the shards.  Those beyond its own number of slots go, in order, to
   the sources that drew too few; so every source meets its target to within a block and none is read too often.
3. Slot k of a source reads, in the pass k div n over its n blocks, the block to which that pass's pseudorandom index
   permutation (a swap-or-not network keyed by seed, source and pass) maps k mod n.  Slots and blocks are joined by
   (source, index): that is the mix, and what it takes of each document is summed from it.

All of it is DataFrame expressions.  Places are running sums in two steps, within ranges of the order and over the
ranges, so a source that holds most rows is spread over many tasks.  Nothing depends on the number of tasks or on row
order: reruns agree.

Defined results: a null text has size 0 and takes 0; a null source is a source of its own, last in order; rows that
repeat a doc_id are documents of their own, alike ones of which share a place by count; an empty table gives an empty
result.  Documents of size 0 and sources of size 0 take 0.  The results have only the columns named below.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stratalog.llm.common import SPACE_CHARS, SPACE_CLASS, cut, quoted, spark_of

BLOCK_WORDS = 64
SHARD_SLOTS = 1 << 14
WEIGHTS = (1, 2, 3)
#: Sources that may be broadcast to their documents (some 100 bytes each); more are joined by a shuffle.
BROADCAST_SOURCES = 100_000
ROUNDS = 12
#: Slots that one row of an interval table spans at most, and that one task makes.
_CHUNK, _TASK_SLOTS = 1 << 12, 1 << 17


def word_count(text: Column) -> Column:
    bare = F.btrim(text, F.lit(SPACE_CHARS))
    return F.when(F.coalesce(bare, F.lit("")) == "", F.lit(0)).otherwise(F.size(F.split(bare, f"[{SPACE_CLASS}]+"))).cast("long")


def permuted(rows: DataFrame, x: str, n: str, key: str, seed: int) -> DataFrame:
    """rows with `x` replaced by its image in a pseudorandom permutation of 0..n-1 chosen by seed and key: rounds that swap x with k - x, or not."""
    for r in range(ROUNDS):
        rows = rows.withColumn("_other", F.pmod(F.xxhash64(F.lit(seed), F.lit(r), key), n) - F.col(x))
        rows = rows.withColumn("_other", F.when(F.col("_other") < 0, F.col("_other") + F.col(n)).otherwise(F.col("_other")))
        swap = F.xxhash64(F.lit(seed + 1), F.lit(r), F.greatest(x, "_other"), key).bitwiseAND(F.lit(1)) == 1
        rows = rows.withColumn(x, F.when(swap, F.col("_other")).otherwise(F.col(x)))
    return rows.drop("_other")


def running_sum(rows: DataFrame, order: list[Column], value: str, name: str) -> DataFrame:
    """rows with the sum of `value` over all rows before, in two steps: within ranges of the order, and over the ranges."""
    ranged = cut(rows.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()))
    upto = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)  # a row for each range
    firsts = ranged.groupBy("_range").agg(F.sum(value).alias("_sum")).select("_range", F.coalesce(F.sum("_sum").over(upto), F.lit(0)).alias("_first"))
    within = Window.partitionBy("_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    summed = ranged.withColumn("_within", F.coalesce(F.sum(value).over(within), F.lit(0)))
    return summed.join(F.broadcast(firsts), "_range").withColumn(name, (F.col("_first") + F.col("_within")).cast("long")).drop("_range", "_first", "_within")


def _by(source: str = "source") -> Column:
    return F.col(source).asc_nulls_last()


def targets(sizes: DataFrame, *, weights: tuple[int, ...] = WEIGHTS, most_repeats: int = 3) -> DataFrame:
    """sizes (source, source_size), a row for each source, with its target."""
    turn = F.element_at(F.array(*map(F.lit, weights)), (F.pmod("_rank", F.lit(len(weights))) + 1).cast("int"))
    ranked = cut(
        running_sum(sizes.withColumn("_one", F.lit(1)), [_by()], "_one", "_rank")
        .withColumn("_weight", turn.cast("double"))
        .withColumn("_most", (most_repeats * F.col("source_size")).cast("double"))
        .drop("_rank", "_one")
    )
    # The level is what a weight of one gets: sources that it would fill beyond their most leave the rest to the others.
    level, before = 0.0, -1.0
    while level > before:
        full = F.col("_most") < F.col("_weight") * F.lit(level)
        left = F.sum("source_size").cast("double") - F.coalesce(F.sum(F.when(full, F.col("_most"))), F.lit(0.0))
        left, weight = ranked.agg(left, F.sum(F.when(~full, F.col("_weight")))).first()
        before, level = level, (left / weight if left and weight else level)
    return ranked.select("source", "source_size", F.least("_most", F.col("_weight") * F.lit(level)).alias("target"))


def _spans(rows: DataFrame, first: str, size: str) -> DataFrame:
    """rows, each once for every chunk of places that first .. first + size - 1 touches."""
    place = lambda c: F.floor(c / F.lit(_CHUNK)).cast("long")
    return rows.where(F.col(size) > 0).withColumn("_chunk", F.explode(F.sequence(place(F.col(first)), place(F.col(first) + F.col(size) - 1))))


def _inside(places: DataFrame, x: str, spans: DataFrame, first: str, size: str) -> DataFrame:
    """places joined with the span that holds x."""
    keyed = places.withColumn("_chunk", F.floor(F.col(x) / F.lit(_CHUNK)).cast("long"))
    return keyed.join(spans, "_chunk").where((F.col(x) >= F.col(first)) & (F.col(x) < F.col(first) + F.col(size))).drop("_chunk")


def draw_counts(sources: DataFrame, total: int, *, shard_slots: int = SHARD_SLOTS, seed: int = 17) -> DataFrame:
    """shard, no, drawn: how many slots of each output shard drew each source.  sources: no, n_slots, first_slot; total: all n_slots."""
    draws = spark_of(sources).range(0, total, 1, -(-total // _TASK_SLOTS) or 1).select((F.col("id") / shard_slots).cast("long").alias("shard"), F.pmod(F.xxhash64(F.lit(seed + 2), "id"), F.lit(total or 1)).alias("x"))
    return _inside(draws, "x", _spans(sources.select("no", "n_slots", "first_slot"), "first_slot", "n_slots"), "first_slot", "n_slots").groupBy("shard", "no").agg(F.count("*").alias("drawn"))


def slots(sources: DataFrame, *, shard_slots: int = SHARD_SLOTS, seed: int = 17) -> DataFrame:
    """One row a slot: no (the source's), slot, shard, block.  sources: no, n_blocks, n_slots, first_slot."""
    total = sources.agg(F.coalesce(F.sum("n_slots"), F.lit(0))).first()[0]
    counts = draw_counts(sources, total, shard_slots=shard_slots, seed=seed)
    numbered = running_sum(counts, [F.col("no"), F.col("shard")], "drawn", "_at")
    begins = numbered.groupBy("no").agg(F.min("_at").alias("_begin"), F.sum("drawn").alias("_all"))
    known = sources.select("no", "n_slots", "n_blocks").join(begins, "no", "left").withColumn("_all", F.coalesce("_all", F.lit(0)))
    owned = cut(numbered.join(known, "no").withColumn("slot", F.col("_at") - F.col("_begin")))
    own = owned.select("no", "n_blocks", "shard", "slot", F.least(F.col("drawn"), F.greatest(F.col("n_slots") - F.col("slot"), F.lit(0))).alias("_n"))
    # What a source drew beyond its slots, one by one in order, meets what others lack.
    beyond = owned.withColumn("_over", F.col("drawn") - F.greatest(F.least(F.col("drawn"), F.col("n_slots") - F.col("slot")), F.lit(0))).where("_over > 0").select("no", "shard", "_over")
    passed = running_sum(beyond, [F.col("no"), F.col("shard")], "_over", "_e").withColumn("_e", F.explode(F.sequence(F.col("_e"), F.col("_e") + F.col("_over") - 1))).select("shard", "_e")
    lacking = running_sum(known.withColumn("_lack", F.col("n_slots") - F.col("_all")).where("_lack > 0").select("no", "n_blocks", "_all", "_lack"), [F.col("no")], "_lack", "_l")
    taken = _inside(passed, "_e", _spans(lacking, "_l", "_lack"), "_l", "_lack").select("no", "n_blocks", "shard", (F.col("_all") + F.col("_e") - F.col("_l")).alias("slot"), F.lit(1).cast("long").alias("_n"))
    runs = own.where("_n > 0").union(taken).repartition(-(-total // _TASK_SLOTS) or 1)
    each = runs.withColumn("slot", F.explode(F.sequence(F.col("slot"), F.col("slot") + F.col("_n") - 1)))
    turned = each.withColumn("_key", F.xxhash64("no", (F.col("slot") / F.col("n_blocks")).cast("long"))).withColumn("block", F.pmod("slot", "n_blocks"))
    # Cut, or filters on `block` that later joins imply would be pushed below the rounds, each of which copies them.
    return cut(permuted(turned, "block", "n_blocks", "_key", seed).select("no", "slot", "shard", "block"))


def mix(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", source: str = "source", weights: tuple[int, ...] = WEIGHTS, most_repeats: int = 3, block_words: int = BLOCK_WORDS, shard_slots: int = SHARD_SLOTS, seed: int = 17) -> tuple[DataFrame, DataFrame]:
    """Two results.  First: doc_id, size, source_size, target, taken, a row for each of docs.  Second, the mix itself:
    source, shard, slot, block, doc_id, first_word and n_words, the words of each document that the slot reads."""
    rows = docs.select(quoted(doc_id).alias("doc_id"), quoted(source).alias("source"), word_count(quoted(text)).alias("size"))
    counted = rows.groupBy("doc_id", "source", "size").agg(F.count("*").alias("copies")).withColumn("words", F.col("size") * F.col("copies"))
    # Documents in order of source, then of a hash of their id: the source's words end to end.
    placed = cut(running_sum(counted.withColumn("_h", F.xxhash64("doc_id")), [_by(), F.col("_h"), F.col("doc_id"), F.col("size")], "words", "at"))
    sizes = placed.groupBy("source").agg(F.sum("words").alias("source_size"), F.min("at").alias("first_word"))
    aimed = targets(sizes, weights=weights, most_repeats=most_repeats)
    blocks = F.ceil(F.col("source_size") / block_words).cast("long")
    mean = F.col("source_size") / F.col("n_blocks")  # words in a block; the last block may be short
    wanted = F.when(F.col("n_blocks") > 0, F.least(F.round(F.col("target") / mean).cast("long"), most_repeats * F.col("n_blocks"))).otherwise(F.lit(0).cast("long"))
    ready = aimed.withColumn("n_blocks", blocks).withColumn("n_slots", wanted).withColumn("no", F.xxhash64(F.lit(seed), "source"))
    sources = cut(running_sum(ready, [_by()], "n_slots", "first_slot"))
    chosen = slots(sources, shard_slots=shard_slots, seed=seed)

    few = sources.select("no", F.col("source").alias("_s"), "source_size", "target")
    begins = sizes.select(F.col("source").alias("_s"), "first_word")
    named = few.join(begins, few["_s"].eqNullSafe(begins["_s"])).select(few["_s"], "no", "source_size", "target", "first_word")
    if sources.count() <= BROADCAST_SOURCES:
        named = F.broadcast(named)
    held = placed.join(named, placed["source"].eqNullSafe(named["_s"])).drop("_s")
    # Words of each document by the block that holds them; copies follow one another and share the document's row.
    start = F.col("at") - F.col("first_word")
    spans = held.where("size > 0").select("source", "no", "doc_id", "size", "at", start.alias("start"), (start + F.col("words")).alias("end"))
    pieces = (
        spans.withColumn("block", F.explode(F.sequence(F.floor(F.col("start") / block_words), F.floor((F.col("end") - 1) / block_words))))
        .withColumn("_first", F.greatest("start", F.col("block") * block_words))
        .withColumn("n_words", F.least("end", (F.col("block") + 1) * block_words) - F.col("_first"))
        .withColumn("first_word", F.pmod(F.col("_first") - F.col("start"), "size"))
        .select("source", "no", "block", "doc_id", "at", "first_word", "n_words")
    )
    mixed = chosen.join(pieces, ["no", "block"])
    taken = mixed.groupBy("at").agg(F.sum("n_words").alias("_taken"))
    keyed = held.withColumn("_at", F.when(F.col("size") > 0, F.col("at"))).join(taken.withColumnRenamed("at", "_at"), "_at", "left")
    # Copies of a row share what was taken as evenly as whole words allow.
    whole = F.coalesce("_taken", F.lit(0))
    shared = F.floor(whole / F.col("copies")) + F.when(F.col("_copy") <= F.pmod(whole, F.col("copies")), 1).otherwise(0)
    digest = keyed.withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies")))).select("doc_id", "size", "source_size", "target", shared.cast("long").alias("taken"))
    return digest, mixed.select("source", "shard", "slot", "block", "doc_id", "first_word", "n_words")

"""Mixing sources to target weights, with DataFrame functions only.

Each source's documents stand in a fixed pseudorandom order and their words are
packed into blocks of fixed length.  A source gets as many slots as its target
needs.  The number of slots that each output shard has of each source is drawn: a
multinomial draw under the condition that the shards together meet the targets,
made by a pseudorandom permutation of all slots cut into shards.  A shard takes
the source's next so many slots.  Slot j of a source takes the block that a
pseudorandom permutation of the source's block numbers (one per pass over the
source) has at j, and slots and blocks are joined by that number.

Nothing here holds a whole source in one task: offsets come from sums over
hash buckets of documents, slots are made in chunks, blocks are joined by
(source, number).

Cases: a null text has size 0 and is never taken; a null source is a source of
its own, last in the order; repeated rows are documents of their own that lie
next to each other; an empty table gives an empty table; all weights apply to
distinct sources in code-point order.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD_PATTERN, free_prefix, materialize

#: Two-level sums: buckets of about so many rows, groups of so many buckets.
BUCKET_ROWS = 2048
GROUP_BUCKETS = 1024
SLOT_CHUNK = 16_384
#: Rounds of the swap-or-not permutation.
ROUNDS = 10


@dataclass(frozen=True)
class Settings:
    """Production parameters."""

    weights: tuple[int, ...] = (5, 2, 1)
    max_repeat: int = 3
    #: Words in a block; a source with few words has blocks of 1/64 of it.
    block_words: int = 64
    shard_slots: int = 4096


def permuted(x: Column, n: Column, key: Column) -> Column:
    """The place of ``x`` in a pseudorandom permutation of 0 .. n-1 (swap-or-not).

    Each round pairs x with its mirror image under a random point and swaps the
    two or not; both see the same hash, so each round is a permutation.
    """

    def one(at: Column, r: Column) -> Column:
        mirror = F.pmod(F.xxhash64(key, r) - at, n)
        coin = F.xxhash64(key, r, F.greatest(at, mirror)).bitwiseAND(F.lit(1)) == 1
        return F.when(coin, mirror).otherwise(at)

    return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), x.cast("long"), one)


def fingerprint(docs: DataFrame) -> Column:
    """A hash of the whole row, whatever columns it has."""
    first = ("doc_id", "source", "text")
    rest = [f.name for f in docs.schema if f.name not in first and f.dataType.typeName() not in ("map", "variant")]
    return F.xxhash64(*[F.col(f"`{c}`") for c in (*first, *rest)])


def sized(docs: DataFrame) -> DataFrame:
    """One narrow row per document: fingerprint, id, source, source key, size."""
    source = F.col("source").cast("string")
    return docs.select(
        fingerprint(docs).alias("fp"),
        "doc_id",
        source.alias("source"),
        F.coalesce(F.concat(F.lit("s"), source), F.lit("n")).alias("skey"),
        F.coalesce(F.regexp_count(F.col("text"), F.lit(WORD_PATTERN)), F.lit(0)).cast("long").alias("size"),
    )


def source_targets(rows: DataFrame, s: Settings = Settings()) -> DataFrame:
    """Per source: key, size, target, block length, number of blocks, slots, first slot.

    Targets are ``level * weight`` up to ``max_repeat`` times the size; the level
    rises until the targets add up to all sizes.  Only sums over the sources
    come to the driver, and they are integers, so reruns agree to the bit.
    """
    order = Window.orderBy(F.col("source").isNull(), "source")
    sizes = rows.groupBy("skey").agg(F.first("source").alias("source"), F.sum("size").alias("source_size"))
    weight = F.element_at(F.array(*map(F.lit, s.weights)), (F.row_number().over(order) - 1) % len(s.weights) + 1)
    sizes = materialize(sizes.withColumn("weight", weight.cast("long")), "mix-sources")
    cap = F.col("source_size") * s.max_repeat
    total = sizes.agg(F.sum("source_size")).first()[0] or 0
    level, seen = 0.0, -1
    while total:
        capped = F.col("weight") * level > cap
        row = sizes.agg(F.sum(F.when(capped, cap).otherwise(0)).alias("full"), F.sum(F.when(capped, 0).otherwise(F.col("weight"))).alias("open"), F.sum(capped.cast("long")).alias("n")).first()
        if row.n == seen or not row.open:
            break
        seen, level = row.n, (total - row.full) / row.open
    size, block = F.col("source_size"), F.greatest(F.lit(1), F.least(F.lit(s.block_words), F.floor(F.col("source_size") / 64))).cast("long")
    out = sizes.withColumn("target", F.least(F.col("weight") * F.lit(level), cap.cast("double"))).withColumn("block", block)
    out = out.withColumn("blocks", F.ceil(size / F.col("block")).cast("long"))
    slots = F.when(size > 0, F.round(F.col("target") * F.col("blocks") / size)).otherwise(0).cast("long")
    out = out.withColumn("slots", F.least(slots, F.col("blocks") * s.max_repeat))
    before = F.sum("slots").over(order.rowsBetween(Window.unboundedPreceding, -1))
    return materialize(out.withColumn("first_slot", F.coalesce(before, F.lit(0))), "mix-targets")


def with_offsets(rows: DataFrame) -> DataFrame:
    """Adds ``offset``: the words of the source that lie before the document."""
    buckets = max(1, math.ceil(rows.count() / BUCKET_ROWS))
    rows = rows.withColumn("bucket", F.pmod(F.xxhash64(F.lit("mix"), "fp"), F.lit(buckets)))
    sums = rows.groupBy("skey", "bucket").agg(F.sum("size").alias("words")).withColumn("group", F.floor(F.col("bucket") / GROUP_BUCKETS))
    up_to = lambda keys, by: Window.partitionBy(*keys).orderBy(*by).rowsBetween(Window.unboundedPreceding, -1)
    groups = sums.groupBy("skey", "group").agg(F.sum("words").alias("all"))
    groups = groups.select("skey", "group", F.coalesce(F.sum("all").over(up_to(["skey"], ["group"])), F.lit(0)).alias("before_group"))
    sums = sums.withColumn("within", F.coalesce(F.sum("words").over(up_to(["skey", "group"], ["bucket"])), F.lit(0)))
    sums = sums.join(groups, ["skey", "group"]).select("skey", "bucket", (F.col("within") + F.col("before_group")).alias("before"))
    own = F.coalesce(F.sum("size").over(up_to(["skey", "bucket"], ["fp", "doc_id", "size"])), F.lit(0))
    rows = rows.withColumn("own", own).join(sums.hint("merge"), ["skey", "bucket"])
    return rows.withColumn("offset", F.col("own") + F.col("before")).drop("bucket", "own", "before")


def shard_counts(targets: DataFrame, s: Settings = Settings()) -> DataFrame:
    """The draw: (shard, skey, n, first), how many slots a shard has of a source, and the source's first slot among them."""
    total = targets.agg(F.sum("slots")).first()[0] or 0
    chunks = targets.where("slots > 0").select("skey", "slots", "first_slot", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("slots") - 1) / SLOT_CHUNK))).alias("chunk"))
    first = F.col("chunk") * SLOT_CHUNK
    last = F.least(F.col("slots"), first + SLOT_CHUNK) - 1
    drawn = chunks.repartition(_tasks(targets, total), "skey", "chunk").select("skey", "first_slot", F.explode(F.sequence(first, last)).alias("slot"))
    place = permuted(F.col("first_slot") + F.col("slot"), F.lit(max(total, 1)).cast("long"), F.xxhash64(F.lit("shards")))
    counts = drawn.groupBy("skey", F.floor(place / s.shard_slots).alias("shard")).agg(F.count("*").alias("n"))
    # Sums over the shards before, in two levels, so that no source's shards meet in one task.
    counts = materialize(counts.withColumn("group", F.floor(F.col("shard") / GROUP_BUCKETS)), "mix-shards")
    up_to = lambda keys, by: Window.partitionBy(*keys).orderBy(by).rowsBetween(Window.unboundedPreceding, -1)
    groups = counts.groupBy("skey", "group").agg(F.sum("n").alias("all"))
    groups = groups.select("skey", "group", F.coalesce(F.sum("all").over(up_to(["skey"], "group")), F.lit(0)).alias("before"))
    within = F.coalesce(F.sum("n").over(up_to(["skey", "group"], "shard")), F.lit(0))
    return counts.withColumn("within", within).join(groups, ["skey", "group"]).select("shard", "skey", "n", (F.col("within") + F.col("before")).alias("first"))


def _tasks(targets: DataFrame, slots: int) -> int:
    return max(1, min(slots // SLOT_CHUNK, 4 * targets.sparkSession.sparkContext.defaultParallelism, 10_000))


def mix_slots(targets: DataFrame, counts: DataFrame, s: Settings = Settings()) -> DataFrame:
    """One row per slot of the mix, as the shards have drawn them: shard, source key, block number."""
    total = targets.agg(F.sum("slots")).first()[0] or 0
    drawn = counts.repartition(_tasks(targets, total), "skey", "shard").join(targets.select("skey", "blocks"), "skey")
    slots = drawn.select("shard", "skey", "blocks", F.explode(F.sequence(F.col("first"), F.col("first") + F.col("n") - 1)).alias("slot"))
    key = F.xxhash64("skey", F.floor(F.col("slot") / F.col("blocks")))
    return slots.select("shard", "skey", permuted(F.col("slot") % F.col("blocks"), F.col("blocks"), key).alias("number"))


def block_parts(placed: DataFrame, targets: DataFrame, slots: DataFrame) -> DataFrame:
    """Documents cut at block borders, each part with how often its block is taken."""
    wide = placed.join(targets.select("skey", "source_size", "target", "block"), "skey")
    block, offset, end = F.col("block"), F.col("offset"), F.col("offset") + F.col("size")
    parts = wide.where("size > 0").withColumn("number", F.explode(F.sequence(F.floor(offset / block), F.floor((end - 1) / block))))
    start = F.greatest(F.col("number") * block, offset) - offset
    stop = F.least((F.col("number") + 1) * block, end) - offset
    parts = parts.withColumns({"start": start, "stop": stop})
    times = slots.groupBy("skey", "number").agg(F.count("*").alias("times"), F.min("shard").alias("shard"))
    # Compressed sizes say little here, so no side may turn into a broadcast.
    return parts.join(times.hint("merge"), ["skey", "number"], "left").withColumn("times", F.coalesce("times", F.lit(0)))


def mix_counts(docs: DataFrame, s: Settings = Settings()) -> DataFrame:
    """Per row: doc_id, size, source_size, target, taken, first_shard (null: taken by none)."""
    rows = materialize(sized(docs), "mix-sizes")
    targets = source_targets(rows, s)
    parts = block_parts(with_offsets(rows), targets, mix_slots(targets, shard_counts(targets, s), s))
    keys = ["fp", "skey", "offset", "doc_id", "size", "source_size", "target"]
    taken = parts.groupBy(*keys).agg(F.sum((F.col("stop") - F.col("start")) * F.col("times")).alias("taken"), F.min("shard").alias("first_shard"))
    empty = rows.where("size = 0").join(targets.select("skey", "source_size", "target"), "skey")
    columns = ["doc_id", "size", "source_size", "target", "taken", "first_shard"]
    return taken.select(*columns).union(empty.select("doc_id", "size", "source_size", "target", F.lit(0).cast("long"), F.lit(None).cast("long")))


def mix_pieces(docs: DataFrame, s: Settings = Settings()) -> DataFrame:
    """The mix itself, with the columns of ``docs``.

    Each row is a run of neighbouring blocks of one document, as often as it is
    taken; a document that is taken whole is one row with its text unchanged.
    ``n_chars`` follows the text.
    """
    rows = materialize(sized(docs), "mix-sizes")
    targets = source_targets(rows, s)
    parts = block_parts(with_offsets(rows), targets, mix_slots(targets, shard_counts(targets, s), s)).where("times > 0")
    parts = parts.select("fp", "offset", "size", "number", "start", "stop", F.explode(F.sequence(F.lit(1), F.col("times").cast("int"))).alias("copy"))
    run = F.col("number") - F.row_number().over(Window.partitionBy("fp", "offset", "copy").orderBy("number"))
    runs = parts.withColumn("run", run).groupBy("fp", "offset", "size", "copy", "run").agg(F.min("start").alias("start"), F.max("stop").alias("stop"))
    own = free_prefix(docs)
    fp, runs_of = f"{own}fp", f"{own}runs"
    runs = runs.groupBy(F.col("fp").alias(fp)).agg(F.collect_list(F.struct("start", "stop", "size")).alias(runs_of))
    texts = docs.withColumn(fp, fingerprint(docs)).dropDuplicates([fp])
    joined = texts.join(runs.hint("merge"), fp)
    # Cut inside the row, then exploded: neither the text nor its words are repeated for each run.
    words = F.regexp_extract_all(F.col("text"), F.lit(r"[\x20\x09-\x0D]*" + WORD_PATTERN), F.lit(0))
    cut = lambda w, r: F.array_join(F.slice(w, (r["start"] + 1).cast("int"), (r["stop"] - r["start"]).cast("int")), "")
    whole = lambda r: (r["start"] == 0) & (r["stop"] == r["size"])
    pieces = F.transform(F.array(words), lambda w: F.transform(F.col(runs_of), lambda r: F.when(whole(r), F.col("text")).otherwise(cut(w, r))))[0]
    joined = joined.select(*[F.col(f"`{c}`") for c in docs.columns if c != "text"], F.explode(pieces).alias("text"))
    if "n_chars" in docs.columns:
        joined = joined.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return joined.select(*[F.col(f"`{c}`") for c in docs.columns])

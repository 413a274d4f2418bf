"""Mixing sources to target weights.  DataFrame functions only.

Words of each source are packed into fixed-length blocks, document after document within
a hash bucket of documents; the last block of a bucket may be short.
The mix is a number of output shards of equal size.  Each shard draws its source
counts: the whole part of each source's expected count, and a multinomial draw for
the slots that remain, so totals stay near their targets at every size.  A source's
slots are numbered through all shards; slot k takes the block at the pseudorandom
permutation of k modulo the source's number of blocks, so no block is taken again
before all others were, and none more than ``most`` times.

Texts are shuffled once, by bucket: a bucket's blocks are packed where its documents are,
and the slots, which are small, come there.  All running sums (blocks before a bucket,
slots before a shard) have two levels, so no task holds all of a source.

Defined results: a null text has size 0 and takes 0; null is a source of its own,
the last; every input row is a document, also one that repeats a doc_id or has none.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from .scratch import Scratch, setting

WEIGHTS = (5, 2, 1)
MOST = 3
BLOCK = 32
SHARD_SLOTS = 16384
BUCKET_ROWS = 512
ROUNDS = 16
SLOT_BITS = 24  # a shard has fewer slots
TASK_SLOTS = 1 << 17
TASK_WORDS = 1 << 25
GROUP = 4096
BROADCAST_ROWS = 1 << 16


def normalised(docs: DataFrame) -> DataFrame:
    """docs(doc_id, source, text) as doc_id, source, _sid, size and _text, the words with one space between.

    Most texts have single spaces between words, which bytes can tell; only the others meet a regular expression.
    """
    text = F.coalesce("text", F.lit(""))
    for space in "\t\n\x0b\x0c\r":
        text = F.replace(text, F.lit(space), F.lit(" "))
    sid = F.xxhash64(F.col("source").isNull(), "source")
    out = docs.select("doc_id", "source", sid.alias("_sid"), F.btrim(text).alias("_flat")).withColumn("_plain", F.instr("_flat", "  ") == 0)
    out = out.withColumn("_text", F.when(F.col("_plain"), F.col("_flat")).otherwise(F.regexp_replace("_flat", " +", " ")))
    words = F.octet_length("_text") - F.octet_length(F.replace("_text", F.lit(" "), F.lit(""))) + 1
    return out.select("doc_id", "source", "_sid", F.when(F.col("_text") == "", 0).otherwise(words).cast("long").alias("size"), "_text")


def running_sum(df: DataFrame, key: str, order: str, value: str, name: str, group: int = GROUP) -> DataFrame:
    """df with the sum of ``value`` over all smaller ``order`` (an integer) of the key: sums of groups of the order, then sums within one."""
    df = df.withColumn("_g", F.floor(F.col(order) / group))
    before = Window.partitionBy(key).orderBy("_g").rowsBetween(Window.unboundedPreceding, -1)
    groups = df.groupBy(key, "_g").agg(F.sum(value).alias("_total"))
    groups = groups.select(F.col(key).alias("_k1"), F.col("_g").alias("_g1"), F.coalesce(F.sum("_total").over(before), F.lit(0)).alias("_earlier"))
    within = Window.partitionBy(key, "_g").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    df = df.withColumn("_inner", F.coalesce(F.sum(value).over(within), F.lit(0)))
    out = df.join(groups, (F.col(key) == F.col("_k1")) & (F.col("_g") == F.col("_g1")))
    return out.withColumn(name, F.col("_earlier") + F.col("_inner")).drop("_g", "_g1", "_k1", "_earlier", "_inner")


def source_targets(sizes: DataFrame, weights=WEIGHTS, most: int = MOST) -> DataFrame:
    """source, source_size, target.  Water filling: with the sources in order of cap / weight, the level
    that remains after the first k are capped is largest at the fixed point."""
    w = F.array(*[F.lit(float(x)) for x in weights])
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    ranked = per.withColumn("_n", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1)
    ranked = ranked.withColumn("_w", F.element_at(w, (F.col("_n") % len(weights) + 1).cast("int")))
    ranked = ranked.withColumn("_cap", F.col("source_size").cast("double") * most)
    before = Window.orderBy(F.col("_cap") / F.col("_w"), "_n").rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    level = (F.sum("source_size").over(everything) - F.coalesce(F.sum("_cap").over(before), F.lit(0.0))) / (
        F.sum("_w").over(everything) - F.coalesce(F.sum("_w").over(before), F.lit(0.0))
    )
    ranked = ranked.withColumn("_level", level).withColumn("_level", F.max("_level").over(everything))
    return ranked.select("source", "source_size", F.least("_cap", F.col("_level") * F.col("_w")).alias("target"))


def round_keys(n: Column, *salt: Column, rounds: int = ROUNDS) -> Column:
    return F.transform(F.sequence(F.lit(1), F.lit(rounds)), lambda r: F.pmod(F.xxhash64(r, *salt), n))


def permuted(x: Column, n: Column, keys: Column) -> Column:
    """Swap-or-not shuffle of 0..n-1: a keyed permutation for any n, from hashes alone.  The keys of the rounds are made once for many x."""

    def swap(acc, key):
        other = F.pmod(key - acc, n)
        return F.when(F.xxhash64(F.greatest(acc, other), key) % 2 == 0, other).otherwise(acc)

    return F.aggregate(keys, x, swap)


def build_mix(
    docs: DataFrame, weights=WEIGHTS, most: int = MOST, block: int = BLOCK, shard_slots: int = SHARD_SLOTS, seed: int = 1
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The written mix: shard, slot, source, text, _rns and _ns (rows and words that each block has), _sid, _b, _k (block in the
    bucket); the rows of docs by _sid, _b, _rn with doc_id, source, size, source_size, target; the blocks before each bucket."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "mix")
    docs = normalised(docs.select("doc_id", "source", "text")).withColumn("_h", F.xxhash64("_text"))
    sizes = scratch.save(docs.drop("_text"), "sizes")
    targets = source_targets(sizes, weights, most).withColumn("_sid", F.xxhash64(F.col("source").isNull(), "source"))
    total = sizes.agg(F.count("*").alias("n"), F.coalesce(F.sum("size"), F.lit(0)).alias("t")).first()
    shards = max(1, -(-total["t"] // (block * shard_slots)))
    buckets = max(1, -(-total["n"] // BUCKET_ROWS))
    # Never null, which the optimiser must see: else it would filter on this, and on all it is made of, once more.
    bucket = F.coalesce(F.pmod(F.xxhash64("doc_id", "_h"), F.lit(buckets)), F.lit(0)).alias("_b")

    # Blocks of each bucket, and how many of its source come before.
    sums = sizes.select("_sid", bucket, "size").groupBy("_sid", "_b").agg(F.ceil(F.sum("size") / block).alias("_n"))
    sums = scratch.save(running_sum(sums.where("_n > 0"), "_sid", "_b", "_n", "_from"), "buckets")
    own = sums.groupBy(F.col("_sid").alias("_s2")).agg(F.sum("_n").alias("_blocks"))
    targets = targets.join(own, F.col("_sid") == F.col("_s2"), "left").drop("_s2").fillna(0, ["_blocks"])
    targets = targets.withColumn("_src", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())))
    targets = scratch.save(targets, "targets")

    # Source counts of each shard, by the mean length of a source's blocks.
    whole = Window.partitionBy()
    upto = Window.orderBy("_src")
    plan = targets.withColumn("_e", F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size") * F.col("_blocks") / shards).otherwise(0.0))
    plan = plan.withColumn("_base", F.floor("_e"))
    plan = plan.withColumn("_f", F.col("_e") - F.col("_base"))
    plan = plan.withColumn("_hi", F.sum("_f").over(upto.rowsBetween(Window.unboundedPreceding, 0)))
    plan = plan.withColumn("_lo", F.coalesce(F.lag("_hi").over(upto), F.lit(0.0)))
    plan = plan.withColumn("_all", F.max("_hi").over(whole)).withColumn("_rest", F.round("_all").cast("int"))
    plan = plan.select("*", F.explode(F.sequence(F.lit(0), F.lit((shards - 1) // GROUP))).alias("_part")).repartition("_sid", "_part")
    last = F.least(F.col("_part") * GROUP + GROUP, F.lit(shards)) - 1
    shard = plan.select("*", F.explode(F.sequence(F.col("_part") * GROUP, last)).alias("_shard"))

    def drawn(k):
        u = F.pmod(F.xxhash64(F.lit(seed), F.col("_shard"), k), F.lit(1 << 40)) / F.lit(float(1 << 40)) * F.col("_all")
        return (u >= F.col("_lo")) & (u < F.col("_hi"))

    rest = F.when(F.col("_rest") > 0, F.size(F.filter(F.sequence(F.lit(1), F.greatest("_rest", F.lit(1))), drawn))).otherwise(0)
    shard = running_sum(shard.withColumn("_count", F.col("_base") + rest), "_sid", "_shard", "_count", "_first")
    # No block more than ``most`` times; what is left of a shard's sources lies side by side, then is permuted.
    shard = shard.withColumn("_count", F.greatest(F.lit(0), F.least("_count", F.col("_blocks") * most - F.col("_first"))))
    of_shard = Window.partitionBy("_shard")
    before = of_shard.orderBy("_src").rowsBetween(Window.unboundedPreceding, -1)
    shard = shard.withColumn("_at", F.coalesce(F.sum("_count").over(before), F.lit(0))).withColumn("_all", F.sum("_count").over(of_shard))
    shard = scratch.save(shard.select("_sid", "source", "_shard", "_blocks", "_all", "_at", "_first", "_count"), "shards")

    # Slots, each with the block it takes.  A few shard rows make all slots, so they are dealt out by the number of slots.
    tasks = max(1, -(-total["t"] // (block * TASK_SLOTS)))
    slots = shard.where("_count > 0 and _blocks > 0").withColumn("_keys", round_keys(F.col("_blocks"), F.lit(seed), F.col("_sid")))
    slots = slots.repartition(tasks, "_shard").select("*", F.explode(F.sequence(F.lit(0), F.col("_count") - 1)).alias("_i"))
    shuffled = Window.partitionBy("_shard").orderBy(F.xxhash64(F.lit(seed), "_shard", "_sid", "_i"), "_sid", "_i")
    slots = slots.select(
        F.col("_sid").alias("_s1"),
        F.shiftleft("_shard", SLOT_BITS).bitwiseOR(F.row_number().over(shuffled).cast("long") - 1).alias("_place"),
        permuted((F.col("_first") + F.col("_i")) % F.col("_blocks"), F.col("_blocks"), F.col("_keys")).alias("block"),
    )
    # The bucket of a block: buckets stand in all cells of block numbers that they reach into, so each slot meets a few.
    cell = max(1, total["t"] // (block * buckets))
    cells = F.explode(F.sequence(F.floor(F.col("_from") / cell), F.floor((F.col("_from") + F.col("_n") - 1) / cell))).alias("_cell")
    cells = sums.select(F.col("_sid").alias("_s2"), F.col("_b").alias("_b2"), "_from", "_n", cells)
    held = (F.col("_s1") == F.col("_s2")) & (F.floor(F.col("block") / cell) == F.col("_cell")) & (F.col("block") >= F.col("_from")) & (F.col("block") < F.col("_from") + F.col("_n"))
    # Buckets go to all tasks while they are few; the estimate of the slots' size says nothing, so else they are merged.
    cells = F.broadcast(cells) if sums.count() <= BROADCAST_ROWS else cells.hint("merge")
    slots = slots.join(cells, held).select("_s2", "_b2", (F.col("block") - F.col("_from")).alias("_k2"), "_place")

    # Documents in their places in a bucket, cut at the ends of blocks.
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total["t"] // TASK_WORDS))
    order = Window.partitionBy("_sid", "_b").orderBy("doc_id", "size", "_h")
    start = F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, 0)) - F.col("size")
    placed = docs.select("_sid", bucket, "source", "doc_id", "size", "_h", "_text").repartition(tasks, "_sid", "_b")
    placed = placed.withColumn("_rn", F.row_number().over(order)).withColumn("_start", start).where("size > 0")
    first, last = F.floor(F.col("_start") / block), F.floor((F.col("_start") + F.col("size") - 1) / block)

    def piece(words, k):
        lo = F.greatest(k * block - F.col("_start"), F.lit(0))
        hi = F.least((k + 1) * block - F.col("_start"), F.col("size"))
        text = F.array_join(F.slice(words, (lo + 1).cast("int"), (hi - lo).cast("int")), " ")
        return F.struct(k.alias("_k"), (F.col("_start") + lo).alias("_at"), (hi - lo).alias("n"), text.alias("text"))

    # The outer lambda binds the words, so that a text is split once and not for every block.
    made = F.transform(F.array(F.split("_text", " ")), lambda words: F.transform(F.sequence(first, last), lambda k: piece(words, k)))[0]
    pieces = placed.select("_sid", "_b", "source", "_rn", F.explode(made).alias("p"))
    pieces = pieces.select("_sid", "_b", "source", F.col("p._k").alias("_k"), F.struct("p._at", "_rn", "p.n", "p.text").alias("p"))
    packed = pieces.groupBy("_sid", "_b", "_k", "source").agg(F.array_sort(F.collect_list("p")).alias("p"))

    # Blocks joined by index into the shards, where they were packed: both sides are dealt by bucket alike.
    slots = slots.repartition(tasks, "_s2", "_b2").hint("merge")
    mixed = packed.join(slots, (F.col("_sid") == F.col("_s2")) & (F.col("_b") == F.col("_b2")) & (F.col("_k") == F.col("_k2"))).select(
        F.shiftright("_place", SLOT_BITS).alias("shard"),
        F.col("_place").bitwiseAND((1 << SLOT_BITS) - 1).alias("slot"),
        "source",
        F.array_join(F.col("p.text"), " ").alias("text"),
        F.col("p._rn").alias("_rns"),
        F.col("p.n").alias("_ns"),
        "_sid",
        "_b",
        "_k",
    )
    with setting(spark, "spark.sql.requireAllClusterKeysForCoPartition", "false"):  # dealt by bucket is enough for a join by bucket and block
        mixed = scratch.save(mixed, "mixed", "zstd")
    first = sums.select(F.col("_sid").alias("_s2"), F.col("_b").alias("_b2"), "_from")
    rows = sizes.select("doc_id", "size", "_h", "_sid", bucket).withColumn("_rn", F.row_number().over(order))
    rows = rows.join(targets.select("_sid", "source", "source_size", "target"), "_sid")
    return mixed, rows, first


def mixed_blocks(docs: DataFrame, *args, **kwargs) -> DataFrame:
    """shard, slot, source, block, text: the mix itself, one row for each slot of each shard."""
    mixed, _, first = build_mix(docs, *args, **kwargs)
    mixed = mixed.join(first, (F.col("_sid") == F.col("_s2")) & (F.col("_b") == F.col("_b2")))
    return mixed.select("shard", "slot", "source", (F.col("_from") + F.col("_k")).alias("block"), "text")


def mix_sources(
    docs: DataFrame, weights=WEIGHTS, most: int = MOST, block: int = BLOCK, shard_slots: int = SHARD_SLOTS, seed: int = 1
) -> DataFrame:
    """doc_id, source, size, source_size, target, taken: one row for each row of docs(doc_id, text, source).
    ``taken`` is counted in the written mix."""
    mixed, rows, _ = build_mix(docs, weights, most, block, shard_slots, seed)
    taken = mixed.select("_sid", "_b", F.explode(F.arrays_zip(F.col("_rns").alias("_rn"), F.col("_ns").alias("n"))).alias("p"))
    taken = taken.groupBy("_sid", "_b", F.col("p._rn").alias("_rn")).agg(F.sum("p.n").alias("_taken"))
    return rows.join(taken, ["_sid", "_b", "_rn"], "left").select(
        "doc_id", "source", "size", "source_size", "target", F.coalesce("_taken", F.lit(0)).cast("long").alias("taken")
    )

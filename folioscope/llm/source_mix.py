"""Operator 9 (native): mixing sources to target weights.

The words of each source form one stream, packed into blocks of a fixed number of words.  Each output
shard holds a fixed number of slots; the source of each slot is a draw by target weight (an alias
table makes it an equi-join), so a shard's counts are multinomial.  Slots beyond a source's quota go
to the sources that the draw left short, which keeps every source at its target.  Slot k of a source
takes block ``permutation(k)``: a swap-or-not shuffle of the block indices, a new one for each pass, so
that no block is taken more than once in a pass.  Blocks are joined by index.

All steps are DataFrame functions.  The prefix sums that give each document its place in its source, and
each shard its first slot, are taken in two levels over buckets whose number follows the rows, so one
source may hold most of them; slots are dealt out by shard before they are unrolled.

Defined results: a null text has size 0 and nothing is taken from it; a null source is a source of its
own, ordered last; repeated rows are documents of their own, placed side by side; rows that share an id
are ordered by a hash of the row; a very long text lies in many blocks, each joined by itself; an empty
table gives an empty table; the columns of the input are only read by name or whole, so other columns
cannot clash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from folioscope.llm._common import checkpoint, conf_int, table, text_column

BLOCK = 64
SHARD = 4096
#: Rows in a bucket of a prefix sum, and slots or copies unrolled by a task, about.
BUCKET, UNROLL = 4_000, 500_000
ROUNDS = 12
WEIGHTS = (3, 1, 2)


def n_words(text: Column) -> Column:
    """Number of words ``[^\\x20\\x09-\\x0D]+``."""
    blanks = F.translate(text, "\t\n\x0b\x0c\r", "     ")
    return F.size(F.array_remove(F.split(blanks, " "), "")).cast("long")


def targets(sizes: DataFrame, weights=WEIGHTS, share: float = 1.5, most: float = 2.0) -> DataFrame:
    """source, position, weight, source_size and target: shares of ``share`` times all words by weight, none above ``most`` times its source.

    Sharing the excess again and again by weight ends at one water level: target = min(limit, level * weight).
    """
    own = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    everything = W.orderBy("ratio", "position").rowsBetween(W.unboundedPreceding, -1)
    whole = W.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    place = F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())) - 1
    return (
        own.withColumn("position", place)
        .withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), F.pmod("position", F.lit(len(weights))).cast("int") + 1).cast("double"))
        .withColumn("limit", F.col("source_size") * F.lit(float(most)))
        .withColumn("ratio", F.col("limit") / F.col("weight"))
        .withColumn("level", (F.sum("source_size").over(whole) * F.lit(float(share)) - F.coalesce(F.sum("limit").over(everything), F.lit(0.0))) / (F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(everything), F.lit(0.0))))
        .withColumn("level", F.max("level").over(whole))
        .select("source", "position", "weight", "source_size", F.least("limit", F.col("level") * F.col("weight")).alias("target"))
    )


def quotas(aims: DataFrame, block: int) -> DataFrame:
    """Blocks of each source and the slots that bring it to its target."""
    blocks = F.ceil(F.col("source_size") / block)
    return (
        aims.where(F.col("source_size") > 0)
        .withColumn("n_blocks", blocks)
        .withColumn("quota", F.least(2 * F.col("n_blocks"), F.floor(F.col("target") * F.col("n_blocks") / F.col("source_size") + 0.5)).cast("long"))
    )


def _alias(rows: list) -> list[tuple[int, float, int]]:
    """Alias table: (column, chance of its own position, other position) for (position, quota) rows."""
    total, n = sum(q for _, q in rows), len(rows)
    level = [q * n / total for _, q in rows]
    small, large = [i for i in range(n) if level[i] < 1], [i for i in range(n) if level[i] >= 1]
    out = [(1.0, i) for i in range(n)]
    while small and large:
        a, b = small.pop(), large[-1]
        out[a] = (level[a], b)
        level[b] -= 1 - level[a]
        if level[b] < 1:
            small.append(large.pop())
    return [(i, rows[i][0], p, rows[b][0]) for i, (p, b) in enumerate(out)]


def _uniform(*parts: Column) -> Column:
    return F.pmod(F.xxhash64(*parts), F.lit(1 << 53)) / float(1 << 53)


def permuted(index: Column, n: Column, *key: Column) -> Column:
    """A pseudorandom permutation of 0..n-1 for each key: a swap-or-not shuffle."""

    def swap(x: Column, r: Column) -> Column:
        partner = F.pmod(F.xxhash64(*key, r) - x, n)
        return F.when(F.pmod(F.xxhash64(F.greatest(x, partner), r, *key), F.lit(2)) == 1, partner).otherwise(x)

    return F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), index.cast("long"), swap)


def mix_plan(quota: DataFrame, block: int = BLOCK, shard: int = SHARD, seed: int = 7) -> DataFrame:
    """shard, position (of the source), slot and block of every slot of the mix.  ``quota`` is small: one row for each source."""
    spark = quota.sparkSession
    rows = [(r["position"], r["quota"]) for r in quota.select("position", "quota").where("quota > 0").orderBy("position").collect()]
    total = sum(q for _, q in rows)
    if not total:
        return spark.createDataFrame([], "shard long, position int, slot long, block long")
    alias = F.broadcast(spark.createDataFrame(_alias(rows), "_column long, _own int, _chance double, _other int"))
    drawn = (
        spark.range(total)
        .select((F.col("id") / shard).cast("long").alias("shard"), F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(len(rows))).alias("_column"), _uniform(F.col("id"), F.lit(seed + 1)).alias("_u"))
        .join(alias, "_column")
        .select("shard", F.when(F.col("_u") < F.col("_chance"), F.col("_own")).otherwise(F.col("_other")).alias("position"))
        .groupBy("shard", "position")
        .count()
    )
    # Shards' first slots: sums over runs of shards, and inside each run.
    inner = W.partitionBy("position", "_run").orderBy("shard").rowsBetween(W.unboundedPreceding, -1)
    outer = W.partitionBy("position").orderBy("_run").rowsBetween(W.unboundedPreceding, -1)
    drawn = drawn.withColumn("_run", F.floor(F.col("shard") / BUCKET))
    runs = drawn.groupBy("position", "_run").agg(F.sum("count").alias("_size")).select("position", "_run", F.coalesce(F.sum("_size").over(outer), F.lit(0)).alias("_first"))
    small = F.broadcast(quota.select("position", "quota", "n_blocks"))
    counts = drawn.join(runs, ["position", "_run"]).withColumn("_base", F.col("_first") + F.coalesce(F.sum("count").over(inner), F.lit(0)))
    dealt = counts.select("shard", "position", "_base", "count").repartition(spread(spark, total), "shard", "position")
    slots = dealt.select("shard", "position", F.explode(F.sequence(F.col("_base"), F.col("_base") + F.col("count") - 1)).alias("slot")).join(small.drop("n_blocks"), "position")
    got = quota.select("position", "quota").join(drawn.groupBy("position").agg(F.sum("count").alias("_drawn")), "position", "left").fillna(0, ["_drawn"])
    order = W.orderBy("position").rowsBetween(W.unboundedPreceding, -1)
    over = got.select("position", F.coalesce(F.sum(F.greatest(F.lit(0), F.col("_drawn") - F.col("quota"))).over(order), F.lit(0)).alias("_before"))
    under = (
        got.withColumn("_short", F.greatest(F.lit(0), F.col("quota") - F.col("_drawn")))
        .withColumn("_before", F.coalesce(F.sum("_short").over(order), F.lit(0)))
        .where("_short > 0")
        .select(F.col("position").alias("_to"), "_before", "_drawn", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_short") - 1)).alias("_i"))
        .select((F.col("_before") + F.col("_i")).alias("_e"), "_to", (F.col("_drawn") + F.col("_i")).alias("_slot"))
    )
    kept = slots.where("slot < quota").select("shard", "position", "slot")
    moved = (
        slots.where("slot >= quota")
        .join(F.broadcast(over), "position")
        .select("shard", (F.col("_before") + F.col("slot") - F.col("quota")).alias("_e"))
        .join(under, "_e")
        .select("shard", F.col("_to").alias("position"), F.col("_slot").alias("slot"))
    )
    turn = F.floor(F.col("slot") / F.col("n_blocks"))
    return kept.unionByName(moved).join(small.drop("quota"), "position").select("shard", "position", "slot", permuted(F.pmod("slot", "n_blocks"), F.col("n_blocks"), F.col("position"), turn, F.lit(seed)).alias("block"))


def spread(spark: SparkSession, rows: int) -> int:
    """Partitions for an unrolling to ``rows`` rows."""
    return max(conf_int(spark, "spark.sql.shuffle.partitions", 200), -(-int(rows) // UNROLL))


def placed(docs: DataFrame, aims: DataFrame, n_rows: int) -> DataFrame:
    """Distinct rows (doc_id, source, size, h) with ``copies``, their source's row and ``start``, the words of their source before the first copy."""
    buckets = max(1, -(-n_rows // BUCKET))
    kinds = docs.groupBy("doc_id", "source", "size", "h").agg(F.count("*").alias("copies")).withColumn("_words", F.col("size") * F.col("copies"))
    known = kinds.withColumn("_bucket", F.pmod(F.xxhash64("doc_id", "h"), F.lit(buckets)).cast("int")).join(F.broadcast(aims), kinds["source"].eqNullSafe(aims["source"]), "left").drop(aims["source"])
    inner = W.partitionBy("position", "_bucket").orderBy("doc_id", "h", "size").rowsBetween(W.unboundedPreceding, -1)
    outer = W.partitionBy("position").orderBy("_bucket").rowsBetween(W.unboundedPreceding, -1)
    sums = known.groupBy("position", "_bucket").agg(F.sum("_words").alias("_size")).select("position", "_bucket", F.coalesce(F.sum("_size").over(outer), F.lit(0)).alias("_base"))
    return known.withColumn("_in", F.coalesce(F.sum("_words").over(inner), F.lit(0))).join(sums, ["position", "_bucket"]).withColumn("start", F.col("_base") + F.col("_in")).drop("_base", "_in", "_bucket", "_words")


def copies_apart(rows: DataFrame, n_rows: int) -> DataFrame:
    """One row for each copy, each with its own ``start``; many copies of one row are unrolled by many tasks."""
    step = BUCKET
    chunks = rows.withColumn("_from", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("copies") - 1) / step)))).withColumn("_from", F.col("_from") * step)
    dealt = chunks.repartition(spread(rows.sparkSession, n_rows), "position", "start", "_from")
    return dealt.withColumn("_copy", F.explode(F.sequence(F.col("_from"), F.least(F.col("copies"), F.col("_from") + step) - 1))).withColumn("start", F.col("start") + F.col("_copy") * F.col("size")).drop("_from", "_copy", "copies")


def row_hash(docs: DataFrame) -> Column:
    """A hash of all columns but those that hold a map, which have no hash."""
    return F.xxhash64(*(F.col(f"`{f.name}`") for f in docs.schema.fields if "map<" not in f.dataType.simpleString() and f.dataType.simpleString() != "variant"))


def _drawn(docs: DataFrame, id_col: str, text_col: str, source_col: str, weights, share: float, block: int, seed: int, h: Column) -> tuple[DataFrame, DataFrame, int]:
    """Distinct rows in their places, draws of each block (position, block, _times), and the number of rows."""
    sized = checkpoint(docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).cast("string").alias("source"), n_words(text_column(text_col)).alias("size"), h.alias("h")))
    n_rows = sized.count()
    aims = checkpoint(targets(sized, weights, share))
    quota = quotas(aims, block)
    times = mix_plan(quota, block, seed=seed).groupBy("position", "block").agg(F.count("*").alias("_times"))
    return placed(sized, aims.select("source", "position", "source_size", "target"), n_rows), times, n_rows


def mix_sources(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights=WEIGHTS, share: float = 1.5, block: int = BLOCK, seed: int = 7) -> DataFrame:
    """doc_id, size, source_size, target and taken of every document."""
    kinds, times, n_rows = _drawn(docs, id_col, text_col, source_col, weights, share, block, seed, F.xxhash64(id_col, text_col, source_col))
    rows = copies_apart(kinds, n_rows)
    full = rows.where("size > 0")
    first, last = F.floor(F.col("start") / block), F.floor((F.col("start") + F.col("size") - 1) / block)
    pieces = full.withColumn("block", F.explode(F.sequence(first, last))).withColumn(
        "_words", F.least((F.col("block") + 1) * block, F.col("start") + F.col("size")) - F.greatest(F.col("block") * block, F.col("start"))
    )
    taken = (
        pieces.join(times, ["position", "block"], "left")
        .groupBy("position", "start", "doc_id", "size", "source_size", "target")
        .agg(F.sum(F.col("_words") * F.coalesce("_times", F.lit(0))).cast("long").alias("taken"))
        .select("doc_id", "size", "source_size", "target", "taken")
    )
    empty = rows.where("size = 0").select("doc_id", "size", "source_size", "target", F.lit(0).cast("long").alias("taken"))
    return taken.unionByName(empty).withColumnRenamed("doc_id", id_col)


def mixed_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights=WEIGHTS, share: float = 1.5, block: int = BLOCK, seed: int = 7) -> DataFrame:
    """The rows of ``docs``, all columns, as often as the mix draws the block in which they start.

    Rows without a word start no block and are left out, as nothing can be taken from them.
    """
    kinds, times, n_rows = _drawn(docs, id_col, text_col, source_col, weights, share, block, seed, row_hash(docs))
    rows = copies_apart(kinds.where("size > 0"), n_rows).withColumn("block", F.floor(F.col("start") / block))
    drawn = rows.join(times, ["position", "block"]).groupBy("doc_id", "h").agg(F.sum("_times").alias("times"), F.count("*").alias("copies")).select(F.struct("doc_id", "h").alias("k"), "times", "copies")
    whole = docs.select(F.struct("*").alias("row"), F.struct(F.col(id_col).alias("doc_id"), row_hash(docs).alias("h")).alias("k"))
    found = whole.alias("w").join(drawn.alias("d"), F.col("w.k").eqNullSafe(F.col("d.k"))).select("row", "w.k", "times", "copies")
    # Copies of one row are drawn together: one of them stands for all.
    once = found.where("copies = 1").unionByName(found.where("copies > 1").dropDuplicates(["k"]))
    return once.select("row", F.explode(F.sequence(F.lit(1).cast("long"), F.col("times"))).alias("_")).select("row.*")


def op9_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(table(spark, sf_dir, "documents"))

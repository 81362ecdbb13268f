"""Registries without a lakehouse: keyed merges, asset and publication plans, quality gates, incremental work."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def merged(target: DataFrame, source: DataFrame, keys: list[str], preserve: tuple[str, ...] = ()) -> DataFrame:
    """Upsert by keys: source rows replace target rows, but keep the target's ``preserve`` columns where it has them."""
    old = target.select(*keys, *(F.col(c).alias(f"_old_{c}") for c in preserve))
    fresh = source.join(old, keys, "left").select(*[F.coalesce(f"_old_{c}", c).alias(c) if c in preserve else F.col(c) for c in target.columns])
    return target.join(source.select(*keys), keys, "left_anti").select(*target.columns).unionByName(fresh)


def cache_key(model: Column, text: Column) -> Column:
    """sha-256 of model, a zero byte and the text."""
    return F.sha2(F.concat(model, F.lit("\x00"), text), 256)


def cache_misses(items: DataFrame, cache: DataFrame, key: str = "k") -> DataFrame:
    """One row for each key that the cache lacks."""
    return items.join(cache.select(key), key, "left_anti").groupBy(key).agg(F.count("*").alias("n_uses"))


def changed(current: DataFrame, processed: DataFrame, key: str, digest: str) -> DataFrame:
    """Rows to process again: new keys or another digest."""
    return current.join(processed.select(key, digest), [key, digest], "left_anti")


def upload_plan(local: DataFrame, remote: DataFrame) -> DataFrame:
    """(key, action): skip what is there with the same size, upload the rest."""
    there = remote.select("key", F.col("size").alias("_size"))
    return local.join(there, "key", "left").select("key", F.when(F.col("_size") == F.col("size"), "skip").otherwise("upload").alias("action"))


def prune_plan(local: DataFrame, remote: DataFrame) -> DataFrame:
    return remote.select("key").exceptAll(local.select("key")).distinct()


def versions(keys: DataFrame) -> DataFrame:
    """Distinct second path components that start with v."""
    return keys.select(F.split_part("key", F.lit("/"), F.lit(2)).alias("version")).where("version LIKE 'v%'").distinct()


def with_budget(requests: DataFrame, order: list[str], budget: int, group: str | None = None) -> DataFrame:
    """Whether each request is inside a budget that is spent in the given order."""
    window = (W.partitionBy(group) if group else W.partitionBy(F.lit(1))).orderBy(*order)
    return requests.withColumn("granted", F.row_number().over(window) <= budget)


def human_size(size: Column) -> Column:
    return F.when(size >= 1 << 20, F.concat(F.floor(size / (1 << 20)).cast("string"), F.lit(" MB"))).when(size >= 1 << 10, F.concat(F.floor(size / (1 << 10)).cast("string"), F.lit(" KB"))).otherwise(F.concat(size.cast("string"), F.lit(" B")))


def publish(df: DataFrame, root: str, version: str, gates: DataFrame) -> str:
    """Write an immutable version, and the pointer to it last, only if every gate is open.  Returns the version's path."""
    spark = df.sparkSession
    closed = gates.where(~F.col("ok")).count()
    if closed:
        raise ValueError(f"{closed} gates are closed")
    path = f"{root}/{version}"
    df.write.mode("errorifexists").parquet(path)
    # Pointers are only ever added, so there is one at all times; the newest holds.
    pointer = spark.createDataFrame([(version, path)], "version string, path string").withColumn("at", F.current_timestamp())
    pointer.coalesce(1).write.mode("append").json(f"{root}/pointers")
    return path


def published(spark: SparkSession, root: str) -> DataFrame:
    """The version that the newest pointer names."""
    newest = spark.read.schema("version string, path string, at timestamp").json(f"{root}/pointers").orderBy(F.col("at").desc(), F.col("version").desc()).first()
    return spark.read.parquet(newest["path"])


def replace_source(df: DataFrame, path: str, by: str = "source") -> None:
    """Replace the partitions that ``df`` has rows for, and only those."""
    df.write.option("partitionOverwriteMode", "dynamic").mode("overwrite").partitionBy(by).parquet(path)

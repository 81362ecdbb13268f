"""Keyed tables on plain files: an append-only log of merges with numbered snapshots, and published versions.

A table is a folder of parts and of snapshots.  A write adds a part, then a snapshot that lists the parts it
consists of.  Snapshots are numbered and never overwritten: of two writers that took the same number, the file
store lets one create the name and the other tries again on top of it.  A reader takes the snapshot with the
highest number, so it sees one state whole, however a writer fares.  Compaction is a snapshot of one new part.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscope.operators.registry import cache_key

#: Parts from which a write compacts the table first; tries of a writer that others overtake.
PARTS, TRIES = 16, 20


class Files:
    """The few calls of Hadoop's file systems that snapshots need."""

    def __init__(self, spark: SparkSession, root: str):
        self.path = spark._jvm.org.apache.hadoop.fs.Path
        self.fs = self.path(root).getFileSystem(spark._jsc.hadoopConfiguration())

    def names(self, folder: str) -> list[str]:
        where = self.path(folder)
        return sorted(s.getPath().getName() for s in self.fs.listStatus(where)) if self.fs.exists(where) else []

    def create(self, file: str, text: str) -> bool:
        """Whether the file could be created with this text: written aside and renamed, which fails if the name is taken."""
        where, aside = self.path(file), self.path(f"{file}.{uuid.uuid4().hex}.tmp")
        out = self.fs.create(aside, False)
        out.write(bytearray(text.encode()))
        out.close()
        done = not self.fs.exists(where) and self.fs.rename(aside, where)
        if not done:
            self.fs.delete(aside, False)
        return done

    def read(self, file: str) -> str:
        stream = self.fs.open(self.path(file))
        try:
            return bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()

    def drop(self, folder: str) -> None:
        self.fs.delete(self.path(folder), True)


class KeyedLog:
    """A table with a key, stored at ``root``; of several rows of a key the one merged last holds."""

    def __init__(self, spark: SparkSession, root: str, keys: list[str], schema: str):
        self.spark, self.root, self.keys, self.schema = spark, root.rstrip("/"), keys, schema
        self.files = Files(spark, self.root)

    def _numbers(self) -> list[int]:
        return sorted(int(n.split(".")[0]) for n in self.files.names(f"{self.root}/snapshots") if n.endswith(".json"))

    def snapshot(self, number: int | None = None) -> dict:
        """number and parts of the newest snapshot, or of the one asked for; an empty one if there is none yet."""
        if number is None:
            numbers = self._numbers()
            if not numbers:
                return {"number": 0, "parts": []}
            number = numbers[-1]
        return json.loads(self.files.read(f"{self.root}/snapshots/{number:012d}.json"))

    def read(self, number: int | None = None) -> DataFrame:
        """The table at a snapshot, the newest if none is named; empty before the first write."""
        return self._state(self.snapshot(number)["parts"])

    def _state(self, parts: list[str]) -> DataFrame:
        out = self.spark.createDataFrame([], self.schema)
        if not parts:
            return out
        rows = [self.spark.read.schema(out.schema).parquet(f"{self.root}/parts/{p}").withColumn("_part", F.lit(i)) for i, p in enumerate(parts)]
        every = rows[0]
        for r in rows[1:]:
            every = every.unionByName(r)
        if len(parts) == 1:
            return every.drop("_part")
        last = every.groupBy(*self.keys).agg(F.max_by(F.struct(*out.columns), "_part").alias("r"))
        return last.select("r.*").select(*out.columns)

    def _written(self, rows: DataFrame) -> str:
        name = f"part-{uuid.uuid4().hex}"
        rows.write.parquet(f"{self.root}/parts/{name}")
        return name

    def merge(self, rows: DataFrame) -> int:
        """Insert or replace by key; of repeated keys in ``rows`` one row, the greatest, counts.  The number of the new snapshot."""
        columns = self.spark.createDataFrame([], self.schema).columns
        one = rows.select(*columns).groupBy(*self.keys).agg(F.max(F.struct(*columns)).alias("r")).select("r.*")
        return self._added([self._written(one)])

    def _added(self, names: list[str]) -> int:
        for _ in range(TRIES):
            now = self.snapshot()
            if len(now["parts"]) >= PARTS:
                self.compact()
                continue
            number = now["number"] + 1
            if self.files.create(f"{self.root}/snapshots/{number:012d}.json", json.dumps({"number": number, "parts": now["parts"] + names})):
                return number
        raise RuntimeError(f"{self.root}: other writers were faster {TRIES} times")

    def compact(self) -> int:
        """One part instead of many.  What others have merged meanwhile stays, after it."""
        base = self.snapshot()
        if len(base["parts"]) < 2:
            return base["number"]
        whole = self._written(self._state(base["parts"]))
        for _ in range(TRIES):
            now = self.snapshot()
            if now["parts"][: len(base["parts"])] != base["parts"]:
                return now["number"]  # another writer has compacted
            number = now["number"] + 1
            if self.files.create(f"{self.root}/snapshots/{number:012d}.json", json.dumps({"number": number, "parts": [whole, *now["parts"][len(base["parts"]) :]]})):
                return number
        raise RuntimeError(f"{self.root}: other writers were faster {TRIES} times")

    def prune(self, keep: int = 2) -> list[str]:
        """Drop all but the last ``keep`` snapshots and the parts that these don't name; the dropped parts."""
        numbers = self._numbers()
        kept = [self.snapshot(n) for n in numbers[-keep:]]
        alive = {p for s in kept for p in s["parts"]}
        for n in numbers[:-keep]:
            self.files.drop(f"{self.root}/snapshots/{n:012d}.json")
        gone = [p for p in self.files.names(f"{self.root}/parts") if p not in alive]
        for p in gone:
            self.files.drop(f"{self.root}/parts/{p}")
        return gone


def embedding_cache(spark: SparkSession, root: str) -> KeyedLog:
    return KeyedLog(spark, root, ["k"], "k string, model string, vec array<float>")


def embedded(items: DataFrame, cache: KeyedLog, model: str, embed: Callable[[DataFrame], DataFrame], text: str = "text") -> DataFrame:
    """``items`` with ``embedding``: from the cache, else made once for each text that differs, and kept.

    ``embed`` adds ``vec`` to rows of (k, text).  Every row is answered, repeated ones too; the frame keeps the
    columns of ``items``, so what they are ordered by is there.
    """
    keyed = items.withColumn("_k", cache_key(F.lit(model), F.coalesce(F.col(text), F.lit(""))))
    asked = keyed.groupBy(F.col("_k").alias("k")).agg(F.min(F.coalesce(F.col(text), F.lit(""))).alias("text"))
    known = cache.read()
    missing = asked.join(known.where(F.col("model") == model).select("k"), "k", "left_anti")
    cache.merge(embed(missing).select("k", F.lit(model).alias("model"), F.col("vec").cast("array<float>").alias("vec")))
    now = cache.read().where(F.col("model") == model).select(F.col("k").alias("_k"), F.col("vec").alias("embedding"))
    return keyed.join(now, "_k", "left").drop("_k")


class Publication:
    """Immutable versions under ``root`` and the numbered pointers to them; a mirror is brought up to date before it is pruned."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root, self.files = spark, root.rstrip("/"), Files(spark, root)

    def _pointers(self) -> list[str]:
        return [n for n in self.files.names(f"{self.root}/pointers") if n.endswith(".json")]

    def current(self) -> str | None:
        names = self._pointers()
        return json.loads(self.files.read(f"{self.root}/pointers/{names[-1]}"))["version"] if names else None

    def versions(self) -> list[str]:
        return [v for v in self.files.names(self.root) if v.startswith("v")]

    def publish(self, tables: dict[str, DataFrame], version: str, gates: DataFrame | None = None) -> str:
        """Write every table under a new version, then the pointer.  A version is written once; closed gates leave all as it was."""
        if gates is not None and (closed := [r["gate"] for r in gates.where("NOT ok").select("gate").collect()]):
            raise ValueError(f"closed gates: {', '.join(sorted(closed))}")
        for name, df in tables.items():
            df.write.mode("errorifexists").parquet(f"{self.root}/{version}/{name}")
        for _ in range(TRIES):
            names = self._pointers()
            number = int(names[-1].split(".")[0]) + 1 if names else 1
            if self.files.create(f"{self.root}/pointers/{number:012d}.json", json.dumps({"version": version, "tables": sorted(tables)})):
                return version
        raise RuntimeError(f"{self.root}: other writers were faster {TRIES} times")

    def read(self, name: str, version: str | None = None) -> DataFrame:
        return self.spark.read.parquet(f"{self.root}/{version or self.current()}/{name}")

    def mirror(self, target: str) -> tuple[int, int]:
        """Copy what the current version has and ``target`` lacks, then drop what it has too much: (copied, dropped) files.

        Files are dealt out to tasks, each tries a file up to six times, and nothing is dropped unless all copies are there.
        """
        version = self.current()
        size = lambda root: self.spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).select("path", F.col("length").alias("size"))
        base = f"{self.root}/{version}"
        key = lambda root: F.regexp_extract("path", rf"/{root.rstrip('/').rsplit('/', 1)[-1]}/(.*)$", 1)
        own = size(base).select(key(base).alias("key"), F.col("path").alias("source"), "size")
        there = size(target).select(key(target).alias("key"), "size") if self.files.names(target) else self.spark.createDataFrame([], "key string, size long")
        todo = own.join(there, ["key", "size"], "left_anti").withColumn("target", F.concat(F.lit(target.rstrip("/") + "/"), "key"))
        copied = todo.select("source", "target").mapInPandas(copied_files, "target string, size long, error string").collect()
        if bad := [r for r in copied if r["error"]]:
            raise OSError(f"{len(bad)} files not copied, first: {bad[0]['target']}: {bad[0]['error']}")
        spare = [r["key"] for r in there.join(own.select("key"), "key", "left_anti").select("key").collect()]
        for k in spare:
            self.files.drop(f"{target.rstrip('/')}/{k}")
        return len(copied), len(spare)


def waits(tries: int = 6, most: float = 60.0) -> list[float]:
    """Seconds before each further try."""
    return [min(most, 3.0 * 2**n) for n in range(tries - 1)]


def copied_files(frames, pause: Callable[[float], None] | None = None):
    """Copy (source, target) files of any store that pyarrow opens; (target, size, error) of each, error null if it is there."""
    import time

    import pandas as pd
    from pyarrow import fs

    pause = pause or time.sleep
    for frame in frames:
        rows = []
        for source, target in zip(frame["source"], frame["target"], strict=True):
            error, size = None, None
            for wait in [*waits(), None]:
                try:
                    (a, a_path), (b, b_path) = fs.FileSystem.from_uri(source.replace("file:///", "file:/").replace("file:/", "file:///")), fs.FileSystem.from_uri(target if ":" in target else f"file://{target}")
                    b.create_dir(b_path.rsplit("/", 1)[0], recursive=True)
                    # Written aside and moved, so that no half file has the name.
                    with a.open_input_stream(a_path) as i, b.open_output_stream(f"{b_path}.part") as o:
                        while piece := i.read(8 << 20):
                            o.write(piece)
                    b.move(f"{b_path}.part", b_path)
                    error, size = None, b.get_file_info(b_path).size
                    break
                except OSError as e:
                    error = str(e)[:200]
                    if wait is not None:
                        pause(wait)
            rows.append((target, size, error))
        yield pd.DataFrame(rows, columns=["target", "size", "error"])


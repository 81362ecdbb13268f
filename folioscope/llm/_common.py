"""Small helpers shared by the corpus operators."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from folioscope.llm._kernels import slices

WORD = r"[^\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_column(name: str = "text"):
    """A text column with null as the empty string."""
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def lower_ascii(column):
    return F.translate(column, UPPER, LOWER)


def checkpoint(df: DataFrame, keep: bool = False) -> DataFrame:
    """Cut the lineage through the shared folder in spark.checkpoint.dir.

    Where it is unset, as in tests, a local session gets a folder of its own, which goes with the process;
    a cluster has to name one, as its executors share no local folder.
    ``keep``: as the rows are dealt out, which later joins by the same key then know; a plan that adapts does not tell.
    """
    spark = df.sparkSession
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder:
            if not re.match(r"local(\[|$)", context.master):
                raise RuntimeError("spark.checkpoint.dir has to name a folder that all executors share")
            folder = tempfile.mkdtemp(prefix="folioscope-")
            atexit.register(shutil.rmtree, folder, ignore_errors=True)
        context.setCheckpointDir(folder)
    with passing_shuffles(spark), setting(spark, "spark.sql.adaptive.enabled", "false" if keep else None):
        return df.select("*").checkpoint(eager=True)


@contextmanager
def setting(spark: SparkSession, key: str, value: str | None) -> Iterator[None]:
    """A setting of the session for the frames made in here; none: as it is."""
    before = spark.conf.get(key, None)
    if value is not None:
        spark.conf.set(key, value)
    try:
        yield
    finally:
        if value is not None and before is None:
            spark.conf.unset(key)
        elif value is not None:
            spark.conf.set(key, before)


def passing_shuffles(spark: SparkSession):
    """Frames made in here drop their shuffle files as soon as they have run, so that the steps of a long job don't add up on disk."""
    return setting(spark, "spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true")  # read when a DataFrame is made


def compact(df: DataFrame, rows: int = 200_000) -> DataFrame:
    """A checkpoint in partitions of about so many rows, so that small tables between steps don't cost a task for each shuffle partition."""
    out = checkpoint(df)
    return out.coalesce(1 + out.count() // rows)


def map_text(df: DataFrame, make: Callable[[], Callable[[pa.RecordBatch], pa.RecordBatch | None]], schema: T.StructType, column: str = "text", budget: int = 2 << 20) -> DataFrame:
    """``mapInArrow`` in parts of about ``budget`` bytes of text; ``make()`` runs once in each task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = make()
        for batch in batches:
            for part in slices(batch, column, budget):
                out = step(part)
                if out is not None and out.num_rows:
                    yield out

    return df.mapInArrow(run, schema)


def id_field(df: DataFrame, name: str = "doc_id") -> T.StructField:
    return T.StructField(name, df.schema[name].dataType, True)


def conf_int(spark: SparkSession, key: str, default: int) -> int:
    try:
        return int(spark.conf.get(key))
    except Exception:  # noqa: BLE001 - an unset or odd value falls back to the default
        return default

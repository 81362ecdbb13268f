"""Readers: engine tables, page and stage files, object listings, rule files; and the snapshot resolver."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def inline(spark: SparkSession, values: str, columns: str) -> DataFrame:
    """A small literal table, written once for Spark and for the SQL that checks it."""
    return spark.sql(f"SELECT * FROM VALUES {values} AS t({columns})")


def inline_sql(values: str, columns: str) -> str:
    return f"(SELECT * FROM (VALUES {values}) t({columns}))"


def lines(docs: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """keys, line_no (from 0) and line of every line."""
    return docs.select(*keys, F.posexplode(F.split(text, "\n")).alias("line_no", "line"))


def listing(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """path, name, size, modified and content hash of every file under a folder of any Hadoop store, folders skipped."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(path)
    return files.select("path", F.regexp_extract("path", "[^/]+$", 0).alias("name"), F.col("length").alias("size"), F.col("modificationTime").alias("modified"), F.sha2("content", 256).alias("sha256"))


def rule_files(spark: SparkSession, path: str) -> DataFrame:
    """name, keys (map) and body of ``---`` frontmatter files; files without a head or a body are left out."""
    whole = spark.read.text(path, wholetext=True)
    head, body = F.regexp_extract("value", r"(?s)^---\n(.*?)\n---\n(.*)$", 1), F.regexp_extract("value", r"(?s)^---\n(.*?)\n---\n(.*)$", 2)
    pairs = F.expr(r"map_from_entries(transform(filter(split(head, '\n'), l -> instr(l, ':') > 0), l -> struct(trim(substring_index(l, ':', 1)) as k, trim(substring(l, instr(l, ':') + 1)) as v)))")
    return whole.select(head.alias("head"), F.trim(body).alias("body")).where("head != '' AND body != ''").select(pairs.alias("keys"), "body").select(F.col("keys")["name"].alias("name"), "keys", "body")


def collections(spark: SparkSession, names: str) -> list[str]:
    """Those of the comma-separated tables that exist; all tables if none does."""
    present = [t.name for t in spark.catalog.listTables()]
    wanted = [n.strip() for n in names.split(",") if n.strip() in present]
    return wanted or sorted(present)


def resolve_snapshot(spark: SparkSession, candidates: list[str], required: set[str], vector: str | None = None, dimension: int | None = None) -> str | None:
    """The first path that reads, has rows, the required columns and vectors of the right length."""
    from pyspark.errors import PySparkException

    for path in candidates:
        try:
            df = spark.read.parquet(path)
            row = df.limit(1).select(F.size(vector).alias("n") if vector else F.lit(0).alias("n")).first()
        except PySparkException:
            continue
        if row and required <= set(df.columns) and (dimension is None or row["n"] == dimension):
            return path
    return None

"""Stores and services around the engine: chat history, binaries, index builds, traces, tools, the question service."""

from __future__ import annotations

import time
from collections import OrderedDict
from collections.abc import Callable, Sequence
from contextlib import contextmanager
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from folioscope.operators.lexical_index import LexicalIndex
from folioscope.operators.search import best_documents

HISTORY = "session_id string, user_id string, role string, content string, created_at timestamp"
BINARIES = "name string, content_type string, metadata map<string,string>, sha256 string, content binary"


def add_messages(rows: DataFrame, path: str) -> None:
    """Append messages that have a content, a folder for each session."""
    kept = rows.where(F.coalesce("content", F.lit("")) != "").withColumn("created_at", F.coalesce("created_at", F.current_timestamp()))
    kept.write.mode("append").partitionBy("session_id").parquet(path)


def delete_session(spark: SparkSession, path: str, session: str) -> int:
    """Drop a session's folder; how many messages it held."""
    rows = spark.read.schema(HISTORY).parquet(path).where(F.col("session_id") == session).count()
    if rows:
        folder = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/session_id={session}")
        folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)
    return rows


def save_binaries(files: DataFrame, path: str) -> DataFrame:
    """Append (path, content) files of a binary listing, named by their last part, with the default content type and metadata; returns what was saved."""
    rows = files.select(
        F.regexp_extract("path", "[^/]+$", 0).alias("name"), F.lit("application/octet-stream").alias("content_type"),
        F.create_map(F.lit("source"), F.col("path")).alias("metadata"), F.sha2("content", 256).alias("sha256"), "content",
    )
    rows.write.mode("append").parquet(path)
    return rows.drop("content")


def listed(files: DataFrame, prefix: str) -> DataFrame:
    """kind, n and bytes of the objects under a prefix: assets (a key with ``/assets/``) and the core."""
    kind = F.when(F.contains("path", F.lit("/assets/")), "assets").otherwise("core")
    return files.where(F.contains("path", F.lit(prefix))).groupBy(kind.alias("kind")).agg(F.count("*").alias("n"), F.sum("size").alias("bytes"))


def drop_table(spark: SparkSession, name: str) -> bool:
    """Whether there was such a table; it is gone now."""
    there = spark.catalog.tableExists(name)
    spark.sql(f"DROP TABLE IF EXISTS `{name}`")
    return there


def write_stages(stages: dict[str, DataFrame], root: str) -> dict[str, str]:
    """Each stage's output as JSON lines under its name."""
    for name, df in stages.items():
        df.write.mode("overwrite").json(f"{root}/{name}")
    return {name: f"{root}/{name}" for name in stages}


def contents(segments: DataFrame) -> DataFrame:
    """The table of contents: kind, number, title cut to 120, breadcrumb, pages and characters of every segment."""
    return segments.select("doc_id", "segment_no", "kind", "number", F.substring("title", 1, 120).alias("title"), "breadcrumb", "page_start", "page_end", F.length("text").alias("chars"))


def registered(documents: DataFrame, files: DataFrame, only: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Registered documents whose file is there, and those whose file is missing; an error if the only one asked for is missing."""
    wanted = documents if only is None else documents.where(F.col("doc_id") == only)
    names = files.select(F.col("name").alias("file")).distinct()
    found, missing = wanted.join(names, "file", "left_semi"), wanted.join(names, "file", "left_anti")
    if only is not None and found.isEmpty():
        raise FileNotFoundError(f"no file for {only}")
    return found, missing


def build_index(docs: DataFrame, root: str, version: str) -> DataFrame:
    """Rebuild the lexical index from scratch under ``root/version`` and write its manifest last: one row."""
    spark = docs.sparkSession
    built = LexicalIndex.read(spark, LexicalIndex.build(docs).write(f"{root}/{version}/lexical"))
    manifest = built.snapshot.crossJoin(built.terms.agg(F.count("*").alias("n_terms"))).crossJoin(built.postings.agg(F.count("*").alias("n_postings"))).withColumn("version", F.lit(version))
    manifest.coalesce(1).write.mode("overwrite").json(f"{root}/{version}/manifest")
    return spark.read.schema(manifest.schema).json(f"{root}/{version}/manifest")


def embedded_once(questions: DataFrame, embed: Callable[[Column], Column], text: str = "text") -> DataFrame:
    """Questions with ``embedding``, made once for each text that differs after trimming and lower-casing."""
    keyed = questions.withColumn("_key", F.lower(F.trim(F.col(text))))
    once = keyed.select("_key").distinct().withColumn("embedding", embed(F.col("_key")))
    return keyed.join(once, "_key", "left").drop("_key")


class Recent:
    """The last ``size`` results of a function of one text, keyed by the text trimmed and lower-cased."""

    def __init__(self, make: Callable[[str], object], size: int = 256):
        self.make, self.size, self.kept, self.hits = make, size, OrderedDict(), 0

    def __call__(self, text: str) -> object:
        key = text.strip().lower()
        if key in self.kept:
            self.hits += 1
            self.kept.move_to_end(key)
        else:
            self.kept[key] = self.make(key)
            if len(self.kept) > self.size:
                self.kept.popitem(last=False)
        return self.kept[key]


@dataclass
class Trace:
    """Spans of a request: name, seconds, rows and what went wrong.  Disabled, it does nothing."""

    enabled: bool = True
    spans: list[dict] = field(default_factory=list)

    @contextmanager
    def span(self, name: str):
        if not self.enabled:
            yield None
            return
        entry, began = {"name": name, "error": None}, time.monotonic()
        self.spans.append(entry)
        try:
            yield entry
        except Exception as error:
            entry["error"] = str(error)[:200]
            raise
        finally:
            entry["seconds"] = time.monotonic() - began

    def observed(self, df: DataFrame, name: str) -> tuple[DataFrame, Observation | None]:
        """The frame with its rows counted as they pass; the count is there once an action has run."""
        if not self.enabled:
            return df, None
        seen = Observation(name)
        return df.observe(seen, F.count(F.lit(1)).alias("rows")), seen


def tool(step: Callable[[str], str]) -> Callable[[Column], Column]:
    """A user's function of one text as a column function: it always gives a text, and an error becomes its message."""

    def safe(value: str | None) -> str:
        try:
            return str(step(value or ""))
        except Exception as error:  # noqa: BLE001 - a tool never raises
            return f"error: {type(error).__name__}: {str(error)[:200]}"

    def column(text: Column) -> Column:
        @F.pandas_udf("string")
        def run(texts: pd.Series) -> pd.Series:
            return texts.map(safe)

        return run(text)

    return column


class Service:
    """The engine behind an interface: health, questions one batch at a time, documents, rebuild."""

    def __init__(self, docs: DataFrame, path: str):
        self.docs, self.path = docs, path
        self.index, self.rebuilt = LexicalIndex.current(docs, path)

    def health(self) -> dict[str, object]:
        return {"status": "ok", "documents": self.index.snapshot.first()["n"]}

    def query(self, questions: Sequence[str], k: int = 4, session: str | None = None) -> DataFrame:
        """session_id, query_id, doc_id, score and rank of a batch of questions; none may be empty."""
        if not questions or any(not (q or "").strip() for q in questions):
            raise ValueError("a question is required")
        spark = self.docs.sparkSession
        asked = spark.createDataFrame([(i, q.strip()) for i, q in enumerate(questions)], "query_id long, text string")
        return best_documents(self.index, asked, k).withColumn("session_id", F.lit(session or "api_query"))

    def rebuild(self) -> bool:
        """Whether the index had to be built again for the documents as they are now."""
        self.index, self.rebuilt = LexicalIndex.current(self.docs, self.path)
        return self.rebuilt

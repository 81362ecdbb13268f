"""A build as a chain of stages: each document goes through a stage again only if its content or a version changed.

The key of a document at a stage is a digest of its content and of the names and versions of all stages up to
there.  A manifest, a keyed log, has for each (stage, document) the digest that was built and the part that
holds its rows.  A run anti-joins the manifest, makes the missing rows into one new part, and then merges the
manifest: a run that breaks off leaves a part that nothing points to, and the next one makes it again.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscope.functions.text import clean_text, token_estimate
from folioscope.lineage import cut
from folioscope.operators.merge_log import KeyedLog, Publication
from folioscope.operators.structure import chunks
from folioscope.settings import Settings


@dataclass(frozen=True)
class Stage:
    name: str
    version: str
    #: From the rows of the stage before (the documents for the first), of the documents to be built, to this stage's rows.
    make: Callable[[DataFrame], DataFrame]


class BuildChain:
    def __init__(self, spark: SparkSession, root: str, stages: list[Stage], doc: str = "doc_id", text: str = "text", doc_type: str = "bigint"):
        self.spark, self.root, self.stages, self.doc, self.text = spark, root.rstrip("/"), stages, doc, text
        self.manifest = KeyedLog(spark, f"{self.root}/manifest", ["stage", doc], f"stage string, {doc} {doc_type}, digest string, part string")

    def digest(self, upto: int):
        """16 hex digits of a document's content and the versions of the stages up to one."""
        versions = "|".join(f"{s.name}={s.version}" for s in self.stages[: upto + 1])
        return F.substring(F.sha2(F.concat(F.lit(versions + "\x00"), F.coalesce(F.col(self.text), F.lit(""))), 256), 1, 16)

    def output(self, stage: str) -> DataFrame | None:
        """The rows of a stage as they are now; None before its first run."""
        now = self.manifest.read().where((F.col("stage") == stage) & F.col("part").isNotNull()).select(self.doc, "part")
        parts = [r["part"] for r in now.select("part").distinct().collect()]
        if not parts:
            return None
        rows = self.spark.read.option("basePath", f"{self.root}/{stage}").parquet(*(f"{self.root}/{stage}/part={p}" for p in parts))
        return rows.join(now, [self.doc, "part"], "left_semi").drop("part")

    def run(self, docs: DataFrame) -> dict[str, int]:
        """Build what is new or changed, forget documents that are gone; the number of documents built, by stage."""
        built: dict[str, int] = {}
        for i, stage in enumerate(self.stages):
            keyed = docs.select(self.doc, self.digest(i).alias("digest"))
            known = self.manifest.read().where((F.col("stage") == stage.name) & F.col("part").isNotNull()).select(self.doc, "digest")
            todo = cut(keyed.join(known, [self.doc, "digest"], "left_anti"))
            built[stage.name] = todo.count()
            gone = known.join(keyed, self.doc, "left_anti").select(F.lit(stage.name).alias("stage"), self.doc, F.lit(None).cast("string").alias("digest"), F.lit(None).cast("string").alias("part"))
            changes = gone
            if built[stage.name]:
                before = docs if i == 0 else self.output(self.stages[i - 1].name)
                part = uuid.uuid4().hex
                made = stage.make(before.join(todo.select(self.doc), self.doc, "left_semi"))
                made.write.parquet(f"{self.root}/{stage.name}/part={part}")
                changes = gone.unionByName(todo.select(F.lit(stage.name).alias("stage"), self.doc, "digest", F.lit(part).alias("part")))
            if built[stage.name] or not gone.isEmpty():
                self.manifest.merge(changes)
        return built

    def publish(self, target: str, version: str, gates: DataFrame | None = None) -> str:
        """The outputs of all stages as one published version."""
        tables = {s.name: out for s in self.stages if (out := self.output(s.name)) is not None}
        return Publication(self.spark, target).publish(tables, version, gates)


def standard_stages(settings: Settings | None = None) -> list[Stage]:
    """Cleaned texts, chunks under a header, and counts.  The chunk budgets of the settings are part of the version."""
    settings = settings or Settings.load()
    budget, hard = settings.chunk_tokens, settings.chunk_hard_tokens

    def cleaned(docs: DataFrame) -> DataFrame:
        return docs.select("doc_id", "source", clean_text(F.coalesce("text", F.lit(""))).alias("text"))

    def packed(rows: DataFrame) -> DataFrame:
        return chunks(rows.withColumn("_head", F.concat_ws(" · ", "source", F.col("doc_id").cast("string"))), budget, hard, header="_head")

    def counted(rows: DataFrame) -> DataFrame:
        return rows.groupBy("doc_id").agg(F.count("*").alias("n_chunks"), F.sum(token_estimate(F.col("text"))).alias("n_tokens"))

    return [Stage("cleaned", "1", cleaned), Stage("chunks", f"1-{budget}-{hard}", packed), Stage("counts", "1", counted)]


def gates(chunks: DataFrame, vectors: DataFrame, tables: DataFrame, assets: DataFrame, recall: DataFrame, settings: Settings | None = None, dimension: int = 1536) -> DataFrame:
    """gate, value and ok of every rule that a version has to meet before it is published.

    ``tables`` has (table_id, state, png_key), ``assets`` has (key), ``recall`` one row (recall).  There are
    chunks; all vectors have the dimension; every picture that a table names is there; no table waits for a
    revision; and the golden questions are answered well enough, where there are any.
    """
    settings = settings or Settings.load()
    named = tables.where(F.col("png_key").isNotNull()).select(F.col("png_key").alias("key"))
    rows = [
        chunks.agg(F.lit("chunks").alias("gate"), F.count("*").cast("double").alias("value")).withColumn("ok", F.col("value") > 0),
        vectors.agg(F.lit("dimension").alias("gate"), F.count_if(F.coalesce(F.size("embedding"), F.lit(0)) != dimension).cast("double").alias("value")).withColumn("ok", F.col("value") == 0),
        named.join(assets.select("key").distinct(), "key", "left_anti").agg(F.lit("missing_pictures").alias("gate"), F.count("*").cast("double").alias("value")).withColumn("ok", F.col("value") == 0),
        tables.agg(F.lit("revision").alias("gate"), F.count_if(F.col("state") == "revision").cast("double").alias("value")).withColumn("ok", F.col("value") == 0),
        recall.agg(F.lit("recall").alias("gate"), F.avg("recall").alias("value")).withColumn("ok", F.coalesce(F.col("value") >= settings.recall_gate, F.lit(True))),
    ]
    out = rows[0]
    for r in rows[1:]:
        out = out.unionByName(r)
    return out

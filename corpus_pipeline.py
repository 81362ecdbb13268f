"""A corpus pipeline of five stages, each over all that the one before it kept.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last keep the columns of
``documents``.  Documents that the quality classifier rejects go; of each group of near duplicates the
document with the smallest id stays; secrets are replaced by a mark; documents are repeated or left out
so that the sources meet their target weights; texts are encoded and decoded.

Defined results: a null or empty text is scored like any text without a word; it is near to no other, so
all such rows pass the second stage; it has no secrets and stays as it is; it starts no block, so the mix
leaves it out.  Of a group without any id, the row whose text has the smallest hash stays; of rows that
repeat the one that stays, one stays.  A very long text passes every stage whole.  An empty table passes
all stages empty.  Rows travel in a struct of their own, so no further column clashes with a stage's own.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscope.llm._common import checkpoint, table
from folioscope.llm.bpe_codec import bpe_tokens
from folioscope.llm.ngram_join import ngram_components
from folioscope.llm.quality_crf import fit_quality, keep_quality
from folioscope.llm.secret_scan import new_findings, redacted, with_findings
from folioscope.llm.source_mix import mixed_documents


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return keep_quality(docs, fit_quality(docs, table(spark, sf_dir, "labels")))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group the row with the smallest id, ties by a hash of the text; all rows without a word."""
    groups = ngram_components(docs, with_group=True).where(F.col("group").isNotNull())
    kinds = groups.groupBy("group", "doc_id", "h").agg(F.count("*").alias("copies"))
    first = kinds.groupBy("group").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "h", "copies")).alias("f"))
    first = first.select(F.struct("f.doc_id", "f.h").alias("k"), "f.copies")
    whole = docs.select(F.struct("*").alias("row"), F.struct("doc_id", F.xxhash64(F.col("text").cast("string")).alias("h")).alias("k"), F.coalesce(F.col("text").rlike(r"[^\x20\x09-\x0D]"), F.lit(False)).alias("words"))
    stay = whole.where("words").alias("w").join(first.alias("f"), F.col("w.k").eqNullSafe(F.col("f.k"))).select("row", "w.k", "copies")
    once = stay.where("copies = 1").unionByName(stay.where("copies > 1").dropDuplicates(["k"]))
    return once.select("row.*").unionByName(whole.where("not words").select("row.*"))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    found = with_findings(docs, new_findings(docs))
    text = F.when(F.col("row.text").isNotNull(), redacted(F.col("row.text"), F.col("spans")))
    changed = {"text": text, "n_chars": F.length(text).cast(docs.schema["n_chars"].dataType)}
    return found.select(*(changed.get(c, F.col(f"row.`{c}`")).alias(c) for c in docs.columns))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix draws the block in which it starts."""
    return mixed_documents(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return bpe_tokens(docs)


STAGES = [("quality classifier", quality), ("n-gram Jaccard join", near_duplicates), ("secret scans", secrets), ("mixing sources to target weights", mixing), ("BPE encoding and decoding", tokens)]

#: SQL can express neither the classifier nor the tokenizer; tests/llm compares each stage with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = checkpoint(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)

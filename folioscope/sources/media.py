"""Images, recordings and remote answers: adapters that never fail a job, and what is built on them."""

from __future__ import annotations

import textwrap
from collections.abc import Callable, Iterator
from pathlib import Path

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscope.operators.figures import bad_transcript, recursive_chunks
from folioscope.operators.metadata import image_question, image_reading
from folioscope.operators.search import bm25
from folioscope.sources.adapters import pages

Reader = Callable[[bytes], str]


def read_binaries(content: Column, reader: Reader) -> Column:
    """What a reader makes of each binary; an empty text where it fails or there is none."""

    def safe(raw: bytes | None) -> str:
        try:
            return reader(bytes(raw)) if raw is not None else ""
        except Exception:  # noqa: BLE001 - a reading that fails is an empty one
            return ""

    @F.pandas_udf("string")
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for part in parts:
            yield part.map(safe)

    return run(content)


def image_texts(files: DataFrame, reader: Reader) -> DataFrame:
    """(path, text) of the images of a binary listing."""
    return files.select("path", read_binaries(F.col("content"), reader).alias("text"))


def transcripts(files: DataFrame, reader: Reader, stronger: Reader) -> DataFrame:
    """(path, text, retried): a transcript that looks bad is made again by the stronger reader, which alone reads those files."""
    first = files.select("path", "content", read_binaries(F.col("content"), reader).alias("text")).withColumn("retried", bad_transcript(F.col("text")))
    again = first.where("retried").select("path", read_binaries(F.col("content"), stronger).alias("text"), "retried")
    return first.where("NOT retried").select("path", "text", "retried").unionByName(again)


class RemoteAnswers:
    """Answers over a call (session, question) -> text; once more with a fresh session if the first one is stale, slow or broken."""

    MARKERS = ("session", "timeout", "timed out", "500")

    def __init__(self, call: Callable[[str, str], str], open_session: Callable[[], str]):
        self.call, self.open_session, self.session = call, open_session, None

    def ask(self, question: str) -> str:
        self.session = self.session or self.open_session()
        try:
            return self.call(self.session, question)
        except Exception as error:
            if not any(m in str(error).lower() for m in self.MARKERS):
                raise
            self.session = self.open_session()
            return self.call(self.session, question)


def model_intents(question: Column, classify: Callable[[str], dict], fields: str, most: int = 500) -> Column:
    """A struct by a model from the first ``most`` characters of each question, null where it fails."""

    def safe(text: str | None) -> dict | None:
        try:
            return classify((text or "")[:most])
        except Exception:  # noqa: BLE001 - the caller falls back to its rules
            return None

    @F.pandas_udf("string")
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: None if (got := safe(t)) is None else pd.io.json.ujson_dumps(got))

    return F.from_json(run(question), fields)


def image_answers(readings: DataFrame, docs: DataFrame, k: int = 3) -> DataFrame:
    """From readings (query_id, text) of exam images: the question, the option marked, the options, and the evidence of the best ``k`` documents; none found is said so."""
    read = image_reading(F.col("text"))
    asked = readings.select("query_id", image_question(F.col("text")).alias("question"), read["answer"].alias("answer"), read["options"].alias("options"))
    hits = bm25(docs, asked.select("query_id", F.col("question").alias("text")), k).groupBy("query_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "doc_id"))), lambda x: x["doc_id"].cast("string")), ",").alias("evidence"))
    status = F.when(F.col("question") == "", "no_question").when(F.col("evidence").isNull(), "no_evidence").otherwise("ok")
    return asked.join(hits, "query_id", "left").select("query_id", "question", F.coalesce(F.nullif("answer", F.lit("")), F.lit("?")).alias("answer"), "options", "evidence", status.alias("status"))


def index_file(spark: SparkSession, path: str, name: str = "") -> dict[str, object]:
    """{file, chunks} of one file, through its page parser and the recursive splitter."""
    chunks = pages(spark, path, name).select(F.explode(recursive_chunks(F.col("text"))))
    return {"file": Path(path).name, "chunks": chunks.count()}


class Similarity:
    """``similarity_search(query, k)`` over documents: their texts with their ids, best first."""

    def __init__(self, docs: DataFrame):
        self.docs = docs

    def similarity_search(self, query: str, k: int = 4) -> list[dict]:
        asked = self.docs.sparkSession.createDataFrame([(0, query)], "query_id long, text string")
        found = bm25(self.docs, asked, k).join(self.docs.select("doc_id", "text"), "doc_id").orderBy("rank")
        return [{"page_content": r["text"], "metadata": {"doc_id": r["doc_id"]}} for r in found.collect()]


def upload_tree(spark: SparkSession, source: str, target: str) -> list[str]:
    """Copy a local folder's files to a folder of any Hadoop store, what is there of other names stays; the names copied."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    names = sorted(str(p.relative_to(source)) for p in Path(source).rglob("*") if p.is_file())
    for name in names:
        to = jvm.org.apache.hadoop.fs.Path(f"{target}/{name}")
        to.getFileSystem(conf).copyFromLocalFile(False, True, jvm.org.apache.hadoop.fs.Path(str(Path(source, name))), to)
    return names


def replace_tree(spark: SparkSession, source: str, target: str) -> list[str]:
    """Delete the folder at the target and upload the source: the older way to publish, with a gap for readers."""
    to = spark._jvm.org.apache.hadoop.fs.Path(target)
    to.getFileSystem(spark._jsc.hadoopConfiguration()).delete(to, True)
    return upload_tree(spark, source, target)


def allowed(user: Column, listed: tuple[str, ...]) -> Column:
    """Whether a user is among the listed ones; an empty list allows none, and no user is never allowed."""
    return F.coalesce(F.trim(user.cast("string")).isin([x.strip() for x in listed if x.strip()]), F.lit(False))


def wrapped_cells(value: Column, width: int) -> Column:
    """A cell's lines of at most ``width`` characters, words whole where they fit."""

    @F.pandas_udf("array<string>")
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: textwrap.wrap(" ".join((t or "").split()), width, break_long_words=True) or [""])

    return run(value)

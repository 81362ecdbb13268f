"""Pluggable models and parsers: small protocols, deterministic stand-ins, retries, and a page data source."""

from __future__ import annotations

import hashlib
import time
from collections.abc import Callable, Iterator
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition


class Embedder(Protocol):
    def embed(self, texts: list[str]) -> list[list[float]]: ...


class Writer(Protocol):
    def write(self, prompts: list[str]) -> list[str | None]: ...


class HashingEmbedder:
    """Signed token hashing to a unit vector: the same everywhere, without a model."""

    def __init__(self, dimension: int = 64):
        self.dimension = dimension

    def embed(self, texts: list[str]) -> list[list[float]]:
        out = np.zeros((len(texts), self.dimension))
        for i, text in enumerate(texts):
            for token in text.lower().split():
                h = int.from_bytes(hashlib.blake2b(token.encode(), digest_size=8).digest(), "big")
                out[i, h % self.dimension] += 1 if h >> 63 else -1
        norm = np.linalg.norm(out, axis=1, keepdims=True)
        return (out / np.where(norm == 0, 1, norm)).tolist()


class EchoWriter:
    """Gives the last line of a prompt back."""

    def write(self, prompts: list[str]) -> list[str | None]:
        return [p.rstrip().rsplit("\n", 1)[-1] if p else None for p in prompts]


def embedded(text: Column, embedder: Embedder, batch: int = 100) -> Column:
    """One vector for each text, order kept, in batches."""

    @F.pandas_udf("array<float>")
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for part in parts:
            rows = part.fillna("").tolist()
            yield pd.Series([v for i in range(0, len(rows), batch) for v in embedder.embed(rows[i : i + batch])], index=part.index, dtype=object)

    return run(text)


def written(prompt: Column, writer: Writer) -> Column:
    """Model text; null where the model fails, so that a job never does."""

    @F.pandas_udf("string")
    def run(prompts: pd.Series) -> pd.Series:
        try:
            return pd.Series(writer.write(prompts.fillna("").tolist()), index=prompts.index, dtype=object)
        except Exception:  # noqa: BLE001 - the contract of a model column is text or null
            return pd.Series([None] * len(prompts), index=prompts.index, dtype=object)

    return run(prompt)


def with_retries(call: Callable[[], str], markers: tuple[str, ...] = ("503", "429"), tries: int = 4, wait: Callable[[float], None] = time.sleep) -> str:
    """Call again after 2, 4, 8 ... seconds, but only on errors that say the service is busy."""
    for attempt in range(tries):
        try:
            return call()
        except Exception as error:
            if attempt == tries - 1 or not any(m in str(error) for m in markers):
                raise
            wait(2.0 ** (attempt + 1))
    raise AssertionError


PARSERS: dict[str, Callable[[bytes], list[str]]] = {"formfeed": lambda raw: raw.decode("utf-8", "replace").split("\f"), "whole": lambda raw: [raw.decode("utf-8", "replace")]}
DEFAULT_PARSER = "formfeed"


def parser(name: str = "") -> Callable[[bytes], list[str]]:
    """A page parser by name; the default for none, an error for an unknown one."""
    if (key := name.strip().lower() or DEFAULT_PARSER) not in PARSERS:
        raise ValueError(f"unknown parser {name!r}; known: {sorted(PARSERS)}")
    return PARSERS[key]


def pages(spark: SparkSession, path: str, name: str = "", pattern: str = "*") -> DataFrame:
    """(path, page, text) of the non-empty pages of every file of a folder."""
    parse = parser(name)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = [(p, i, t.strip()) for p, raw in zip(frame["path"], frame["content"], strict=True) for i, t in enumerate(parse(raw), 1) if t.strip()]
            yield pd.DataFrame(rows, columns=["path", "page", "text"])

    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path)
    return files.select("path", "content").mapInPandas(run, "path string, page int, text string")


class GeneratedPages(DataSource):
    """``spark.read.format("generated_pages").option("documents", n)``: pages by rule, a partition for each document."""

    @classmethod
    def name(cls) -> str:
        return "generated_pages"

    def schema(self) -> str:
        return "doc_id int, page int, text string"

    def reader(self, schema) -> DataSourceReader:
        return _GeneratedReader(int(self.options.get("documents", "2")), int(self.options.get("pages", "3")))


class _GeneratedReader(DataSourceReader):
    def __init__(self, documents: int, pages: int):
        self.documents, self.pages = documents, pages

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(i) for i in range(self.documents)]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        for page in range(1, self.pages + 1):
            yield partition.value, page, f"ARTÍCULO {page}. Documento {partition.value}"

"""Queries that write the web pages as paged documents, twenty to a file, and read them back."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from folioscope.lineage import shared_folder
from folioscope.plans.structure import _CLEAN
from folioscope.sources.adapters import HashingEmbedder, embedded
from folioscope.sources.paged import index_folder, read_paged, write_paged
from folioscope.sources.tables import table


def _written(spark, sf) -> str:
    folder = f"{shared_folder(spark)}/paged/{uuid.uuid4().hex}"
    pages = table(spark, sf, "pages").select(F.floor(F.col("page_id") / 20).cast("long").alias("document"), F.col("page_id").alias("page"), F.col("html").alias("text"))
    write_paged(pages, folder)
    return folder


def _document(path):
    return F.regexp_extract(path, r"(\d+)\.paged$", 1).cast("long").alias("document")


def paged_documents(spark, sf):
    return read_paged(spark, _written(spark, sf), 7).select(_document("path"), "page", F.length("text").alias("n_chars"), "digest")


def paged_range(spark, sf):
    """The third to ninth page of every file; the other ranges are not read."""
    return read_paged(spark, _written(spark, sf), 4).where("page >= 3 AND page < 10").select(_document("path"), "page", "digest")


def indexed_folder(spark, sf):
    """Chunks and vectors of all pages, as they are stored."""
    folder = _written(spark, sf)
    index_folder(spark, folder, f"{folder}-index", lambda text: embedded(text, HashingEmbedder()))
    stored = spark.read.parquet(f"{folder}-index")
    return stored.groupBy(_document("path")).agg(F.count("*").alias("n_chunks"), F.countDistinct("page").alias("n_pages"), F.min(F.size("embedding") > 0).alias("embedded"))


_PAGES = f"""p AS (SELECT page_id // 20 AS document, row_number() OVER (PARTITION BY page_id // 20 ORDER BY page_id)::INT AS page, {_CLEAN.replace("(text,", "(coalesce(html, ''),")} AS t FROM pages), w AS (SELECT * FROM p WHERE t <> '')"""
ORACLES = {
    "paged_documents": f"WITH {_PAGES} SELECT document, page, length(t)::INT AS n_chars, substr(sha256(t), 1, 16) AS digest FROM w",
    "paged_range": f"WITH {_PAGES} SELECT document, page, substr(sha256(t), 1, 16) AS digest FROM w WHERE page BETWEEN 3 AND 9",
    "indexed_folder": f"WITH {_PAGES} SELECT document, sum(CASE WHEN length(t) <= 3200 THEN 1 ELSE ceil((length(t) - 3200) / 2600.0) + 1 END)::BIGINT AS n_chunks, count(*) AS n_pages, true AS embedded FROM w GROUP BY document",
}
QUERIES = {name: globals()[name] for name in ORACLES}

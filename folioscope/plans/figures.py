"""Queries over figures, transcripts and recursive chunks."""

from __future__ import annotations

from pyspark.sql import functions as F

from folioscope.operators import figures as ops
from folioscope.sources.tables import inline, inline_sql, table

IMAGES = (
    "(1, 1, false, 0.2, 100, 100, 'a'), (1, 2, false, 0.05, 100, 100, 'b'), (1, 3, true, 0.5, 100, 100, 'c'), (1, 4, false, 0.8, 100, 100, 'd'), (1, 5, false, 0.3, 40, 100, 'e'), "
    "(1, 6, false, 0.1, 90, 90, 'logo'), (1, 7, false, 0.1, 90, 90, 'logo'), (1, 8, false, 0.1, 90, 90, 'logo'), (1, 9, false, 0.1, 90, 90, 'logo'), (2, 1, false, 0.1, 90, 90, 'logo')"
)
_COLUMNS = "doc_id, page, scanned, cover, width, height, digest"
NAMED = "(1, 1, 'a', 'ver Figura 3.2 arriba'), (1, 2, 'b', 'figura 3.2'), (1, 3, 'c', 'nada'), (1, 3, 'd', 'nada'), (2, 3, 'e', 'Figura 3.2')"
SAID = "(1, 'hola que tal estamos'), (2, 'corto'), (3, '1234 5678 9012 3456 ab'), (4, CAST(NULL AS STRING)), (5, 'abcdefgh')"


def figure_candidates(spark, sf):
    return ops.candidates(inline(spark, IMAGES, _COLUMNS)).select("doc_id", "page", "digest")


def figure_names(spark, sf):
    return ops.named(inline(spark, NAMED, "doc_id, page, digest, page_text")).select("doc_id", "page", "digest", "figure_id")


def transcripts(spark, sf):
    return inline(spark, SAID, "id, text").select("id", ops.bad_transcript(F.col("text")).alias("bad"))


def row_candidates(spark, sf):
    return table(spark, sf, "documents").select("doc_id", ops.row_candidates(F.col("text")).alias("n"), ops.too_few_rows(F.col("text"), F.lit(2)).alias("too_few"))


def recursive_chunks(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.posexplode(ops.recursive_chunks(F.col("text"))).alias("place", "text")).select("doc_id", "place", F.length("text").alias("n_chars"))


_LINES = r"len(list_filter(string_split(text, chr(10)), lambda x: len(regexp_extract_all(x, '\b\d[\d.,]*\b')) >= 2))"
ORACLES = {
    "figure_candidates": f"""WITH i AS (SELECT * FROM {inline_sql(IMAGES, _COLUMNS)}), c AS (SELECT doc_id, digest, count(*) AS n FROM i GROUP BY ALL), p AS (SELECT doc_id, count(DISTINCT page) AS pages FROM i GROUP BY doc_id)
SELECT doc_id, page, digest FROM i JOIN c USING (doc_id, digest) JOIN p USING (doc_id) WHERE NOT scanned AND cover >= 0.08 AND cover < 0.70 AND width >= 60 AND height >= 60 AND n <= greatest(3, 0.05 * pages)""",
    "figure_names": "SELECT * FROM (VALUES (1, 1, 'a', '3.2'), (1, 2, 'b', '3.2_2'), (1, 3, 'c', 'p3'), (1, 3, 'd', 'p3_2'), (2, 3, 'e', '3.2')) t(doc_id, page, digest, figure_id)",
    "transcripts": "SELECT * FROM (VALUES (1, false), (2, true), (3, true), (4, true), (5, false)) t(id, bad)",
    "row_candidates": f"SELECT doc_id, CAST({_LINES} AS INT) AS n, {_LINES} > 5 AND 2 < 0.5 * {_LINES} AS too_few FROM documents",
}
QUERIES = {name: globals()[name] for name in [*ORACLES, "recursive_chunks"]}

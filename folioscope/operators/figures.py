"""Figures and small sanity rules around extraction."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

SEPARATORS = ("\n\n", "\n", ".", " ", "")


def candidates(images: DataFrame, least: float = 0.08, most: float = 0.70, side: int = 60) -> DataFrame:
    """Images (doc_id, page, scanned, cover, width, height, digest) that can be figures: large enough, not a page scan, not repeated through the document."""
    pages = images.groupBy("doc_id").agg(F.countDistinct("page").alias("_pages"))
    census = images.groupBy("doc_id", "digest").agg(F.count("*").alias("_n")).join(pages, "doc_id").where(F.col("_n") > F.greatest(F.lit(3.0), 0.05 * F.col("_pages")))
    fits = ~F.col("scanned") & (F.col("cover") >= least) & (F.col("cover") < most) & (F.col("width") >= side) & (F.col("height") >= side)
    return images.where(fits).join(census, ["doc_id", "digest"], "left_anti").select(images.columns)


def named(figures: DataFrame) -> DataFrame:
    """figure_id from the page's ``Figura n``, else from the page; a second one of the same id gets a suffix."""
    found = F.nullif(F.regexp_extract("page_text", r"(?iu)figura\s+(\d+(?:[.\-]\d+)*)", 1), F.lit(""))
    base = F.coalesce(found, F.concat(F.lit("p"), F.col("page").cast("string")))
    place = F.row_number().over(W.partitionBy("doc_id", "_base").orderBy("page", "digest"))
    rows = figures.withColumn("_base", base).withColumn("_n", place)
    return rows.withColumn("figure_id", F.when(F.col("_n") == 1, F.col("_base")).otherwise(F.concat_ws("_", "_base", F.col("_n").cast("string")))).drop("_base", "_n")


def row_candidates(text: Column) -> Column:
    """Lines with two numbers or more."""
    return F.size(F.filter(F.split(text, "\n"), lambda line: F.regexp_count(line, F.lit(r"\b\d[\d.,]*\b")) >= 2))


def too_few_rows(text: Column, rows: Column) -> Column:
    """Whether an extraction has under half of more than five row candidates."""
    return (row_candidates(text) > 5) & (rows < 0.5 * row_candidates(text))


def bad_transcript(text: Column) -> Column:
    """Under eight characters, or letters under the larger of eight and 30 %."""
    bare = F.trim(F.coalesce(text, F.lit("")))
    return (F.length(bare) < 8) | (F.regexp_count(bare, F.lit(r"\p{L}")) < F.greatest(F.lit(8.0), 0.3 * F.length(bare)))


def recursive_chunks(text: Column, size: int = 800, overlap: int = 150) -> Column:
    """Pieces of at most ``size`` characters, cut at the coarsest separator that helps, each going on up to ``overlap`` characters back."""

    def cut(whole: str, separators: tuple[str, ...]) -> list[str]:
        if len(whole) <= size:
            return [whole] if whole.strip() else []
        mark, rest = separators[0], separators[1:]
        if mark == "":
            return [whole[i : i + size] for i in range(0, max(1, len(whole) - overlap), size - overlap)]
        out: list[str] = []
        window: list[str] = []
        for part in whole.split(mark):
            if len(part) > size:
                out += [mark.join(window)] if window else []
                window = []
                out += cut(part, rest)
                continue
            if window and len(mark.join([*window, part])) > size:
                out.append(mark.join(window))
                while window and (len(mark.join(window)) > overlap or len(mark.join([*window, part])) > size):
                    window.pop(0)
            window.append(part)
        return [p for p in [*out, mark.join(window)] if p.strip()]

    @F.pandas_udf("array<string>")
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: cut(t or "", SEPARATORS))

    return run(text)

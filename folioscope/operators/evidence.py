"""Evidence for answers: guards over dense hits, preflight, listings, per-agent settings, usage sums."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def has_evidence(questions: DataFrame, hits: DataFrame, threshold: float = 0.45, top: int = 3, query: str = "query_id") -> DataFrame:
    """Questions with ``evidence``: whether a dense hit (query, rank, distance) among the first lies within the threshold; lexical hits are not among them."""
    near = hits.where((F.col("rank") <= top) & (F.col("distance") <= threshold)).select(query).distinct().withColumn("evidence", F.lit(True))
    return questions.join(near, query, "left").withColumn("evidence", F.coalesce("evidence", F.lit(False)))


def guarded_route(route: Column, origin: Column, evidence: Column) -> Column:
    """struct(route, intent, origin): a question held out of domain goes to retrieval if there is evidence."""
    turned = (route == "out_of_domain") & evidence
    return F.struct(
        F.when(turned, "retrieve").otherwise(route).alias("route"), F.when(turned, "puntual").alias("intent"),
        F.when(turned, F.concat(origin, F.lit("+evidence_guard"))).otherwise(origin).alias("origin"),
    )


def asks_second_source(question: Column, least: int = 12) -> Column:
    return F.length(F.trim(F.coalesce(question, F.lit("")))) >= least


def preflight(hits: DataFrame, threshold: float, least: int, query: str = "query_id") -> DataFrame:
    """query, n_near and ok: whether enough of the hits are within the threshold."""
    return hits.groupBy(query).agg(F.count_if(F.col("distance") <= threshold).alias("n_near")).withColumn("ok", F.col("n_near") >= least)


def listing(rows: DataFrame, k: int | None = None) -> DataFrame:
    """Distinct (source, page, title), as many as asked for: 1 to 20, 5 if not said."""
    return rows.select("source", "page", "title").distinct().orderBy("source", "page", "title").limit(min(20, max(1, 5 if k is None else k)))


def token_usage(calls: DataFrame, key: str) -> DataFrame:
    """Sums of prompt and answer tokens; what is missing counts nothing."""
    zero = lambda c: F.sum(F.coalesce(c, F.lit(0))).alias(c)
    return calls.groupBy(key).agg(zero("prompt_tokens"), zero("completion_tokens"), F.sum(F.coalesce("prompt_tokens", F.lit(0)) + F.coalesce("completion_tokens", F.lit(0))).alias("total_tokens"))


def agent_settings(requests: DataFrame, agents: DataFrame, defaults: dict[str, object], key: str = "agent_key") -> DataFrame:
    """Requests with each agent's own settings, the default where an agent has none.  ``agents`` is a table of a row for each agent."""
    own = agents.select(key, *(F.col(c).alias(f"_own_{c}") for c in defaults))
    return requests.join(own, key, "left").select(*requests.columns, *(F.coalesce(f"_own_{c}", F.lit(v)).alias(c) for c, v in defaults.items()))


def largest(candidates: DataFrame, keys: list[str], area: str = "area") -> DataFrame:
    """Of each key the candidate of the largest area, the first on a tie."""
    order = W.partitionBy(*keys).orderBy(F.col(area).desc(), "ord")
    return candidates.withColumn("_n", F.row_number().over(order)).where("_n = 1").drop("_n")


def table_regions(pages: DataFrame, found: DataFrame) -> DataFrame:
    """The region of a table on its page: from four points above its left-most, then top-most mention to the end of the page; without one the whole page."""
    keys = ["doc_id", "page", "table_id"]
    first = found.groupBy(*keys).agg(F.min(F.struct("x0", "y0"))["y0"].alias("_y"))
    return pages.join(first, keys, "left").select(*keys, F.lit(0.0).alias("x0"), F.greatest(F.lit(0.0), F.coalesce(F.col("_y") - 4, F.lit(0.0))).alias("y0"), F.col("width").alias("x1"), F.col("height").alias("y1"))


def page_columns(pages: DataFrame, profile: DataFrame) -> DataFrame:
    """Pages with the number of columns that their profile states, one if there is none."""
    return pages.join(profile.select("doc_id", "page", "columns"), ["doc_id", "page"], "left").withColumn("columns", F.coalesce("columns", F.lit(1)))


def document_summaries(segments: DataFrame, doc: str = "doc_id") -> DataFrame:
    """One row for each document: segments, characters, pages and the kinds of its segments with their numbers."""
    kinds = segments.groupBy(doc, "kind").agg(F.count("*").alias("n"), F.sum(F.length("text")).alias("chars"), F.max("page_end").alias("last"))
    listed = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("kind", "n"))), lambda x: F.concat_ws("=", x["kind"], x["n"].cast("string"))), ",")
    return kinds.groupBy(doc).agg(F.sum("n").alias("n_segments"), F.sum("chars").alias("n_chars"), F.max("last").alias("n_pages"), listed.alias("kinds"))

"""From questions to answers in batches: rewriting guards, prompts, extractive answers, a bounded search loop, the final payload."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioscope.functions.markup import for_channel
from folioscope.operators.language import citations, classified

# Phrases of answers without a model.
NO_EVIDENCE = "No tengo evidencia en los documentos."
EVIDENCE_HEAD = "Con base en los documentos, encontré lo siguiente:"
NO_HISTORY = "(sin historial)"
FIXED_ANSWERS = {"smalltalk": "¡Hola! ¿En qué puedo ayudarte?", "ambiguous": "¿Puedes precisar tu pregunta?", "out_of_domain": "Eso está fuera de mi dominio."}


def rewritten(question: Column, candidate: Column) -> Column:
    """A rewrite, unless it is empty or out of proportion."""
    fits = (F.trim(candidate) != "") & (F.length(candidate) <= F.greatest(F.lit(300), 4 * F.length(question)))
    return F.when(F.coalesce(fits, F.lit(False)), F.trim(candidate)).otherwise(question)


def context(hits: DataFrame, query: str = "query_id", with_source: bool = True) -> DataFrame:
    """(query, context): numbered quoted blocks in rank order."""
    head = F.concat(F.lit("["), F.col("rank").cast("string"), F.lit("] "), F.concat_ws(", p. ", "source", F.col("page").cast("string")) if with_source else F.lit(""), F.lit("\n"))
    block = F.concat(head, F.lit('"'), F.col("text"), F.lit('"'))
    return hits.groupBy(query).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", block.alias("b")))), lambda x: x["b"]), "\n\n").alias("context"))


def prompts(questions: DataFrame, contexts: DataFrame, histories: DataFrame, query: str = "query_id") -> DataFrame:
    """(query, prompt): evidence, history, the question last."""
    joined = questions.join(contexts, query, "left").join(histories, query, "left")
    return joined.select(query, F.concat_ws("\n\n", "context", F.coalesce("history", F.lit(NO_HISTORY)), "question").alias("prompt"))


def extractive(questions: DataFrame, hits: DataFrame, query: str = "query_id", cited: bool = False, cut: int = 350) -> DataFrame:
    """(query, answer): the first characters of each hit as a list; a fixed phrase without hits."""
    text = F.replace(F.trim("text"), F.lit("\n"), F.lit(" "))
    short = F.when(F.length(text) > cut, F.concat(F.substring(text, 1, cut), F.lit("..."))).otherwise(text)
    source = F.concat(F.lit(" ["), F.coalesce("source", F.lit("?")), F.lit(", p"), F.coalesce(F.col("page").cast("string"), F.lit("0")), F.lit("]")) if cited else F.lit("")
    listed = hits.groupBy(query).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", F.concat(F.lit("- "), short, source).alias("l")))), lambda x: x["l"]), "\n").alias("_list"))
    return questions.join(listed, query, "left").select(query, F.when(F.col("_list").isNull(), NO_EVIDENCE).otherwise(F.concat(F.lit(EVIDENCE_HEAD + "\n"), "_list")).alias("answer"))


def searched_until_found(questions: DataFrame, search: Callable[[DataFrame], DataFrame], broaden: Callable[[Column, int], Column], rounds: int = 4, query: str = "query_id") -> DataFrame:
    """Hits of a bounded loop: each round asks again, more broadly, only for the questions without a hit."""
    open_, found = questions, None
    for turn in range(rounds):
        hits = search(open_.withColumn("text", broaden(F.col("text"), turn))).withColumn("round", F.lit(turn + 1))
        found = hits if found is None else found.unionByName(hits)
        open_ = questions.join(found.select(query).distinct(), query, "left_anti")
        if turn + 1 < rounds and open_.isEmpty():
            break
    return found


def answered(questions: DataFrame, hits: DataFrame, query: str = "query_id", channel: str = "telegram") -> DataFrame:
    """(query, intent, route, format, answer, sources): routes that need no evidence get their fixed answer, the rest an extractive one with citations."""
    routed = classified(questions)
    asked = routed.where("route = 'retrieval'")
    own = hits.join(asked.select(query), query, "left_semi")
    drafts = extractive(asked, own, query)
    sources = citations(own.withColumnRenamed("rank", "ord"), query=query).groupBy(query).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "line"))), lambda x: x["line"]), "\n").alias("sources"))
    fixed = F.element_at(F.create_map(*[F.lit(x) for kv in FIXED_ANSWERS.items() for x in kv]), F.col("route"))
    joined = routed.join(drafts, query, "left").join(sources, query, "left").withColumn("_out", for_channel(F.coalesce("answer", fixed), F.lit(channel)))
    return joined.select(query, "intent", "route", F.col("_out.format").alias("format"), F.col("_out.text").alias("answer"), F.coalesce("sources", F.lit("")).alias("sources"))

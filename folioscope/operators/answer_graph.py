"""The graph of an answer for a batch of questions: branches that part by route, search side by side and meet again.

Each question takes one way: it is classified (a question held out of domain goes on if there is evidence), its
sources are asked side by side, what they return meets with a status, and it leaves as a table, in full, enriched
or with the phrase for no evidence.  The state of a question is one row; every node adds columns or joins rows by
the question's key, so a batch runs through the graph as a handful of joins, whatever its size.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from folioscope.lineage import cut
from folioscope.operators.answers import EVIDENCE_HEAD, FIXED_ANSWERS, NO_EVIDENCE
from folioscope.operators.evidence import asks_second_source, guarded_route, has_evidence
from folioscope.operators.language import classified, source_flags
from folioscope.settings import Settings

#: Characters of a fragment in an extractive answer.
FRAGMENT = 350


@dataclass(frozen=True)
class Sources:
    """What the branches return: dense and lexical hits (query, doc_id, source, page, text, rank, distance), and answers of the other sources (query, answer, status)."""

    hits: DataFrame
    notebook: DataFrame | None = None
    files: DataFrame | None = None


def routed(questions: DataFrame, dense: DataFrame, settings: Settings, query: str = "query_id") -> DataFrame:
    """Questions with intent, route and origin; one that is out of domain by its wording is kept if the index has evidence."""
    asked = has_evidence(classified(questions, model_intent="model_intent", model_confidence="model_confidence"), dense, settings.distance_threshold, 3, query)
    turned = guarded_route(F.col("route"), F.col("decided_by"), F.col("evidence"))
    out = asked.withColumn("_g", turned)
    route = F.when(F.col("_g.route") == "retrieve", "retrieval").otherwise(F.col("_g.route"))
    return out.withColumns({"route": route, "intent": F.coalesce("_g.intent", "intent"), "origin": F.col("_g.origin")}).drop("_g", "decided_by")


def evidence(asked: DataFrame, sources: Sources, settings: Settings, query: str = "query_id") -> DataFrame:
    """Per question that is retrieved for: its hits in order, the second source's answer, and a status for each branch.

    As many hits count as the question's kind allows: ``top_k_full`` if it wants all, else ``top_k``.  A branch
    that was not asked is ``off``, one that returned nothing ``empty``, one that failed keeps its own status.
    If no source that was asked for can be, the index is.
    """
    flags = asked.withColumn("_f", source_flags(F.col("source_setting")))
    second = F.when(F.col("_f.primary") == "files", "files").otherwise("notebook")
    long_enough = asks_second_source(F.col("question"))
    able = {"notebook": sources.notebook is not None, "files": sources.files is not None}
    ask = {n: F.col(f"_f.{n}") & F.lit(able[n]) & long_enough for n in able}
    flags = flags.withColumns({"_notebook": ask["notebook"], "_files": ask["files"], "second": second})
    flags = flags.withColumn("_index", F.col("_f.index") | ~(F.col("_notebook") | F.col("_files"))).drop("_f")
    most = F.when(F.col("wants_full"), settings.top_k_full).otherwise(settings.top_k)
    few = sources.hits.join(flags.where("_index").select(query, most.alias("_k")), query).where(F.col("rank") <= F.col("_k"))
    # The same page counts once, at its best rank.
    once = few.withColumn("_n", F.row_number().over(W.partitionBy(query, "source", "page").orderBy("rank", "doc_id"))).where("_n = 1")
    placed = once.withColumn("place", F.row_number().over(W.partitionBy(query).orderBy("rank", "doc_id")))
    hits = placed.groupBy(query).agg(F.array_sort(F.collect_list(F.struct("place", "doc_id", "source", "page", "text"))).alias("hits"))
    out = flags.join(hits, query, "left").withColumn("index_status", F.when(~F.col("_index"), "off").when(F.col("hits").isNull(), "empty").otherwise("ok"))
    for name, answers in (("notebook", sources.notebook), ("files", sources.files)):
        if answers is None:
            out = out.withColumns({f"{name}_status": F.when(F.col(f"_{name}"), "empty").otherwise("off"), f"_{name}_answer": F.lit(None).cast("string")})
            continue
        own = answers.select(query, F.col("answer").alias(f"_{name}_answer"), F.col("status").alias("_status"))
        out = out.join(own, query, "left")
        said = F.trim(F.coalesce(f"_{name}_answer", F.lit(""))) != ""
        status = F.when(~F.col(f"_{name}"), "off").when(F.col("_status").isNotNull() & (F.col("_status") != "ok"), F.col("_status")).when(said, "ok").otherwise("empty")
        out = out.withColumn(f"{name}_status", status).withColumn(f"_{name}_answer", F.when(status == "ok", F.trim(f"_{name}_answer"))).drop("_status")
    answer = F.when(F.col("second") == "files", F.col("_files_answer")).otherwise(F.col("_notebook_answer"))
    return out.withColumn("second_answer", answer).drop("_notebook", "_files", "_index", "_notebook_answer", "_files_answer")


def drafted(met: DataFrame, drafts: DataFrame | None = None, query: str = "query_id", fragment: int = FRAGMENT) -> DataFrame:
    """``answer``, ``status`` and ``route`` where the branches meet.

    ``drafts`` (query, draft, draft_status): what a model made of the evidence.  Without one, or if it failed, is
    empty or denies evidence that there is, the answer is put together from the fragments; the status says so.
    Media without evidence are answered from the question alone; all else without evidence has no context.
    """
    drafts = met.sparkSession.createDataFrame([], f"{query} {met.schema[query].dataType.simpleString()}, draft string, draft_status string") if drafts is None else drafts
    rows = met.join(drafts, query, "left")
    quoted = F.transform("hits", lambda h: F.concat(F.lit("- "), F.when(F.length(h["text"]) > fragment, F.concat(F.substring(h["text"], F.lit(1), F.lit(fragment)), F.lit("..."))).otherwise(h["text"])))
    parts = F.array_compact(F.array(F.when(F.col("second") == "files", F.col("second_answer")), F.when(F.col("hits").isNotNull(), F.concat(F.lit(EVIDENCE_HEAD + "\n"), F.array_join(quoted, "\n"))), F.when(F.col("second") != "files", F.col("second_answer"))))
    rows = rows.withColumns({"_none": F.col("hits").isNull() & F.col("second_answer").isNull(), "_simple": F.array_join(parts, "\n\n"), "_draft": F.trim(F.coalesce("draft", F.lit("")))})
    good = (F.coalesce("draft_status", F.lit("ok")) == "ok") & (F.col("_draft") != "") & ~F.startswith(F.col("_draft"), F.lit(NO_EVIDENCE))
    media = F.col("_none") & F.col("media").isin("image", "voice")
    status = F.when(media, "media_only").when(F.col("_none"), "no_evidence").when(good, "ok").when(F.coalesce("draft_status", F.lit("ok")) != "ok", F.concat("draft_status", F.lit("->simple"))).otherwise("simple")
    answer = F.when(media, F.when(F.col("_draft") != "", F.col("_draft")).otherwise(F.col("question"))).when(F.col("_none"), NO_EVIDENCE).when(good, F.col("_draft")).otherwise(F.col("_simple"))
    rows = rows.withColumns({"status": status, "answer": answer})
    return rows.withColumn("route", F.when(F.col("status") == "no_evidence", "no_context").otherwise("answer")).drop("_none", "_simple", "_draft", "draft", "draft_status")


def finished(rows: DataFrame, query: str = "query_id") -> DataFrame:
    """``exit``: the node that a question leaves by; administrators get a header and the list of sources with their answer."""
    leave = F.when(F.col("route") == "no_context", "no_context").when(F.col("wants_table"), "table").when(F.col("wants_full"), "suggest").otherwise("enrich")
    listed = F.array_join(F.array_distinct(F.transform("hits", lambda h: F.concat(F.lit("- "), F.coalesce(h["source"], F.lit("?")), F.lit(", p"), F.coalesce(h["page"].cast("string"), F.lit("0"))))), "\n")
    header = F.concat(F.lit("["), "intent", F.lit(" · "), "origin", F.lit(" · "), "status", F.lit("]\n"))
    admin = F.col("is_admin") & (F.col("route") == "answer")
    text = F.when(admin, F.concat(header, "answer", F.when(F.col("hits").isNotNull(), F.concat(F.lit("\n\nFuentes:\n"), listed)).otherwise(F.lit("")))).otherwise(F.col("answer"))
    return rows.withColumns({"exit": leave, "answer": text, "n_hits": F.coalesce(F.size("hits"), F.lit(0))})


OUT = ("intent", "origin", "route", "index_status", "notebook_status", "files_status", "status", "exit", "n_hits", "answer")


def answered(questions: DataFrame, dense: DataFrame, sources: Sources, settings: Settings | None = None, drafts: DataFrame | None = None, query: str = "query_id") -> DataFrame:
    """One row of ``OUT`` for each question (query, question, source_setting, media, is_admin, model_intent, model_confidence)."""
    settings = settings or Settings.load()
    way = cut(routed(questions, dense, settings, query))
    met = cut(evidence(way.where("route = 'retrieval'"), sources, settings, query))
    through = finished(drafted(met, drafts, query), query).select(query, *OUT)
    fixed = F.element_at(F.create_map(*[F.lit(x) for kv in FIXED_ANSWERS.items() for x in kv]), F.col("route"))
    off = [F.lit("off").alias(f"{n}_status") for n in ("index", "notebook", "files")]
    short = way.where("route != 'retrieval'").select(query, "intent", "origin", "route", *off, F.lit("fixed").alias("status"), F.lit("stylist").alias("exit"), F.lit(0).alias("n_hits"), fixed.alias("answer"))
    return through.unionByName(short)

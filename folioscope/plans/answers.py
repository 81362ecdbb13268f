"""Queries over model output, markup and answers."""

from __future__ import annotations

from pyspark.sql import functions as F

from folioscope.functions import json_text, markup
from folioscope.operators import answer_graph as graph
from folioscope.operators import answers as ops
from folioscope.operators.language import history_text
from folioscope.operators.search import best_documents, knn_blocks, ranked
from folioscope.plans.search import _bm25_sql, _knn_sql, stored_index
from folioscope.settings import Settings
from folioscope.sources.adapters import HashingEmbedder, embedded
from folioscope.sources.tables import table

RAW = (
    (1, '```json\n{"title": "T", "headers": ["a", "b"], "rows": [["1", "2"], ["3"]]}\n```'),
    (2, 'Aqui va: {"headers": ["a", "b"], "rows": [["1", "2"], ["3", "4"], ["5'),
    (3, '{"headers": [], "rows": []}'), (4, "sin json"), (5, None), (6, '{"headers": ["a"], "rows": [[null], ["x", "y"]], "title": 3}'),
)
LISTS = ((1, '["uno?", " dos? ", "tres?", "cuatro?"]'), (2, 'claro: ["uno?", "dos?", "tr'), (3, "nada"), (4, '[1, "", "x"]'))
MARKED = (
    (1, "# Título\n**negrita** y *cursiva* con `x<y`\n- uno\n- dos", "telegram"), (2, "a <b>b</b> <div>c</div> <600V & más", "telegram"), (3, "<pre>1 | 2</pre>\n```sql\na < b\n```", "telegram"),
    (4, "ver [guía](https://x.org/?a=1&b=2)", "telegram"), (5, "<pre>t</pre> &lt;x&gt; <i>y</i>", "whatsapp"), (6, "uno\n\ndos\ntres", "web"), (7, "<b>", "otro"),
)
STREAM = 'event: x\ndata: {"id": 1, "result": {"a": 1}}\ndata: [DONE]\ndata: {"id": 2}\ndata: {"id": 3, "error": "e"}\nend'


def model_tables(spark, sf):
    rows = spark.createDataFrame(list(RAW), "id int, raw string").select("id", json_text.model_table(F.col("raw")).alias("t"))
    return rows.select("id", "t.title", F.array_join("t.headers", "|").alias("headers"), F.array_join(F.transform("t.rows", lambda r: F.array_join(r, ",")), ";").alias("rows"), "t.repaired")


def suggestion_lists(spark, sf):
    return spark.createDataFrame(list(LISTS), "id int, raw string").select("id", F.array_join(json_text.suggestions(F.col("raw")), "|").alias("suggestions"))


def stream_events(spark, sf):
    return spark.createDataFrame([(STREAM,)], "s string").select(F.get_json_object(json_text.last_event(F.col("s")), "$.id").alias("id"))


def channel_formats(spark, sf):
    out = spark.createDataFrame(list(MARKED), "id int, text string, channel string").select("id", markup.for_channel(F.col("text"), F.col("channel")).alias("o"))
    return out.select("id", "o.text", "o.format")


def split_messages(spark, sf):
    """Messages of every document: all of its characters but white space, and none longer than the limit."""
    parts = table(spark, sf, "documents").select("doc_id", F.explode(markup.messages(F.col("text"), 1000)).alias("text"))
    return parts.groupBy("doc_id").agg(F.sum(F.length(F.regexp_replace("text", r"\s+", ""))).alias("n_letters"), (F.max(F.length("text")) <= 1000).alias("within"))


def _questions(spark, sf):
    return table(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("question"), "text")


def _hits(spark, sf, questions):
    found = best_documents(stored_index(spark, sf), questions, 4)
    return found.join(table(spark, sf, "documents").select("doc_id", "source", "text"), "doc_id").select("query_id", "rank", "source", F.col("doc_id").alias("page"), "text")


def answer_batch(spark, sf):
    asked = _questions(spark, sf)
    return ops.answered(asked.drop("text"), _hits(spark, sf, asked)).select("query_id", "intent", "route", "format", F.length("answer").alias("n_chars"), "sources")


def prompt_batch(spark, sf):
    asked = _questions(spark, sf)
    histories = history_text(table(spark, sf, "conversations")).withColumnRenamed("conv_id", "query_id")
    return ops.prompts(asked, ops.context(_hits(spark, sf, asked)), histories).select("query_id", F.sha2("prompt", 256).alias("digest"), F.length("prompt").alias("n_chars"))


def broadened_search(spark, sf):
    """Questions are cut to their first half, quarter, eighth of words until something is found."""
    words = lambda c, turn: F.array_join(F.slice(F.split(c, " "), F.lit(1), F.greatest(F.lit(1), (F.size(F.split(c, " ")) / (1 << turn)).cast("int"))), " ")
    found = ops.searched_until_found(_questions(spark, sf).drop("question"), lambda q: best_documents(stored_index(spark, sf), q, 4), words)
    return found.select("query_id", "doc_id", "rank", "round")


def embedded_documents(spark, sf):
    """Stand-in vectors of all documents: how long they are and how many are zero."""
    v = table(spark, sf, "documents").select("doc_id", embedded(F.col("text"), HashingEmbedder()).alias("v"))
    return v.select("doc_id", F.size("v").alias("dimension"), F.exists("v", lambda x: x != 0).alias("filled"))


def answer_graph(spark, sf):
    """Every benchmark question through the graph: greetings, tables, lists and questions that a model holds out of domain; four settings of the sources, two branches, drafts of three kinds."""
    items = table(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), "text")
    i = F.col("query_id")
    asked = items.select(
        "query_id", "text",
        F.when(i % 8 == 0, "Hola").when(i % 8 == 1, F.concat(F.lit("Dame la tabla de "), "text")).when(i % 8 == 2, F.concat(F.lit("Dame todos los requisitos de "), "text")).otherwise(F.col("text")).alias("question"),
        F.element_at(F.array(*map(F.lit, ("chroma", "notebooklm", "gemini", "both"))), (i % 4 + 1).cast("int")).alias("source_setting"),
        F.lit(None).cast("string").alias("media"), (i % 2 == 0).alias("is_admin"),
        F.when(i % 8 == 3, "fuera_de_dominio").alias("model_intent"), F.when(i % 8 == 3, 0.9).alias("model_confidence"),
    )
    vectors = table(spark, sf, "embeddings")
    own = vectors.join(items.select(i.alias("vec_id")), "vec_id", "left_semi").withColumnRenamed("vec_id", "query_id")
    others = knn_blocks(vectors, own, 4).where("vec_id != query_id").drop("rank")
    dense = ranked(others, "query_id", [F.col("distance"), F.col("vec_id")]).withColumn("distance", F.col("distance") / 1e6)
    found = best_documents(stored_index(spark, sf), items, 12)
    hits = found.join(table(spark, sf, "documents").select("doc_id", "source", "text"), "doc_id").select("query_id", "doc_id", "rank", "source", (F.col("doc_id") % 2).alias("page"), "text")
    said = items.select("query_id", F.when(i % 5 == 0, None).otherwise(F.concat(F.lit(" N"), i.cast("string"))).alias("answer"), F.when(i % 5 == 0, "timeout").when(i % 5 == 1, "ok").alias("status"))
    drafts = items.select("query_id", F.when(i % 3 == 0, F.concat(F.lit("Borrador "), i.cast("string"))).when(i % 3 == 2, ops.NO_EVIDENCE).alias("draft"), F.when(i % 3 == 1, "timeout").otherwise("ok").alias("draft_status"))
    out = graph.answered(asked.drop("text"), dense, graph.Sources(hits, said), Settings(), drafts)
    return out.select("query_id", *(c for c in graph.OUT if c != "answer"), F.sha2("answer", 256).alias("digest"))


_GRAPH_SQL = f"""WITH {_bm25_sql(12)}, {_knn_sql(4, queries="vec_id IN (SELECT item_id FROM benchmark)")},
near AS (SELECT query_id, bool_or(distance <= 450000) AS evidence FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, vec_id) AS r FROM knn WHERE vec_id <> query_id) WHERE r <= 3 GROUP BY 1),
q AS (SELECT b.item_id AS i, b.text, coalesce(evidence, false) AS evidence, CASE b.item_id % 8 WHEN 1 THEN 'Dame la tabla de ' || b.text WHEN 2 THEN 'Dame todos los requisitos de ' || b.text ELSE b.text END AS question,
  ['index', 'notebook', 'files', 'both'][b.item_id % 4 + 1] AS s FROM benchmark b LEFT JOIN near n ON n.query_id = b.item_id),
r AS (SELECT *, CASE WHEN i % 8 = 0 THEN 'smalltalk' WHEN i % 8 = 1 THEN 'tabla' WHEN i % 8 = 2 THEN 'exhaustiva' WHEN i % 8 = 3 AND NOT evidence THEN 'fuera_de_dominio' ELSE 'puntual' END AS intent,
  CASE WHEN i % 8 = 3 THEN CASE WHEN evidence THEN 'model+evidence_guard' ELSE 'model' END ELSE 'regex' END AS origin,
  s IN ('notebook', 'both') AND length(trim(question)) >= 12 AS nb FROM q),
e AS (SELECT *, s <> 'notebook' OR NOT nb AS ix, CASE WHEN NOT nb THEN 'off' WHEN i % 5 = 0 THEN 'timeout' ELSE 'ok' END AS notebook_status FROM r WHERE intent NOT IN ('smalltalk', 'fuera_de_dominio')),
h AS (SELECT query_id, rank, doc_id, source, documents.text, row_number() OVER (PARTITION BY query_id, source, doc_id % 2 ORDER BY rank) AS n FROM bm25 JOIN documents USING (doc_id) JOIN e ON e.i = query_id WHERE ix AND rank <= CASE WHEN intent = 'exhaustiva' THEN 12 ELSE 4 END),
l AS (SELECT query_id, count(*) AS n_hits, string_agg('- ' || CASE WHEN length(text) > 350 THEN text[1:350] || '...' ELSE text END, chr(10) ORDER BY rank) AS quoted,
  string_agg('- ' || coalesce(source, '?') || ', p' || (doc_id % 2), chr(10) ORDER BY rank) AS listed FROM h WHERE n = 1 GROUP BY 1),
m AS (SELECT e.*, coalesce(n_hits, 0)::INT AS n_hits, quoted, listed, CASE WHEN notebook_status = 'ok' AND s <> 'files' THEN 'N' || i END AS second, CASE WHEN NOT ix THEN 'off' WHEN quoted IS NULL THEN 'empty' ELSE 'ok' END AS index_status FROM e LEFT JOIN l ON query_id = i),
d AS (SELECT *, CASE WHEN quoted IS NULL AND second IS NULL THEN 'no_evidence' WHEN i % 3 = 0 THEN 'ok' WHEN i % 3 = 1 THEN 'timeout->simple' ELSE 'simple' END AS status FROM m),
a AS (SELECT *, CASE status WHEN 'no_evidence' THEN '{ops.NO_EVIDENCE}' WHEN 'ok' THEN 'Borrador ' || i ELSE concat_ws(chr(10) || chr(10), '{ops.EVIDENCE_HEAD}' || chr(10) || quoted, second) END AS answer FROM d),
o AS (SELECT i, intent, origin, CASE status WHEN 'no_evidence' THEN 'no_context' ELSE 'answer' END AS route, index_status, notebook_status, 'off' AS files_status, status,
  CASE WHEN status = 'no_evidence' THEN 'no_context' WHEN intent = 'tabla' THEN 'table' WHEN intent = 'exhaustiva' THEN 'suggest' ELSE 'enrich' END AS exit, n_hits,
  CASE WHEN i % 2 = 0 AND status <> 'no_evidence' THEN '[' || intent || ' · ' || origin || ' · ' || status || ']' || chr(10) || answer || coalesce(chr(10) || chr(10) || 'Fuentes:' || chr(10) || listed, '') ELSE answer END AS answer FROM a
  UNION ALL SELECT i, intent, origin, CASE intent WHEN 'smalltalk' THEN 'smalltalk' ELSE 'out_of_domain' END, 'off', 'off', 'off', 'fixed', 'stylist', 0,
  CASE intent WHEN 'smalltalk' THEN '{ops.FIXED_ANSWERS["smalltalk"]}' ELSE '{ops.FIXED_ANSWERS["out_of_domain"]}' END FROM r WHERE intent IN ('smalltalk', 'fuera_de_dominio'))
SELECT i AS query_id, intent, origin, route, index_status, notebook_status, files_status, status, exit, n_hits, sha256(answer) AS digest FROM o"""


ORACLES = {
    "answer_graph": _GRAPH_SQL,
    "split_messages": r"SELECT doc_id, length(regexp_replace(coalesce(text, ''), '\s+', '', 'g')) AS n_letters, true AS within FROM documents",
    "model_tables": "SELECT * FROM (VALUES (1, 'T', 'a|b', '1,2;3,', false), (2, NULL, 'a|b', '1,2;3,4;5,', true), (3, NULL, NULL, NULL, NULL), (4, NULL, NULL, NULL, NULL), (5, NULL, NULL, NULL, NULL), (6, NULL, 'a', ';x', false)) t(id, title, headers, rows, repaired)",
    "suggestion_lists": "SELECT * FROM (VALUES (1, 'uno?|dos?|tres?'), (2, 'uno?|dos?'), (3, ''), (4, 'x')) t(id, suggestions)",
    "stream_events": "SELECT '3' AS id",
    "channel_formats": "SELECT id, replace(text, '\\n', chr(10)) AS text, format FROM (VALUES (1, '<b>Título</b>\\n<b>negrita</b> y <i>cursiva</i> con <code>x&lt;y</code>\\n• uno\\n• dos', 'telegram_html'), (2, 'a <b>b</b> c &lt;600V &amp; más', 'telegram_html'), (3, '<pre>1 | 2</pre>\\n<pre>a &lt; b</pre>', 'telegram_html'), (4, 'ver <a href=\"https://x.org/?a=1&amp;b=2\">guía</a>', 'telegram_html'), (5, '```t``` <x> y', 'whatsapp_text'), (6, '<p>uno</p>\\n<p>dos<br>tres</p>', 'web_html'), (7, '<b>', 'plain_text')) t(id, text, format)",
}
QUERIES = {name: globals()[name] for name in [*ORACLES, "answer_batch", "prompt_batch", "broadened_search", "embedded_documents"]}

"""Queries over metadata shaping, answer cleaning, evidence and the stored index."""

from __future__ import annotations

from pyspark.sql import functions as F

from folioscope.operators import evidence, services
from folioscope.operators import metadata as ops
from folioscope.operators.lexical_index import LexicalIndex
from folioscope.operators.search import best_documents, knn_blocks, scaled
from folioscope.plans import search
from folioscope.sources.tables import inline, inline_sql, table

ANSWERS = (
    "(1, concat('Texto [1] con  citas [2, p. 4].', chr(10), 'Fuentes:', chr(10), '1. a')), (2, concat('<pre>a   b</pre>', chr(10), chr(10), chr(10), 'fin [3-5, 7]')), "
    "(3, concat('uno <pre>x  y</pre> dos  tres', chr(10), ' SOURCES :', chr(10), '<pre>z</pre>')), (4, 'nada [abc] [12345]'), (5, '')"
)
READINGS = "(1, concat('1. ¿Cual es la altura minima?', chr(10), 'A. 3 m', chr(10), 'B) 5 m')), (2, concat('corta', chr(10), 'una linea bastante larga de texto')), (3, 'Verdadero o falso'), (4, '¿que?'), (5, NULL)"
REFUSALS = "(1, '{\"error\": {\"param\": \"max_tokens\"}}', 'x'), (2, NULL, 'Error: {''param'': ''temperature''}'), (3, '{\"param\": \"top_p\"}', ''), (4, '{}', 'Unsupported value: ''stop'' here'), (5, NULL, 'nothing')"
CELLS = "(0, '  a  b '), (5, concat('x', chr(10), 'y')), (19, 'una celda que es demasiado larga'), (20, NULL)"
RECTS = "(1, 1, 0.0, 0.0, 100.0, 80.0, 10000.0), (1, 1, 0.0, 0.0, 10.0, 10.0, 10000.0), (1, 2, 0.0, 0.0, 50.0, 70.0, 10000.0), (2, 1, 5.0, 5.0, 15.0, 15.0, 10000.0), (2, 2, 0.0, 0.0, 1.0, 1.0, 0.0)"
MENTIONS = "(1, 1, 'T1', 50.0, 10.0), (1, 1, 'T1', 20.0, 300.0), (1, 1, 'T1', 20.0, 120.0), (1, 2, 'T2', 0.0, 2.0)"


def _docs(spark, sf):
    return table(spark, sf, "documents")


def normalised_metadata(spark, sf):
    rows = _docs(spark, sf).select(
        "doc_id", F.expr("CASE doc_id % 3 WHEN 0 THEN source WHEN 1 THEN '' END").alias("source"), F.expr("CASE WHEN doc_id % 2 = 0 THEN lang ELSE '' END").alias("doc_name"),
        F.expr("CASE WHEN doc_id % 5 = 0 THEN n_chars END").alias("page"), (F.col("n_chars") % 50).alias("pagina"),
    )
    return ops.normalised(rows).select("doc_id", "source", "page")


def flat_metadata(spark, sf):
    """Chunks (lines) with their document's fields, as primitives, and what is not null as one JSON object."""
    registry = _docs(spark, sf).select("doc_id", F.col("source").alias("doc_name"), F.col("lang").alias("doc_tipo"), F.expr("CASE WHEN doc_id % 2 = 0 THEN doc_id % 7 END").alias("libro"))
    chunks = _docs(spark, sf).select("doc_id", F.posexplode(F.split("text", "\n")).alias("page", "line"))
    flat = ops.flat_metadata(chunks, registry)
    made = ops.primitives_only(flat.withColumn("pair", F.array("page", "pagina")))
    return made.select("doc_id", "page", "doc_name", "libro", "pair", ops.metadata_json(flat.withColumn("pair", F.lit(0)), ["doc_tipo", "libro", "pagina"]).alias("item"))


def trace_rows(spark, sf):
    hits = _docs(spark, sf).select(
        F.col("lang").alias("query_id"), F.col("doc_id").alias("ord"), F.expr("CASE WHEN doc_id % 4 > 0 THEN n_chars / 8.0 END").cast("double").alias("score"), F.expr("CASE WHEN doc_id % 3 = 0 THEN 'bm25' END").alias("score_type"),
        F.lit(None).cast("string").alias("method"), F.expr("CASE WHEN doc_id % 5 > 0 THEN source END").alias("source"), F.lit(None).cast("int").alias("page"), F.col("doc_id").alias("chunk_id"), "text",
    )
    return ops.trace_rows(hits).select("query_id", "rank", "score", "score_type", "method", "source", "chunk_id", F.length("content").alias("n_chars"))


def source_rows(spark, sf):
    turns = table(spark, sf, "conversations").select("conv_id", F.col("turn").alias("ord"), F.col("role").alias("title"), F.lit("").alias("uri"), F.expr("CASE WHEN turn % 2 = 0 THEN 'nota' END").alias("type"), "text")
    return ops.source_rows(turns, "conv_id", 3)


def question_states(spark, sf):
    asked = table(spark, sf, "benchmark").select("item_id", F.concat(F.lit("  "), "text", F.lit(" ")).alias("question"), F.expr("CASE WHEN item_id % 2 = 0 THEN concat('u', item_id) ELSE '' END").alias("user_id"), F.lit(None).cast("string").alias("session_id"))
    return ops.question_state(asked).withColumn("asks_second", evidence.asks_second_source(F.col("question")))


def document_listing(spark, sf):
    rows = _docs(spark, sf).select("source", (F.col("doc_id") % 3).alias("page"), F.col("lang").alias("title"))
    return evidence.listing(rows, 50)


def event_names(spark, sf):
    """Stamps, version and object names, and merged maps of every event."""
    rows = table(spark, sf, "events")
    merged = ops.merged_maps(F.create_map(F.lit("a"), F.lit("left"), F.lit("b"), F.lit("left")), F.create_map(F.lit("b"), F.col("event_type")))
    return rows.select("event_id", ops.utc_stamp(F.col("ts")).alias("stamp"), ops.version_name(F.col("ts")).alias("version"), ops.object_name(F.lit("media"), F.col("user_id").cast("string"), F.col("ts"), F.lit("png")).alias("object"), F.concat_ws("-", merged["a"], merged["b"]).alias("pair"))


def cleaned_answers(spark, sf):
    return inline(spark, ANSWERS, "id, text").select("id", ops.cleaned_answer(F.col("text")).alias("text"))


def cleaned_turns(spark, sf):
    """Every turn with cites and a sources section added, which the cleaning takes away again."""
    turns = table(spark, sf, "conversations").select("conv_id", "turn", F.regexp_replace("text", r"[\[\]]", "").alias("text"))
    marked = turns.withColumn("text", F.concat("text", F.lit(" [3, p. 12]\n\n\n\n"), "text", F.lit("\nFuentes:\n1. x")))
    return marked.select("conv_id", "turn", F.length(ops.cleaned_answer(F.col("text"))).alias("n_chars"))


def table_cells(spark, sf):
    rows = inline(spark, CELLS, "n, value")
    return rows.select("n", ops.cell(F.col("value"), 18).alias("cut"), ops.cell(F.col("value")).alias("whole"), ops.bullet(F.col("n")).alias("bullet"))


def footnote_lines(spark, sf):
    noted = F.concat(F.lit("* una nota\n"), "text", F.lit("\n(2) otra\nNota: tres\nFuente del dato\nNotario"))
    return _docs(spark, sf).select("doc_id", ops.footnotes(noted).alias("notes"), ops.footnotes(F.lit("sin")).alias("none"))


def image_readings(spark, sf):
    rows = inline(spark, READINGS, "id, text")
    read = ops.image_reading(F.col("text"))
    return rows.select("id", read["answer"].alias("answer"), read["options"].alias("options"), ops.image_question(F.col("text"), F.lit("otra")).alias("question"), ops.exam_like(F.col("text")).alias("exam"), ops.asks_about_image(F.col("text")).alias("asks"), F.length(ops.image_prompt(F.col("text"), F.lit(None).cast("string"), F.lit(""))).alias("n_prompt"))


def exam_like_documents(spark, sf):
    return _docs(spark, sf).where(ops.exam_like(F.col("text"))).groupBy("lang").agg(F.count("*").alias("n"), F.count_if(ops.asks_about_image(F.col("text"))).alias("n_asks"))


def refused_parameters(spark, sf):
    rows = inline(spark, REFUSALS, "id, body, message")
    return rows.select("id", ops.unsupported_parameter(F.col("body"), F.col("message")).alias("parameter"), ops.error_detail(F.concat("message", F.lit("\nmore"))).alias("detail"))


def page_profiles(spark, sf):
    """The largest image of every page, as a share of it, what kind of page that makes, and its columns."""
    rects = inline(spark, RECTS, "doc_id, page, x0, y0, x1, y1, area")
    cover = rects.withColumn("cover", ops.image_cover(*(F.col(c).cast("double") for c in ("x0", "y0", "x1", "y1", "area"))))
    pages = cover.groupBy("doc_id", "page").agg(F.max("cover").alias("cover"), F.count("*").alias("n_images"))
    profile = inline(spark, "(1, 1, 2)", "doc_id, page, columns")
    return evidence.page_columns(pages, profile).select("doc_id", "page", scaled(F.col("cover")).alias("cover"), ops.page_kind(F.col("cover")).alias("kind"), "n_images", "columns")


def table_regions(spark, sf):
    pages = inline(spark, "(1, 1, 'T1', 600.0, 800.0), (1, 2, 'T2', 600.0, 800.0), (1, 3, 'T3', 500.0, 700.0)", "doc_id, page, table_id, width, height")
    out = evidence.table_regions(pages, inline(spark, MENTIONS, "doc_id, page, table_id, x0, y0"))
    return out.select("doc_id", "page", "table_id", *(F.col(c).cast("int").alias(c) for c in ("x0", "y0", "x1", "y1")))


def largest_tables(spark, sf):
    """Of the parts of each brand and size the one with the largest price."""
    rows = table(spark, sf, "part").select("p_brand", "p_size", F.col("p_partkey").alias("ord"), F.col("p_retailprice").alias("area"))
    return evidence.largest(rows, ["p_brand", "p_size"]).select("p_brand", "p_size", F.col("ord").alias("p_partkey"))


def asset_chunks(spark, sf):
    """A chunk for each nation as a table of its suppliers."""
    rows = table(spark, sf, "supplier").groupBy("s_nationkey").agg(F.transform(F.array_sort(F.collect_list(F.struct("s_suppkey", "s_name"))), lambda x: F.array(x["s_suppkey"].cast("string"), x["s_name"])).alias("rows"))
    nations = table(spark, sf, "nation").join(rows, F.col("n_nationkey") == F.col("s_nationkey"), "left")
    text = ops.table_chunk(F.lit("atlas"), F.col("n_nationkey").cast("string"), F.col("n_name"), F.when(F.col("n_regionkey") > 1, F.concat(F.lit("region "), F.col("n_regionkey").cast("string"))), F.array(F.lit("clave"), F.lit("nombre")), F.col("rows"))
    return nations.select("n_nationkey", ops.asset_id(F.lit("atlas"), "tabla", F.col("n_name")).alias("chunk_id"), text.alias("text"), F.get_json_object(ops.table_payload(F.col("n_name"), F.array(F.lit("a")), F.col("rows"), F.lit(None).cast("string")), "$.title").alias("title"))


def requested_tables(spark, sf):
    asked = table(spark, sf, "benchmark").select("item_id", F.concat(F.lit("dame la Tabla 220."), F.col("item_id").cast("string"), F.lit(" ya")).alias("question"))
    none = F.array().cast("array<struct<type:string,value:string>>")
    named = F.when(F.col("item_id") % 3 == 0, F.array(F.struct(F.lit("ref").alias("type"), F.lit("1").alias("value")), F.struct(F.lit("tabla").alias("type"), F.lit("9.9").alias("value")))).otherwise(none)
    return asked.select("item_id", ops.requested_table(named, F.col("question")).alias("wanted"), ops.requested_table(none, F.lit("nada")).alias("none"))


def _near(spark, sf, k):
    vectors = table(spark, sf, "embeddings")
    return knn_blocks(vectors, vectors.where("vec_id % 20 = 0").withColumnRenamed("vec_id", "query_id"), k)


def evidence_guard(spark, sf):
    """Questions that were held out of domain and have another vector near go to retrieval."""
    hits = _near(spark, sf, 4).where("query_id != vec_id").withColumn("distance", F.col("distance") / 1e6)
    asked = table(spark, sf, "embeddings").where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.expr("CASE WHEN label % 2 = 0 THEN 'out_of_domain' ELSE 'retrieve' END").alias("route"))
    found = evidence.has_evidence(asked, hits, threshold=0.6, top=4)
    turned = evidence.guarded_route(F.col("route"), F.lit("model"), F.col("evidence"))
    return found.select("query_id", "evidence", turned["route"].alias("route"), turned["intent"].alias("intent"), turned["origin"].alias("origin"))


def preflight(spark, sf):
    return evidence.preflight(_near(spark, sf, 8), 600_000, 3)


def token_usage(spark, sf):
    calls = table(spark, sf, "conversations").select("conv_id", F.expr("CASE role WHEN 'user' THEN length(text) END").alias("prompt_tokens"), F.expr("CASE role WHEN 'assistant' THEN length(text) END").alias("completion_tokens"))
    return evidence.token_usage(calls, "conv_id")


def agent_settings(spark, sf):
    agents = table(spark, sf, "nation").select(F.col("n_nationkey").alias("agent_key"), F.expr("CASE WHEN n_nationkey % 2 = 0 THEN n_regionkey END").alias("top_k"), F.expr("CASE WHEN n_nationkey % 3 = 0 THEN n_name END").alias("model"))
    requests = table(spark, sf, "customer").select("c_custkey", F.col("c_nationkey").alias("agent_key"))
    return evidence.agent_settings(requests, agents, {"top_k": 4, "model": "base"})


def _lines_as_segments(spark, sf):
    lines = _docs(spark, sf).select("doc_id", F.posexplode(F.split("text", "\n")).alias("segment_no", "text"))
    kind = F.when(F.length("text") > 80, "articulo").when(F.length("text") > 0, "linea").otherwise("vacia")
    return lines.select("doc_id", "segment_no", kind.alias("kind"), F.col("segment_no").cast("string").alias("number"), F.col("text").alias("title"), F.lit("").alias("breadcrumb"), (F.col("segment_no") + 1).alias("page_start"), (F.col("segment_no") + 1).alias("page_end"), "text")


def document_summaries(spark, sf):
    return evidence.document_summaries(_lines_as_segments(spark, sf))


def contents_listing(spark, sf):
    return services.contents(_lines_as_segments(spark, sf)).select("doc_id", "segment_no", "kind", F.length("title").alias("n_title"), "page_start", "chars")


def index_build(spark, sf):
    """Document and collection frequencies of a lexical index of all documents: one row for each length of a term."""
    index = LexicalIndex.build(_docs(spark, sf))
    sums = index.postings.groupBy("term").agg(F.count("*").alias("n"), F.sum("tf").alias("tf"))
    return index.terms.join(sums, "term").groupBy(F.length("term").alias("n_letters")).agg(F.count("*").alias("n_terms"), F.sum("df").alias("n_postings"), F.sum("n").alias("n_stored"), F.sum("tf").alias("n_tokens"))


def index_search(spark, sf):
    """Ranked search on the full index."""
    asked = table(spark, sf, "benchmark").withColumnRenamed("item_id", "query_id")
    return best_documents(LexicalIndex.build(_docs(spark, sf)), asked, 4)


_NEAR = """pairs AS (SELECT q.vec_id AS query_id, i.vec_id, floor((1 - list_cosine_similarity(q.embedding::DOUBLE[], i.embedding::DOUBLE[])) * 1e6 + 0.5) AS distance FROM embeddings q, embeddings i WHERE q.vec_id % 20 = 0),
near AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, vec_id) AS rank FROM pairs) WHERE rank <= {k})"""
_TOKENS = "regexp_extract_all(lower(text), '[a-z0-9áéíóúüñ]+')"
_LINES = "SELECT doc_id, unnest(string_split(text, chr(10))) AS text, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS segment_no FROM documents"

ORACLES = {
    "normalised_metadata": """SELECT doc_id, coalesce(nullif(CASE doc_id % 3 WHEN 0 THEN source WHEN 1 THEN '' END, ''), CASE WHEN doc_id % 2 = 0 THEN nullif(lang, '') END, doc_id::VARCHAR) AS source,
coalesce(CASE WHEN doc_id % 5 = 0 THEN n_chars END, n_chars % 50) AS page FROM documents""",
    "flat_metadata": """WITH l AS (SELECT doc_id, source, lang, CASE WHEN doc_id % 2 = 0 THEN doc_id % 7 END AS libro, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS page FROM documents)
SELECT doc_id, page::INT AS page, source AS doc_name, libro, '[' || page || ',' || page || ']' AS pair, '{' || coalesce('"doc_tipo":"' || lang || '",', '') || coalesce('"libro":' || libro || ',', '') || '"pagina":' || page || '}' AS item FROM l""",
    "trace_rows": """SELECT lang AS query_id, CAST(row_number() OVER (PARTITION BY lang ORDER BY doc_id) AS INT) AS rank, round(CASE WHEN doc_id % 4 > 0 THEN n_chars / 8.0 END::DOUBLE, 4) AS score,
CASE WHEN doc_id % 3 = 0 THEN 'bm25' ELSE 'cosine_distance' END AS score_type, 'dense' AS method, coalesce(CASE WHEN doc_id % 5 > 0 THEN source END, 'desconocido') AS source, doc_id AS chunk_id, CAST(length(coalesce(text, '')) AS INT) AS n_chars FROM documents""",
    "source_rows": r"""WITH r AS (SELECT conv_id, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS INT) AS rank, role, turn, nullif(substr(text, 1, 500), '') AS t FROM conversations)
SELECT conv_id, rank, '{"rank":' || rank || coalesce(',"title":' || to_json(nullif(role, '')), '') || CASE WHEN turn % 2 = 0 THEN ',"type":"nota"' ELSE '' END || coalesce(',"text":' || to_json(t), '') || '}' AS item FROM r WHERE rank <= 3""",
    "question_states": "SELECT item_id, trim(text) AS question, CASE WHEN item_id % 2 = 0 THEN 'u' || item_id ELSE 'anon' END AS user_id, 'default' AS session_id, length(trim(text)) >= 12 AS asks_second FROM benchmark",
    "document_listing": "SELECT DISTINCT source, doc_id % 3 AS page, lang AS title FROM documents ORDER BY ALL LIMIT 20",
    "event_names": """SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%SZ') AS stamp, 'v' || strftime(ts, '%Y%m%d-%H%M%S') AS version, 'media/' || user_id || '/' || strftime(ts, '%Y%m%dT%H%M%SZ') || '.png' AS object, 'left-' || event_type AS pair FROM events""",
    "cleaned_answers": r"""SELECT id, replace(text, '~', chr(10)) AS text FROM (VALUES (1, 'Texto con citas .'), (2, '<pre>a   b</pre>~~fin'), (3, 'uno <pre>x  y</pre> dos tres'), (4, 'nada [abc] [12345]'), (5, '')) t(id, text)
WHERE (SELECT count(*) FROM """ + inline_sql(ANSWERS, "id, text") + ") = 5",
    "cleaned_turns": r"""WITH t AS (SELECT conv_id, turn, regexp_replace(text, '[\[\]]', '', 'g') AS text FROM conversations)
SELECT conv_id, turn, CAST(length(regexp_replace(regexp_replace(regexp_replace(text || ' ' || chr(10) || chr(10) || chr(10) || text, '[ \t]{2,}', ' ', 'g'), '\n{3,}', chr(10) || chr(10), 'g'), '^\s+|\s+$', '', 'g')) AS INT) AS n_chars FROM t""",
    "table_cells": f"""WITH c AS (SELECT n, trim(regexp_replace(coalesce(value, ''), '\\s+', ' ', 'g')) AS v FROM {inline_sql(CELLS, 'n, value')})
SELECT n, CASE WHEN length(v) > 18 THEN substr(v, 1, 17) || '…' ELSE v END AS cut, v AS whole, CASE WHEN n < 20 THEN substr('①②③④⑤⑥⑦⑧⑨⑩⑪⑫⑬⑭⑮⑯⑰⑱⑲⑳', n + 1, 1) ELSE (n + 1) || '.' END AS bullet FROM c""",
    "footnote_lines": r"""WITH x AS (SELECT doc_id, list_filter(list_transform(string_split_regex('* una nota' || chr(10) || text || chr(10) || '(2) otra' || chr(10) || 'Nota: tres' || chr(10) || 'Fuente del dato' || chr(10) || 'Notario', '\r?\n'), lambda s: trim(s)),
lambda s: regexp_matches(s, '(?i)^\s*(?:\*+\s|\(\d+\)\s|\d\)\s|Notas?\b|Fuente\b)')) AS l FROM documents) SELECT doc_id, array_to_string(l, ' · ') AS notes, NULL::VARCHAR AS none FROM x""",
    "image_readings": f"""SELECT t.*, CAST(coalesce(length(concat('{ops.IMAGE_PARTS[0]}', text)) + 2, 0) * (text IS NOT NULL)::INT + length('{ops.IMAGE_DEFAULT}') + 2 + length('{ops.IMAGE_END}') AS INT) AS n_prompt
FROM (VALUES (1, 'A', 'A. 3 m ' || chr(10) || 'B) 5 m', '1. ¿Cual es la altura minima?', true, true), (2, '', '', 'una linea bastante larga de texto', false, false), (3, 'VERDADERO', '', 'Verdadero o falso', true, false), (4, '', '', 'otra', false, true), (5, '', '', 'otra', false, false)) t(id, answer, options, question, exam, asks)
JOIN {inline_sql(READINGS, 'id, text')} USING (id)""",
    "exam_like_documents": r"""SELECT lang, count(*) AS n, count(*) FILTER (regexp_matches(lower(text), '\?|¿|(^|[^\p{L}\p{N}_])(qu[eé]|cu[aá]l|cu[aá]les|cu[aá]nto|c[oó]mo|seg[uú]n|tipo|clase|identifica|analiza|interpreta|explica|indica|dime)($|[^\p{L}\p{N}_])')) AS n_asks
FROM documents WHERE regexp_matches(text, '(?i)(pregunta|verdadero|falso|marque|seleccione|opción\s+[A-D]|[a-d]\.)') GROUP BY lang""",
    "refused_parameters": f"""SELECT t.* FROM (VALUES (1, 'max_tokens', 'x'), (2, 'temperature', 'Error: {{''param'': ''temperature''}}'), (3, 'top_p', ''), (4, 'stop', 'Unsupported value: ''stop'' here'), (5, NULL, 'nothing')) t(id, parameter, detail)""",
    "page_profiles": f"""WITH c AS (SELECT doc_id, page, max((x1 - x0) * (y1 - y0) / coalesce(nullif(area, 0), 1)) AS cover, count(*) AS n_images FROM {inline_sql(RECTS, 'doc_id, page, x0, y0, x1, y1, area')} GROUP BY ALL)
SELECT doc_id, page, CAST(floor(cover * 1e6 + 0.5) AS BIGINT) AS cover, CASE WHEN cover >= 0.70 THEN 'escaneada' WHEN cover >= 0.30 THEN 'mixta' ELSE 'texto' END AS kind, n_images, CASE WHEN doc_id = 1 AND page = 1 THEN 2 ELSE 1 END AS columns FROM c""",
    "table_regions": "SELECT * FROM (VALUES (1, 1, 'T1', 0, 116, 600, 800), (1, 2, 'T2', 0, 0, 600, 800), (1, 3, 'T3', 0, 0, 500, 700)) t(doc_id, page, table_id, x0, y0, x1, y1)",
    "largest_tables": "SELECT p_brand, p_size, arg_min(p_partkey, row(-p_retailprice, p_partkey)) AS p_partkey FROM part GROUP BY ALL",
    "asset_chunks": """WITH r AS (SELECT s_nationkey, list(s_suppkey || ' | ' || s_name ORDER BY s_suppkey)[1:3] AS rows FROM supplier GROUP BY 1)
SELECT n_nationkey, 'atlas_tabla_' || regexp_replace(n_name, '[^0-9A-Za-z.()-]', '_', 'g') AS chunk_id,
'[atlas — Tabla ' || n_nationkey || '] ' || n_name || CASE WHEN n_regionkey > 1 THEN chr(10) || 'Pertenece a: region ' || n_regionkey ELSE '' END || chr(10) || 'Columnas: clave | nombre' || coalesce(array_to_string(list_transform(rows, lambda x: chr(10) || 'Fila: ' || x), ''), '') AS text, n_name AS title
FROM nation LEFT JOIN r ON n_nationkey = s_nationkey""",
    "requested_tables": "SELECT item_id, CASE WHEN item_id % 3 = 0 THEN '9.9' ELSE '220.' || item_id END AS wanted, NULL::VARCHAR AS none FROM benchmark",
    "evidence_guard": f"""WITH {_NEAR.format(k=4)}, e AS (SELECT DISTINCT query_id FROM near WHERE query_id <> vec_id AND distance <= 600000),
q AS (SELECT vec_id AS query_id, CASE WHEN label % 2 = 0 THEN 'out_of_domain' ELSE 'retrieve' END AS route, vec_id IN (SELECT query_id FROM e) AS evidence FROM embeddings WHERE vec_id % 20 = 0)
SELECT query_id, evidence, CASE WHEN route = 'out_of_domain' AND evidence THEN 'retrieve' ELSE route END AS route, CASE WHEN route = 'out_of_domain' AND evidence THEN 'puntual' END AS intent, CASE WHEN route = 'out_of_domain' AND evidence THEN 'model+evidence_guard' ELSE 'model' END AS origin FROM q""",
    "preflight": f"WITH {_NEAR.format(k=8)} SELECT query_id, count(*) FILTER (distance <= 600000) AS n_near, count(*) FILTER (distance <= 600000) >= 3 AS ok FROM near GROUP BY query_id",
    "token_usage": """SELECT conv_id, coalesce(sum(length(text)) FILTER (role = 'user'), 0)::BIGINT AS prompt_tokens, coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS completion_tokens, coalesce(sum(length(text)) FILTER (role IN ('user', 'assistant')), 0)::BIGINT AS total_tokens FROM conversations GROUP BY conv_id""",
    "agent_settings": "SELECT c_custkey, c_nationkey AS agent_key, coalesce(CASE WHEN n_nationkey % 2 = 0 THEN n_regionkey END, 4) AS top_k, coalesce(CASE WHEN n_nationkey % 3 = 0 THEN n_name END, 'base') AS model FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey",
    "document_summaries": f"""WITH l AS ({_LINES}), k AS (SELECT doc_id, CASE WHEN length(text) > 80 THEN 'articulo' WHEN length(text) > 0 THEN 'linea' ELSE 'vacia' END AS kind, count(*) AS n, sum(length(text)) AS chars, max(segment_no + 1) AS last FROM l GROUP BY ALL)
SELECT doc_id, sum(n)::BIGINT AS n_segments, sum(chars)::BIGINT AS n_chars, max(last)::INT AS n_pages, string_agg(kind || '=' || n, ',' ORDER BY kind) AS kinds FROM k GROUP BY doc_id""",
    "contents_listing": f"""WITH l AS ({_LINES}) SELECT doc_id, segment_no::INT AS segment_no, CASE WHEN length(text) > 80 THEN 'articulo' WHEN length(text) > 0 THEN 'linea' ELSE 'vacia' END AS kind, CAST(least(120, length(text)) AS INT) AS n_title, CAST(segment_no + 1 AS INT) AS page_start, CAST(length(text) AS INT) AS chars FROM l""",
    "index_build": f"""WITH p AS (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest({_TOKENS}) AS term FROM documents) GROUP BY ALL), t AS (SELECT term, count(*) AS n, sum(tf) AS tf FROM p GROUP BY term)
SELECT CAST(length(term) AS INT) AS n_letters, count(*) AS n_terms, sum(n)::BIGINT AS n_postings, sum(n)::BIGINT AS n_stored, sum(tf)::BIGINT AS n_tokens FROM t GROUP BY 1""",
}
ORACLES["index_search"] = search.ORACLES["bm25_topk"]
QUERIES = {name: globals()[name] for name in ORACLES}

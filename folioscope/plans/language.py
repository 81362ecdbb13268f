"""Queries over questions, answers and conversations."""

from __future__ import annotations

from pyspark.sql import functions as F

from folioscope.functions import text as tx
from folioscope.operators import language as ops
from folioscope.operators.search import scaled
from folioscope.sources.tables import inline, inline_sql, table

QUESTIONS = (
    ("hola buenas tardes", "smalltalk"), ("graciaaas!!", "smalltalk"), ("holaaaa", "smalltalk"), ("heyyy, graciaaas", "smalltalk"), ("ok", "smalltalk"),
    ("que es", "ambiguous"), ("y eso", "ambiguous"), ("holaaaa, ¿qué es una acometida?", "puntual"), ("muestrame la tabla 220.55", "tabla"), ("diferencia entre neutro y tierra", "comparativa"),
    ("requisitos de puesta a tierra", "exhaustiva"), ("que exige el artículo 10", "exhaustiva"), ("distancia minima de seguridad", "puntual"), ("lista completa de materiales", "exhaustiva"), ("cobre versus aluminio", "comparativa"),
)
_QUESTIONS = ", ".join(f"({i}, '{q}')" for i, (q, _) in enumerate(QUESTIONS))
CITED = "(1, 'tabla 220.55'), (2, 'articulo 12 y NTC  2050'), (3, 'la 110-14 y la tabla 392.10 (A)'), (4, 'seccion 3.2, capitulo IV, anexo B'), (5, 'requisitos de puesta a tierra'), (6, 'tablas 5 y tabla 5')"
PAIRS = (
    "(1, 'a) usar 120 V', 'a) se debe usar 120 V siempre'), (2, 'usar 120 V en el tablero', 'usar 110 V en el tablero'), (3, 'c) uno d) dos y tres mas', 'c) uno y dos y tres en total'), "
    "(4, '3,5 m y 2 m', 'son 2 m y luego 3.5 m'), (5, 'ver (C) aqui', 'corto'), (6, 'sin numeros en este borrador', CAST(NULL AS STRING))"
)
ANSWERS = (
    """(1, '{"intent":"puntual","response_format":"steps","output_length":"short","complexity":"low","needs_calculation":true,"confidence":3.7}'), (2, '{"intent":"tabla","confidence":-1}'), """
    """(3, '{"intent":"exhaustiva","response_format":"x","confidence":"alto"}'), (4, '{"intent":"otra","confidence":0.9}'), (5, 'roto')"""
)
CITATIONS = """(1, '{"chunks":[{"title":"Norma A","uri":"u1","page":3,"text":"uno"},{"title":null,"uri":"u2","page":null,"text":"dos"}]}'), (2, '{"chunks":[]}')"""
HITS = "(1, 0, 'norma.PDF', 3, 'Según el ARTÍCULO 5 del texto'), (1, 1, 'norma.pdf', 3, 'otro'), (1, 2, 'guia.pdf', 1, 'nada'), (1, 3, NULL, 2, 'Tabla 3.1'), (2, 0, 'a', 1, 'x'), (2, 1, 'b', 1, 'x'), (2, 2, 'c', 1, 'x'), (2, 3, 'd', 1, 'x'), (2, 4, 'e', 1, 'x'), (2, 5, 'f', 1, 'x')"
FLAGS = "(1, 'chroma'), (2, 'notebooklm'), (3, ' \"Gemini\" '), (4, 'NLM'), (5, 'raro')"
RULES = "('tabla', 'markdown_table', 'grid'), ('tabla', NULL, 'any_table'), (NULL, 'steps', 'stepwise'), ('puntual', 'markdown', 'short')"
ASKED = "(1, 'tabla', 'markdown_table'), (2, 'tabla', 'steps'), (3, 'otra', 'steps'), (4, 'otra', 'otro')"
NAMES = "(1, 'Norma Técnica.pdf'), (2, 'guía Nº 3.PDF'), (3, ''), (4, NULL), (5, 'ñandú & co')"


def intent_rules(spark, sf):
    return ops.classified(inline(spark, _QUESTIONS, "id, question")).select("id", "intent", "route", "wants_table", "wants_full")


def vague_query(spark, sf):
    return table(spark, sf, "conversations").where("role = 'user'").select("conv_id", "turn", ops.is_vague(F.col("text")).alias("vague"))


def entities(spark, sf):
    found = inline(spark, CITED, "id, question").select("id", F.explode(ops.entities(F.col("question"))).alias("e"))
    return found.select("id", "e.type", "e.value")


def fidelity_tokens(spark, sf):
    """How often each document has each number and list mark; the marks need a look behind, which the SQL engine lacks, so the tests have a brute-force version."""
    found = table(spark, sf, "documents").select("doc_id", F.explode(ops.fidelity_tokens(F.col("text"))).alias("token"))
    return found.groupBy("doc_id", "token").agg(F.count("*").alias("n"))


def fidelity_diff(spark, sf):
    return ops.fidelity_diff(inline(spark, PAIRS, "id, draft, candidate"), "id", "draft", "candidate")


def enrich_accept(spark, sf):
    return inline(spark, PAIRS, "id, draft, candidate").select("id", ops.accepted(F.col("draft"), F.col("candidate")).alias("a")).select("id", "a.status", "a.text")


def json_intent_validate(spark, sf):
    checked = inline(spark, ANSWERS, "id, raw").select("id", ops.model_intent(F.col("raw")).alias("m"))
    return checked.select("id", "m.intent", "m.response_format", "m.output_length", "m.complexity", "m.needs_calculation", scaled(F.col("m.confidence")).alias("confidence"))


def citation_extract(spark, sf):
    parsed = inline(spark, CITATIONS, "id, raw").select("id", F.from_json("raw", "chunks array<struct<title:string,uri:string,page:int,text:string>>").alias("r"))
    return parsed.select("id", F.posexplode("r.chunks").alias("place", "c")).select("id", "place", F.coalesce("c.title", "c.uri").alias("source"), "c.page", F.substring("c.text", 1, 300).alias("snippet"))


def history_last_n(spark, sf):
    return ops.history_text(table(spark, sf, "conversations")).select("conv_id", F.sha2("history", 256).alias("digest"), F.length("history").alias("n_chars"))


def last_user_turns(spark, sf):
    return ops.last_turns(table(spark, sf, "conversations").where("role = 'user'"), 2).select("conv_id", "turn", "place")


def citations(spark, sf):
    return ops.citations(inline(spark, HITS, "query_id, ord, source, page, text"))


def route_flags(spark, sf):
    return inline(spark, FLAGS, "id, flag").select("id", ops.source_flags(F.col("flag")).alias("s")).select("id", "s.*")


def skill_resolve(spark, sf):
    return ops.resolved_rules(inline(spark, ASKED, "id, intent, format"), inline(spark, RULES, "intent, format, name"))


def source_name_clean(spark, sf):
    return inline(spark, NAMES, "id, name").select("id", tx.source_name(F.col("name")).alias("source"), tx.ascii_name(F.col("name")).alias("stored"), tx.safe_id(F.coalesce("name", F.lit(""))).alias("key"))


def truncated_titles(spark, sf):
    return table(spark, sf, "documents").select("doc_id", tx.truncated_at_word(F.regexp_replace("text", r"\s+", " "), 80).alias("title"))


_STOP = ", ".join(f"'{w}'" for w in ops.STOPWORDS)
_SHORT = "substr(t, 1, 80)"
ORACLES = {
    "intent_rules": "SELECT id, intent, CASE WHEN intent IN ('smalltalk', 'ambiguous') THEN intent ELSE 'retrieval' END AS route, intent = 'tabla' AS wants_table, intent IN ('exhaustiva', 'comparativa') AS wants_full FROM (VALUES " + ", ".join(f"({i}, '{x}')" for i, (_, x) in enumerate(QUESTIONS)) + ") t(id, intent)",
    "vague_query": f"SELECT conv_id, turn, len(list_filter(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}_]+'), lambda w: length(w) > 1 AND w NOT IN ({_STOP}))) = 0 AS vague FROM conversations WHERE role = 'user'",
    "entities": "SELECT * FROM (VALUES (1, 'tabla', '220.55'), (2, 'articulo', '12'), (2, 'norma', 'NTC 2050'), (3, 'tabla', '392.10(A)'), (3, 'ref', '110-14'), (3, 'ref', '392.10'), (4, 'seccion', '3.2'), (4, 'capitulo', 'IV'), (4, 'anexo', 'B'), (6, 'tabla', '5')) t(id, type, value)",
    "fidelity_diff": "SELECT * FROM (VALUES (2, 'n:120', 1::BIGINT, 0::BIGINT), (2, 'n:110', 0, 1), (3, 'l:d', 1, 0), (5, 'l:c', 1, 0)) t(id, token, missing, added)",
    "enrich_accept": "SELECT * FROM (VALUES (1, 'ok', 'a) se debe usar 120 V siempre'), (2, 'rejected_fidelity', 'usar 120 V en el tablero'), (3, 'rejected_fidelity', 'c) uno d) dos y tres mas'), (4, 'ok', 'son 2 m y luego 3.5 m'), (5, 'fallback', 'ver (C) aqui'), (6, 'fallback', 'sin numeros en este borrador')) t(id, status, text)",
    "json_intent_validate": "SELECT * FROM (VALUES (1, 'puntual', 'steps', 'short', 'low', true, 1000000::BIGINT), (2, 'tabla', 'markdown', 'medium', 'medium', false, 0), (3, 'exhaustiva', 'markdown', 'medium', 'medium', false, 500000), (4, NULL, NULL, NULL, NULL, NULL, NULL), (5, NULL, NULL, NULL, NULL, NULL, NULL)) t(id, intent, response_format, output_length, complexity, needs_calculation, confidence)",
    "citation_extract": f"""WITH c AS (SELECT id, generate_subscripts(json_extract(raw, '$.chunks[*]'), 1) - 1 AS place, unnest(json_extract(raw, '$.chunks[*]')) AS c FROM {inline_sql(CITATIONS, 'id, raw')})
SELECT id, CAST(place AS INT) AS place, coalesce(c->>'$.title', c->>'$.uri') AS source, CAST(c->>'$.page' AS INT) AS page, substr(c->>'$.text', 1, 300) AS snippet FROM c""",
    "history_last_n": """WITH r AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS b FROM conversations WHERE trim(text) <> ''),
h AS (SELECT conv_id, string_agg(role || ': ' || CASE WHEN length(text) > 500 THEN substr(text, 1, 500) || '…' ELSE text END, chr(10) ORDER BY turn) AS h FROM r WHERE b <= 6 GROUP BY conv_id)
SELECT conv_id, sha256(h) AS digest, CAST(length(h) AS INT) AS n_chars FROM h""",
    "last_user_turns": "WITH r AS (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS b FROM conversations WHERE role = 'user') SELECT conv_id, turn, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS INT) AS place FROM r WHERE b <= 2",
    "citations": "SELECT * FROM (VALUES (1, 1, '1. norma · pág. 3 · ARTÍCULO 5'), (1, 2, '2. guia · pág. 1'), (1, 3, '3. Documento · pág. 2 · Tabla 3.1'), (2, 1, '1. a · pág. 1'), (2, 2, '2. b · pág. 1'), (2, 3, '3. c · pág. 1'), (2, 4, '4. d · pág. 1'), (2, 5, '5. e · pág. 1')) t(query_id, place, line)",
    "route_flags": "SELECT * FROM (VALUES (1, true, false, false, 'index'), (2, false, true, false, 'notebook'), (3, false, false, true, 'files'), (4, false, true, false, 'notebook'), (5, true, true, false, 'notebook')) t(id, index, notebook, files, \"primary\")",
    "skill_resolve": f"""WITH r AS (SELECT * FROM {inline_sql(RULES, 'intent, format, name')}) SELECT id, coalesce(
(SELECT name FROM r WHERE r.intent = a.intent AND r.format = a.format), (SELECT name FROM r WHERE r.intent = a.intent AND r.format IS NULL), (SELECT name FROM r WHERE r.intent IS NULL AND r.format = a.format), 'default') AS rule FROM {inline_sql(ASKED, 'id, intent, format')} a""",
    "source_name_clean": "SELECT * FROM (VALUES (1, 'Norma Técnica', 'Norma_Tecnica.pdf', 'Norma_T_cnica.pdf'), (2, 'guía Nº 3', 'guia_N_3.PDF', 'gu_a_N__3.PDF'), (3, 'Documento', 'documento', ''), (4, 'Documento', 'documento', ''), (5, 'ñandú & co', 'nandu_co', '_and____co')) t(id, source, stored, key)",
    "truncated_titles": rf"""WITH d AS (SELECT doc_id, regexp_replace(text, '\s+', ' ', 'g') AS t FROM documents), c AS (SELECT *, strpos(reverse({_SHORT}), ' ') AS back FROM d)
SELECT doc_id, CASE WHEN length(t) <= 80 THEN t ELSE rtrim(substr({_SHORT}, 1, CASE WHEN back > 0 AND 80 - back >= 40 THEN 80 - back ELSE 80 END)) || '…' END AS title FROM c""",
}
QUERIES = {name: globals()[name] for name in [*ORACLES, "fidelity_tokens"]}

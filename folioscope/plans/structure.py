"""Queries over text and page structure."""

from __future__ import annotations

from pyspark.sql import functions as F

from folioscope.functions import text as tx
from folioscope.operators import structure as ops
from folioscope.sources.tables import inline, inline_sql, lines, table

SPACED = "(1, concat('a', chr(13), chr(10), 'b', chr(9), 'c')), (2, concat('  x  ', chr(10), chr(10), chr(10), chr(10), ' y ')), (3, 'a   b'), (4, concat(chr(10), 'z', chr(10))), (5, concat('p', chr(12), chr(11), 'q'))"
LINES = (
    "(1, 1, 0, 'Prologo de la norma'), (1, 1, 1, 'TÍTULO I Disposiciones'), (1, 1, 2, 'CAPÍTULO II Objeto'), (1, 1, 3, 'ARTÍCULO 1. Alcance'), (1, 1, 4, 'texto uno'), "
    "(1, 2, 0, 'Artículo 2° Campo'), (1, 2, 1, 'texto dos'), (1, 2, 2, 'ANEXO GENERAL Notas'), (1, 2, 3, '220.55 Estufas de cocina'), (1, 3, 0, '220.55 12 13 14 15 16'), (1, 3, 1, 'fin'), "
    "(2, 1, 0, 'sin encabezados'), (2, 2, 0, 'SECCIÓN 3.2 Una sola')"
)
_LINE_COLUMNS = "doc_id, page, line_no, line"
ARTICLES = "(1, 1, 1), (1, 2, 1), (1, 8, 3), (1, 9, 4), (1, 13, 5), (2, 4, 1), (2, 5, 2)"
SECTIONS = "(1, 'Segun el Artículo 12° vigente'), (2, 'ver sección  3.2'), (3, 'Tabla 220-55 y artículo 7'), (4, 'nada'), (5, 'anexo B2 del capítulo IV')"
ANCHORS = (
    "(1, 1, 0, 'Tabla 2.3.26.2.2.1.a. Distancias'), (1, 2, 0, 'Tabla 392.10 (A) Ocupacion'), (1, 3, 0, 'tabla 392.10(A) (continuación)'), (1, 3, 1, 'ver Tabla 5'), "
    "(1, 5, 0, 'Tabla 392.10(A) (continuacion)'), (2, 1, 0, '  Tabla 220.55. Factores de demanda'), (2, 2, 0, 'texto')"
)
SPANS = "(1, 1, 3, 1, 'A1'), (1, 3, 4, 2, 'A2'), (1, 6, 6, 3, 'A3'), (2, 1, 2, 1, 'B1')"
POINTS = "(1, 1), (1, 3), (1, 4), (1, 5), (1, 6), (2, 2), (3, 1)"
BLOCKS = "(1, 0.0, 10.0, 290.0, 20.0, 'l1'), (1, 310.0, 10.0, 590.0, 20.0, 'r1'), (1, 0.0, 30.0, 290.0, 40.0, 'l2'), (1, 310.0, 30.0, 590.0, 40.0, 'r2'), (1, 0.0, 50.0, 600.0, 60.0, 'wide'), (1, 310.0, 70.0, 590.0, 80.0, 'r3'), (1, 0.0, 75.0, 290.0, 85.0, 'l3')"


def clean_text(spark, sf):
    docs = table(spark, sf, "documents").select(F.col("doc_id").alias("id"), "text")
    odd = inline(spark, SPACED, "id, text").select((-F.col("id")).cast("long").alias("id"), "text")
    out = tx.clean_text(F.col("text"))
    return docs.unionByName(odd).select("id", F.length(out).alias("n_chars"), F.sha2(out, 256).alias("digest"))


def norm_line_boilerplate(spark, sf):
    return ops.boilerplate(table(spark, sf, "documents"), "source", "doc_id", share=0.01)


def strip_boilerplate(spark, sf):
    docs = table(spark, sf, "documents")
    out = ops.strip_boilerplate(docs, ops.boilerplate(docs, "source", "doc_id", share=0.01), "source", "doc_id")
    return out.select("source", "doc_id", F.sha2("text", 256).alias("digest"), F.length("text").alias("n_chars"))


def token_windows(spark, sf):
    out = ops.windows(table(spark, sf, "documents"), 3200, 600)
    return out.select("doc_id", "window_no", "start", tx.token_estimate(F.col("text")).alias("n_tokens"), F.sha2("text", 256).alias("digest"))


def pieces(spark, sf):
    marked = lines(table(spark, sf, "documents"), ["doc_id"])
    return ops.pieces(marked).select("doc_id", "piece_no", F.sha2("text", 256).alias("digest"))


def _segments(spark):
    return ops.segments(inline(spark, LINES, _LINE_COLUMNS))


def heading_segments(spark, sf):
    return _segments(spark).select("doc_id", "segment_no", "kind", "number", "title", "page_start", "page_end", "n_lines")


def breadcrumb_ffill(spark, sf):
    return _segments(spark).select("doc_id", "segment_no", "breadcrumb")


def numbering_gaps(spark, sf):
    return ops.numbering_gaps(inline(spark, ARTICLES, "doc_id, number, page_start"))


def extract_section(spark, sf):
    return inline(spark, SECTIONS, "id, text").select("id", tx.first_section(F.col("text")).alias("section"))


def table_anchors(spark, sf):
    return ops.anchors(inline(spark, ANCHORS, _LINE_COLUMNS))


def contiguous_pages(spark, sf):
    return ops.contiguous_pages(table_anchors(spark, sf), ["doc_id", "table_id"])


def interval_parent(spark, sf):
    return ops.interval_parent(inline(spark, POINTS, "doc_id, page"), inline(spark, SPANS, "doc_id, page_start, page_end, ord, label"))


def reading_order(spark, sf):
    blocks = inline(spark, BLOCKS, "page, x0, y0, x1, y1, text")
    two, one = ops.reading_order(blocks, 600, True), ops.reading_order(blocks, 600, False)
    return two.select("page", "text", "place").join(one.select("page", "text", F.col("place").alias("single")), ["page", "text"])


def greedy_pack(spark, sf):
    """Packed chunks of every document; the brute-force version is in the tests."""
    return ops.chunks(table(spark, sf, "documents")).select("doc_id", "chunk_id", "n_tokens", F.sha2("text", 256).alias("digest"))


_CLEAN = r"regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '\r\n?', chr(10), 'g'), '[\t\f\v]', ' ', 'g'), '\n{3,}', chr(10) || chr(10), 'g'), ' {2,}', ' ', 'g'), ' ?\n ?', chr(10), 'g'), '^\s+|\s+$', '', 'g')"
_KEY = r"regexp_replace(regexp_replace(lower(trim(line)), '\s+', ' ', 'g'), '\d', '#', 'g')"
_BOILER = f"""
l AS (SELECT source, doc_id, string_split(text, chr(10)) AS ls FROM documents),
e AS (SELECT source, doc_id, unnest(list_concat(ls[1:4], ls[greatest(len(ls) - 2, 1):len(ls)])) AS line FROM l),
k AS (SELECT DISTINCT source, doc_id, {_KEY} AS line_key FROM e),
found AS (SELECT source, line_key, n_pages FROM (SELECT source, line_key, count(*) AS n_pages FROM k WHERE length(line_key) >= 6 GROUP BY ALL)
  JOIN (SELECT source, count(DISTINCT doc_id) AS n FROM documents GROUP BY source) USING (source) WHERE n_pages >= 0.01 * n)"""

ORACLES = {
    "clean_text": f"WITH d AS (SELECT doc_id AS id, text FROM documents UNION ALL SELECT -id, text FROM {inline_sql(SPACED, 'id, text')}), c AS (SELECT id, {_CLEAN} AS t FROM d) SELECT id, CAST(length(t) AS INT) AS n_chars, sha256(t) AS digest FROM c",
    "norm_line_boilerplate": f"WITH {_BOILER} SELECT source, line_key, n_pages FROM found",
    "strip_boilerplate": rf"""WITH {_BOILER}, r AS (SELECT source, doc_id, generate_subscripts(ls, 1) AS i, trim(unnest(ls)) AS line FROM l),
kept AS (SELECT *, {_KEY} AS line_key FROM r),
j AS (SELECT source, doc_id, string_agg(line, chr(10) ORDER BY i) AS t FROM kept x WHERE NOT EXISTS (SELECT 1 FROM found f WHERE f.source = x.source AND f.line_key = x.line_key) AND NOT regexp_matches(line, '(?i)^\s*(?:p[áa]g(?:ina)?\.?\s*)?\d{{1,4}}\s*$') GROUP BY ALL),
o AS (SELECT d.source, d.doc_id, coalesce(regexp_replace(regexp_replace(t, '\n{{3,}}', chr(10) || chr(10), 'g'), '^\s+|\s+$', '', 'g'), '') AS t FROM documents d LEFT JOIN j USING (source, doc_id))
SELECT source, doc_id, sha256(t) AS digest, CAST(length(t) AS INT) AS n_chars FROM o""",
    "token_windows": """WITH w AS (SELECT doc_id, text, unnest(generate_series(0, greatest(0, ceil((length(text) - 3200) / 2600.0)::INT))) AS n FROM documents WHERE length(text) > 0),
p AS (SELECT doc_id, CAST(n AS INT) AS window_no, CAST(n * 2600 AS INT) AS start, substr(text, n * 2600 + 1, 3200) AS t FROM w)
SELECT doc_id, window_no, start, CAST(greatest(1, (length(t) + 3) // 4) AS INT) AS n_tokens, sha256(t) AS digest FROM p""",
    "pieces": r"""WITH r AS (SELECT doc_id, generate_subscripts(string_split(text, chr(10)), 1) AS i, unnest(string_split(text, chr(10))) AS line FROM documents),
b AS (SELECT *, regexp_matches(line, '^\s*(?:[a-zñ]\)|[A-ZÑ]\)|\d{1,2}\.\s|[•\-–]\s)') OR coalesce(lag(trim(line) = '') OVER (PARTITION BY doc_id ORDER BY i), true) AS s FROM r),
p AS (SELECT doc_id, line, i, sum(s::INT) OVER (PARTITION BY doc_id ORDER BY i) AS piece_no FROM b WHERE trim(line) <> '')
SELECT doc_id, CAST(piece_no AS BIGINT) AS piece_no, sha256(string_agg(line, chr(10) ORDER BY i)) AS digest FROM p GROUP BY doc_id, piece_no""",
    "heading_segments": "SELECT * FROM (VALUES (1, 0::BIGINT, 'preambulo', '', '', 1, 1, 3::BIGINT), (1, 1, 'articulo', '1', 'Alcance', 1, 1, 2), (1, 2, 'articulo', '2', 'Campo', 2, 2, 2), (1, 3, 'anexo', 'GENERAL', 'Notas', 2, 2, 1), (1, 4, 'numeral', '220.55', 'Estufas de cocina', 2, 3, 3), (2, 1, 'pagina', '1', '', 1, 1, 1), (2, 2, 'pagina', '2', '', 2, 2, 1)) t(doc_id, segment_no, kind, number, title, page_start, page_end, n_lines)",
    "breadcrumb_ffill": f"""WITH x AS (SELECT *, regexp_extract(line, '(?i)^\\s*T[IÍ]TULO\\s+([IVXLCDM]+|\\d+)', 1) AS t, regexp_extract(line, '(?i)^\\s*CAP[IÍ]TULO\\s+([IVXLCDM]+|\\d+)', 1) AS c FROM {inline_sql(LINES, _LINE_COLUMNS)}),
f AS (SELECT *, last_value(nullif(t, '') IGNORE NULLS) OVER w AS tt, last_value(nullif(c, '') IGNORE NULLS) OVER w AS cc FROM x WINDOW w AS (PARTITION BY doc_id ORDER BY page, line_no))
SELECT 1 AS doc_id, v.s::BIGINT AS segment_no, CASE WHEN v.s = 0 THEN '' ELSE concat_ws(' > ', 'TÍTULO ' || tt, 'CAPÍTULO ' || cc, v.n) END AS breadcrumb
FROM (VALUES (0, 1, 0, ''), (1, 1, 3, 'ARTICULO 1'), (2, 2, 0, 'ARTICULO 2'), (3, 2, 2, 'ANEXO GENERAL'), (4, 2, 3, 'NUMERAL 220.55')) v(s, p, l, n) JOIN f ON f.doc_id = 1 AND f.page = v.p AND f.line_no = v.l
UNION ALL SELECT 2, page, '' FROM f WHERE doc_id = 2""",
    "numbering_gaps": f"SELECT * FROM (SELECT *, lag(number) OVER (PARTITION BY doc_id ORDER BY page_start, number) AS previous FROM {inline_sql(ARTICLES, 'doc_id, number, page_start')}) WHERE number > previous + 3",
    "extract_section": rf"""SELECT id, coalesce(nullif(regexp_extract(text, '(?i)ART[IÍ]CULO\s+\d+[°ºo]?'), ''), nullif(regexp_replace(regexp_extract(text, '(?i)SECCI[OÓ]N\s+\d+(?:\.\d+)*'), '\s+', ' ', 'g'), ''), nullif(regexp_extract(text, '(?i)CAP[IÍ]TULO\s+[IVXLCDM0-9]+'), ''),
nullif(regexp_extract(text, '(?i)T[IÍ]TULO\s+[IVXLCDM0-9]+'), ''), nullif(regexp_extract(text, '(?i)TABLA\s+\d+(?:[.\-]\d+)*'), ''), nullif(regexp_extract(text, '(?i)ANEXO\s+[A-Z0-9]+'), '')) AS section FROM {inline_sql(SECTIONS, 'id, text')}""",
    "table_anchors": "SELECT * FROM (VALUES (1, 1, 0, '2.3.26.2.2.1.a', 'Distancias', false), (1, 2, 0, '392.10(A)', 'Ocupacion', false), (1, 3, 0, '392.10(A)', '(continuación)', true), (1, 5, 0, '392.10(A)', '(continuacion)', true), (2, 1, 0, '220.55', 'Factores de demanda', false)) t(doc_id, page, line_no, table_id, title, continued)",
    "contiguous_pages": "SELECT * FROM (VALUES (1, '2.3.26.2.2.1.a', 1, 1, 1::BIGINT, 'Distancias'), (1, '392.10(A)', 2, 3, 2, 'Ocupacion'), (2, '220.55', 1, 1, 1, 'Factores de demanda')) t(doc_id, table_id, page_start, page_end, n_pages, title)",
    "interval_parent": f"SELECT p.doc_id, p.page, arg_min(label, ord) AS label FROM {inline_sql(POINTS, 'doc_id, page')} p LEFT JOIN {inline_sql(SPANS, 'doc_id, page_start, page_end, ord, label')} s ON p.doc_id = s.doc_id AND p.page BETWEEN s.page_start AND s.page_end GROUP BY p.doc_id, p.page",
    "reading_order": "SELECT 1 AS page, * FROM (VALUES ('l1', 1, 1), ('l2', 2, 3), ('r1', 3, 2), ('r2', 4, 4), ('wide', 5, 5), ('l3', 6, 7), ('r3', 7, 6)) t(text, place, single)",
}
QUERIES = {name: globals()[name] for name in [*ORACLES, "greedy_pack"]}

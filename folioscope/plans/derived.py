"""Queries over texts and rows that Spark derives from the tables: questions, headings, anchors, grids and registries are set from them, and the operators have to find them again."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from folioscope.functions import json_text
from folioscope.functions import text as tx
from folioscope.operators import ancestry, evidence, figures, grids, language, metadata, registry, search, structure
from folioscope.plans.language import RULES
from folioscope.sources.tables import inline, inline_sql, table


def _text(*parts) -> Column:
    """Strings and columns (by ``F.col``) one after the other; a null counts as nothing."""
    return F.concat(*(F.lit(p) if isinstance(p, str) else F.coalesce(p.cast("string"), F.lit("")) for p in parts))


def _pick(number: Column, *choices) -> Column:
    """One of the choices, by the number."""
    return F.element_at(F.array(*(c if isinstance(c, Column) else F.lit(c) for c in choices)), (F.pmod(number, F.lit(len(choices))) + 1).cast("int"))


def _docs(spark, sf):
    return table(spark, sf, "documents")


def _lines(spark, sf):
    """Documents as pages of ten lines, with a title, a chapter and an article every fourth line put in."""
    doc, n = F.col("doc_id"), F.col("line_no")
    split = _docs(spark, sf).select("doc_id", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
    line = F.when(n == 0, _text("TÍTULO ", doc % 9 + 1, " Disposiciones")).when(n == 1, _text("Capítulo ", doc % 5 + 1)).when(n % 4 == 2, _text("ARTÍCULO ", F.floor(n / 4) + 1, ". Objeto")).otherwise(F.col("line"))
    return split.select("doc_id", (F.floor(n / 10) + 1).cast("int").alias("page"), "line_no", line.alias("line"))


def heading_segments(spark, sf):
    return structure.segments(_lines(spark, sf)).select("doc_id", "segment_no", "kind", "number", "title", "page_start", "page_end", "n_lines")


def breadcrumb_ffill(spark, sf):
    return structure.segments(_lines(spark, sf)).select("doc_id", "segment_no", "breadcrumb")


def numbering_gaps(spark, sf):
    """Orders of a customer as articles, where the numbers jump."""
    rows = table(spark, sf, "orders").select(F.col("o_custkey").alias("doc_id"), F.col("o_orderkey").alias("number"), F.col("o_orderkey").alias("page_start"))
    return structure.numbering_gaps(rows)


def extract_section(spark, sf):
    i = F.col("doc_id")
    cited = _pick(i, _text("Según el Artículo ", i, "° de la sección  3.2 "), _text("ver sección   ", i % 7, ".", i % 3, " "), _text("tabla ", i % 50, "-5 "), _text("anexo B", i % 4, " del capítulo IV "), "", _text("TITULO ", i % 9 + 1, " "))
    return _docs(spark, sf).select("doc_id", tx.first_section(F.concat(cited, F.coalesce("text", F.lit("")))).alias("section"))


def _anchored(spark, sf):
    """Documents as pages, ten to a volume; three pages and a sixth carry the volume's table."""
    page, volume = F.col("doc_id") % 10 + 1, F.floor(F.col("doc_id") / 10)
    own = F.when(page == 1, _text("  Tabla ", volume, ".1.a. Cargas – \n")).when(page.isin(2, 3), _text("tabla ", volume, ".1.a (continuación)\n")).when(page == 6, _text("Tabla ", volume, ".1.a continuacion de la carga\n")).otherwise(F.lit(""))
    set_ = _docs(spark, sf).select(volume.cast("long").alias("doc_id"), page.cast("int").alias("page"), F.posexplode(F.split(F.concat(own, F.coalesce("text", F.lit(""))), "\n")).alias("line_no", "line"))
    return structure.anchors(set_)


def table_anchors(spark, sf):
    return _anchored(spark, sf)


def contiguous_pages(spark, sf):
    return structure.contiguous_pages(_anchored(spark, sf), ["doc_id", "table_id"])


def interval_parent(spark, sf):
    """Documents as pages, ten to a volume, with the articles of their volume."""
    points = _docs(spark, sf).select(F.floor(F.col("doc_id") / 10).cast("long").alias("doc_id"), (F.col("doc_id") % 10 + 1).cast("int").alias("page"))
    spans = F.array(*(F.struct(F.lit(a).alias("page_start"), F.lit(b).alias("page_end"), F.lit(o).alias("ord"), F.lit(n).alias("label")) for a, b, o, n in ((1, 3, 1, "A1"), (3, 4, 2, "A2"), (6, 6, 3, "A3"))))
    return structure.interval_parent(points, points.select("doc_id").distinct().select("doc_id", F.explode(spans).alias("s")).select("doc_id", "s.*"))


def intent_rules(spark, sf):
    turns = table(spark, sf, "conversations").where("role = 'user'").select("conv_id", "turn", _pick(
        F.col("conv_id") + F.col("turn"), "hola buenas tardes", "que es", _text("muestrame la tabla de ", F.col("text")), _text("diferencia entre ", F.col("text")), _text("requisitos de ", F.col("text")), _text("lista completa de ", F.col("text")), F.coalesce("text", F.lit(""))
    ).alias("question"))
    return language.classified(turns).select("conv_id", "turn", "intent", "route", "wants_table", "wants_full")


def entities(spark, sf):
    i = F.col("doc_id")
    asked = _docs(spark, sf).select("doc_id", _pick(i, _text("la tabla ", i, ".5"), _text("articulo ", i % 100 + 1, " y NTC  2050"), _text("seccion 3.", i % 7, ", capitulo IV, anexo B"), _text("tablas ", i, " y tabla ", i), "requisitos de puesta a tierra").alias("question"))
    return asked.select("doc_id", F.explode(language.entities(F.col("question"))).alias("e")).select("doc_id", "e.type", "e.value")


def _drafts(spark, sf):
    """A draft for each order, and a rewrite that keeps, changes, lacks or cuts its numbers."""
    key, total, cust = F.col("o_orderkey"), F.floor("o_totalprice").cast("long"), F.col("o_custkey")
    rewrite = _pick(key, _text("Para ", cust, " son en total ", total, " V justos"), _text("El total es ", total, " V para ", cust + 1, " en todo"), F.lit(None).cast("string"), "corto")
    return table(spark, sf, "orders").select("o_orderkey", _text("El total es ", total, " V para ", cust).alias("draft"), rewrite.alias("candidate"))


def fidelity_diff(spark, sf):
    return language.fidelity_diff(_drafts(spark, sf), "o_orderkey", "draft", "candidate")


def enrich_accept(spark, sf):
    return _drafts(spark, sf).select("o_orderkey", language.accepted(F.col("draft"), F.col("candidate")).alias("a")).select("o_orderkey", "a.status", "a.text")


def json_intent_validate(spark, sf):
    key = F.col("o_orderkey")
    sure = _pick(key, "3.7", "-1", '"alto"', _text("0.", key % 90 + 10))
    raw = F.when(key % 11 == 0, "roto").otherwise(_text('{"intent":"', _pick(key, "puntual", "tabla", "otra", "exhaustiva", "puntual"), '","response_format":"', _pick(key, "steps", "x"), '","needs_calculation":', _pick(key, "true", "false"), ',"confidence":', sure, "}"))
    checked = table(spark, sf, "orders").select("o_orderkey", language.model_intent(raw).alias("m"))
    return checked.select("o_orderkey", "m.intent", "m.response_format", "m.needs_calculation", search.scaled(F.col("m.confidence")).alias("confidence"))


def _placed(spark, sf):
    """Lines of orders with ``ord``, their place in the order from 0."""
    order = W.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_shipdate")
    return table(spark, sf, "lineitem").withColumn("ord", F.row_number().over(order) - 1)


def citation_extract(spark, sf):
    """The lines of every order as the chunks of a model's answer, in JSON and back."""
    chunk = F.struct(F.when(F.col("l_linenumber") % 2 == 1, _text("P", F.col("l_partkey"))).alias("title"), _text("u", F.col("l_suppkey")).alias("uri"), F.col("l_linenumber").alias("page"), F.repeat(F.concat("l_returnflag", F.lit("x")), 200).alias("text"))
    raw = _placed(spark, sf).groupBy("l_orderkey").agg(F.to_json(F.struct(F.transform(F.array_sort(F.collect_list(F.struct("ord", chunk.alias("c")))), lambda x: x["c"]).alias("chunks"))).alias("raw"))
    parsed = raw.select("l_orderkey", F.from_json("raw", "chunks array<struct<title:string,uri:string,page:int,text:string>>").alias("r"))
    return parsed.select("l_orderkey", F.posexplode("r.chunks").alias("place", "c")).select("l_orderkey", "place", F.coalesce("c.title", "c.uri").alias("source"), "c.page", F.length(F.substring("c.text", 1, 300)).alias("n_chars"))


def citations(spark, sf):
    """The lines of every order as hits."""
    hits = _placed(spark, sf).select(F.col("l_orderkey").alias("query_id"), "ord", F.when(F.col("l_suppkey") % 4 > 0, _text("S", F.col("l_suppkey") % 4, ".PDF")).alias("source"), (F.col("l_partkey") % 2).cast("int").alias("page"), F.when(F.col("l_partkey") % 3 > 0, _text("Según el ARTÍCULO ", F.col("l_partkey"), " del texto")).otherwise("nada").alias("text"))
    return language.citations(hits)


def dedupe_hits(spark, sf):
    """The lines of every order as hits of a few pages."""
    hits = _placed(spark, sf).select(F.col("l_orderkey").alias("query_id"), "ord", F.col("l_returnflag").alias("source"), (F.col("l_suppkey") % 3).alias("page"), F.when(F.col("l_linenumber") % 3 > 0, F.col("l_discount")).alias("score"), _text("P", F.col("l_partkey")).alias("text"))
    return search.dedupe_hits(hits).withColumn("score", search.scaled(F.col("score")))


def route_flags(spark, sf):
    flag = _pick(F.col("c_custkey"), "chroma", "notebooklm", ' "Gemini" ', "NLM", F.col("c_mktsegment"))
    return table(spark, sf, "customer").select("c_custkey", language.source_flags(flag).alias("s")).select("c_custkey", "s.*")


def skill_resolve(spark, sf):
    asked = table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), _pick(F.col("o_custkey"), "tabla", "otra", "puntual").alias("intent"), _pick(F.col("o_orderkey"), "markdown_table", "steps", "otro", "markdown").alias("format"))
    return language.resolved_rules(asked, inline(spark, RULES, "intent, format, name"))


def source_name_clean(spark, sf):
    name = F.when(F.col("doc_id") % 9 == 0, None).otherwise(_text("Ñandú ", F.col("source"), " Nº ", F.col("doc_id"), _pick(F.col("doc_id"), ".PDF", ".pdf", ".txt")))
    return _docs(spark, sf).select("doc_id", tx.source_name(name).alias("source"), tx.ascii_name(name).alias("stored"), tx.safe_id(F.coalesce(name, F.lit(""))).alias("key"))


def _registry(spark, sf):
    """Parts as tables: the key and size are the id, the key's remainder the state."""
    key = F.col("p_partkey")
    return table(spark, sf, "part").select(key.alias("ord"), _text(key, ".", F.col("p_size")).alias("table_id"), _pick(key, "extraida", "revision", "verificada", "solo_imagen").alias("state"))


def table_ref_prefix(spark, sf):
    """Every table asked for by its id, by one that goes on after it, and by the tenth of its number."""
    ids = _registry(spark, sf).select("table_id", F.floor(F.col("ord") / 10).cast("string").alias("tenth"))
    refs = ids.select(F.explode(F.array("table_id", F.concat("table_id", F.lit(".7")), "tenth")).alias("ref")).distinct()
    return grids.lookup(refs, _registry(spark, sf))


def count_by_state(spark, sf):
    return _registry(spark, sf).groupBy("state").agg(F.count("*").alias("n"))


def table_state(spark, sf):
    """Every order read twice: its lines, and the suppliers among them."""
    key = F.col("l_orderkey")
    read = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.count("*").cast("int").alias("n"), F.countDistinct("l_suppkey").cast("int").alias("m"))
    return read.select("l_orderkey", grids.table_state(F.when(key % 7 > 0, F.col("n")), F.when(key % 5 > 0, F.col("m")), key % 11 == 0).alias("state"))


def grid_consistent(spark, sf):
    """Every order's lines as a grid with gaps."""
    cells = F.array(F.col("l_linenumber").cast("string"), F.when(F.col("l_linestatus") == "O", F.col("l_returnflag")).otherwise(""), F.lit(""))
    body = _placed(spark, sf).groupBy("l_orderkey").agg(F.transform(F.array_sort(F.collect_list(F.struct("ord", cells.alias("c")))), lambda x: x["c"]).alias("body"))
    headers = F.array(F.lit("n"), F.when(F.col("l_orderkey") % 4 > 0, "flag").otherwise(""), F.lit(""))
    return body.select("l_orderkey", grids.is_consistent(headers, F.col("body")).alias("consistent"))


def merge_headers(spark, sf):
    """Suppliers of every nation under two levels of headings."""
    rows = table(spark, sf, "supplier").groupBy("s_nationkey").agg(F.transform(F.array_sort(F.collect_list("s_suppkey")), lambda k: F.array(k.cast("string"), F.lit("1"), F.lit("2"))).alias("rows"))
    nations = table(spark, sf, "nation").join(rows, F.col("n_nationkey") == F.col("s_nationkey"), "left")
    grid = F.concat(F.array(F.array(F.col("n_name"), F.lit("PROMEDIO"), F.lit("")), F.array(F.lit(""), F.lit("gr/m²"), F.lit(" µm "))), F.coalesce("rows", F.array().cast("array<array<string>>")))
    clean = nations.select("n_nationkey", grids.clean_grid(grid).alias("g"))
    return clean.select("n_nationkey", grids.merged_headers(F.col("g")).alias("m")).select("n_nationkey", F.array_join("m.headers", " | ").alias("headers"), F.size("m.body").alias("n_rows"))


def table_regions(spark, sf):
    """Every order a page; its lines are mentions of its table."""
    pages = table(spark, sf, "orders").select(F.col("o_orderkey").alias("doc_id"), F.lit(1).alias("page"), F.lit("T").alias("table_id"), F.lit(600.0).alias("width"), F.lit(800.0).alias("height"))
    found = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("doc_id"), F.lit(1).alias("page"), F.lit("T").alias("table_id"), F.floor(F.col("l_quantity") / 20).cast("double").alias("x0"), (F.col("l_linenumber") * 50 - 49).cast("double").alias("y0"))
    return evidence.table_regions(pages, found).select("doc_id", *(F.col(c).cast("int").alias(c) for c in ("x0", "y0", "x1", "y1")))


def _stored(spark, sf):
    """(local, remote): objects of finished orders and of customers of even number, some of another size."""
    orders = table(spark, sf, "orders")
    key, size = _text("v1/o", F.col("o_orderkey")), F.floor("o_totalprice").cast("long")
    return orders.where("o_orderstatus = 'F'").select(key.alias("key"), size.alias("size")), orders.where("o_custkey % 2 = 0").select(key.alias("key"), (size + F.when(F.col("o_orderkey") % 3 == 0, 1).otherwise(0)).alias("size"))


def publish_plan(spark, sf):
    return registry.upload_plan(*_stored(spark, sf))


def prune_plan(spark, sf):
    return registry.prune_plan(*_stored(spark, sf))


def list_versions(spark, sf):
    keys = table(spark, sf, "orders").select(F.concat(F.lit("store/"), F.when(F.col("o_orderkey") % 2 == 0, F.concat(F.lit("v"), F.date_format("o_orderdate", "yyyyMMdd"))).otherwise("current"), F.lit("/o"), F.col("o_orderkey").cast("string")).alias("key"))
    return registry.versions(keys)


def alias_resolve(spark, sf):
    """Every customer asks with the names of a nation and of a region; the first registered name that occurs decides.

    The question's runs of one to three words are its keys, so the join is by equality and nothing is broadcast unchecked.
    """
    nations, regions = table(spark, sf, "nation"), table(spark, sf, "region")
    asked = table(spark, sf, "customer").join(nations, F.col("c_nationkey") == F.col("n_nationkey")).join(regions, F.pmod("c_custkey", F.lit(5)) == F.col("r_regionkey"))
    asked = asked.select("c_custkey", F.lower(_text("pedido de ", F.col("n_name"), " para ", F.col("r_name"), " hoy")).alias("question"))
    known = nations.where("n_nationkey % 3 > 0").select((F.col("n_nationkey") + 10).alias("ord"), _text("n", F.col("n_nationkey")).alias("doc_id"), F.lower("n_name").alias("alias")).unionByName(regions.select(F.col("r_regionkey").alias("ord"), _text("r", F.col("r_regionkey")).alias("doc_id"), F.lower("r_name").alias("alias")))
    words = F.split("question", " ")
    runs = F.flatten(F.transform(F.sequence(F.lit(1), F.size(words)), lambda i: F.transform(F.sequence(F.lit(1), F.lit(3)), lambda n: F.array_join(F.slice(words, i, n), " "))))
    best = asked.select("c_custkey", F.explode(F.array_distinct(runs)).alias("alias")).join(known, "alias").groupBy("c_custkey").agg(F.min(F.struct("ord", "doc_id"))["doc_id"].alias("doc_id"))
    return asked.select("c_custkey").join(best, "c_custkey", "left")


_LINES_SQL = """r AS (SELECT doc_id, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS n, unnest(string_split(text, chr(10))) AS line FROM documents),
p AS (SELECT doc_id, n, line, (n // 10 + 1)::INT AS page, (n + 2) // 4 AS s FROM r), c AS (SELECT doc_id, max(s) AS openers FROM p GROUP BY doc_id)"""
_STOP = ", ".join(f"'{w}'" for w in language.STOPWORDS)
_SECTION = r"""coalesce(nullif(regexp_extract(t, '(?i)ART[IÍ]CULO\s+\d+[°ºo]?'), ''), nullif(regexp_replace(regexp_extract(t, '(?i)SECCI[OÓ]N\s+\d+(?:\.\d+)*'), '\s+', ' ', 'g'), ''), nullif(regexp_extract(t, '(?i)CAP[IÍ]TULO\s+[IVXLCDM0-9]+'), ''),
nullif(regexp_extract(t, '(?i)T[IÍ]TULO\s+[IVXLCDM0-9]+'), ''), nullif(regexp_extract(t, '(?i)TABLA\s+\d+(?:[.\-]\d+)*'), ''), nullif(regexp_extract(t, '(?i)ANEXO\s+[A-Z0-9]+'), ''))"""
_ANCHOR_SQL = "a AS (SELECT doc_id // 10 AS doc_id, (doc_id % 10 + 1)::INT AS page, 0 AS line_no, (doc_id // 10) || '.1.a' AS table_id FROM documents WHERE doc_id % 10 IN (0, 1, 2, 5))"
_PLACED_SQL = "l AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_shipdate) - 1 AS ord FROM lineitem)"
_DRAFT_SQL = "d AS (SELECT o_orderkey, floor(o_totalprice)::BIGINT AS t, o_custkey AS c, o_orderkey % 4 AS k FROM orders)"
_PART_SQL = "t AS (SELECT p_partkey AS ord, p_partkey || '.' || p_size AS i, ['extraida', 'revision', 'verificada', 'solo_imagen'][p_partkey % 4 + 1] AS state, [2, 1, 3, 0][p_partkey % 4 + 1] AS s FROM part)"
_STORED_SQL = "l AS (SELECT 'v1/o' || o_orderkey AS key, floor(o_totalprice) AS size FROM orders WHERE o_orderstatus = 'F'), r AS (SELECT 'v1/o' || o_orderkey AS key, floor(o_totalprice) + (o_orderkey % 3 = 0)::INT AS size FROM orders WHERE o_custkey % 2 = 0)"
ORACLES = {
    "heading_segments": f"""WITH {_LINES_SQL} SELECT doc_id, s AS segment_no, CASE WHEN s = 0 THEN 'preambulo' ELSE 'articulo' END AS kind, CASE WHEN s = 0 THEN '' ELSE s::VARCHAR END AS number, CASE WHEN s = 0 THEN '' ELSE 'Objeto' END AS title,
min(page) AS page_start, max(page) AS page_end, count(*) AS n_lines FROM p JOIN c USING (doc_id) WHERE openers >= 3 GROUP BY doc_id, s
UNION ALL SELECT doc_id, page, 'pagina', page::VARCHAR, '', page, page, count(*) FROM p JOIN c USING (doc_id) WHERE openers < 3 GROUP BY doc_id, page""",
    "breadcrumb_ffill": f"""WITH {_LINES_SQL} SELECT DISTINCT doc_id, s AS segment_no, CASE WHEN s = 0 THEN '' ELSE 'TÍTULO ' || (doc_id % 9 + 1) || ' > CAPÍTULO ' || (doc_id % 5 + 1) || ' > ARTICULO ' || s END AS breadcrumb FROM p JOIN c USING (doc_id) WHERE openers >= 3
UNION ALL SELECT DISTINCT doc_id, page, '' FROM p JOIN c USING (doc_id) WHERE openers < 3""",
    "numbering_gaps": "SELECT * FROM (SELECT o_custkey AS doc_id, o_orderkey AS number, o_orderkey AS page_start, lag(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS previous FROM orders) WHERE number > previous + 3",
    "extract_section": f"""WITH d AS (SELECT doc_id, ['Según el Artículo ' || doc_id || '° de la sección  3.2 ', 'ver sección   ' || (doc_id % 7) || '.' || (doc_id % 3) || ' ', 'tabla ' || (doc_id % 50) || '-5 ', 'anexo B' || (doc_id % 4) || ' del capítulo IV ', '', 'TITULO ' || (doc_id % 9 + 1) || ' '][doc_id % 6 + 1] || coalesce(text, '') AS t FROM documents)
SELECT doc_id, {_SECTION} AS section FROM d""",
    "table_anchors": f"WITH {_ANCHOR_SQL} SELECT doc_id, page, line_no, table_id, CASE WHEN page = 1 THEN 'Cargas' WHEN page = 6 THEN 'continuacion de la carga' ELSE '(continuación)' END AS title, page > 1 AS continued FROM a",
    "contiguous_pages": f"""WITH {_ANCHOR_SQL}, i AS (SELECT *, page - row_number() OVER (PARTITION BY doc_id ORDER BY page) AS g FROM a), f AS (SELECT *, min(g) OVER (PARTITION BY doc_id) AS g0 FROM i)
SELECT doc_id, table_id, min(page) FILTER (g = g0) AS page_start, max(page) FILTER (g = g0) AS page_end, count(*) FILTER (g = g0) AS n_pages, CASE min(page) WHEN 1 THEN 'Cargas' WHEN 6 THEN 'continuacion de la carga' ELSE '(continuación)' END AS title FROM f GROUP BY doc_id, table_id""",
    "interval_parent": "SELECT doc_id // 10 AS doc_id, (doc_id % 10 + 1)::INT AS page, CASE WHEN doc_id % 10 < 3 THEN 'A1' WHEN doc_id % 10 = 3 THEN 'A2' WHEN doc_id % 10 = 5 THEN 'A3' END AS label FROM documents",
    "intent_rules": f"""WITH q AS (SELECT conv_id, turn, (conv_id + turn) % 7 AS k, len(list_filter(regexp_extract_all(lower(coalesce(text, '')), '[\\p{{L}}\\p{{N}}_]+'), lambda w: length(w) > 1 AND w NOT IN ({_STOP}))) = 0 AS vague FROM conversations WHERE role = 'user'),
i AS (SELECT *, CASE k WHEN 0 THEN 'smalltalk' WHEN 1 THEN 'ambiguous' WHEN 2 THEN 'tabla' WHEN 3 THEN 'comparativa' WHEN 4 THEN 'exhaustiva' WHEN 5 THEN 'exhaustiva' ELSE CASE WHEN vague THEN 'ambiguous' ELSE 'puntual' END END AS intent FROM q)
SELECT conv_id, turn, intent, CASE WHEN intent IN ('smalltalk', 'ambiguous') THEN intent ELSE 'retrieval' END AS route, intent = 'tabla' AS wants_table, intent IN ('exhaustiva', 'comparativa') AS wants_full FROM i""",
    "entities": """SELECT doc_id, 'tabla' AS type, CASE doc_id % 5 WHEN 0 THEN doc_id || '.5' ELSE doc_id::VARCHAR END AS value FROM documents WHERE doc_id % 5 IN (0, 3) UNION ALL SELECT doc_id, 'articulo', (doc_id % 100 + 1)::VARCHAR FROM documents WHERE doc_id % 5 = 1
UNION ALL SELECT doc_id, 'norma', 'NTC 2050' FROM documents WHERE doc_id % 5 = 1 UNION ALL SELECT doc_id, unnest(['seccion', 'capitulo', 'anexo']), unnest(['3.' || (doc_id % 7), 'IV', 'B']) FROM documents WHERE doc_id % 5 = 2""",
    "fidelity_diff": f"""WITH {_DRAFT_SQL}, a AS (SELECT o_orderkey, unnest([t, c]) AS x, 1 AS a, 0 AS b FROM d UNION ALL SELECT o_orderkey, unnest(CASE k WHEN 0 THEN [c, t] WHEN 1 THEN [t, c + 1] ELSE [] END), 0, 1 FROM d),
s AS (SELECT o_orderkey, 'n:' || x AS token, sum(a)::BIGINT AS a, sum(b)::BIGINT AS b FROM a GROUP BY o_orderkey, x) SELECT o_orderkey, token, greatest(a - b, 0) AS missing, greatest(b - a, 0) AS added FROM s WHERE a <> b""",
    "enrich_accept": f"WITH {_DRAFT_SQL} SELECT o_orderkey, CASE k WHEN 0 THEN 'ok' WHEN 1 THEN 'rejected_fidelity' ELSE 'fallback' END AS status, CASE k WHEN 0 THEN 'Para ' || c || ' son en total ' || t || ' V justos' ELSE 'El total es ' || t || ' V para ' || c END AS text FROM d",
    "json_intent_validate": """WITH k AS (SELECT o_orderkey, ['puntual', 'tabla', 'otra', 'exhaustiva', 'puntual'][o_orderkey % 5 + 1] AS i, o_orderkey % 11 <> 0 AND o_orderkey % 5 <> 2 AS good FROM orders)
SELECT o_orderkey, CASE WHEN good THEN i END AS intent, CASE WHEN good THEN CASE o_orderkey % 2 WHEN 0 THEN 'steps' ELSE 'markdown' END END AS response_format, CASE WHEN good THEN o_orderkey % 2 = 0 END AS needs_calculation,
CASE WHEN good THEN [1000000, 0, 500000, (o_orderkey % 90 + 10) * 10000][o_orderkey % 4 + 1] END::BIGINT AS confidence FROM k""",
    "citation_extract": f"WITH {_PLACED_SQL} SELECT l_orderkey, ord::INT AS place, CASE WHEN l_linenumber % 2 = 1 THEN 'P' || l_partkey ELSE 'u' || l_suppkey END AS source, l_linenumber AS page, 300 AS n_chars FROM l",
    "citations": f"""WITH {_PLACED_SQL}, h AS (SELECT l_orderkey AS query_id, ord, CASE WHEN l_suppkey % 4 > 0 THEN 'S' || (l_suppkey % 4) ELSE 'Documento' END AS source, l_partkey % 2 AS page, CASE WHEN l_partkey % 3 > 0 THEN 'ARTÍCULO ' || l_partkey END AS section FROM l),
f AS (SELECT query_id, source, page, min(ord) AS ord, arg_min(row(section), ord) AS section FROM h GROUP BY ALL), p AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY ord) AS place FROM f)
SELECT query_id, place::INT AS place, place || '. ' || concat_ws(' · ', source, 'pág. ' || page, section[1]) AS line FROM p WHERE place <= 5""",
    "dedupe_hits": f"""WITH {_PLACED_SQL}, h AS (SELECT l_orderkey AS query_id, ord, l_returnflag AS source, l_suppkey % 3 AS page, CASE WHEN l_linenumber % 3 > 0 THEN l_discount END AS score, 'P' || l_partkey AS text FROM l),
b AS (SELECT query_id, source, page, arg_min(row(score, text), row(coalesce(score, 'infinity'::DOUBLE), ord)) AS x, min(ord) AS f FROM h GROUP BY ALL)
SELECT query_id, source, page, floor(x[1] * 1e6 + 0.5)::BIGINT AS score, x[2] AS text, row_number() OVER (PARTITION BY query_id ORDER BY f)::INT AS rank FROM b""",
    "route_flags": "SELECT c_custkey, c_custkey % 5 IN (0, 4) AS index, c_custkey % 5 IN (1, 3, 4) AS notebook, c_custkey % 5 = 2 AS files, ['index', 'notebook', 'files', 'notebook', 'notebook'][c_custkey % 5 + 1] AS \"primary\" FROM customer",
    "skill_resolve": f"""WITH r AS (SELECT * FROM {inline_sql(RULES, 'intent, format, name')}), a AS (SELECT o_orderkey AS id, ['tabla', 'otra', 'puntual'][o_custkey % 3 + 1] AS intent, ['markdown_table', 'steps', 'otro', 'markdown'][o_orderkey % 4 + 1] AS format FROM orders)
SELECT id, coalesce(x.name, y.name, z.name, 'default') AS rule FROM a LEFT JOIN r x ON x.intent = a.intent AND x.format = a.format LEFT JOIN r y ON y.intent = a.intent AND y.format IS NULL LEFT JOIN r z ON z.intent IS NULL AND z.format = a.format""",
    "source_name_clean": """WITH n AS (SELECT doc_id, coalesce(source, '') AS s, ['.PDF', '.pdf', '.txt'][doc_id % 3 + 1] AS x, doc_id % 9 = 0 AS none FROM documents)
SELECT doc_id, CASE WHEN none THEN 'Documento' ELSE 'Ñandú ' || s || ' Nº ' || doc_id || CASE WHEN x = '.txt' THEN x ELSE '' END END AS source, CASE WHEN none THEN 'documento' ELSE 'Nandu_' || s || '_N_' || doc_id || x END AS stored, CASE WHEN none THEN '' ELSE '_and__' || s || '_N__' || doc_id || x END AS key FROM n""",
    "table_ref_prefix": f"""WITH {_PART_SQL}, r AS (SELECT DISTINCT unnest([i, i || '.7', (ord // 10)::VARCHAR]) AS ref FROM t),
m AS (SELECT *, CASE WHEN i = ref THEN 3 WHEN starts_with(i, ref) THEN 2 ELSE 1 END AS fit FROM r JOIN t ON starts_with(i, ref) OR starts_with(ref, i))
SELECT ref, i AS table_id, state, CASE fit WHEN 3 THEN 'exact' WHEN 2 THEN 'stored_extends_ref' ELSE 'ref_extends_stored' END AS match FROM m QUALIFY row_number() OVER (PARTITION BY ref ORDER BY fit DESC, s DESC, length(i) DESC, ord) = 1""",
    "count_by_state": f"WITH {_PART_SQL} SELECT state, count(*) AS n FROM t GROUP BY state",
    "table_state": """WITH c AS (SELECT l_orderkey, CASE WHEN l_orderkey % 7 > 0 THEN count(*) END AS g, CASE WHEN l_orderkey % 5 > 0 THEN count(DISTINCT l_suppkey) END AS v FROM lineitem GROUP BY l_orderkey)
SELECT l_orderkey, CASE WHEN g IS NOT NULL AND v IS NOT NULL THEN CASE WHEN abs(g - v) <= greatest(1, floor(0.1 * greatest(g, v))) THEN 'verificada' ELSE 'revision' END WHEN v IS NOT NULL THEN CASE WHEN l_orderkey % 11 = 0 THEN 'revision' ELSE 'extraida' END WHEN g IS NOT NULL THEN 'extraida' ELSE 'solo_imagen' END AS state FROM c""",
    "grid_consistent": "SELECT l_orderkey, l_orderkey % 4 > 0 AND count(*) >= 2 AND count(*) + count(*) FILTER (l_linestatus = 'O' AND l_returnflag <> '') >= 0.45 * 3 * count(*) AS consistent FROM lineitem GROUP BY l_orderkey",
    "merge_headers": "SELECT n_nationkey, n_name || CASE WHEN count(s_suppkey) > 0 THEN ' | PROMEDIO gr/m² | PROMEDIO µm' ELSE ' | PROMEDIO | ' END AS headers, greatest(1, count(s_suppkey))::INT AS n_rows FROM nation LEFT JOIN supplier ON s_nationkey = n_nationkey GROUP BY n_nationkey, n_name",
    "table_regions": "SELECT o_orderkey AS doc_id, 0 AS x0, greatest(0, coalesce(min(row(floor(l_quantity / 20), l_linenumber))[2] * 50 - 53, 0))::INT AS y0, 600 AS x1, 800 AS y1 FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_orderkey",
    "publish_plan": f"WITH {_STORED_SQL} SELECT l.key, CASE WHEN r.size = l.size THEN 'skip' ELSE 'upload' END AS action FROM l LEFT JOIN r USING (key)",
    "prune_plan": f"WITH {_STORED_SQL} SELECT key FROM r EXCEPT SELECT key FROM l",
    "list_versions": "SELECT DISTINCT 'v' || strftime(o_orderdate, '%Y%m%d') AS version FROM orders WHERE o_orderkey % 2 = 0",
    "alias_resolve": """WITH q AS (SELECT c_custkey, ' ' || lower('pedido de ' || n_name || ' para ' || r_name || ' hoy') || ' ' AS q FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON r_regionkey = c_custkey % 5),
k AS (SELECT n_nationkey + 10 AS ord, 'n' || n_nationkey AS doc_id, lower(n_name) AS alias FROM nation WHERE n_nationkey % 3 > 0 UNION ALL SELECT r_regionkey, 'r' || r_regionkey, lower(r_name) FROM region)
SELECT c_custkey, arg_min(doc_id, ord) AS doc_id FROM q LEFT JOIN k ON contains(q, ' ' || alias || ' ') GROUP BY c_custkey""",
}


def figure_candidates(spark, sf):
    """The lines of orders as images of their supplier's document."""
    images = table(spark, sf, "lineitem").select(F.col("l_suppkey").alias("doc_id"), (F.col("l_orderkey") % 100).alias("page"), (F.col("l_linestatus") == "O").alias("scanned"), (F.col("l_discount") * 10).alias("cover"), (F.col("l_quantity") * 4).alias("width"), F.lit(100).alias("height"), F.col("l_partkey").cast("string").alias("digest"))
    return figures.candidates(images).groupBy("doc_id", "page", "digest").agg(F.count("*").alias("n"))


def figure_names(spark, sf):
    """Documents as figures, ten to a volume."""
    i = F.col("doc_id")
    said = F.concat(_pick(i, "ver Figura 3.2 arriba ", _text("figura ", i % 3, " "), "", ""), F.coalesce("text", F.lit("")))
    rows = _docs(spark, sf).select(F.floor(i / 10).cast("long").alias("doc_id"), F.floor(i % 10 / 3).cast("int").alias("page"), i.cast("string").alias("digest"), said.alias("page_text"))
    return figures.named(rows).select("doc_id", "page", "digest", "figure_id")


def transcripts(spark, sf):
    """Every turn, as it is and behind a row of digits."""
    turns = table(spark, sf, "conversations").select("conv_id", "turn", "text", _text("0123456789 " * 4, F.substring("text", 1, 12)).alias("noisy"))
    return turns.select("conv_id", "turn", figures.bad_transcript(F.col("text")).alias("bad"), figures.bad_transcript(F.col("noisy")).alias("bad_noisy"))


def suggestion_lists(spark, sf):
    """Every customer's suggestions as a model writes them, of every third cut off."""
    whole = F.to_json(F.array(F.col("c_name"), F.lit("  "), F.concat(F.lit(" "), "c_mktsegment", F.lit("? ")), F.lit("x"), F.lit("y")))
    two = F.to_json(F.array("c_name", "c_mktsegment"))
    cut = F.concat(F.lit("claro: "), two.substr(F.lit(1), F.length(two) - 1), F.lit(', "tr'))
    raw = F.when(F.col("c_custkey") % 3 == 0, cut).otherwise(whole)
    return table(spark, sf, "customer").select("c_custkey", F.array_join(json_text.suggestions(raw), "|").alias("suggestions"))


def stream_events(spark, sf):
    """Every order as a stream of events; the last one with a result or an error counts."""
    own = _text('event: x\ndata: {"id": ', F.col("o_orderkey"), ', "result": {"a": 1}}\r\ndata: [DONE]\ndata: {"id": 2}\n')
    stream = F.concat(own, F.when(F.col("o_orderkey") % 2 == 0, _text('data: {"id": ', F.col("o_custkey"), ', "error": "e"}\nend')).otherwise(F.lit("")))
    return table(spark, sf, "orders").select("o_orderkey", F.get_json_object(json_text.last_event(stream), "$.id").alias("id"))


def table_cells(spark, sf):
    return _docs(spark, sf).select("doc_id", metadata.cell(F.col("text"), 18).alias("cut"), F.sha2(metadata.cell(F.col("text")), 256).alias("whole"), metadata.bullet(F.col("doc_id")).alias("bullet"))


def part_hierarchy(spark, sf):
    """The parts above every part, where n div 3 is above n."""
    links = table(spark, sf, "part").select("p_partkey", F.expr("CASE WHEN p_partkey > 0 THEN p_partkey div 3 END").alias("above"))
    return ancestry.roots(links, "p_partkey", "above")


def refused_parameters(spark, sf):
    """Every event as a refusal of the parameter that its type names."""
    kind, i = F.col("event_type"), F.col("event_id")
    body = F.when(i % 4 == 0, _text('{"error": {"param": "', kind, '"}}')).when(i % 4 == 1, _text('{"param": "', kind, '"}'))
    message = F.when(i % 4 == 2, _text("Unsupported value: '", kind, "' here")).otherwise(F.lit("nothing"))
    return table(spark, sf, "events").select("event_id", metadata.unsupported_parameter(body, message).alias("parameter"), metadata.error_detail(F.concat(message, F.lit("\nmore"))).alias("detail"))


def struct_ref_search(spark, sf):
    """Documents that open with the article that a question names, or with one whose number goes on from it."""
    asked = table(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), F.explode(tx.struct_refs(_text("según el articulo ", F.col("item_id") % 40, " y ", F.col("text")))).alias("reference"))
    chunks = _docs(spark, sf).select("doc_id", F.explode(F.array_distinct(tx.all_refs(_text("Artículo ", F.col("doc_id") % 40, ". ", F.col("text"))))).alias("own"))
    number = F.substring_index("own", " ", -1)
    begun = F.transform(F.sequence(F.lit(1), F.length(number)), lambda n: F.concat_ws(" ", F.substring_index("own", " ", 1), F.substring(number, F.lit(1), n)))
    # Every beginning of a number is a key, so the join is by equality.
    return asked.join(chunks.select("doc_id", F.explode(begun).alias("reference")), "reference").select("query_id", "reference", "doc_id").distinct()


ORACLES |= {
    "figure_candidates": """WITH i AS (SELECT l_suppkey AS doc_id, l_orderkey % 100 AS page, l_linestatus = 'O' AS scanned, l_discount * 10 AS cover, l_quantity * 4 AS width, l_partkey::VARCHAR AS digest FROM lineitem),
c AS (SELECT doc_id, digest, count(*) AS n FROM i GROUP BY ALL), p AS (SELECT doc_id, count(DISTINCT page) AS pages FROM i GROUP BY doc_id)
SELECT doc_id, page, digest, count(*) AS n FROM i JOIN c USING (doc_id, digest) JOIN p USING (doc_id) WHERE NOT scanned AND cover >= 0.08 AND cover < 0.70 AND width >= 60 AND c.n <= greatest(3, 0.05 * pages) GROUP BY ALL""",
    "figure_names": """WITH f AS (SELECT doc_id // 10 AS doc_id, (doc_id % 10 // 3)::INT AS page, doc_id::VARCHAR AS digest, CASE doc_id % 4 WHEN 0 THEN '3.2' WHEN 1 THEN (doc_id % 3)::VARCHAR ELSE 'p' || (doc_id % 10 // 3) END AS base FROM documents),
n AS (SELECT *, row_number() OVER (PARTITION BY doc_id, base ORDER BY page, digest) AS n FROM f) SELECT doc_id, page, digest, CASE WHEN n = 1 THEN base ELSE base || '_' || n END AS figure_id FROM n""",
    "transcripts": r"""WITH t AS (SELECT conv_id, turn, trim(coalesce(text, '')) AS a, trim(repeat('0123456789 ', 4) || substr(coalesce(text, ''), 1, 12)) AS b FROM conversations)
SELECT conv_id, turn, length(a) < 8 OR len(regexp_extract_all(a, '\p{L}')) < greatest(8, 0.3 * length(a)) AS bad, length(b) < 8 OR len(regexp_extract_all(b, '\p{L}')) < greatest(8, 0.3 * length(b)) AS bad_noisy FROM t""",
    "suggestion_lists": "SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN c_name || '|' || c_mktsegment ELSE c_name || '|' || c_mktsegment || '?|x' END AS suggestions FROM customer",
    "stream_events": "SELECT o_orderkey, (CASE WHEN o_orderkey % 2 = 0 THEN o_custkey ELSE o_orderkey END)::VARCHAR AS id FROM orders",
    "table_cells": r"""WITH c AS (SELECT doc_id, trim(regexp_replace(coalesce(text, ''), '\s+', ' ', 'g')) AS v FROM documents)
SELECT doc_id, CASE WHEN length(v) > 18 THEN substr(v, 1, 17) || '…' ELSE v END AS cut, sha256(v) AS whole, CASE WHEN doc_id < 20 THEN substr('①②③④⑤⑥⑦⑧⑨⑩⑪⑫⑬⑭⑮⑯⑰⑱⑲⑳', doc_id + 1, 1) ELSE (doc_id + 1) || '.' END AS bullet FROM c""",
    "part_hierarchy": """WITH RECURSIVE l AS (SELECT p_partkey AS child, CASE WHEN p_partkey > 0 THEN p_partkey // 3 END AS parent FROM part), r AS (SELECT child, child AS root, 0::BIGINT AS depth FROM l WHERE parent IS NULL OR parent NOT IN (SELECT child FROM l)
UNION ALL SELECT l.child, r.root, r.depth + 1 FROM r JOIN l ON l.parent = r.child) SELECT child AS p_partkey, root, depth FROM r""",
    "refused_parameters": "SELECT event_id, CASE WHEN event_id % 4 < 3 THEN event_type END AS parameter, CASE WHEN event_id % 4 = 2 THEN 'Unsupported value: ' || chr(39) || event_type || chr(39) || ' here' ELSE 'nothing' END AS detail FROM events",
    "struct_ref_search": "SELECT item_id AS query_id, 'ARTÍCULO ' || (item_id % 40) AS reference, doc_id FROM benchmark, documents WHERE starts_with((doc_id % 40)::VARCHAR, (item_id % 40)::VARCHAR)",
}
QUERIES = {name: globals()[name] for name in ORACLES}

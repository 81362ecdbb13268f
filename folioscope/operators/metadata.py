"""Metadata shaping, answer cleaning, small rules over texts and image readings: column functions and projections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Patterns of the answer cleaning, of footnotes and of questions in images.
SOURCES_HEADER = r"(?im)^\s*(?:fuentes|referencias|sources|citas)\s*:\s*$"
BRACKET_CITE = r"\[\s*\d{1,3}(?:\s*[-–]\s*\d{1,3})?(?:\s*,\s*(?:p|pp)\.?\s*\d+)?(?:\s*,\s*\d{1,3})*\s*\]"
FOOTNOTE = r"(?i)^\s*(?:\*+\s|\(\d+\)\s|\d\)\s|Notas?\b|Fuente\b)"
EXAM = r"(?i)(pregunta|verdadero|falso|marque|seleccione|opción\s+[A-D]|[a-d]\.)"
ASKS = r"(?iu)\?|¿|\b(qu[eé]|cu[aá]l(?:es)?|cu[aá]nto|c[oó]mo|seg[uú]n|tipo|clase|identifica|analiza|interpreta|explica|indica|dime)\b"
OPTIONS = ("A", "B", "C", "D", "TRUE", "FALSE", "VERDADERO", "FALSO")
OPTION_LINE = r"([A-Da-d]\s*[).\-:]\s*[^A-Da-d]+)"
IMAGE_PARTS = ("Usuario dijo sobre la imagen: ", "Contenido interpretado de la imagen:\n", "Texto detectado en la imagen:\n")
IMAGE_DEFAULT = "Interpreta la imagen y responde según la norma."
IMAGE_END = "Con base en lo anterior, responde la consulta del usuario de forma breve y precisa."
FLAT = ("doc_id", "doc_name", "doc_tipo", "vigente", "entidad", "version", "alias")
OPTIONAL = ("libro", "complementa")
#: Rows of a key that a task ranks.
RANKED = 20_000


def filled(text: Column) -> Column:
    """Null for an empty string."""
    return F.nullif(text, F.lit(""))


def flat_metadata(chunks: DataFrame, documents: DataFrame, page: str = "page") -> DataFrame:
    """Chunks with the flat fields of their document, those that it has of the optional ones, and ``pagina``."""
    have = [c for c in (*FLAT, *OPTIONAL) if c in documents.columns]
    kept = [c for c in chunks.columns if c not in have or c == "doc_id"]
    return chunks.select(*kept).join(documents.select(*have), "doc_id", "left").withColumn("pagina", F.col(page))


def primitives_only(df: DataFrame) -> DataFrame:
    """Arrays, maps and structs as JSON text; primitives as they are."""
    nested = (T.ArrayType, T.MapType, T.StructType)
    return df.select(*(F.to_json(f.name).alias(f.name) if isinstance(f.dataType, nested) else F.col(f.name) for f in df.schema.fields))


def metadata_json(df: DataFrame, columns: list[str]) -> Column:
    """One JSON object of the columns, nulls left out."""
    return F.to_json(F.struct(*(F.col(c) for c in columns)))


def normalised(df: DataFrame) -> DataFrame:
    """``source`` from source, doc_name or doc_id, the first that isn't empty; ``page`` from page or pagina."""
    source = F.coalesce(filled(F.col("source")), filled(F.col("doc_name")), F.col("doc_id").cast("string"))
    return df.withColumns({"source": source, "page": F.coalesce("page", "pagina")})


def trace_rows(hits: DataFrame, query: str = "query_id") -> DataFrame:
    """Hits as rows of a trace: rank, score to four digits, how it was scored and found, source, page, chunk and text."""
    return long_ranked(hits, query, "ord").select(
        query, "rank", F.round("score", 4).alias("score"), F.coalesce("score_type", F.lit("cosine_distance")).alias("score_type"),
        F.coalesce("method", F.lit("dense")).alias("method"), F.coalesce("source", F.lit("desconocido")).alias("source"), "page", "chunk_id", F.coalesce("text", F.lit("")).alias("content"),
    )


def long_ranked(rows: DataFrame, key: str, order: str, most: int = RANKED) -> DataFrame:
    """Rows with ``rank``, the place in the order of a number within each key, where a few keys have most rows.

    A key of more than ``most`` rows is dealt out by ranges of the number, so that no task has the whole key, and
    the counts of the ranges before are added.  Equal numbers share a range, in which they are in no fixed order.
    What is broadcast is a row for each such key and one for each of its ranges.
    """
    sizes = rows.groupBy(F.col(key).alias("_key")).agg(F.count("*").alias("_size"))
    parts = -(-(sizes.agg(F.max("_size")).first()[0] or 0) // most)
    if parts <= 1:
        return rows.withColumn("rank", F.row_number().over(W.partitionBy(key).orderBy(order)))
    quantiles = F.percentile_approx(order, [i / parts for i in range(1, parts)], 100 * parts)
    bounds = rows.groupBy(F.col(key).alias("_key")).agg(F.count("*").alias("_size"), F.sort_array(F.array_distinct(quantiles)).alias("_bounds")).where(F.col("_size") > most)
    cut = rows.join(F.broadcast(bounds), F.col(key).eqNullSafe(F.col("_key")), "left")
    # Nulls come first, before the first bound.
    cut = cut.withColumn("_range", F.coalesce(F.size(F.filter("_bounds", lambda x: F.when(F.col(order).isNotNull(), x < F.col(order)).otherwise(False))), F.lit(0))).withColumn("_long", F.col("_size").isNotNull()).drop("_key", "_size", "_bounds")
    counts = cut.where("_long").groupBy(F.col(key).alias("_key"), F.col("_range").alias("_part")).agg(F.count("*").alias("_n"))
    before = counts.select("_key", "_part", (F.sum("_n").over(W.partitionBy("_key").orderBy("_part")) - F.col("_n")).alias("_before"))
    own = cut.withColumn("_own", F.row_number().over(W.partitionBy(key, "_range").orderBy(order)))
    placed = own.join(F.broadcast(before), F.col(key).eqNullSafe(F.col("_key")) & (F.col("_range") == F.col("_part")), "left")
    return placed.select(*rows.columns, (F.col("_own") + F.coalesce("_before", F.lit(0))).cast("int").alias("rank"))


def source_rows(sources: DataFrame, key: str, limit: int = 20) -> DataFrame:
    """The first ``limit`` (ord, title, uri, type, text) of each key: rank, and a JSON object without nulls, the text cut to 500 characters."""
    rank = F.row_number().over(W.partitionBy(key).orderBy("ord"))
    named = sources.withColumn("rank", rank).where(F.col("rank") <= limit)
    text = filled(F.substring("text", 1, 500))
    return named.select(key, "rank", F.to_json(F.struct("rank", filled(F.col("title")).alias("title"), filled(F.col("uri")).alias("uri"), "type", text.alias("text"))).alias("item"))


def question_state(df: DataFrame, question: str = "question", user: str = "user_id", session: str = "session_id") -> DataFrame:
    return df.withColumns({question: F.trim(F.coalesce(question, F.lit(""))), user: F.coalesce(filled(F.col(user)), F.lit("anon")), session: F.coalesce(filled(F.col(session)), F.lit("default"))})


def utc_stamp(time: Column) -> Column:
    return F.date_format(time, "yyyy-MM-dd'T'HH:mm:ss'Z'")


def version_name(time: Column) -> Column:
    return F.concat(F.lit("v"), F.date_format(time, "yyyyMMdd-HHmmss"))


def object_name(prefix: Column, chat: Column, time: Column, suffix: Column) -> Column:
    return F.concat_ws("/", prefix, chat, F.concat_ws(".", F.date_format(time, "yyyyMMdd'T'HHmmss'Z'"), suffix))


def merged_maps(left: Column, right: Column) -> Column:
    """Both maps; where both have a key, the right one's value."""
    return F.map_concat(F.map_filter(left, lambda k, _: ~F.map_contains_key(right, k)), right)


def cleaned_answer(text: Column, sources: Column | None = None) -> Column:
    """Without the sources section and bracketed cites, spaces squeezed outside preformatted blocks; a list of sources goes to the end."""
    pre = r"(?is)<pre>.*?</pre>"
    rest, blocks = F.split(text, pre, -1), F.regexp_extract_all(text, F.lit(pre), F.lit(0))
    # A header ends the answer in the first part that has one: the parts after it, and the blocks between, go.
    heads = F.transform(rest, lambda p: F.rlike(p, F.lit(SOURCES_HEADER)))
    upto = F.coalesce(F.nullif(F.array_position(heads, True), F.lit(0)), F.size(rest).cast("long")).cast("int")
    squeeze = lambda p: F.regexp_replace(F.regexp_replace(F.regexp_replace(p, BRACKET_CITE, ""), r"[ \t]{2,}", " "), r"\n{3,}", "\n\n")
    shown = F.transform(F.slice(rest, F.lit(1), upto), lambda p: squeeze(F.element_at(F.split(p, SOURCES_HEADER, 2), 1)))
    body = F.array_join(F.transform(shown, lambda p, i: F.concat(p, F.when(i < upto - 1, F.get(blocks, i)).otherwise(F.lit("")))), "")
    body = F.regexp_replace(body, r"^\s+|\s+$", "")
    return body if sources is None else F.when(F.size(sources) > 0, F.concat(body, F.lit("\n\nFuentes:\n"), F.array_join(sources, "\n"))).otherwise(body)


def cell(value: Column, width: int | None = None) -> Column:
    """White space collapsed; above ``width`` cut, with an ellipsis as the last character."""
    flat = F.trim(F.regexp_replace(F.coalesce(value.cast("string"), F.lit("")), r"\s+", " "))
    return flat if width is None else F.when(F.length(flat) > width, F.concat(F.substring(flat, 1, width - 1), F.lit("…"))).otherwise(flat)


def bullet(index: Column) -> Column:
    """Circled numbers for 0 to 19, then ``21.`` and so on."""
    return F.when(index < 20, F.lit("①②③④⑤⑥⑦⑧⑨⑩⑪⑫⑬⑭⑮⑯⑰⑱⑲⑳").substr((index + 1).cast("int"), F.lit(1))).otherwise(F.concat((index + 1).cast("string"), F.lit(".")))


def footnotes(text: Column) -> Column:
    """Footnote lines joined, null if there are none."""
    kept = F.filter(F.transform(F.split(text, r"\r?\n"), lambda x: F.trim(x)), lambda x: F.rlike(x, F.lit(FOOTNOTE)))
    return F.when(F.size(kept) > 0, F.array_join(kept, " · "))


def exam_like(text: Column) -> Column:
    return F.coalesce(F.rlike(text, F.lit(EXAM)), F.lit(False))


def asks_about_image(caption: Column) -> Column:
    return F.coalesce(F.rlike(caption, F.lit(ASKS)), F.lit(False))


def image_reading(text: Column) -> Column:
    """struct(answer, options): the first option named in a reading, and its option lines."""
    flat = F.regexp_replace(F.regexp_replace(F.coalesce(text, F.lit("")), "[·•▪]", "."), r"\s+", " ")
    named = F.filter(F.array(*map(F.lit, OPTIONS)), lambda o: F.regexp_like(flat, F.concat(F.lit(r"(?i)\b"), o, F.lit(r"\b"))))
    lines = F.regexp_extract_all(flat, F.lit(OPTION_LINE), F.lit(1))
    return F.struct(F.coalesce(F.get(named, F.lit(0)), F.lit("")).alias("answer"), F.array_join(lines, "\n").alias("options"))


def image_question(text: Column, other: Column | None = None) -> Column:
    """The longest line that ends in a question mark, else the longest line; under 15 characters, ``other`` if there is one."""
    lines = F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), r"\r?\n"), lambda x: F.trim(x)), lambda x: x != "")
    longest = lambda xs: F.element_at(F.array_sort(F.transform(xs, lambda x, i: F.struct((-F.length(x)).alias("n"), i.alias("i"), x.alias("x")))), 1)["x"]
    asked = F.filter(lines, lambda x: F.endswith(x, F.lit("?")))
    found = F.when(F.size(asked) > 0, longest(asked)).when(F.size(lines) > 0, longest(lines)).otherwise(F.lit(""))
    return F.when(F.length(found) >= 15, found).otherwise(F.coalesce(filled(other) if other is not None else F.lit(None).cast("string"), found))


def image_prompt(caption: Column, vision: Column, ocr: Column) -> Column:
    """What is known of an image, each part only if there is one, and the instruction."""
    part = lambda name, value: F.when(F.coalesce(value, F.lit("")) != "", F.concat(F.lit(name), F.trim(value)))
    none = F.when((F.coalesce(vision, F.lit("")) == "") & (F.coalesce(ocr, F.lit("")) == ""), F.lit(IMAGE_DEFAULT))
    return F.concat_ws("\n\n", *(part(n, v) for n, v in zip(IMAGE_PARTS, (caption, vision, ocr), strict=True)), none, F.lit(IMAGE_END))


def error_detail(text: Column) -> Column:
    return F.substring(F.split_part(F.coalesce(text, F.lit("")), F.lit("\n"), F.lit(1)), 1, 200)


def unsupported_parameter(body: Column, message: Column) -> Column:
    """The parameter that a refused request names: in the error's body, else quoted in the message."""
    inner = F.coalesce(filled(F.get_json_object(body, "$.error.param")), filled(F.get_json_object(body, "$.param")))
    quoted = filled(F.regexp_extract(message, r"'param':\s*'([^']+)'", 1))
    named = filled(F.regexp_extract(message, r"(?i)unsupported (?:parameter|value):?\s*'([^']+)'", 1))
    return F.coalesce(inner, quoted, named)


def content_text(blocks: Column) -> Column:
    """The texts of content blocks (type, text) joined."""
    return F.array_join(F.transform(F.filter(blocks, lambda b: b["type"] == "text"), lambda b: b["text"]), "")


def requested_table(entities: Column, question: Column) -> Column:
    """The first table among the entities (type, value), else the one that the question names."""
    first = F.get(F.filter(entities, lambda e: (e["type"] == "tabla") & (F.coalesce(e["value"], F.lit("")) != "")), F.lit(0))["value"]
    return F.coalesce(first, filled(F.regexp_extract(question, r"(?iu)\btabla\s+(\d+(?:[.\-]\d+)*(?:\.[a-z]\b|\s?\([A-Z]\))?)", 1)))


def image_cover(x0: Column, y0: Column, x1: Column, y1: Column, page_area: Column) -> Column:
    return ((x1 - x0) * (y1 - y0)) / F.coalesce(F.nullif(page_area, F.lit(0.0)), F.lit(1.0))


def page_kind(cover: Column) -> Column:
    """By the largest image of a page: a scan from 0.70, mixed from 0.30, else text."""
    return F.when(cover >= 0.70, "escaneada").when(cover >= 0.30, "mixta").otherwise("texto")


def content_hash(content: Column) -> Column:
    return F.substring(F.sha2(content, 256), 1, 16)


def table_payload(title: Column, headers: Column, rows: Column, notes: Column) -> Column:
    return F.to_json(F.struct(F.coalesce(title, F.lit("")).alias("title"), headers.alias("headers"), rows.alias("rows"), notes.alias("notes")))


def table_chunk(doc_name: Column, table_id: Column, title: Column, parent: Column, headers: Column, rows: Column) -> Column:
    """The text that stands for a table in the index: name and title, parent article, columns and the first three rows."""
    name = F.trim(F.concat(F.lit("["), doc_name, F.lit(" — Tabla "), table_id, F.lit("] "), F.coalesce(title, F.lit(""))))
    under = F.when(F.coalesce(parent, F.lit("")) != "", F.concat(F.lit("Pertenece a: "), parent))
    columns = F.when(F.size(headers) > 0, F.concat(F.lit("Columnas: "), F.array_join(headers, " | ")))
    shown = F.transform(F.slice(F.coalesce(rows, F.array().cast("array<array<string>>")), 1, 3), lambda r: F.concat(F.lit("Fila: "), F.array_join(r, " | ")))
    return F.concat_ws("\n", name, under, columns, shown)


def asset_id(doc_id: Column, kind: str, name: Column) -> Column:
    return F.concat_ws("_", doc_id.cast("string"), F.lit(kind), F.regexp_replace(name, "[^0-9A-Za-z.()_-]" if kind == "fig" else "[^0-9A-Za-z.()-]", "_"))

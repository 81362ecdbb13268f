"""Page and line structure: boilerplate, reading order, segments, pieces, windows and packed chunks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from folioscope.functions.text import PAGE_NUMBER, PIECE_START, any_case, heading, line_key, table_anchor, token_estimate


def edge_lines(lines: Column, top: int = 4, bottom: int = 3) -> Column:
    """The first and last lines of a page; both ends of a short page."""
    return F.concat(F.slice(lines, 1, top), F.slice(lines, F.greatest(F.size(lines) - bottom + 1, F.lit(1)), F.lit(bottom)))


def boilerplate(pages: DataFrame, group: str, page: str, text: str = "text", share: float = 0.35, least: int = 6) -> DataFrame:
    """(group, line_key, n_pages) of edge lines on at least ``share`` of a group's pages, empty pages included."""
    total = pages.groupBy(group).agg(F.countDistinct(page).alias("_all"))
    edges = pages.select(group, page, F.explode(edge_lines(F.split(text, "\n"))).alias("line")).select(group, page, line_key(F.col("line")).alias("line_key"))
    counted = edges.where(F.length("line_key") >= least).distinct().groupBy(group, "line_key").agg(F.count("*").alias("n_pages"))
    return counted.join(total, group).where(F.col("n_pages") >= share * F.col("_all")).drop("_all")


def strip_boilerplate(pages: DataFrame, found: DataFrame, group: str, page: str, text: str = "text") -> DataFrame:
    """Pages without boilerplate lines and bare page numbers, lines trimmed, blank runs squeezed."""
    rows = pages.select(group, page, F.posexplode(F.split(text, "\n")).alias("line_no", "line")).withColumn("line", F.trim("line")).withColumn("line_key", line_key(F.col("line")))
    kept = rows.join(found.select(group, "line_key"), [group, "line_key"], "left_anti").where(~F.rlike("line", F.lit(any_case(PAGE_NUMBER))))
    joined = kept.groupBy(group, page).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "line"))), lambda x: x["line"]), "\n").alias("text"))
    clean = F.regexp_replace(F.regexp_replace("text", r"\n{3,}", "\n\n"), r"^\s+|\s+$", "")
    return pages.select(group, page).join(joined, [group, page], "left").select(group, page, F.coalesce(clean, F.lit("")).alias("text"))


def reading_order(blocks: DataFrame, width: float, two_columns: bool, full: float = 0.62) -> DataFrame:
    """Blocks (page, x0, y0, x1, y1, text) with their place: bands cut by full-width blocks, then column, then height."""
    if not two_columns:
        return blocks.withColumn("place", F.row_number().over(W.partitionBy("page").orderBy(F.floor(F.col("y0") * 10 + 0.5), "x0", "text")))
    middle = (F.col("y0") + F.col("y1")) / 2
    wide = ((F.col("x1") - F.col("x0")) >= full * width).cast("int")
    up = W.partitionBy("page").orderBy(middle, "x0")
    before = F.coalesce(F.sum(wide).over(up.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    band = before * 2 + wide
    column = F.when(wide == 1, 0).otherwise(F.when((F.col("x0") + F.col("x1")) / 2 < width / 2, 0).otherwise(1))
    banded = blocks.withColumns({"_band": band, "_column": column, "_middle": middle})
    return banded.withColumn("place", F.row_number().over(W.partitionBy("page").orderBy("_band", "_column", "_middle", "x0"))).drop("_band", "_column", "_middle")


def segments(lines: DataFrame, doc: str = "doc_id") -> DataFrame:
    """(doc, segment_no, kind, number, title, breadcrumb, page_start, page_end, n_lines, text) from lines (doc, page, line_no, line).

    Titles and chapters fill forward into the breadcrumb; the other headings open a segment; lines before
    the first are the preamble; with fewer than three opened segments every page is one.
    """
    order = W.partitionBy(doc).orderBy("page", "line_no")
    so_far = order.rowsBetween(W.unboundedPreceding, 0)
    # A line's own text is only read by the texts; where these are not asked for it is neither dealt out nor sorted.
    rows = lines.withColumns({"h": heading(F.col("line")), "_filled": F.trim("line") != "", "_there": F.col("line").isNotNull()})
    context = F.col("h.kind").isin("titulo", "capitulo")
    opens = F.col("h").isNotNull() & ~context
    label = lambda kind, name: F.last(F.when(F.col("h.kind") == kind, F.concat_ws(" ", F.lit(name), F.col("h.number"))), ignorenulls=True).over(so_far)
    rows = rows.withColumns({"segment_no": F.sum(opens.cast("int")).over(so_far), "_t": label("titulo", "TÍTULO"), "_c": label("capitulo", "CAPÍTULO"), "_opens": opens})
    rows = rows.withColumn("_few", (F.max("segment_no").over(W.partitionBy(doc)) < 3) & F.col(doc).isNotNull())
    own = F.max(F.when(F.col("_opens"), F.struct("h.kind", "h.number", "h.title", "_t", "_c")))
    grouped = rows.where("NOT _few").groupBy(doc, "segment_no").agg(
        own.alias("o"), F.min("page").alias("page_start"), F.max("page").alias("page_end"), F.count("*").alias("n_lines"),
        # Two lines have a line break between them, which is not trimmed.
        (F.coalesce(F.max("_filled"), F.lit(False)) | (F.count_if("_there") > 1)).alias("_text"),
        F.array_join(F.sort_array(F.collect_list(F.struct("page", "line_no", "line")))["line"], "\n").alias("text"),
    )
    crumb = F.concat_ws(" > ", "o._t", "o._c", F.when(F.col("o.kind").isNotNull(), F.concat_ws(" ", F.upper("o.kind"), F.col("o.number"))))
    named = grouped.where("segment_no > 0 OR _text").select(doc, "segment_no", F.coalesce("o.kind", F.lit("preambulo")).alias("kind"), F.coalesce("o.number", F.lit("")).alias("number"), F.coalesce("o.title", F.lit("")).alias("title"), crumb.alias("breadcrumb"), "page_start", "page_end", "n_lines", "text")
    paged = rows.where("_few").groupBy(doc, "page").agg(
        F.count("*").alias("n_lines"), F.array_join(F.sort_array(F.collect_list(F.struct("line_no", "line")))["line"], "\n").alias("text")
    )
    fallback = paged.select(doc, F.col("page").cast("long").alias("segment_no"), F.lit("pagina").alias("kind"), F.col("page").cast("string").alias("number"), F.lit("").alias("title"), F.lit("").alias("breadcrumb"), F.col("page").alias("page_start"), F.col("page").alias("page_end"), "n_lines", "text")
    return named.unionByName(fallback)


def numbering_gaps(articles: DataFrame, doc: str = "doc_id", most: int = 3) -> DataFrame:
    """Articles whose number jumps by more than ``most``."""
    before = F.lag("number").over(W.partitionBy(doc).orderBy("page_start", "number"))
    return articles.withColumn("previous", before).where(F.col("number") > F.col("previous") + most)


def contiguous_pages(anchors: DataFrame, keys: list[str]) -> DataFrame:
    """Pages of each key that run on from its first one without a gap; title of the first anchor that doesn't continue another."""
    pages = anchors.select(*keys, "page").distinct()
    order = W.partitionBy(*keys).orderBy("page")
    island = pages.withColumn("_island", F.col("page") - F.row_number().over(order)).withColumn("_first", F.min("_island").over(W.partitionBy(*keys)))
    run = island.where("_island = _first").groupBy(*keys).agg(F.min("page").alias("page_start"), F.max("page").alias("page_end"), F.count("*").alias("n_pages"))
    title = anchors.groupBy(*keys).agg(F.coalesce(F.min(F.when(~F.col("continued"), F.struct("page", "line_no", "title")))["title"], F.min(F.struct("page", "line_no", "title"))["title"]).alias("title"))
    return run.join(title, keys)


def anchors(lines: DataFrame) -> DataFrame:
    return lines.withColumn("a", table_anchor(F.col("line"))).where("a IS NOT NULL").select(*[c for c in lines.columns if c != "line"], "a.*")


def pieces(lines: DataFrame, doc: str = "doc_id") -> DataFrame:
    """(doc, piece_no, text): runs of lines that blank lines and list markers part."""
    order = W.partitionBy(doc).orderBy("line_no")
    blank = F.trim("line") == ""
    rows = lines.withColumn("_blank", blank).withColumn("_start", F.rlike("line", F.lit(PIECE_START)) | F.coalesce(F.lag("_blank").over(order), F.lit(True)))
    numbered = rows.where(~F.col("_blank")).withColumn("piece_no", F.sum(F.col("_start").cast("int")).over(order.rowsBetween(W.unboundedPreceding, 0)))
    return numbered.groupBy(doc, "piece_no").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "line"))), lambda x: x["line"]), "\n").alias("text"))


def windows(docs: DataFrame, size: int, overlap: int, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc, window_no, start, text) of fixed windows that overlap; the last one ends with the text."""
    step = size - overlap
    starts = F.sequence(F.lit(0), F.greatest(F.lit(0), F.ceil((F.length(text) - size) / step).cast("int")) * step, F.lit(step))
    return docs.where(F.length(text) > 0).select(doc, text, F.posexplode(starts).alias("window_no", "start")).select(doc, "window_no", "start", F.substring(F.col(text), F.col("start") + 1, F.lit(size)).alias("text"))


def packed(parts: Column, budget: int | Column, hard: int | Column) -> Column:
    """Pieces packed greedily into chunks of at most ``budget`` estimated tokens; a piece above ``hard`` is cut after ``.``, ``;`` or ``:`` first."""
    small = F.flatten(F.transform(parts, lambda p: F.when(token_estimate(p) <= hard, F.array(p)).otherwise(F.split(p, r"(?<=[.;:])\s+"))))

    def add(state: Column, piece: Column) -> Column:
        both = F.concat(state["open"], F.lit("\n"), piece)
        fits = (state["open"] != "") & (token_estimate(both) <= budget)
        done = F.when(state["open"] == "", state["done"]).otherwise(F.concat(state["done"], F.array(state["open"])))
        return F.struct(F.when(fits, state["done"]).otherwise(done).alias("done"), F.when(fits, both).otherwise(piece).alias("open"))

    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("open"))
    return F.aggregate(small, start, add, lambda s: F.when(s["open"] == "", s["done"]).otherwise(F.concat(s["done"], F.array(s["open"]))))


def chunks(docs: DataFrame, budget: int = 450, hard: int = 560, doc: str = "doc_id", text: str = "text", header: str | None = None) -> DataFrame:
    """(doc, chunk_id, n_tokens, text): a document's pieces packed, after ``[header]`` if given, whose tokens go off the budgets."""
    head = F.concat(F.lit("["), F.col(header), F.lit("]\n")) if header else F.lit("")
    if header:
        docs = docs.withColumn("_used", token_estimate(head))
        budget, hard = F.greatest(F.lit(80), budget - F.col("_used")), F.greatest(F.lit(120), hard - F.col("_used"))
    parts = F.filter(F.split(text, r"\n(?=\s*(?:[a-zñ]\)|[A-ZÑ]\)|\d{1,2}\.\s|[•\-–]\s))|\n\s*\n"), lambda p: F.trim(p) != "")
    rows = docs.select(doc, head.alias("_head"), F.posexplode(packed(parts, budget, hard)).alias("_n", "_text"))
    return rows.select(doc, F.format_string("%s_c%05d", F.col(doc).cast("string"), F.col("_n")).alias("chunk_id"), token_estimate(F.col("_text")).alias("n_tokens"), F.concat("_head", "_text").alias("text"))


def interval_parent(points: DataFrame, spans: DataFrame, doc: str = "doc_id") -> DataFrame:
    """Each point (doc, page) with the label of the first span (doc, page_start, page_end, ord) around it, null if none is.

    Spans are unrolled to their pages, so the join is an equi-join.
    """
    unrolled = spans.select(doc, F.explode(F.sequence("page_start", "page_end")).alias("page"), "ord", "label").groupBy(doc, "page").agg(F.min(F.struct("ord", "label"))["label"].alias("label"))
    return points.join(unrolled, [doc, "page"], "left")

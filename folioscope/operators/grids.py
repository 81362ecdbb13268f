"""Table grids: header levels, sanity rules, rendering, the extraction state and lookup by reference."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioscope.functions.text import markdown_row

# Fixed values.
NUMERIC_CELL = r"^[\d.,\s%–\-—()]+$"
STATE_RANK = {"verificada": 3, "extraida": 2, "revision": 1}
LABEL_MOST = 30


def clean_grid(grid: Column) -> Column:
    """Cells trimmed, nulls empty, empty rows dropped, rows padded to the widest; no grid of fewer than two rows."""
    rows = F.filter(F.transform(grid, lambda r: F.transform(r, lambda c: F.coalesce(F.trim(c), F.lit("")))), lambda r: F.exists(r, lambda c: c != ""))
    # Bound once as the element of an array: named in the lambda over the rows, both would be computed for every row.
    bound = F.transform(F.array(rows), lambda r: F.struct(r.alias("rows"), F.array_max(F.transform(r, lambda x: F.size(x))).alias("width")))
    padded = lambda g: F.transform(g["rows"], lambda r: F.slice(F.concat(r, F.array_repeat(F.lit(""), g["width"])), F.lit(1), g["width"]))
    return F.get(F.transform(bound, lambda g: F.when(F.size(g["rows"]) >= 2, padded(g)).otherwise(F.array().cast("array<array<string>>"))), F.lit(0))


def fill_right(row: Column) -> Column:
    """Empty cells take the value to their left, as under a merged parent."""
    last = lambda a: F.coalesce(F.try_element_at(a, F.lit(-1)), F.lit(""))
    return F.aggregate(row, F.array().cast("array<string>"), lambda a, c: F.concat(a, F.array(F.when(c != "", c).otherwise(last(a)))))


def is_subheader(header: Column, row: Column) -> Column:
    """Whether a row names columns under a header with gaps: short labels, no numbers, at least one gap filled."""
    label = lambda c: (c == "") | (~F.rlike(c, F.lit(NUMERIC_CELL)) & (F.length(c) <= LABEL_MOST) & ~F.rlike(c, F.lit(r"[.;:]\s")))
    filled = F.exists(F.zip_with(header, row, lambda h, c: (h == "") & (F.coalesce(c, F.lit("")) != "")), lambda x: x)
    return F.exists(row, lambda c: c != "") & F.forall(row, label) & filled


def merged_headers(grid: Column) -> Column:
    """struct(headers, body) of a clean grid with up to three header levels; a body row always stays."""
    row = lambda i: F.try_element_at(grid, F.lit(i))
    two = F.coalesce((F.size(grid) > 2) & is_subheader(row(1), row(2)), F.lit(False))
    three = F.coalesce(two & (F.size(grid) > 3) & is_subheader(row(2), row(3)), F.lit(False))
    depth = F.lit(1) + two.cast("int") + three.cast("int")
    levels = F.transform(F.slice(grid, F.lit(1), depth), lambda r, i: F.when(i < depth - 1, fill_right(r)).otherwise(r))
    named = F.transform(
        F.sequence(F.lit(1), F.size(row(1))),
        lambda j: F.trim(F.aggregate(
            F.transform(levels, lambda lv: F.element_at(lv, j)), F.struct(F.lit("").alias("all"), F.lit("").alias("last")),
            lambda s, v: F.when((v == "") | (v == s["last"]), s).otherwise(F.struct(F.concat_ws(" ", F.nullif(s["all"], F.lit("")), v).alias("all"), v.alias("last"))),
            lambda s: s["all"],
        )),
    )
    return F.when(F.size(grid) >= 2, F.struct(named.alias("headers"), F.slice(grid, depth + 1, F.size(grid)).alias("body")))


def is_consistent(headers: Column, body: Column) -> Column:
    """At least two columns and rows, enough named columns and filled cells."""
    cells = F.flatten(body)
    full = lambda a: F.size(F.filter(a, lambda c: c != ""))
    return (F.size(headers) >= 2) & (F.size(body) >= 2) & (full(headers) >= F.greatest(F.lit(2), F.floor(F.size(headers) / 2))) & (full(cells) >= 0.45 * F.greatest(F.lit(1), F.size(cells)))


def is_prose(headers: Column, body: Column) -> Column:
    """Running text cut into false columns: words that go on over cell borders, or syllable hyphens at cell ends."""
    rows = F.concat(F.array(headers), body)
    glued = lambda r: F.size(F.filter(F.zip_with(F.slice(r, F.lit(1), F.size(r) - 1), F.slice(r, F.lit(2), F.size(r)), lambda a, b: F.rlike(a, F.lit(r"\p{L}$")) & F.rlike(b, F.lit(r"^\p{Ll}"))), lambda x: x)) >= 2
    hyphen = lambda r: F.exists(r, lambda c: F.rlike(c, F.lit(r"-\s*$")))
    return (F.size(F.filter(rows, glued)) >= 0.4 * F.size(rows)) | (F.size(F.filter(rows, hyphen)) >= 0.25 * F.size(rows))


def to_markdown(title: Column, headers: Column, body: Column) -> Column:
    rule = F.concat(F.lit("|"), F.array_join(F.transform(headers, lambda _: F.lit("---")), "|"), F.lit("|"))
    return F.concat_ws("\n", F.concat(F.lit("**"), title, F.lit("**")), F.lit(""), markdown_row(headers), rule, F.array_join(F.transform(body, markdown_row), "\n"))


def column_widths(headers: Column, body: Column) -> Column:
    return F.transform(headers, lambda h, j: F.greatest(F.length(h), F.coalesce(F.array_max(F.transform(body, lambda r: F.length(F.get(r, j)))), F.lit(0))))


def text_grid(headers: Column, body: Column, limit: int = 32) -> Column:
    """Fixed-width grid where it fits, else one ``name: value`` block for each row."""
    widths = column_widths(headers, body)
    total = F.aggregate(widths, F.lit(0), lambda a, w: a + w) + 2 * (F.size(widths) - 1)
    line = lambda r: F.rtrim(F.array_join(F.zip_with(r, widths, lambda c, w: F.rpad(c, w, F.lit(" "))), "  "))
    grid = F.array_join(F.transform(F.concat(F.array(headers), body), line), "\n")
    block = lambda r: F.array_join(F.zip_with(headers, r, lambda h, c: F.concat(h, F.lit(": "), c)), "\n")
    return F.when((F.size(headers) <= 1) | (total <= limit), grid).otherwise(F.array_join(F.transform(body, block), "\n\n"))


def table_state(geometry: Column, vision: Column, truncated: Column) -> Column:
    """State from the row counts of two extractions, null where one found none."""
    close = F.abs(geometry - vision) <= F.greatest(F.lit(1), F.floor(0.1 * F.greatest(geometry, vision)))
    return (
        F.when(geometry.isNotNull() & vision.isNotNull(), F.when(close, "verificada").otherwise("revision"))
        .when(vision.isNotNull(), F.when(truncated, "revision").otherwise("extraida"))
        .when(geometry.isNotNull(), "extraida")
        .otherwise("solo_imagen")
    )


def reference_key(name: Column) -> Column:
    return F.lower(F.regexp_replace(name, r"\s+", ""))


def lookup(refs: DataFrame, registry: DataFrame) -> DataFrame:
    """For each ref the registered table that fits best: equal, then extending the ref, then extended by it; ties by state, longer id, earlier row.

    Every proper prefix of a key is looked up by equality, in both directions, instead of comparing all pairs.
    Of the tables that extend one prefix only the best goes into the join, so a ref meets one row for each length
    of key; the joins merge sorted rows, as the sizes of exploded prefixes are estimated too low for a broadcast.
    """
    rank = F.coalesce(F.element_at(F.create_map(*[x for k, v in STATE_RANK.items() for x in (F.lit(k), F.lit(v))]), F.col("state")), F.lit(0))
    stored = registry.select(reference_key(F.col("table_id")).alias("id_key"), (-rank).alias("_state"), "ord", "table_id", "state")
    asked = refs.select("ref", reference_key(F.col("ref")).alias("ref_key")).where("ref_key != ''")
    prefixes = lambda c: F.transform(F.sequence(F.lit(1), F.length(c)), lambda n: F.substring(F.col(c), F.lit(1), n))
    fit = lambda n: F.min(F.struct(n.alias("_fit"), "_state", (-F.length("id_key")).alias("_length"), "ord", "table_id", "state")).alias("_best")
    extending = stored.withColumn("ref_key", F.explode(prefixes("id_key"))).groupBy("ref_key").agg(fit(F.when(F.col("id_key") == F.col("ref_key"), -3).otherwise(-2)))
    equal = stored.groupBy("id_key").agg(fit(F.lit(-1)))
    extends = asked.hint("merge").join(extending, "ref_key").select("ref", "_best")
    extended = asked.withColumn("id_key", F.explode(prefixes("ref_key"))).where("id_key != ref_key").hint("merge").join(equal, "id_key").select("ref", "_best")
    best = extends.unionByName(extended).groupBy("ref").agg(F.min("_best").alias("_best"))
    return best.select("ref", "_best.table_id", "_best.state", F.element_at(F.array(F.lit("ref_extends_stored"), F.lit("stored_extends_ref"), F.lit("exact")), -F.col("_best._fit")).alias("match"))

"""Tables from the boxes of words: ruled cells, gaps in projections, and how two readings agree.

Words are rows (region, x0, y0, x1, y1, text) of any number of regions; a region is a clip of one page.  Rulings
are rows (region, at, low, high, upright) of drawn lines.  The cascade reads a region by its rulings, else by the
gaps between its words, else takes what a model has read from its picture, else leaves the picture alone.

Words and rulings are gathered by region once, and everything else is found row by row, so that the disk holds
one shuffle of them and nothing between the steps; what a task holds at a time is an Arrow batch of regions, read
in parts of ``table_boxes.WORDS``.  Words with a null or NaN in a coordinate are left out.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioscope.lineage import cut
from folioscope.operators import table_boxes
from folioscope.operators.grids import clean_grid, is_consistent, is_prose, merged_headers, table_state, to_markdown

#: Part of a region's digest, so that a change of these rules reads all regions anew.
LAYOUT_VERSION = "1"
#: Distances below which words belong to one phrase, words to one line, and rulings to one ruling.
SPACE, LEADING, STROKE = 6.0, 0.0, 2.0
#: Share of the lines that a gap between columns may be crossed by, as headings do that span columns.
CROSSED = 0.2
BOX, STROKES = ("x0", "y0", "x1", "y1", "text"), ("at", "low", "high", "upright")
# Fixed value: lines below a table that belong to it.
FOOTNOTE = r"(?i)^\s*(?:\*+\s|\(\d+\)\s|\d\)\s|Notas?\b|Fuente\b)"


def _gathered(words: DataFrame, rulings: DataFrame | None = None) -> DataFrame:
    """(region, words, rulings): what is drawn in each region as lists in one row; one shuffle of the words and the rulings."""
    word, ruling = F.struct(*BOX), F.struct(*STROKES)
    if rulings is None:
        empty = F.array().cast("array<struct<at:double,low:double,high:double,upright:boolean>>")
        return words.groupBy("region").agg(F.collect_list(word).alias("words")).withColumn("rulings", empty)
    both = words.select("region", word.alias("word")).unionByName(rulings.select("region", ruling.alias("ruling")), allowMissingColumns=True)
    return both.groupBy("region").agg(F.collect_list("word").alias("words"), F.collect_list("ruling").alias("rulings"))


def _boxes(words: Column, rulings: Column, space: float = SPACE, leading: float = LEADING, crossed: float = CROSSED, stroke: float = STROKE) -> Column:
    """struct(ruled, spaced, lines) of the lists of a region."""

    @F.arrow_udf("struct<ruled:array<array<string>>,spaced:array<array<string>>,lines:array<string>>")
    def boxes(words: pa.Array, rulings: pa.Array) -> pa.Array:
        return table_boxes.read(words, rulings, space, leading, crossed, stroke)

    return boxes(words, rulings)


def read_by_gaps(words: DataFrame, space: float = SPACE, leading: float = LEADING, crossed: float = CROSSED) -> DataFrame:
    """(region, grid): columns are parted by gaps that run through the lines of the region's largest table-like block."""
    found = _gathered(words).select("region", _boxes(F.col("words"), F.col("rulings"), space, leading, crossed)["spaced"].alias("grid"))
    return found.where("region IS NOT NULL AND grid IS NOT NULL")


def read_by_rulings(words: DataFrame, rulings: DataFrame, stroke: float = STROKE) -> DataFrame:
    """(region, grid): a cell lies between the nearest rulings to its left and above that reach its place.

    A ruling that ends short of a cell doesn't part it, so merged cells keep their text in their first place.
    Regions without three rulings each way have no grid.
    """
    found = _gathered(words, rulings).select("region", _boxes(F.col("words"), F.col("rulings"), stroke=stroke)["ruled"].alias("grid"))
    return found.where("region IS NOT NULL AND grid IS NOT NULL")


def footnotes(words: DataFrame, space: float = SPACE, leading: float = LEADING) -> DataFrame:
    """(region, notes): the lines of a region that read as notes to its table."""
    found = _gathered(words).select("region", _boxes(F.col("words"), F.col("rulings"), space, leading)["lines"].alias("lines"))
    return found.select("region", notes_of(F.col("lines")).alias("notes")).where("notes IS NOT NULL")


def notes_of(lines: Column) -> Column:
    """Those of the lines that read as notes, null without any."""
    notes = F.array_join(F.transform(F.filter(lines, lambda t: F.rlike(t, F.lit(FOOTNOTE))), F.trim), " · ")
    return F.when(F.exists(lines, lambda t: F.rlike(t, F.lit(FOOTNOTE))), notes)


def region_digest(words: Column, rulings: Column, version: str = LAYOUT_VERSION) -> Column:
    """16 hex digits of what is drawn in a region and of the version of the rules."""
    point = lambda s, *c: F.concat_ws(":", *(s[x].cast("string") for x in c))
    boxes = F.transform(words, lambda w: F.concat_ws("|", point(w, "x0", "y0", "x1", "y1"), w["text"]))
    strokes = F.transform(rulings, lambda r: F.concat(F.lit("ruling|"), point(r, "at", "low", "high", "upright")))
    marks = F.sort_array(F.concat(boxes, strokes))
    drawn = F.concat_ws("\n", F.lit(version), F.when(F.size(marks) > 0, F.array_join(marks, "\n")))
    return F.substring(F.sha2(drawn, 256), 1, 16)


def _once(df: DataFrame, **columns: Column) -> DataFrame:
    """The frame with columns that are found once: what reads the element of an array doesn't repeat the expression that made it."""
    return df.select(*(c for c in df.columns if c not in columns), F.inline(F.array(F.struct(*(c.alias(n) for n, c in columns.items())))))


def read_regions(regions: DataFrame) -> DataFrame:
    """One row of ``RESULT`` for each row (region, title, scanned, words, rulings, picture, digest) of what is drawn in a region.

    Nothing is shuffled or kept; a task reads the boxes of a batch of regions at a time.
    """
    # Words and rulings are columns before they go to Python, as Spark doesn't send arguments that hold a lambda.
    legible = _once(regions, words=F.when(~F.col("scanned"), F.col("words")), rulings=F.col("rulings"))
    read = legible.withColumn("_read", _boxes(F.col("words"), F.col("rulings")))
    clean = _once(read, _ruled=clean_grid(F.col("_read.ruled")), _spaced=clean_grid(F.col("_read.spaced")), notes=notes_of(F.col("_read.lines")))
    # The second reading only counts where the first has found no table.
    table = _once(clean, _ruled=merged_headers(F.col("_ruled")), _spaced=merged_headers(F.col("_spaced")))
    good = lambda n: is_consistent(F.col(f"{n}.headers"), F.col(f"{n}.body"))
    usable = _once(table, _ruled=F.when(good("_ruled"), F.col("_ruled")), _spaced=F.when(good("_spaced") & ~is_prose(F.col("_spaced.headers"), F.col("_spaced.body")), F.col("_spaced")))
    seen = F.when(F.col("picture").isNotNull(), F.struct("picture.headers", "picture.body"))
    n = lambda t: F.when(t.isNotNull(), F.size(t["body"]))
    geo = F.coalesce("_ruled", "_spaced")
    counted = _once(usable, _n=n(geo), _m=n(seen), _final=F.coalesce(seen, geo), _cut=F.coalesce("picture.truncated", F.lit(False)))
    judged = _once(counted, state=table_state(F.col("_n"), F.col("_m"), F.col("_cut")))
    method = F.when(F.col("_n").isNotNull() & (F.col("state") == "verificada"), "vision+geo").when(F.col("_m").isNotNull(), "vision")
    method = method.when(F.col("_ruled").isNotNull(), "lattice").when(F.col("_spaced").isNotNull(), "text").otherwise("none")
    differ = F.col("_n").isNotNull() & F.col("_m").isNotNull() & (F.col("state") == "revision")
    notes = F.when(differ, F.concat(F.lit("geo="), "_n", F.lit(" / vision="), "_m")).when(F.col("_m").isNull() & F.col("_n").isNotNull(), F.col("notes"))
    headers, body = F.col("_final.headers"), F.col("_final.body")
    markdown = F.when(F.col("_final").isNotNull(), to_markdown(F.coalesce("title", F.col("region").cast("string")), headers, body))
    return judged.select("region", "digest", method.alias("method"), "state", headers.alias("headers"), body.alias("body"), notes.alias("notes"), markdown.alias("markdown"))


RESULT = ("region", "digest", "method", "state", "headers", "body", "notes", "markdown")


def extracted_tables(regions: DataFrame, words: DataFrame, rulings: DataFrame, pictures: DataFrame | None = None, previous: DataFrame | None = None, version: str = LAYOUT_VERSION) -> DataFrame:
    """One row of ``RESULT`` for each of the ``regions`` (region, title, scanned).

    ``pictures``: what a model has read (region, headers, body, truncated), where it was asked.  A region of a
    scan is not read by its words.  Two readings that agree in their rows, to a tenth, verify each other.
    ``previous``: results of an earlier run; a region with the same digest and a grid is taken over as it is.
    """
    words_of, rulings_of = (F.coalesce(n, F.array()) for n in ("words", "rulings"))
    drawn = regions.select("region", "title", "scanned").hint("merge").join(_gathered(words, rulings), "region", "left").withColumns({"words": words_of, "rulings": rulings_of})
    drawn = drawn.withColumn("digest", region_digest(F.col("words"), F.col("rulings"), version))
    if previous is not None:
        # Cut, as both what is kept and what is read anew are made of it.
        drawn = cut(drawn)
        kept = previous.where("headers IS NOT NULL").select(*RESULT).join(drawn.select("region", "digest"), ["region", "digest"], "left_semi").select(*RESULT)
        drawn = drawn.join(kept.select("region"), "region", "left_anti")
    if pictures is None:
        todo = drawn.withColumn("picture", F.lit(None).cast("struct<headers:array<string>,body:array<array<string>>,truncated:boolean>"))
    else:
        todo = drawn.join(pictures.select("region", F.struct("headers", "body", "truncated").alias("picture")), "region", "left")
    fresh = read_regions(todo)
    return fresh if previous is None else fresh.unionByName(kept)

"""Tables read back from boxes: headings that span columns, merged cells, prose, notes, readings that are kept."""

from pathlib import Path

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from folioscope.lineage import shared_folder
from folioscope.operators import table_boxes
from folioscope.operators import table_layout as ops
from folioscope.operators.table_layout import RESULT
from folioscope.plans import catalogue

WORDS, RULINGS, REGIONS = "region long, x0 double, y0 double, x1 double, y1 double, text string", "region long, at double, low double, high double, upright boolean", "region long, title string, scanned boolean"


def words(region, lines, left=(0, 100, 200), letter=5):
    """Lines of cells, each cell's words set from its column's left edge on."""
    out = []
    for i, line in enumerate(lines):
        for cell, x in zip(line, left, strict=False):
            for word in (cell or "").split():
                out.append((region, float(x), 12.0 * i, float(x + letter * len(word)), 12.0 * i + 8, word))
                x += letter * (len(word) + 1)
    return out


GRID = [["Nombre", "PROMEDIO", None], [None, "gr total", "um"], ["Pletinas y láminas", "458", "65,4"], ["Pernos", "381", "54,5"]]


def read(spark, frame):
    return {r["region"]: [list(x) for x in r["grid"]] for r in frame.collect()}


def test_gaps_with_a_heading_that_spans_columns(spark):
    wide = words(1, [["Nombre", "PROMEDIO DE TODAS LAS MEDIDAS"], *GRID[1:], *[[f"fila {i}", str(i), str(i)] for i in range(6)]])
    two = words(2, GRID) + [(2, None, 1.0, 2.0, 3.0, "lost"), (2, 0.0, 60.0, 15.0, 68.0, "end")]
    got = read(spark, ops.read_by_gaps(spark.createDataFrame(wide + two, WORDS)))
    assert got[1][0] == ["Nombre", "PROMEDIO DE TODAS LAS MEDIDAS", ""] and got[1][1:3] == [["", "gr total", "um"], ["Pletinas y láminas", "458", "65,4"]]
    assert got[2] == [[c or "" for c in line] for line in GRID]


def test_rulings_with_merged_cells_and_doubled_strokes(spark):
    rows = [(1, 10.0, 2.0, 90.0, 8.0, "both"), (1, 5.0, 14.0, 20.0, 20.0, "a"), (1, 55.0, 14.0, 70.0, 20.0, "b"), (1, 5.0, 26.0, 20.0, 32.0, "c"), (1, 200.0, 5.0, 210.0, 9.0, "out")]
    upright = [(1, x, 0.0, 36.0, True) for x in (0.0, 0.5, 100.0)] + [(1, 50.0, 12.0, 36.0, True)]
    flat = [(1, y, 0.0, 100.0, False) for y in (0.0, 12.0, 24.0, 36.0, 36.4)]
    words_, lines = spark.createDataFrame(rows, WORDS), spark.createDataFrame(upright + flat, RULINGS)
    assert read(spark, ops.read_by_rulings(words_, lines)) == {1: [["both", ""], ["a", "b"], ["c", ""]]}
    assert ops.read_by_rulings(words_, lines.where("upright")).collect() == []


def test_prose_is_left_to_the_picture_and_notes_are_kept(spark):
    prose = words(1, [["(1) Conduct", "ores individua", "les que dan"], ["itirse la ins-", "talacion en cana", "les que no"], ["mas de lo indi", "cado en la ta", "bla siguiente"]], (0, 90, 190))
    noted = words(2, [*GRID, ["Fuente: catastro de obras"], ["* nota al pie"], ["otra cosa"]])
    regions = spark.createDataFrame([(1, "uno", False), (2, "dos", False), (3, None, True), (4, None, False)], REGIONS)
    seen = spark.createDataFrame([(3, ["a", "b"], [["1", "2"]], True)], "region long, headers array<string>, body array<array<string>>, truncated boolean")
    all_words = spark.createDataFrame(prose + noted + words(3, GRID), WORDS)
    none = spark.createDataFrame([], RULINGS)
    first = ops.extracted_tables(regions, all_words, none, seen)
    got = {r["region"]: r for r in first.collect()}
    assert [(i, got[i]["method"], got[i]["state"]) for i in (1, 2, 3, 4)] == [(1, "none", "solo_imagen"), (2, "text", "extraida"), (3, "vision", "revision"), (4, "none", "solo_imagen")]
    assert got[2]["headers"] == ["Nombre", "PROMEDIO gr total", "PROMEDIO um"] and got[2]["notes"] == "Fuente: catastro de obras · * nota al pie" and got[1]["markdown"] is None
    # Read again with another picture and another word: only what changed, or had no grid, is read anew.
    changed = all_words.withColumn("text", F.when((F.col("region") == 3) & (F.col("text") == "458"), "459").otherwise(F.col("text")))
    fake = first.withColumn("markdown", F.lit("kept"))
    again = {r["region"]: r for r in ops.extracted_tables(regions, changed, none, None, fake).collect()}
    assert again[2]["markdown"] == "kept" and again[3]["method"] == "none" and len(again) == 4
    other = {r["region"]: r for r in ops.extracted_tables(regions, all_words, none, None, fake, version="2").collect()}
    assert other[2]["markdown"] != "kept" and set(RESULT) == set(first.columns)


def test_no_regions(spark):
    empty = [spark.createDataFrame([], s) for s in (REGIONS, WORDS, RULINGS)]
    assert ops.extracted_tables(*empty).collect() == []


@pytest.mark.parametrize(("name", "shuffles"), [("table_cascade", 1), ("table_cascade_states", 2)])
def test_the_disk_holds_one_shuffle_of_the_lines_as_they_are_stored(spark, sf, name, shuffles):
    folder = Path(shared_folder(spark).removeprefix("file:"))
    before = set(folder.rglob("*"))
    got = catalogue.queries()[name](spark, sf)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == plan.count("Exchange ") == shuffles and "Join" not in plan and "Window" not in plan
    # No text that is set from a line is dealt out.
    exchanged = plan[plan.index("Exchange hashpartitioning(region"):]
    assert "concat" not in exchanged and "date_format" not in exchanged
    assert got.count() and set(folder.rglob("*")) == before


def test_regions_read_in_small_parts_are_the_same(monkeypatch):
    lines = [[None], *GRID[1:], ["", "z", None], ["a", "b", "c"]]
    listed = [[w[1:] for w in words(i, lines[: i % 7])] for i in range(20)]
    listed[5] = [*listed[5], (float("nan"), 0.0, 5.0, 8.0, "lost"), (0.0, 0.0, 5.0, 8.0, None), (0.0, 0.0, 5.0, 8.0, "tie"), (0.0, 0.0, 5.0, 8.0, "even")]
    listed[6] = None
    drawn = [[(at, 0.0, 300.0, True) for at in (-1.0, 99.0, 99.5, 199.0, 299.0)] + [(at, -1.0, 300.0, False) for at in (-2.0, 10.0, 22.0, 34.0, 100.0)] + [(None, 0.0, 1.0, True), (5.0, None, 1.0, True), (5.0, 0.0, 1.0, None)] if i % 3 else None for i in range(20)]
    box, ruling = [(c, pa.float64()) for c in ("x0", "y0", "x1", "y1")] + [("text", pa.string())], [(c, pa.float64()) for c in ("at", "low", "high")] + [("upright", pa.bool_())]
    arrays = [pa.array([None if r is None else [dict(zip([n for n, _ in kind], v, strict=True)) for v in r] for r in rows], pa.list_(pa.struct(kind))) for rows, kind in ((listed, box), (drawn, ruling))]
    whole = table_boxes.read(*arrays, 6.0, 0.0, 0.2, 2.0)
    assert whole[5]["lines"][0].as_py() == "even tie" and whole[6].as_py() == {"ruled": None, "spaced": None, "lines": []}
    assert whole[4]["ruled"].as_py() == [["", "", "gr total", "um"], ["Pletinas y láminas", "", "458", "65,4"], ["Pernos", "", "381", "54,5"]]
    monkeypatch.setattr(table_boxes, "WORDS", 3)
    monkeypatch.setattr(table_boxes, "PAIRS", 5)
    assert table_boxes.read(*arrays, 6.0, 0.0, 0.2, 2.0).equals(whole)
    assert table_boxes.read(*(a.slice(3, 9) for a in arrays), 6.0, 0.0, 0.2, 2.0).to_pylist() == whole.slice(3, 9).to_pylist()
    assert len(table_boxes.read(*(a.slice(0, 0) for a in arrays), 6.0, 0.0, 0.2, 2.0)) == 0

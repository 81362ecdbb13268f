"""Plans whose cost has to follow the input: what is kept for each key, broadcast or shuffled."""

import time
import tracemalloc

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from folioscope.operators import grids, lexical_index, metadata, search, structure, table_layout
from folioscope.operators.lexical_index import LexicalIndex
from folioscope.plans import catalogue
from folioscope.sources import paged
from folioscope.sources.tables import table


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_sketches_are_not_kept_for_each_part(spark, sf):
    aggregates = [line for line in plan(catalogue.queries()["approximate_counts"](spark, sf)).splitlines() if "percentile" in line and "Aggregate" in line]
    assert aggregates and not any("l_partkey" in line.split("functions")[0] for line in aggregates)


def test_prefixes_are_not_broadcast_and_only_the_best_of_each_is_joined(spark):
    stored = spark.createDataFrame([(i, f"{i}", "extraida" if i % 2 else "verificada") for i in range(10, 1000)] + [(5000, "77", "verificada")], "ord long, table_id string, state string")
    refs = spark.createDataFrame([("1",), ("77",), ("77.5",), ("x",), (None,), (" ",)], "ref string")
    found = grids.lookup(refs, stored)
    got = {r["ref"]: (r["table_id"], r["state"], r["match"]) for r in found.collect()}
    assert got == {"1": ("100", "verificada", "stored_extends_ref"), "77": ("77", "verificada", "exact"), "77.5": ("77", "verificada", "ref_extends_stored")}
    assert "Broadcast" not in plan(found) and "Window" not in plan(found)


def test_lexical_search_shuffles_no_postings(spark, sf):
    docs, asked = table(spark, sf, "documents"), table(spark, sf, "benchmark").withColumnRenamed("item_id", "query_id")
    index = LexicalIndex.build(docs.where("doc_id % 7 > 0").repartition(5))
    got = search.best_documents(index, asked, 6)
    shuffled = [line for line in plan(got).splitlines() if "Exchange hashpartitioning" in line]
    assert len(shuffled) == 1 and "query_id" in shuffled[0]
    rows = lambda df: sorted(map(tuple, df.select("query_id", "doc_id", "score", "rank").collect()))
    assert rows(got) == rows(search.best(index.scores(asked), 6))


def test_lexical_search_of_odd_rows(spark):
    docs = spark.createDataFrame([("b", "uno dos dos"), ("a", "uno dos dos"), (None, "uno dos dos"), ("c", None), ("d", ""), ("e", "tres " * 30), ("f", "cuatro cinco seis"), ("g", "siete"), ("h", "ocho")], "doc_id string, text string")
    asked = spark.createDataFrame([("q", "dos uno dos"), ("r", "nada"), ("s", None), (None, "tres"), ("t", "TRES cuatro")], "query_id string, text string")
    index = LexicalIndex.build(docs)
    rows = lambda df: sorted(map(str, df.select("query_id", "doc_id", "score", "rank").collect()))
    got = search.best_documents(index, asked, 2)
    assert rows(got) == rows(search.best(index.scores(asked), 2)) and got.count() == 5
    assert search.best_documents(index, asked.limit(0), 2).collect() == [] == search.best_documents(LexicalIndex.build(docs.limit(0)), asked, 2).collect()


def test_questions_go_in_groups_whose_matrix_fits(monkeypatch):
    monkeypatch.setattr(lexical_index, "BLOCK", 6)
    asked = [[("x", 1.0), ("y", 2.0)], [("y", 1.0)], [("z", 3.0)], [("x", 1.0), ("z", 1.0)]]
    batch = pa.record_batch({"doc": pa.array([3, 1, 2]), "tokens": pa.array([["x", "y"], ["y", "y", "w"], ["z"]])})
    step = lexical_index._best_step([10, 11, 12, 13], pa.int64(), asked, 2.0, 1, ["q", "d", "score"])
    small = sorted((r["q"], r["d"], r["score"]) for out in step([batch, batch.slice(0, 1)]) for r in out.to_pylist())
    monkeypatch.setattr(lexical_index, "BLOCK", 1000)
    whole = sorted((r["q"], r["d"], r["score"]) for out in step([batch]) for r in out.to_pylist())
    assert small == whole and [(q, d) for q, d, _ in small] == [(10, 3), (11, 1), (12, 2), (13, 2)]


def test_lexical_search_holds_a_part_of_a_batch(monkeypatch):
    draw = np.random.default_rng(5)
    lists = [list(map(str, draw.integers(0, 300, n))) for n in [*draw.integers(0, 90, 20_000), 30_000]]
    batch = pa.record_batch({"doc": pa.array(draw.permutation(len(lists))), "tokens": pa.array([*lists[:7], None, *lists[8:]], pa.list_(pa.string()))})
    asked = [[(str(t), 1.0 + t) for t in draw.choice(300, 5, replace=False)] for _ in range(3)]

    def found():
        step = lexical_index._best_step([10, 11, 12], pa.int64(), asked, 45.0, 4, ["q", "d", "score"])
        tracemalloc.start()
        got = sorted((r["q"], r["d"], r["score"]) for out in step([batch, batch.slice(0, 0), batch.slice(5, 100)]) for r in out.to_pylist())
        peak = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        return got, peak

    monkeypatch.setattr(lexical_index, "BLOCK", 20_000)
    monkeypatch.setattr(lexical_index, "TOKENS", 10_000_000, raising=False)
    whole, much = found()
    monkeypatch.setattr(lexical_index, "TOKENS", 30_000, raising=False)
    monkeypatch.setattr(lexical_index, "BLOCK", 50)
    parts, peak = found()
    assert parts == whole and len(whole) == 12
    # A batch has 900,000 tokens; eight bytes for each of them alone are 7 MB.
    assert peak < 3_000_000 < much


def test_a_long_grid_is_cleaned_in_time_that_follows_its_rows(spark):
    def seconds(n):
        grid = F.transform(F.sequence(F.lit(1), F.lit(n)), lambda i: F.array(i.cast("string"), F.lit(" x "), F.lit(None).cast("string")))
        begin = time.monotonic()
        rows = spark.range(1).select(F.size(grids.clean_grid(F.when(F.col("id") >= 0, grid))).alias("n")).collect()
        assert rows[0]["n"] == n
        return time.monotonic() - begin

    seconds(100)
    assert seconds(8000) < 15
    odd = spark.createDataFrame([(1, [["a", None], None, [" "], ["b", "c", "d"]]), (2, None), (3, [["a"]]), (4, [])], "id int, grid array<array<string>>")
    got = {r["id"]: r["g"] for r in odd.select("id", grids.clean_grid(F.col("grid")).alias("g")).collect()}
    assert got == {1: [["a", "", ""], ["b", "c", "d"]], 2: [], 3: [], 4: []}


def test_a_tables_words_are_put_together_once(spark):
    def lines(region, widths):
        return [(region, 100.0 * j, 12.0 * i, 100.0 * j + 20, 12.0 * i + 8, f"{i}.{j}") for i, n in enumerate(widths) for j in range(n)]

    rows = lines(1, [1, 2, 2, 1, 3, 3, 1, 2]) + lines(2, [2, 2, 1, 2, 2]) + lines(3, [1, 1]) + lines(4, [2])
    words = spark.createDataFrame(rows, "region long, x0 double, y0 double, x1 double, y1 double, text string")
    grids_ = table_layout.read_by_gaps(words)
    # Lines, phrases and the block are found before the cut; what reads it has the windows of the spans and of the width.
    assert plan(grids_).count("Window [") <= 6
    got = {r["region"]: [list(x) for x in r["grid"]] for r in grids_.collect()}
    assert got == {1: [["4.0", "4.1", "4.2"], ["5.0", "5.1", "5.2"]], 2: [["0.0", "0.1"], ["1.0", "1.1"]], 4: [["0.0", "0.1"]]}


def test_segments_deal_out_no_text_that_is_not_asked_for(spark):
    rows = [(1, 1, 0, " "), (1, 1, 1, "ARTÍCULO 1. Uno"), (1, 2, 0, "ARTÍCULO 2. Dos"), (1, 2, 1, "b"), (1, 3, 0, "ARTÍCULO 3. Tres"), (2, 1, 0, ""), (2, 1, 1, ""), *((2, 1, i, f"ARTÍCULO {i}. X") for i in (2, 3, 4)), (3, 4, 0, "z"), (3, 5, 0, None), (None, 1, 0, "n")]
    found = structure.segments(spark.createDataFrame(rows, "doc_id long, page int, line_no int, line string"))
    narrow = found.select("doc_id", "segment_no", "kind", "n_lines")
    exchanged = [x for x in narrow._jdf.queryExecution().optimizedPlan().toString().splitlines() if "collect_list" in x]
    assert not exchanged and plan(narrow).count("Join") == 0
    got = sorted(map(str, map(tuple, narrow.collect())))
    assert got == sorted(map(str, [(1, 1, "articulo", 1), (1, 2, "articulo", 2), (1, 3, "articulo", 1), (2, 0, "preambulo", 2), *((2, i, "articulo", 1) for i in (1, 2, 3)), (3, 4, "pagina", 1), (3, 5, "pagina", 1), (None, 0, "preambulo", 1)]))
    assert {r["segment_no"]: r["text"] for r in found.where("doc_id = 1").collect()} == {1: "ARTÍCULO 1. Uno", 2: "ARTÍCULO 2. Dos\nb", 3: "ARTÍCULO 3. Tres"}


def test_a_long_key_is_ranked_in_ranges(spark):
    rows = [("a", i * 7 % 1000) for i in range(1000)] + [("a", None), ("a", None)] + [(None, i) for i in range(300)] + [("b", i) for i in range(5)] + [("c", 4)] * 150
    frame = spark.createDataFrame(rows, "k string, n long").withColumn("text", F.lit("x"))
    found = metadata.long_ranked(frame, "k", "n", 100)
    got = {}
    for r in found.collect():
        got.setdefault(r["k"], []).append((r["rank"], r["n"]))
    assert {k: [n for _, n in sorted(v)] for k, v in got.items()} == {"a": [None, None, *range(1000)], None: list(range(300)), "b": list(range(5)), "c": [4] * 150}
    assert all([i for i, _ in sorted(v)] == list(range(1, len(v) + 1)) for v in got.values())
    assert found.columns == ["k", "n", "text", "rank"] and "hashpartitioning(k#" in plan(found) and "_range" in plan(found)
    assert metadata.long_ranked(frame.limit(0), "k", "n").collect() == []


def test_small_files_share_a_task(spark, tmp_path):
    for i in range(60):
        (tmp_path / f"{i}.paged").write_bytes(paged.packed([{"text": f"{i} {j} " + "x" * 1000} for j in range(i % 12)]))
    read = paged.read_paged(spark, str(tmp_path), 5, task=40_000)
    size = sum(f.stat().st_size for f in tmp_path.iterdir())
    assert size / 40_000 <= read.rdd.getNumPartitions() <= 2 * size / 40_000
    whole = sorted((i, j) for i in range(60) for j in range(i % 12))
    assert sorted(tuple(map(int, r["text"].split()[:2])) for r in read.collect()) == whole
    assert sorted(tuple(map(int, r["text"].split()[:2])) for r in read.where("page > 2 AND page < 8").collect()) == [(i, j) for i, j in whole if 2 <= j <= 6]
    big = paged.PagedReader({"path": str(tmp_path), "range": "5", "task": "1"}).partitions()
    assert all(len(p.ranges) == 1 for p in big) and len(big) == sum(-(-(i % 12) // 5) for i in range(60))


def test_nearest_holds_few_arrays_of_a_block():
    draw = np.random.default_rng(3)
    matrix, rows = draw.normal(size=(1000, 8)), np.repeat(draw.normal(size=(1000, 8)), 2, axis=0)
    rows[7], matrix[3], own = 0, 0, draw.permutation(2000)
    batch = pa.record_batch({"i": pa.array(own), "v": pa.array(list(rows), pa.list_(pa.float64()))})
    step = search._nearest(np.arange(1000), matrix, 3, 0.9, ["q", "i", "d"])
    tracemalloc.start()
    got = [tuple(r.values()) for out in step([batch.slice(0, 1500), batch.slice(1500)]) for r in out.to_pylist()]
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    size = np.outer(np.linalg.norm(matrix, axis=1), np.linalg.norm(rows, axis=1))
    distance = np.floor((1 - np.divide(matrix @ rows.T, size, out=np.zeros_like(size), where=size > 0)) * 1e6 + 0.5)
    want = {(q, int(own[i]), int(distance[q, i])) for q in range(1000) for i in np.lexsort((own, distance[q]))[:3] if distance[q, i] <= 900_000}
    assert set(got) == want and len(got) == len(want)
    # A block is 1000 x 1500 distances here.
    assert peak < 4 * 1000 * 1500 * 8

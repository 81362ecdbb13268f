"""Operators that SQL does not cover, against plain second versions, and properties."""

import random
import re

import pytest
from pyspark.sql import functions as F

from folioscope.functions import text as tx
from folioscope.operators import grids, language, registry, search, structure
from folioscope.sources import tables as src
from folioscope.streaming import events


def tokens(text):
    return max(1, (len(text) + 3) // 4)


def packed(parts, budget, hard):
    small = [s for p in parts for s in ([p] if tokens(p) <= hard else re.split(r"(?<=[.;:])\s+", p))]
    out, current = [], ""
    for piece in small:
        both = f"{current}\n{piece}"
        if current and tokens(both) <= budget:
            current = both
        else:
            if current:
                out.append(current)
            current = piece
    return [*out, current] if current else out


def test_packing(spark):
    rng = random.Random(2)
    cases = [["".join(rng.choice("abc. ; ") for _ in range(rng.randint(1, 300))).strip() or "x" for _ in range(rng.randint(1, 12))] for _ in range(40)]
    df = spark.createDataFrame([(i, c) for i, c in enumerate(cases)], "id int, parts array<string>").select("id", structure.packed(F.col("parts"), 40, 50).alias("p"))
    assert {r["id"]: list(r["p"]) for r in df.collect()} == {i: packed(c, 40, 50) for i, c in enumerate(cases)}


def test_every_line_lands_in_one_chunk(spark, sf):
    docs = src.table(spark, sf, "documents").limit(50)
    chunks = structure.chunks(docs).groupBy("doc_id").agg(F.sum(F.length(F.regexp_replace("text", r"\s", ""))).alias("n"))
    whole = docs.select("doc_id", F.length(F.regexp_replace("text", r"\s", "")).alias("m"))
    assert chunks.join(whole, "doc_id").where("n <> m").count() == 0


def test_windows_cover_the_text(spark):
    df = spark.createDataFrame([(n, "x" * n) for n in (1, 799, 800, 801, 1450, 1451, 5000)], "doc_id int, text string")
    rows = structure.windows(df, 800, 150).collect()
    for n in (1, 799, 800, 801, 1450, 1451, 5000):
        own = sorted((r["start"], len(r["text"])) for r in rows if r["doc_id"] == n)
        assert own[0][0] == 0 and sum(own[-1]) == n and all(b[0] - a[0] == 650 for a, b in zip(own, own[1:], strict=False))


def test_headers_keep_a_body_row(spark):
    grid = [["A", "", ""], ["x", "y", "z"]]
    df = spark.createDataFrame([(grid,)], "g array<array<string>>").select(grids.merged_headers(grids.clean_grid(F.col("g"))).alias("m")).first()["m"]
    assert (df["headers"], df["body"]) == (["A", "", ""], [["x", "y", "z"]])


def test_text_grid_turns_vertical_when_wide(spark):
    df = spark.createDataFrame([(["a" * 20, "b" * 20], [["1", "2"]])], "h array<string>, b array<array<string>>").select(grids.text_grid(F.col("h"), F.col("b")).alias("t"))
    assert df.first()["t"] == f"{'a' * 20}: 1\n{'b' * 20}: 2"


def test_fusion_depends_on_ranks_only(spark):
    rows = [(1, d, l, r, 1.0) for l in (0, 1) for r, d in enumerate(random.Random(l).sample(range(9), 6), 1)]
    one = search.rrf(spark.createDataFrame(rows, "query_id int, doc_id int, list_no int, rank int, weight double"), 5).collect()
    random.Random(3).shuffle(rows)
    assert one == search.rrf(spark.createDataFrame(rows, "query_id int, doc_id int, list_no int, rank int, weight double"), 5).collect()


def test_knn_refuses_an_unbounded_batch(spark, monkeypatch):
    monkeypatch.setattr(search, "MAX_QUERIES", 2)
    rows = spark.createDataFrame([(i, [1.0, float(i)]) for i in range(3)], "vec_id int, embedding array<double>")
    with pytest.raises(ValueError):
        search.knn(rows, rows.withColumnRenamed("vec_id", "query_id"), 1)


def test_knn_blocks_answer_every_query(spark, monkeypatch):
    rng = random.Random(4)
    rows = spark.createDataFrame([(i, [rng.random() for _ in range(4)]) for i in range(25)], "vec_id int, embedding array<double>")
    asked = rows.withColumnRenamed("vec_id", "query_id")
    whole = search.knn(rows, asked, 3).collect()
    monkeypatch.setattr(search, "MAX_QUERIES", 7)
    assert len(whole) == 75 and sorted(search.knn_blocks(rows, asked, 3).collect()) == sorted(whole)
    near = search.similar_cached(rows, rows, 0.0).collect()
    assert {r["query_id"] for r in near} == set(range(25))


def test_fidelity_is_symmetric_and_ignores_order(spark):
    df = spark.createDataFrame([(1, "a) 3,5 y 2", "2 luego a) 3.5"), (2, "1. uno\n2. dos", "2. dos\n1. uno"), (3, "(C) 7", "7")], "id int, a string, b string")
    got = {r["id"]: r["same"] for r in df.select("id", (language.fidelity_tokens(F.col("a")) == language.fidelity_tokens(F.col("b"))).alias("same")).collect()}
    assert got == {1: True, 2: True, 3: False}
    forth = {(r["id"], r["token"], r["missing"], r["added"]) for r in language.fidelity_diff(df, "id", "a", "b").collect()}
    back = {(r["id"], r["token"], r["added"], r["missing"]) for r in language.fidelity_diff(df, "id", "b", "a").collect()}
    assert forth == back


def test_model_answers_pass_the_guards(spark):
    df = spark.createDataFrame([("distancia minima", "fuera_de_dominio", 0.82), ("distancia minima", "fuera_de_dominio", 0.9), ("hola", "puntual", 0.99), ("distancia", "smalltalk", 0.99), ("lista completa", "procedimiento", 0.6)], "question string, m string, c double")
    got = [r["intent"] for r in language.classified(df, model_intent="m", model_confidence="c").collect()]
    assert got == ["puntual", "fuera_de_dominio", "smalltalk", "puntual", "exhaustiva"]


def test_elongations(spark):
    row = spark.createDataFrame([("graciaaas coool llama",)], "t string").select(tx.collapse_elongations(F.col("t")).alias("t")).first()
    assert row["t"] == "gracias col llama"


def test_publication_is_gated_and_versioned(spark, tmp_path):
    df = spark.range(3)
    gates = spark.createDataFrame([("a", True)], "gate string, ok boolean")
    with pytest.raises(ValueError):
        registry.publish(df, str(tmp_path), "v1", gates.withColumn("ok", F.lit(False)))
    path = registry.publish(df, str(tmp_path), "v1", gates)
    assert registry.published(spark, str(tmp_path)).count() == 3
    registry.publish(spark.range(5), str(tmp_path), "v2", gates)
    assert registry.published(spark, str(tmp_path)).count() == 5 and spark.read.parquet(path).count() == 3
    files = src.listing(spark, path, "*.parquet")
    again = registry.upload_plan(files.select(F.col("name").alias("key"), "size"), files.select(F.col("name").alias("key"), "size"))
    assert {r["action"] for r in again.collect()} == {"skip"}


def test_replacing_one_source_keeps_the_others(spark, tmp_path):
    path = str(tmp_path / "t")
    registry.replace_source(spark.createDataFrame([(1, "a"), (2, "b")], "id int, source string"), path)
    registry.replace_source(spark.createDataFrame([(3, "a")], "id int, source string"), path)
    assert sorted((r["id"], r["source"]) for r in spark.read.parquet(path).collect()) == [(2, "b"), (3, "a")]


def test_rule_files_and_snapshots(spark, tmp_path):
    (tmp_path / "a.md").write_text("---\nname: grid\nresponse_format: markdown_table\n---\nUse a grid.")
    (tmp_path / "b.md").write_text("no head")
    rows = src.rule_files(spark, str(tmp_path)).collect()
    assert [(r["name"], r["keys"]["response_format"], r["body"]) for r in rows] == [("grid", "markdown_table", "Use a grid.")]
    good = str(tmp_path / "good")
    spark.createDataFrame([(1, [1.0, 2.0])], "id int, v array<double>").write.parquet(good)
    assert src.resolve_snapshot(spark, [str(tmp_path / "none"), good], {"id"}, "v", 2) == good
    assert src.resolve_snapshot(spark, [good], {"id"}, "v", 3) is None


def test_stream_equals_batch(spark, sf):
    batch = src.table(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    stream = events.run_once(spark, events.windowed(events.event_stream(spark, sf), "1 hour", "30 minutes"), "sliding_test", "complete")
    assert sorted(map(str, stream.collect())) == sorted(map(str, events.windowed(batch, "1 hour", "30 minutes").collect()))


def test_fidelity_tokens_against_brute_force(spark, sf):
    from folioscope.plans import language as plans

    rows = src.table(spark, sf, "documents").collect()
    marked = [(r["doc_id"], f"a) uno (b) dos 1) 12,5 c. x\n 3. y {r['text']} zz)9") for r in rows]
    docs = spark.createDataFrame(marked, "doc_id long, text string")
    expect = {}
    for i, text in marked:
        tokens = ["n:" + n.replace(",", ".") for n in re.findall(r"\d+(?:[.,]\d+)*", text)]
        for pattern in language.LIST_MARKS:
            tokens += ["l:" + m.lower() for m in re.findall(pattern.replace("(?m)", "(?m)"), text)]
        expect[i] = sorted(tokens)
    got = {r["doc_id"]: sorted(r["t"]) for r in docs.select("doc_id", language.fidelity_tokens(F.col("text")).alias("t")).collect()}
    assert got == expect
    counted = {(r["doc_id"], r["token"]): r["n"] for r in plans.fidelity_tokens(spark, sf).collect()}
    assert sum(counted.values()) == sum(len(language_tokens(r["text"])) for r in rows)


def language_tokens(text):
    return re.findall(r"\d+(?:[.,]\d+)*", text) + [m for p in language.LIST_MARKS for m in re.findall(p, text)]

"""Keyed logs, publication, incremental builds and ancestries against plain versions."""

import os
import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from folioscope.operators import ancestry
from folioscope.operators.build_chain import BuildChain, Stage, gates
from folioscope.operators.merge_log import KeyedLog, Publication, copied_files, embedded, embedding_cache, waits

SCHEMA = "k long, v string"


def table(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def test_merges_against_a_dictionary(spark, tmp_path):
    rng, log, expected = random.Random(4), KeyedLog(spark, f"{tmp_path}/log", ["k"], SCHEMA), {}
    assert log.read().collect() == [] and log.compact() == 0
    for n in range(5):
        rows = [(rng.randint(0, 8) if rng.random() < 0.9 else None, f"{n}") for _ in range(5)]
        log.merge(table(spark, rows))
        expected |= dict(rows)
        assert dict(log.read().collect()) == expected
    old = log.snapshot()["number"]
    before = log.read(old)
    assert log.compact() == old + 1 and len(log.snapshot()["parts"]) == 1
    log.merge(table(spark, [(3, "new")]))
    assert dict(log.read().collect()) == expected | {3: "new"} and dict(before.collect()) == expected
    gone = log.prune(keep=1)
    assert len(gone) == 5 and dict(log.read().collect()) == expected | {3: "new"}


def test_writers_that_meet_and_a_writer_that_breaks_off(spark, tmp_path, monkeypatch):
    one, two = (KeyedLog(spark, f"{tmp_path}/log", ["k"], SCHEMA) for _ in range(2))
    one.merge(table(spark, [(1, "a")]))
    create, met = one.files.create, []

    def overtaken(file, text):
        if not met:
            met.append(two.merge(table(spark, [(2, "b")])))
        return create(file, text)

    monkeypatch.setattr(one.files, "create", overtaken)
    assert one.merge(table(spark, [(3, "c")])) == met[0] + 1
    assert dict(one.read().collect()) == {1: "a", 2: "b", 3: "c"}
    # A part without a snapshot is nobody's.
    two._written(table(spark, [(1, "lost")]))
    assert dict(two.read().collect())[1] == "a"


def test_embeddings_once_for_each_text_in_any_order(spark, tmp_path):
    cache, asked = embedding_cache(spark, f"{tmp_path}/cache"), []

    def embed(rows):
        asked.append(sorted(r["text"] for r in rows.collect()))
        return rows.withColumn("vec", F.array(F.length("text").cast("float")))

    items = spark.createDataFrame([(5, "bb"), (1, "a"), (2, "bb"), (3, None), (4, "")], "place int, text string")
    got = embedded(items, cache, "m", embed).orderBy("place").collect()
    assert [(r["place"], r["text"], r["embedding"]) for r in got] == [(1, "a", [1.0]), (2, "bb", [2.0]), (3, None, [0.0]), (4, "", [0.0]), (5, "bb", [2.0])]
    embedded(items.union(spark.createDataFrame([(6, "ccc")], items.schema)), cache, "m", embed)
    embedded(items, cache, "other", embed)
    assert asked == [["", "a", "bb"], ["ccc"], ["", "a", "bb"]]


def test_publication(spark, tmp_path):
    store = Publication(spark, f"{tmp_path}/store")
    assert store.current() is None
    rows = table(spark, [(1, "a"), (2, "b")])
    shut = spark.createDataFrame([("recall", False), ("chunks", True)], "gate string, ok boolean")
    with pytest.raises(ValueError, match="recall"):
        store.publish({"t": rows}, "v1", shut)
    assert store.current() is None and store.versions() == []
    store.publish({"t": rows}, "v1")
    reader = store.read("t")
    store.publish({"t": rows.where("k = 1"), "u": rows}, "v2")
    assert reader.count() == 2 and store.read("t").count() == 1 and store.versions() == ["v1", "v2"]
    with pytest.raises(Exception, match="exist"):
        store.publish({"t": rows}, "v2")
    target = f"{tmp_path}/mirror"
    first = store.mirror(target)
    os.makedirs(f"{target}/t", exist_ok=True)
    open(f"{target}/t/old.bin", "wb").write(b"x")
    assert first[0] > 0 and first[1] == 0 and store.mirror(target) == (0, 1)
    assert spark.read.parquet(f"{target}/u").count() == 2 and not os.path.exists(f"{target}/t/old.bin")


def test_copies_are_tried_six_times(tmp_path):
    slept = []
    frame = pd.DataFrame({"source": [f"file://{tmp_path}/none"], "target": [f"{tmp_path}/copy"]})
    out = next(copied_files([frame], slept.append))
    assert slept == waits() == [3.0, 6.0, 12.0, 24.0, 48.0] and out["error"][0] and not os.path.exists(tmp_path / "copy")


def test_chain_builds_what_changed_and_what_broke_off(spark, tmp_path):
    made = []

    def stage(name, version, suffix, fail=None):
        def make(rows):
            got = rows.collect()
            made.append((name, sorted(r["doc_id"] for r in got)))
            if fail:
                raise RuntimeError(fail)
            return spark.createDataFrame([(r["doc_id"], (r["text"] or "") + suffix) for r in got], "doc_id long, text string")

        return Stage(name, version, make)

    docs = spark.createDataFrame([(1, "a"), (2, None), (3, "c")], "doc_id long, text string")
    chain = BuildChain(spark, f"{tmp_path}/b", [stage("x", "1", "x"), stage("y", "1", "y", "breaks")])
    with pytest.raises(RuntimeError):
        chain.run(docs)
    chain.stages[1] = stage("y", "1", "y")
    made.clear()
    assert chain.run(docs) == {"x": 0, "y": 3} and made == [("y", [1, 2, 3])]
    changed = docs.where("doc_id != 3").withColumn("text", F.when(F.col("doc_id") == 2, "new").otherwise(F.col("text")))
    made.clear()
    assert chain.run(changed) == {"x": 1, "y": 1} and made == [("x", [2]), ("y", [2])]
    assert sorted(map(tuple, chain.output("y").collect())) == [(1, "axy"), (2, "newxy")]
    chain.stages[1] = stage("y", "2", "z")
    made.clear()
    assert chain.run(changed) == {"x": 0, "y": 2} and made == [("y", [1, 2])]
    assert sorted(map(tuple, chain.output("y").collect())) == [(1, "axz"), (2, "newxz")]
    assert chain.publish(f"{tmp_path}/p", "v1") == "v1" and Publication(spark, f"{tmp_path}/p").read("y").count() == 2


def test_gates(spark):
    none = spark.createDataFrame([], "table_id string, state string, png_key string")
    vectors = spark.createDataFrame([([1.0, 2.0],), (None,)], "embedding array<double>")
    got = {r["gate"]: r["ok"] for r in gates(none, vectors, none, spark.createDataFrame([], "key string"), spark.createDataFrame([], "recall double"), dimension=2).collect()}
    assert got == {"chunks": False, "dimension": False, "missing_pictures": True, "revision": True, "recall": True}


def test_ancestries_against_walking_up(spark):
    rng = random.Random(6)
    up = {i: rng.randrange(i) if i and rng.random() < 0.97 else None for i in range(150)} | {i: i - 1 for i in range(150, 260)} | {500: 501, 501: 502, 502: 500, 503: 501, 600: 999}
    links = spark.createDataFrame([*up.items(), (None, 3), (260, 259), (260, 300)], "child long, parent long")
    up[260] = 259

    def walk(i):
        out = [i]
        while up.get(out[-1]) in up and len(out) < 400:
            out.append(up[out[-1]])
        return out

    roots = {i: (walk(i)[-1], len(walk(i)) - 1) for i in up if i not in (500, 501, 502, 503)}
    assert {r["child"]: (r["root"], r["depth"]) for r in ancestry.roots(links).collect()} == roots
    pairs = {(i, a, d) for i in roots for d, a in enumerate(walk(i))}
    assert {tuple(r) for r in ancestry.ancestors(links).collect()} == pairs
    assert ancestry.roots(links.limit(0)).collect() == []

"""The inverted file against a comparison with all vectors."""

import numpy as np

from folioscope.operators import vector_index as ops
from folioscope.operators.search import knn
from folioscope.operators.vector_index import Quantizer, VectorIndex

SCHEMA = "vec_id long, embedding array<double>"


def clustered(n=1500, width=16, groups=30, seed=2):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(groups, width))
    return centres[rng.integers(0, groups, n)] + 0.25 * rng.normal(size=(n, width))


def recall(found, exact):
    best = {(r["query_id"], r["vec_id"]) for r in exact}
    return sum((r["query_id"], r["vec_id"]) in best for r in found) / len(best)


def test_recall_and_a_stored_index(spark, tmp_path):
    points = clustered()
    items = spark.createDataFrame([(i, p.tolist()) for i, p in enumerate(points)], SCHEMA)
    asked = items.where("vec_id % 20 = 0").withColumnRenamed("vec_id", "query_id")
    index = VectorIndex.build(items, lists=20)
    assert index.entries.count() == len(points) and index.quantizer.probes < 15
    exact = knn(items, asked, 4).collect()
    found = index.search(asked, 4).collect()
    assert recall(found, exact) >= 0.9 and {r["rank"] for r in found} == {1, 2, 3, 4}
    distances = {(r["query_id"], r["vec_id"]): r["distance"] for r in exact}
    assert all(abs(distances.get((r["query_id"], r["vec_id"]), r["distance"]) - r["distance"]) <= 1 for r in found)
    index.write(f"{tmp_path}/index")
    stored = VectorIndex.read(spark, f"{tmp_path}/index")
    key = lambda rows: sorted((r["query_id"], r["rank"], r["vec_id"]) for r in rows)
    assert key(stored.search(asked, 4).collect()) == key(found)
    # With all lists probed and all candidates compared, the answer is exact.
    assert key(index.search(asked, 4, probes=20, keep=2000).collect()) == key(exact)


def test_a_list_with_most_vectors_is_cut_into_blocks(spark, monkeypatch):
    monkeypatch.setattr(ops, "BLOCK", 100)
    monkeypatch.setattr(ops, "ASKED", 7)
    points = np.concatenate([np.tile([1.0, 2.0, 3.0, 4.0], (700, 1)), clustered(300, 4)])
    items = spark.createDataFrame([(i, p.tolist()) for i, p in enumerate(points)], SCHEMA)
    index = VectorIndex.build(items, lists=8)
    sizes = [r["count"] for r in index.entries.groupBy("list_no", "block").count().collect()]
    assert sum(sizes) == 1000 and max(sizes) <= 200
    asked = items.where("vec_id % 10 = 0").withColumnRenamed("vec_id", "query_id")
    found = index.search(asked, 4).collect()
    assert len(found) == 400 and all(r["distance"] == 0 for r in found if r["query_id"] < 700)


def test_vectors_that_are_none(spark):
    rows = [(1, [1.0, 0.0]), (2, None), (3, [1.0]), (4, [None, 1.0]), (5, [0.9, 0.1]), (6, [float("nan"), 1.0]), (None, [1.0, 1.0])]
    index = VectorIndex.build(spark.createDataFrame(rows, SCHEMA), lists=4)
    asked = spark.createDataFrame([(1, [1.0, 0.0]), (2, None), (3, [1.0, 2.0, 3.0])], "query_id long, embedding array<double>")
    assert [(r["query_id"], r["vec_id"]) for r in index.search(asked, 5).orderBy("rank").collect()] == [(1, 1), (1, 5)]


def test_estimates_are_distances_to_what_the_codes_stand_for():
    points = ops.unit(clustered(400, 8))
    q = Quantizer.fit(points, 6)
    near = q.lists(points, 1)[:, 0]
    codes = q.codes(points - q.centroids[near])
    own = np.flatnonzero(near == near[0])
    said = q.centroids[near[0]] + np.concatenate([q.books[j][codes[own, j]] for j in range(len(q.books))], axis=1)
    assert np.allclose(q.estimates(points[0], codes[own], near[0]), ((points[0] - said) ** 2).sum(1))

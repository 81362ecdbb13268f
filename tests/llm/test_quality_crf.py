import itertools
import math

import numpy as np

from folioscope.llm.quality_crf import LineField, fit_quality, keep_quality, op6_quality_crf, score_quality
from tests.llm.helpers import documents, texts


def test_forward_backward_against_enumeration():
    rng = np.random.default_rng(1)
    count = np.array([1, 4, 2])
    unary, turn, first = rng.normal(size=7), np.array([0.7, -0.4]), np.array([0, 1, 5])
    good, stays, logs = LineField.chain(unary, turn, first, count)
    expect, stay, total = np.zeros(7), np.zeros(2), 0.0
    for a, n in zip(first, count, strict=True):
        weight = {}
        for y in itertools.product((0, 1), repeat=int(n)):
            s = sum(unary[a + i] for i in range(n) if y[i]) + sum(turn[y[i]] for i in range(n - 1) if y[i] == y[i + 1])
            weight[y] = math.exp(s)
        z = sum(weight.values())
        total += math.log(z)
        for y, w in weight.items():
            for i in range(n):
                expect[a + i] += y[i] * w / z
                if i and y[i] == y[i - 1]:
                    stay[y[i]] += w / z
    assert np.allclose(good, expect) and np.allclose(stays, stay) and abs(logs.sum() - total) < 1e-9


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    rows = [r for r in op6_quality_crf(spark, sf).collect() if r["held_out"] and r["doc_id"] in labels]
    right = sum(r["predicted"] == labels[r["doc_id"]] for r in rows)
    kept = [r["predicted"] for r in rows if labels[r["doc_id"]] == 1]
    assert len(rows) > 50 and right >= 0.95 * len(rows) and sum(kept) >= 0.97 * len(kept)


def test_nulls_long_texts_and_empty(spark, sf):
    docs = documents(spark, [*texts(n=5), "word " * 200_000, "\n".join("line" for _ in range(3000))], extra=["score", "label"])
    model = fit_quality(spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet"))
    scores = {r["doc_id"]: r["score"] for r in score_quality(docs, model).collect()}
    assert len(scores) == docs.count() and all(0 <= s <= 1 for s in scores.values())
    assert scores[0] == scores[1] == scores[2] == model.prior
    assert keep_quality(docs, model, threshold=0.0).columns == docs.columns and keep_quality(docs, model, threshold=0.0).count() == docs.count()
    assert score_quality(docs.limit(0), model).collect() == []
    none = spark.read.parquet(f"{sf}/labels.parquet").limit(0)
    assert fit_quality(docs, none) is None and {r["score"] for r in score_quality(docs, None).collect()} == {0.5}

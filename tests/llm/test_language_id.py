import itertools
import random

import numpy as np
import pyarrow as pa

from folioscope.llm.language_id import WordField, fit_languages, forward_backward, has_letter, identified, labelled_words, op13_language_id
from tests.llm.helpers import documents, texts


def test_forward_backward_against_enumeration():
    rng = np.random.default_rng(2)
    emit, turn = rng.uniform(0.1, 3, (11, 3)), rng.uniform(0.1, 3, (3, 3))
    fresh = np.zeros(11, dtype=bool)
    fresh[[0, 4, 5]] = True
    marginal, pairs, logs = forward_backward(emit, fresh, turn)
    expect, moves, total = np.zeros((11, 3)), np.zeros((3, 3)), 0.0
    for a, b in ((0, 4), (4, 5), (5, 11)):
        paths = {}
        for y in itertools.product(range(3), repeat=b - a):
            paths[y] = np.prod([emit[a + i, k] for i, k in enumerate(y)]) * np.prod([turn[i, j] for i, j in itertools.pairwise(y)])
        z = sum(paths.values())
        total += np.log(z)
        for y, w in paths.items():
            for i, k in enumerate(y):
                expect[a + i, k] += w / z
            for i, j in itertools.pairwise(y):
                moves[i, j] += w / z
    assert np.allclose(marginal, expect) and np.allclose(pairs, moves) and abs(logs - total) < 1e-9


def test_blocks_do_not_show():
    """One long chain equals the plain recursion, whatever the number of blocks."""
    rng = np.random.default_rng(3)
    emit, turn = rng.uniform(0.01, 1, (1003, 2)), np.array([[5.0, 0.1], [0.2, 4.0]])
    fresh = rng.random(1003) < 0.01
    fresh[0] = True
    marginal, _, _ = forward_backward(emit, fresh, turn)
    ahead, behind = np.ones((1003, 2)), np.ones((1003, 2))
    for t in range(1003):
        ahead[t] = emit[t] * (1 if fresh[t] else ahead[t - 1] @ turn)
        ahead[t] /= ahead[t].sum()
    for t in range(1001, -1, -1):
        behind[t] = 1 if fresh[t + 1] else turn @ (emit[t + 1] * behind[t + 1])
        behind[t] /= behind[t].sum()
    plain = ahead * behind
    assert np.allclose(marginal, plain / plain.sum(axis=1, keepdims=True))


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    lang = {r["doc_id"]: r["lang"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    out = op13_language_id(spark, sf).collect()
    held = [r for r in out if r["held_out"] and lang[r["doc_id"]]]
    assert len(out) == len(lang) and len(held) > 100
    assert sum(r["lang_pred"] == lang[r["doc_id"]] for r in held) >= 0.98 * len(held)
    assert all(0 <= r["score"] <= 1 for r in out)


def test_code_switching(spark):
    """Halves of documents of two languages in one text: the words follow their own language, also with none of the lines marked."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = fit_languages(docs)
    some = {}
    for r in docs.where("n_chars > 400 AND crc32(cast(doc_id AS string)) % 5 = 0").orderBy("doc_id").collect():
        some.setdefault(r["lang"], []).append(" ".join(r["text"].split()[:60]))
    mixed = [(i, a + " " + b) for i, (a, b) in enumerate(zip(some["de"][:8], some["fr"][:8], strict=False))]
    right = total = 0
    for r in labelled_words(spark.createDataFrame(mixed, "doc_id long, text string"), model).collect():
        cut = sum(len([x for x in [w.strip(".,|!?") for w in some["de"][r["doc_id"]].split()] if x]) for _ in (0,))
        right += sum(w["lang"] == ("de" if i < cut else "fr") for i, w in enumerate(r["words"]))
        total += len(r["words"])
    assert total > 500 and right >= 0.85 * total
    assert (np.diag(model.turn) > model.turn.max(axis=1) - 1e-6).all()


def test_defined_results(spark):
    rng = random.Random(1)
    de, en = "der die das und ist ein nicht".split(), "the and is of a not was".split()
    rows = [(i, " ".join(rng.choice(de if i % 2 else en) for _ in range(40)), "de" if i % 2 else "en") for i in range(120)]
    train = spark.createDataFrame([*rows, (None, "the and", "xx"), (500, None, "yy"), (501, "12 34", "zz"), (502, "die das", None)], "doc_id long, text string, lang string")
    model = fit_languages(train.selectExpr("*", "1 AS at", "2 AS score"))
    assert model.names == ["de", "en"]
    odd = [None, "", "12 — 34!", "‰‱ …", "der die das", "The AND of", "x" * 100_000, "der und " * 60_000, *texts(n=3)]
    got = {r["doc_id"]: r for r in identified(documents(spark, odd, extra=["lang_pred", "words"]), model).collect()}
    assert len(got) == len(odd) and [got[i]["lang_pred"] for i in range(6)] == ["und"] * 4 + ["de", "en"]
    assert [got[i]["score"] for i in range(4)] == [0.0] * 4 and got[7]["lang_pred"] == "de" and got[6]["lang_pred"] in ("de", "en")
    assert has_letter(pa.array(["é", "—", None, "a1", "漢字", "١٢"])).tolist() == [True, False, False, True, True, False]
    twice = identified(documents(spark, [(1, "der die"), (1, "der die"), (None, "the")]), model).collect()
    assert len(twice) == 3 and twice[0] == twice[1]
    assert identified(train.limit(0), model).collect() == [] and fit_languages(train.limit(0)) is None
    assert {r["lang_pred"] for r in identified(train, None).collect()} == {"und"}


def test_bounded_sample(spark, monkeypatch):
    """A third of the rows being one text, and another bound: the sample stays equal and within it."""
    seen = []
    monkeypatch.setattr(WordField, "fit", classmethod(lambda cls, names, data, labels: seen.append((names, data, labels))))
    rows = spark.range(3000).selectExpr("id AS doc_id", "CASE WHEN id % 3 = 0 THEN 'same words here' WHEN id % 3 = 1 THEN concat('words ', repeat(concat('more', id, ' '), 300)) ELSE concat('mots ', id) END AS text", "CASE WHEN id % 3 = 2 THEN 'fr' ELSE 'en' END AS lang")
    fit_languages(rows, train_pieces=60)
    names, data, labels = seen[0]
    assert names == ["en", "fr"] and np.bincount(labels).tolist() == [30, 30] and len(set(data)) == 60 and max(map(len, data)) <= 400
    assert len({d for d, k in zip(data, labels, strict=True) if k == 0 and not d.startswith(b"words")}) > 5

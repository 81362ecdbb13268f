import math
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from folioscope.llm import suffix_tree_lm as lm
from tests.llm.helpers import documents, texts


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if c.isascii() else c for c in text or ""))


def held(i):
    return zlib.crc32(str(i).encode()) % 7 == 2


def brute(train, floor):
    """probability(context tuple, token) by definition, with dictionaries."""
    count = Counter()
    for t in train:
        seq = ("", *words(t), "")
        for k in range(1, lm.DEPTH + 2):
            for i in range(len(seq) - k + 1):
                if k > 1 or i:
                    count[seq[i : i + k]] += 1
    often = {s for s in count if all(count[s[i:j]] >= floor for i in range(len(s)) for j in range(i + 1, len(s) + 1))}
    n = sum(c for s, c in count.items() if len(s) == 1)
    v = sum(len(s) == 1 for s in count)
    kept, rest, states = {}, {}, set()
    value = {s: (count[s] + 1) / (n + v + 1) for s in often if len(s) == 1}
    for d in range(1, lm.DEPTH + 1):
        grams = [s for s in often if len(s) == d + 1]
        good = [s for s in grams if count[s] * math.log(count[s] / max(count[s[:-1]], count[s]) / value[s[1:]]) >= lm.GAIN]
        share = {s: (1 - lm.ESCAPE) * max(count[s] - lm.DISCOUNT, 0) / max(count[s[:-1]], count[s]) for s in good}
        used = Counter()
        for s in good:
            used[s[:-1]] += share[s]
        scale = {c: (1 - lm.ESCAPE) / u if u > 1 - lm.ESCAPE else 1.0 for c, u in used.items()}
        for s in [x for x in often if len(x) == d]:
            rest[s] = 1 - used[s] * scale.get(s, 1.0)
        for s in grams:
            value[s] = share.get(s, 0) * scale.get(s[:-1], 1.0) + rest[s[:-1]] * value[s[1:]]
        kept |= {s: value[s] for s in good}
        states |= {s[:-1] for s in good}
    for s in list(states):
        states |= {s[i:] for i in range(1, len(s))}

    def chance(context, token):
        if not context:
            return (count[(token,)] + 1) / (n + v + 1)
        below = chance(context[1:], token)
        if context not in states:
            return below
        return kept.get((*context, token), rest[context] * below)

    return count, n, v, chance


def test_against_definition(spark):
    rows = texts(n=100) + ["the quick brown fox jumps over the lazy dog " + str(i) for i in range(40)]
    got = {r["doc_id"]: r for r in lm.score_texts(documents(spark, rows, extra=["score", "chunk"])).collect()}
    count, n, v, chance = brute([t for i, t in enumerate(rows) if not held(i)], lm.LOWEST)
    assert len(got) == len(rows)
    for i, t in enumerate(rows):
        r, tokens = got[i], [*words(t), ""]
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (held(i), len(tokens), sum((w,) in count for w in tokens), n)
        assert abs(r["base_score"] - sum(math.log10((count[(w,)] + 1) / (n + v + 1)) for w in tokens)) < 1e-6 * len(tokens)
        seq = ["", *tokens]
        assert abs(r["score"] - sum(math.log10(chance(tuple(seq[max(0, j - lm.DEPTH) : j]), seq[j])) for j in range(1, len(seq)))) < 1e-6 * len(seq)
    # Every context's probabilities sum to one over the training tokens and the unknown token.
    for context in (("quick", "brown", "fox"), ("the",), ("alpha1",)):
        assert abs(sum(chance(context, s[0]) for s in count if len(s) == 1) + chance(context, "never seen") - 1) < 1e-9


def test_beats_the_unigrams_on_held_out(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = [r for r in lm.score_texts(docs).collect() if r["held_out"]]
    score, base, tokens = (sum(r[c] for r in rows) for c in ("score", "base_score", "n_tokens"))
    print(score / tokens, base / tokens)
    assert score > base


def test_floor_does_not_grow_with_the_corpus(spark):
    """Two million tokens: a string counted three times is known, as it is in a small corpus."""
    ids = [i for i in range(1, 400) if not held(i)]
    phrase = "amber basilisk cormorant dulcimer"
    rows = [(i, " ".join(f"w{i}x{j % 100}" for j in range(10_000))) for i in ids[:200]] + [(i, phrase) for i in ids[200:203]] + [(next(i for i in range(400, 500) if held(i)), phrase)]
    got = lm.score_texts(documents(spark, rows)).collect()
    (r,) = [r for r in got if r["held_out"]]
    assert r["train_tokens"] > 2_000_000 and r["score"] > r["base_score"] + 10


def test_distinct_and_packed():
    rng = np.random.default_rng(2)
    near = rng.integers(0, 1 << 63, 50, dtype=np.uint64)
    for hashes in (np.zeros(0, np.uint64), rng.integers(0, 40, 300).astype(np.uint64), np.concatenate([near, near + np.uint64(1), near])):
        order, new = lm.distinct(hashes)
        one, first, which = np.unique(hashes, return_index=True, return_inverse=True)
        assert (hashes[order[new]] == one).all() and (order[new] == first).all() and ((np.cumsum(new) - 1)[np.argsort(order)] == which).all()
    for hashes in (np.zeros(0, np.uint64), np.sort(rng.integers(0, 1 << 63, 5000, dtype=np.uint64) * np.uint64(2)), np.array([0, 5, (1 << 64) - 1], dtype=np.uint64), np.array([1 << 63], dtype=np.uint64)):
        assert (lm.unpacked_hashes(lm.packed_hashes(hashes)) == hashes).all()
    for kind, values in ((1, [0, 1, 5, 1 << 33]), (2, [0, 1, 2, 9, 1 << 20]), (lm._MASS + 1, [0.0, 0.25, 1.5])):
        own = np.array([i % 2 == 1 for i in range(len(values))])
        got, mine = lm.unpacked([lm.packed(np.array(values), own, kind)] * 2 + [lm.packed(np.array(values[:0]), own[:0], kind)], kind)
        least = 0 if kind == 1 or kind > lm._MASS else lm.LOWEST
        expect = [1 - v if v <= 1 - lm.ESCAPE else -v for v in values] if kind > lm._MASS else [v if v >= least else 0 for v in values]
        assert got.tolist() == expect * 2
        assert kind > lm._MASS or mine.tolist() == [bool(o) and v >= max(1, least) for o, v in zip(own, values)] * 2


def test_one_id_and_a_very_long_text(spark):
    rows = [(3, f"the cat sat {i}") for i in range(30)] + [(4, "the cat sat " * 50_000)]
    got = lm.score_texts(documents(spark, rows)).collect()
    assert len(got) == 31 and {r["train_tokens"] for r in got} == {30 * 5 + 150_001} and max(r["n_tokens"] for r in got) == 150_001


def test_nulls_and_empty(spark):
    got = lm.score_texts(documents(spark, [(None, "a b"), (1, None), (1, None)])).collect()
    assert sorted((r["doc_id"] or 0, r["n_tokens"]) for r in got) == [(0, 3), (1, 1), (1, 1)]
    assert lm.score_texts(documents(spark, ["x"]).limit(0)).collect() == []


def test_texts_are_tokenized_once_and_rounds_shuffle_answers_only(spark):
    rows = [(i, t) for i, t in enumerate(texts(n=60))] + [(None, "one two three four"), (5, "one two three four"), (6, " a\x0bB ")]
    docs = documents(spark, rows).withColumn("doc_id", F.col("doc_id").cast("string"))
    found = lm.score_texts(docs)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "text" not in plan
    got = sorted(((r["doc_id"] or "", r["n_tokens"]) for r in found.collect()))
    assert got == sorted(("" if i is None else str(i), len(words(t)) + 1) for i, t in rows)


def test_a_chunk_is_kept_whole():
    rows = pa.table({"doc_id": pa.array([4, None, 4]), "text": pa.array(["b a B " * 300, None, " ".join(map(str, range(70_000)))]), "held_out": pa.array([False, True, False])})
    one, which, edge = lm.tokens_of(rows.column("text"))
    kept = lm.Chunk(pa.Table.from_batches([lm.tokenized(7, rows, pa.int64())]))
    assert (kept.one == one).all() and (kept.which == which).all() and (kept.edge == edge).all()
    assert kept.ids.to_pylist() == [4, None, 4] and kept.held.to_pylist() == [False, True, False]

import math
import re
from collections import defaultdict

import xxhash
from pyspark.sql import functions as F

from folioscope.llm import source_mix
from folioscope.llm.source_mix import mix_sources, mixed_documents, permuted
from tests.llm.helpers import documents, texts


def water(sizes):
    """Targets by sharing the excess again and again."""
    names = sorted((k for k in sizes if k is not None), key=lambda s: [ord(c) for c in s]) + ([None] if None in sizes else [])
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(names)}
    left, open_, out = 1.5 * sum(sizes.values()), set(names), {}
    while open_:
        total = sum(weight[s] for s in open_)
        over = {s for s in open_ if left * weight[s] / total > 2 * sizes[s]}
        if not over:
            out |= {s: left * weight[s] / total for s in open_}
            break
        for s in over:
            out[s] = 2.0 * sizes[s]
        left -= sum(2.0 * sizes[s] for s in over)
        open_ -= over
    return out


def test_targets_and_taken(spark):
    docs = documents(spark, texts(n=200), extra=["size", "target"])
    rows = mix_sources(docs, block=8).collect()
    assert sorted(map(tuple, rows)) == sorted(map(tuple, mix_sources(docs, block=8).collect()))
    source = {r["doc_id"]: (r["source"], len(re.findall(r"[^\x20\x09-\x0D]+", r["text"] or ""))) for r in docs.collect()}
    sizes = defaultdict(int)
    for s, n in source.values():
        sizes[s] += n
    aim, taken = water(sizes), defaultdict(int)
    for r in rows:
        s, n = source[r["doc_id"]]
        assert r["size"] == n and r["source_size"] == sizes[s] and abs(r["target"] - aim[s]) < 1e-6 * max(1, aim[s]) and 0 <= r["taken"] <= 2 * n
        taken[s] += r["taken"]
    assert len(rows) == len(source) and all(abs(taken[s] - aim[s]) <= 3 * 8 for s in aim)


def test_repeated_rows_nulls_and_empty(spark):
    docs = documents(spark, [(1, "a b c d e f g h"), (1, "a b c d e f g h"), (None, "x y z"), (2, None)])
    rows = mix_sources(docs).collect()
    assert len(rows) == 4 and all(r["taken"] <= 2 * r["size"] for r in rows)
    assert mix_sources(docs.limit(0)).collect() == []


def test_permutation(spark):
    for n in (1, 2, 7, 100):
        got = spark.range(n).select(permuted(F.col("id"), F.lit(n), F.lit(3), F.lit(1)).alias("p")).collect()
        assert sorted(r["p"] for r in got) == list(range(n))


def _hash(*values, seed=42):
    """xxhash64 of longs, and of ints given as ("int", value); nulls are skipped, strings are their bytes."""
    for v in values:
        if v is None:
            continue
        raw = v.encode() if isinstance(v, str) else v[1].to_bytes(4, "little") if isinstance(v, tuple) else (v % (1 << 64)).to_bytes(8, "little")
        seed = xxhash.xxh64_intdigest(raw, seed=seed)
    return seed - (1 << 64) if seed >= 1 << 63 else seed


def _permuted(x, n, position, turn, seed):
    key = (("int", position), turn, ("int", seed))
    for r in range(1, source_mix.ROUNDS + 1):
        partner = (_hash(*key, ("int", r)) - x) % n
        if _hash(max(x, partner), ("int", r), *key) % 2:
            x = partner
    return x


def brute_times(quota, seed, shard):
    """Draws of each (position, block); quota: (position, slots, blocks) of each source."""
    total, n = sum(q for _, q, _ in quota), len(quota)
    alias = {c: (own, chance, other) for c, own, chance, other in source_mix._alias([(p, q) for p, q, _ in quota])}
    counts = defaultdict(int)
    for i in range(total):
        own, chance, other = alias[_hash(i, ("int", seed)) % n]
        u = _hash(i, ("int", seed + 1)) % (1 << 53) / float(1 << 53)
        counts[i // shard, own if u < chance else other] += 1
    drawn, kept, beyond = defaultdict(int), [], []
    for s, p in sorted(counts):
        for _ in range(counts[s, p]):
            (kept if drawn[p] < dict((a, b) for a, b, _ in quota)[p] else beyond).append((p, drawn[p]))
            drawn[p] += 1
    short = [(p, drawn[p] + i) for p, q, _ in quota for i in range(max(0, q - drawn[p]))]
    assert len(beyond) == len(short)  # all that is drawn beyond goes to what is left short
    blocks, times = {p: b for p, _, b in quota}, defaultdict(int)
    for p, slot in kept + short:
        times[p, _permuted(slot % blocks[p], blocks[p], p, slot // blocks[p], seed)] += 1
    return times


def test_taken_against_brute_force(spark):
    rows, block, seed = texts(n=60), 8, 7
    docs = documents(spark, rows)
    got = {r["doc_id"]: r for r in mix_sources(docs, block=block).collect()}
    own = [(r["doc_id"], r["text"], r["source"], len(re.findall(r"[^\x20\x09-\x0D]+", r["text"] or ""))) for r in docs.collect()]
    names = sorted({s for _, _, s, _ in own if s is not None}) + [None]
    sizes = {s: sum(n for _, _, x, n in own if x == s) for s in names}
    aim = water(sizes)
    quota = [(p, min(2 * (b := -(-sizes[s] // block)), math.floor(aim[s] * b / sizes[s] + 0.5)), b) for p, s in enumerate(names) if sizes[s]]
    times = brute_times(quota, seed, source_mix.SHARD)
    for p, s in enumerate(names):
        start = 0
        for i, _, _, n in sorted((r for r in own if r[2] == s), key=lambda r: (r[0], _hash(r[0], r[1], r[2]))):
            assert got[i]["taken"] == sum(times[p, w // block] for w in range(start, start + n)), (i, s)
            start += n


def test_many_copies_of_one_row_and_a_very_long_text(spark, monkeypatch):
    monkeypatch.setattr(source_mix, "BUCKET", 7)  # many buckets, and copies unrolled in several steps
    docs = documents(spark, [(1, "a b c d e f g h i j")] * 40 + [(2, "word " * 50_000), (4, "x y z")])
    rows = mix_sources(docs).collect()
    assert len(rows) == 42 and sorted(map(tuple, rows)) == sorted(map(tuple, mix_sources(docs).collect()))
    for r in rows:
        assert 0 <= r["taken"] <= 2 * r["size"]
    by = defaultdict(lambda: [0, 0.0])
    for r in rows:
        by[r["source_size"]][0] += r["taken"]
        by[r["source_size"]][1] = r["target"]
    assert all(abs(t - aim) <= 3 * 64 for t, aim in by.values())
    mixed = mixed_documents(docs).groupBy("doc_id").count().collect()
    assert {r["doc_id"] for r in mixed} <= {1, 2, 4} and all(r["count"] <= 80 for r in mixed)

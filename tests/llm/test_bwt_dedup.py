import hashlib
import random

import numpy as np

from folioscope.llm.bwt_dedup import Shard, merge, suffix_dedup
from tests.llm.helpers import documents, texts


def brute(rows, length=100):
    """rows: (id, bytes) by id; what is left of each and its number of removed runs."""
    seen, out = set(), {}
    for key, data in rows:
        gone = [False] * len(data)
        for i in range(len(data) - length + 1):
            window = data[i : i + length]
            if window in seen:
                gone[i : i + length] = [True] * length
            seen.add(window)
        kept = bytes(b for b, g in zip(data, gone, strict=True) if not g)
        runs = sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone))
        out[key] = (len(data), sum(gone), runs, hashlib.sha256(kept).hexdigest())
    return out


def inputs():
    rng = random.Random(5)
    letters = lambda n: "".join(rng.choice("abcdefgh é") for _ in range(n))
    passage = letters(400)
    rows = [t for t in texts(n=15)]
    for i in range(40):
        a, b = rng.randrange(200), rng.randrange(200, 400)
        rows.append(letters(rng.randrange(300)) + passage[a:b] + letters(rng.randrange(120)))
    rows += [passage, passage[:250] + "X" + passage[251:], "ab" * 400, "b" + "ab" * 300, passage + passage[50:], letters(99), letters(100), rows[-1]]
    return rows


def test_against_brute_force(spark):
    rows = inputs()
    got = suffix_dedup(documents(spark, rows, extra=["key", "start", "spans"])).collect()
    expect = brute([(i, (t or "").encode()) for i, t in enumerate(rows)])
    assert {r["doc_id"]: tuple(r)[1:] for r in got} == expect


def test_repeats_inside_one_run(spark):
    rng = random.Random(9)
    letters = lambda n: "".join(rng.choice("bcdefgh ") for _ in range(n))
    ruler = letters(80) + "-." * 75 + letters(80)
    for rows in (["a" * 150], ["a" * 291], [ruler, ruler], [letters(90) + "xyz " * 30 + letters(90)]):
        got = suffix_dedup(documents(spark, rows)).collect()
        assert {r["doc_id"]: tuple(r)[1:] for r in got} == brute([(i, t.encode()) for i, t in enumerate(rows)])
    assert suffix_dedup(documents(spark, ["a" * 150])).first()["n_removed"] == 149


def test_repeated_rows_nulls_and_empty(spark):
    rng = random.Random(1)
    text = "".join(rng.choice("abcdefghij ") for _ in range(500))
    got = suffix_dedup(documents(spark, [(1, text), (1, text), (2, "q" + text), (None, text), (3, None)])).collect()
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0, r["n_removed"]) for r in got) == [(False, 1, 0), (False, 1, 0), (False, 2, 500), (False, 3, 0), (True, 0, 500)]
    assert suffix_dedup(documents(spark, ["x"]).limit(0)).collect() == []


def test_large_and_repeated_ids(spark):
    rng = random.Random(3)
    text = "".join(rng.choice("abcdefghij ") for _ in range(300))
    big = 1 << 62
    rows = [(big, text), (big, text + "!"), (big - 1, "x" + text), (-big, text[:150]), (2 * big - 1, text), (None, "y" + text), (7, "z")]
    got = {(r["doc_id"], r["n_bytes"]): (r["n_removed"], r["n_spans"]) for r in suffix_dedup(documents(spark, rows)).collect()}
    assert got.pop((-big, 150)) == (0, 0) and got.pop((7, 1)) == (0, 0) and got.pop((big - 1, 301)) == (150, 1)
    # Of the two texts under one id either may come first.
    assert got == {(big, 300): (300, 1), (big, 301): (300, 1), (2 * big - 1, 300): (300, 1), (None, 301): (300, 1)}


def test_transforms_merge_and_give_common_prefixes():
    rng = random.Random(4)
    runs = ["".join(rng.choice("ab") for _ in range(rng.randint(20, 60))).encode() for _ in range(12)]
    offsets = np.concatenate([[0], np.cumsum([len(r) for r in runs])])
    data = np.frombuffer(b"".join(runs), np.uint8)
    cut = [0, 4, 7, 12]
    shards = [Shard(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]) for a, b in zip(cut, cut[1:])]
    interleave, common = merge(shards, 5)
    place, suffixes = [0] * len(shards), []
    for s in interleave.tolist():
        own = shards[s]
        at = int(own.at[own.order[place[s]]])
        place[s] += 1
        run = int(np.searchsorted(offsets, at + offsets[cut[s]], side="right")) - 1
        suffixes.append(None if at < 0 else runs[run][at + offsets[cut[s]] - offsets[run] :][:10])
    full = [(a, b, c) for a, b, c in zip(suffixes, suffixes[1:], common[1:].tolist()) if a and b and len(a) == len(b) == 10]
    assert len(full) > 100
    for a, b, c in full:
        same = next((i for i in range(5) if a[2 * i : 2 * i + 2] != b[2 * i : 2 * i + 2]), 5)
        assert a <= b and c == same


def test_a_very_long_text(spark):
    rng = random.Random(8)
    part = "".join(rng.choice("abcdefghijklmnop ") for _ in range(200_000))
    got = {r["doc_id"]: (r["n_removed"], r["n_spans"]) for r in suffix_dedup(documents(spark, [(1, part), (2, "q" + part + "w" + part[5000:9000]), (3, "e")])).collect()}
    assert got == {1: (0, 0), 2: (204_000, 2), 3: (0, 0)}

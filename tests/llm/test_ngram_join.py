import random
import re

import pytest

from folioscope.llm import ngram_join
from folioscope.llm.ngram_join import ngram_components
from tests.llm.helpers import documents, texts


def shingles(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if c.isascii() else c for c in text or ""))
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)} or ({tuple(words)} if words else set())


def brute(rows):
    sets = {i: shingles(t) for i, t in rows}
    root = {i: i for i, _ in rows}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in ids}


def chains():
    """Documents that drift apart, so that only neighbours link, and others with a passage in common."""
    base = [f"w{i}" for i in range(60)]
    out = []
    for i in range(25):
        out.append(" ".join(base))
        base[(i * 7) % 60] = f"x{i}"
    passage = " ".join(f"common{i}" for i in range(40))
    out += [f"{passage} " + " ".join(f"own{i}_{j}" for j in range(n)) for i, n in enumerate([10, 12, 14, 9, 11, 30, 60, 13] * 6)]
    return out


def test_against_brute_force(spark):
    rows = list(enumerate(texts(n=80) + chains()))
    got = ngram_components(documents(spark, rows, extra=["node", "n", "token"])).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == brute(rows)


def test_repeated_rows_nulls_and_empty(spark):
    text = "one two three four five six seven"
    got = ngram_components(documents(spark, [(3, text), (3, text), (None, text), (5, text.upper()), (7, None), (8, "a b")])).collect()
    assert sorted((r["doc_id"] or -1, r["n_shingles"], r["component_id"]) for r in got) == [(-1, 3, 3), (3, 3, 3), (3, 3, 3), (5, 3, 3), (7, 0, 7), (8, 1, 8)]
    assert ngram_components(documents(spark, ["x"]).limit(0)).collect() == []


def test_rows_without_an_id_link(spark):
    base = [f"w{i}" for i in range(60)]
    near = lambda *at: " ".join("y" if i in at else w for i, w in enumerate(base))
    rows = [(5, near(3)), (None, near(3, 20)), (6, near(3, 20, 40)), (9, "another text of its own entirely")]
    got = sorted(((r["doc_id"] or -1, r["component_id"]) for r in ngram_components(documents(spark, rows)).collect()), key=str)
    assert got == [(-1, 5), (5, 5), (6, 5), (9, 9)]


def drifting(n, edits, seed=1, size=100):
    """Copies of one text with so many words changed that about half of the pairs link, and none with all."""
    rng = random.Random(seed)
    base = [f"b{i}" for i in range(size)]
    out = []
    for i in range(n):
        words = list(base)
        for at in rng.sample(range(size), rng.randint(*edits)):
            words[at] = f"e{i}_{at}" if rng.random() < 0.5 else f"f{at}"
        out.append(" ".join(words))
    return out


@pytest.mark.parametrize("edits", [(1, 6), (3, 4), (4, 8)])
def test_large_group_under_the_threshold(spark, edits):
    rows = list(enumerate(drifting(120, edits) + texts(n=5)))
    got = ngram_components(documents(spark, rows)).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == brute(rows)


def test_a_very_long_text(spark):
    words = [f"w{i}" for i in range(30_000)]
    rows = [(1, " ".join(words)), (2, " ".join(words[:29_000])), (3, " ".join(words[15_000:]))]
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in ngram_components(documents(spark, rows)).collect()}
    assert got == {1: (29_996, 1), 2: (28_996, 1), 3: (14_996, 3)}


def apart(edits, seed, size=100):
    """Copies of one text, each with as many words of its own as ``edits`` has."""
    rng = random.Random(seed)
    out = []
    for i, n in enumerate(edits):
        words = [f"b{j}" for j in range(size)]
        for at in rng.sample(range(2, size - 2), n):
            words[at] = f"e{i}_{at}"
        out.append(" ".join(words))
    return out


def test_a_large_group_apart_from_its_leaders_opens_few_pairs(spark, monkeypatch):
    """The more of a copy is changed, the fewer of its lists are long ones; each kind of list has another leader, so none is a likely pair."""
    rows = list(enumerate(apart([4] * 120 + [3] * 80 + [2] * 60, seed=6)))
    seen, open_groups = [], ngram_join.open_groups

    def counted(*args):
        out = open_groups(*args)
        seen.append(out.count())
        return out

    monkeypatch.setattr(ngram_join, "open_groups", counted)
    got = ngram_components(documents(spark, rows)).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == brute(rows)
    assert seen[0] <= len(rows)

import hashlib
import re
from collections import Counter

import xxhash

from folioscope.llm import term_fingerprint
from folioscope.llm.term_fingerprint import CHANCES, OWN, document_fingerprints, op7_term_fingerprint
from tests.llm.helpers import documents, texts


def test_edits_and_equal_texts(spark):
    rows = texts(n=60)
    got = {r["doc_id"]: r for r in document_fingerprints(documents(spark, rows, extra=["part", "fingerprint", "term"]), least=0.02, most=0.5).collect()}
    assert len(got) == len(rows)
    prints = {}
    for i, t in enumerate(rows):
        text, follower = t or "", rows[i - 1] or ""
        cut = len(text) // 3
        edited = text[: len(text) - cut] + follower[:cut]
        assert got[i]["n_chars"] == len(text) and got[i]["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        assert 0 <= got[i]["near_edited"] <= 1 and 0 <= got[i]["near_next"] <= 1
        assert prints.setdefault(text, got[i]["fingerprint"]) == got[i]["fingerprint"]
        assert got[i]["near_next"] == 1.0 if text == follower else True
        assert (got[i]["near_edited"] == 1.0) == (got[i]["fingerprint"] == got[i]["edited_fingerprint"])


def test_edits_stay_nearer_than_followers(spark, sf):
    rows = op7_term_fingerprint(spark, sf).collect()
    assert sum(r["near_edited"] for r in rows) > 2 * sum(r["near_next"] for r in rows)


def test_a_group_larger_than_the_band_stays_alike(spark):
    words = [f"common{i}" for i in range(90)]
    near = [" ".join([*words[: i % 90], f"edit{i}", *words[i % 90 + 1 :]]) for i in range(80)]
    other = [" ".join(f"word{(7 * i + j * j) % 997}" for j in range(60)) for i in range(120)]
    got = {r["doc_id"]: r for r in document_fingerprints(documents(spark, near + other)).collect()}
    alike = [sum(got[i][c] > 0 for i in range(1, 80)) for c in ("near_next", "near_edited")]
    assert min(alike) > 60, alike
    # Terms that are all below the band.
    lone = {r["doc_id"]: r for r in document_fingerprints(documents(spark, [" ".join(f"t{i}x{j}" for j in range(50)) for i in range(40)])).collect()}
    assert sum(r["near_edited"] > 0 for r in lone.values()) > 30 and all(r["near_next"] == 0 for r in lone.values())


def test_single_repeated_null_and_empty(spark):
    one = document_fingerprints(documents(spark, [(5, "alpha beta")])).collect()
    assert len(one) == 1 and one[0]["near_next"] == 1.0
    many = documents(spark, [(1, "a b c"), (1, "a b c"), (None, None), (2, None)])
    assert len(document_fingerprints(many).collect()) == 4
    assert document_fingerprints(many.limit(0)).collect() == []


def _hash(value, seed=42):
    raw = value.encode() if isinstance(value, str) else value
    return xxhash.xxh64_intdigest(raw, seed=seed)


def _signed(h):
    return h - (1 << 64) if h >= 1 << 63 else h


def _chain(hashes):
    out = 42
    for h in hashes:
        out = _hash((h % (1 << 64)).to_bytes(8, "little"), out)
    return f"{out:016X}"[:8]


def brute(rows, least, most, seed=11):
    """rows: (id, text); the contract's columns by row, each followed by the next one by descending id, then by hash."""
    split = lambda t: {x for x in re.split(r"[\x00-\x20!-/:-@\[-`{-\x7F]+", t.lower()) if x}
    rows = sorted(((i, t or "") for i, t in rows), key=lambda r: (r[0] is None, -(r[0] or 0), _signed(_hash(r[1])), r[1]))
    n, count = len(rows), Counter(x for _, t in rows for x in split(t))
    band = {x for x, c in count.items() if max(2, least * n) <= c <= max(2, most * n)}

    def fingerprint(text):
        found = sorted(_signed(_hash(x)) for x in split(text) & band)
        name = {_signed(_hash(x)): x for x in split(text) & band}
        chosen = [[h for h in found if _signed(_hash((seed + i).to_bytes(4, "little"), _hash(name[h]))) % c == 0] for i, c in enumerate(CHANCES)]
        own = sorted(_signed(_hash(x)) for x in split(text))
        # Of no term the hash is that of null, the seed.
        rest = [next((h for h in own if h % OWN == i), None) for i in range(OWN)]
        return [_chain(c) for c in chosen] + [_chain([] if h is None else [h]) for h in rest]

    def like(a, b):
        pairs = [(x, y) for x, y in zip(a, b) if (x, y) != ("00000000", "00000000")]
        return 1.0 if a == b else sum(x == y for x, y in pairs) / len(pairs) if pairs else 0.0

    out = []
    for k, (i, text) in enumerate(rows):
        follower = rows[(k + 1) % n][1]
        cut = len(text) // 3
        edited = text[: len(text) - cut] + follower[:cut]
        a, b, c = fingerprint(text), fingerprint(edited), fingerprint(follower)
        out.append((i, len(text), hashlib.sha256(edited.encode()).hexdigest(), ".".join(a), ".".join(b), round(like(a, b), 9), round(like(a, c), 9)))
    return sorted(out, key=str)


def plain(rows):
    return sorted(((*tuple(r)[:5], round(r["near_edited"], 9), round(r["near_next"], 9)) for r in rows), key=str)


def test_against_brute_force(spark):
    rows = list(enumerate(texts(n=60)))
    assert plain(document_fingerprints(documents(spark, rows), least=0.02, most=0.5).collect()) == brute(rows, 0.02, 0.5)


def test_frequent_ids_nulls_and_a_very_long_text(spark, monkeypatch):
    monkeypatch.setattr(term_fingerprint, "SMALL", 0)  # the lexicon is joined, not broadcast
    rows = [(i % 3 * 7 if i < 60 else None if i < 100 else i, f"{t or ''} w{i}") for i, t in enumerate(texts(n=100))] + [(50, "long " + " ".join(f"q{j % 999}" for j in range(60_000)))]
    assert plain(document_fingerprints(documents(spark, rows), least=0.02, most=0.5).collect()) == brute(rows, 0.02, 0.5)

import hashlib
import math
import re
import zlib
from collections import Counter

import duckdb

from folioscope.llm.importance_resample import ORACLE_SQL, Trie, bucket_gains, bucket_totals, importance_resample, op11_importance_resample, ranked_draw, resampled
from tests.llm.helpers import documents, texts


def features(text, longest):
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered)
    return len(words), [" ".join(words[i : i + k]) for i in range(len(words)) for k in range(1, longest + 1) if i + k <= len(words)]


def bucket(feature, buckets):
    return zlib.crc32(feature.encode()) % buckets


def brute(corpus, target, longest, buckets, percent, least, seed):
    s, t = (Counter(bucket(f, buckets) for _, text in rows for f in features(text, longest)[1]) for rows in (corpus, target))
    gains = [math.floor(1000 * math.log((t[b] + 1) * (sum(s.values()) + buckets) / ((s[b] + 1) * (sum(t.values()) + buckets)))) for b in range(buckets)]
    out = []
    for i, text in corpus:
        n_words, own = features(text, longest)
        weight = sum(gains[bucket(f, buckets)] for f in own) // len(own) if own else 0
        h = int(hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append([i, n_words, len(own), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2**32))), None])
    may = sorted((r for r in out if r[1] >= least), key=lambda r: (-r[4], r[0] is not None, r[0] or 0, r[2], r[3]))
    for place, row in enumerate(may[: percent * len(may) // 100], 1):
        row[5] = place
    return sorted(map(str, map(tuple, out)))


def test_against_brute_force(spark):
    rows = [*enumerate(texts(seed=9)), (None, "no id " * 30), (None, "other text without an id " * 9), (7, "same id again " * 10), (7, "same id again " * 10), (900, "É漢字 mixed Ünï " * 20), (901, "very long text of words " * 40_000)]
    target = [(i, t) for i, t in enumerate(texts(seed=4, n=6))]
    for longest, buckets, percent in ((1, 10_000, 10), (3, 50, 40), (2, 7, 100)):
        got = importance_resample(documents(spark, rows, extra=["rank", "_row"]), documents(spark, target), longest=longest, buckets=buckets, percent=percent, least=5, seed=11)
        assert got.columns == ["doc_id", "n_words", "n_features", "weight", "score", "rank"]
        assert sorted(map(str, map(tuple, got.collect()))) == brute(rows, target, longest, buckets, percent, 5, 11)


def test_query_against_sql(spark, sf):
    con = duckdb.connect()
    for name in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{sf}/{name}.parquet')")
    expected = con.execute(ORACLE_SQL)
    names = [c[0] for c in expected.description]
    got = op11_importance_resample(spark, sf)
    assert sorted(names) == sorted(got.columns)
    assert sorted(map(str, map(tuple, got.select(*names).collect()))) == sorted(map(str, expected.fetchall()))


def test_a_full_trie_starts_anew():
    words = [f"w{i % 97}" for i in range(2000)]
    small, large = Trie(2, 31, most=10), Trie(2, 31)
    for own in (small, large):
        for a in range(0, 2000, 50):
            own.walk(" ".join(words[a : a + 50]).encode())
        own.flush()
    assert small.totals.tolist() == large.totals.tolist() and small.totals.sum() == 2000 + 40 * 49


def test_long_text_in_chunks(monkeypatch):
    text = " ".join(f"w{i % 13}" for i in range(500)).encode()
    whole = Trie(3, 101)
    n = whole.walk(text)
    whole.flush()
    monkeypatch.setattr("folioscope.llm.importance_resample.CHUNK", 7)
    parts = Trie(3, 101)
    assert parts.walk(text) == n == (500, 500 + 499 + 498, 0)
    parts.flush()
    assert parts.totals.tolist() == whole.totals.tolist()


def test_many_rows_of_one_id_and_score(spark):
    rows = spark.range(3000).selectExpr("CASE WHEN id % 3 = 0 THEN id ELSE 1 END AS doc_id", "30L AS n_words", "30L AS n_features", "5L AS weight", "CASE WHEN id % 3 = 0 THEN id ELSE 2500 END AS score")
    got = ranked_draw(rows, 50).collect()
    assert sorted(r["rank"] for r in got if r["rank"]) == list(range(1, 1501)) and len(got) == 3000
    assert all(r["score"] >= 2500 for r in got if r["rank"]) and {r["doc_id"] for r in got if r["rank"] and r["rank"] > 200} == {1}


def test_empty_tables_and_drawn_rows(spark):
    docs = documents(spark, extra=["_rank0"])
    assert importance_resample(docs.limit(0), docs).collect() == []
    none = importance_resample(docs, docs.limit(0), percent=20)
    gains = bucket_gains(bucket_totals(docs), bucket_totals(docs.limit(0)))
    assert none.count() == docs.count() and len(gains) == 10_000 and max(gains) > 0 > min(gains)
    assert {r["rank"] for r in importance_resample(docs, docs, percent=0).collect()} == {None}
    drawn = resampled(docs, docs, percent=20)
    assert drawn.columns == [*docs.columns, "_rank"]
    assert sorted(r["doc_id"] for r in drawn.collect()) == sorted(r["doc_id"] for r in importance_resample(docs, docs, percent=20).collect() if r["rank"])

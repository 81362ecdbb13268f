import re
from collections import defaultdict

import corpus_pipeline as p
from folioscope.llm.quality_crf import fit_quality, score_quality
from tests.llm.helpers import documents
from tests.llm.test_ngram_join import brute
from tests.llm.test_source_mix import water


def test_every_stage_does_its_work(spark, sf, tmp_path):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    out, kept = {}, docs
    for name, stage in p.STAGES:
        stage(spark, kept, sf).write.parquet(str(tmp_path / name))
        kept = out[name] = spark.read.parquet(str(tmp_path / name))
        assert name == p.STAGES[-1][0] or kept.columns == docs.columns
    quality, near, secrets, mixed, tokens = (out[n].collect() for n, _ in p.STAGES)
    model = fit_quality(docs, spark.read.parquet(f"{sf}/labels.parquet"))
    good = {r["doc_id"] for r in score_quality(docs, model).collect() if r["score"] >= 0.3}
    assert {r["doc_id"] for r in quality} == good
    groups = brute([(r["doc_id"], r["text"]) for r in quality])
    assert sorted(r["doc_id"] for r in near) == sorted(i for i, (_, c) in groups.items() if i == c)
    assert {r["doc_id"] for r in secrets} == {r["doc_id"] for r in near} and all(r["n_chars"] == len(r["text"]) for r in secrets)
    assert not any(re.search(r"AKIA[A-Z0-9]{16,}|[0-9a-f]{24,}", r["text"]) for r in secrets)
    times = {}
    for r in mixed:
        times[r["doc_id"]] = times.get(r["doc_id"], 0) + 1
    assert set(times) <= {r["doc_id"] for r in secrets} and max(times.values()) <= 2
    # Each source comes near its target, in words, but for the documents that start in a block and end in others.
    size = {r["doc_id"]: len(re.findall(r"[^\x20\x09-\x0D]+", r["text"] or "")) for r in secrets}
    source = {r["doc_id"]: r["source"] for r in secrets}
    total, got, longest = defaultdict(int), defaultdict(int), max(size.values())
    for i, n in size.items():
        total[source[i]] += n
        got[source[i]] += n * times.get(i, 0)
    aim = water(total)
    assert all(abs(got[s] - aim[s]) <= 0.25 * aim[s] + 2 * longest for s in total)
    assert len(tokens) == len(mixed) and sum(r["n_tokens"] for r in tokens) > 0


NAMES = ["spans", "blob", "_blob", "_times", "_copy", "row", "k", "h", "copies", "group", "words", "times", "size", "position", "block", "start", "token", "node", "n"]


def test_nulls_empty_texts_repeated_rows_and_clashing_names(spark, sf):
    text = "one two three four five six seven token=abcdefgh1 eight nine"
    rows = [(1, text), (1, text), (2, text), (None, text + " ten"), (3, None), (4, ""), (None, None), (5, "other words are here " * 30), (5, "and a second text of one id " * 20)]
    docs = documents(spark, rows, extra=NAMES)
    near = p.near_duplicates(spark, docs, sf)
    assert near.columns == docs.columns
    kept = sorted(((r["doc_id"] or -1, r["text"] or "") for r in near.collect()))
    assert kept == sorted([(1, text), (3, ""), (4, ""), (-1, ""), (5, rows[7][1]), (5, rows[8][1])])
    safe = p.secrets(spark, docs, sf)
    assert safe.columns == docs.columns and safe.count() == len(rows)
    assert not any("abcdefgh1" in (r["text"] or "") for r in safe.collect()) and all(r["spans"] == "clash" for r in safe.collect())
    mixed = p.mixing(spark, docs, sf)
    assert mixed.columns == docs.columns and 0 < mixed.count() <= 2 * len(rows) and all(r["text"] and r["_times"] == "clash" for r in mixed.collect())
    assert p.tokens(spark, mixed, sf).count() == mixed.count()


def test_empty_table(spark, sf):
    docs = documents(spark, ["x"]).limit(0)
    for _, stage in p.STAGES:
        out = stage(spark, docs, sf)
        assert out.collect() == []

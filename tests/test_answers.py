"""Adapters, settings, model output, markup and the answer path."""

import json
import random

import pytest
from pyspark.sql import functions as F

from folioscope.functions import json_text, markup
from folioscope.operators import answers
from folioscope.settings import Settings
from folioscope.sources import adapters


def test_balanced_json_parses_after_any_cut():
    whole = json.dumps({"headers": ["a", "b"], "rows": [["1", 'x"y\\'], ["3", "{[ ]}"]], "n": {"k": [1, 2]}})
    fixed = [json_text.balanced(whole[:n]) for n in range(1, len(whole) + 1)]
    good = sum(_parses(t) for t in fixed)
    assert _parses(fixed[-1]) and good > 0.6 * len(fixed)


def _parses(text):
    try:
        json.loads(text)
    except ValueError:
        return False
    return True


def test_messages_keep_everything_and_the_limit(spark):
    rng = random.Random(3)
    texts = ["\n\n".join("".join(rng.choice("ab \n") for _ in range(rng.randint(1, 90))) for _ in range(8)) for _ in range(30)] + ["<pre>" + "x\n" * 100 + "</pre>", "short", None]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id int, t string").select("id", markup.messages(F.col("t"), 60).alias("m"))
    for r in df.collect():
        squeezed = lambda s: "".join((s or "").split())
        assert all(len(p) <= 60 for p in r["m"]) and squeezed("".join(r["m"])) == squeezed(texts[r["id"]])


def test_safe_tags(spark):
    row = spark.createDataFrame([("<b>a</b><form>x</form><a href='u'>l</a>",)], "t string").select(markup.safe_tags_only(F.col("t")).alias("t")).first()
    assert row["t"] == "<b>a</b>x<a href='u'>l</a>"


def test_rewrites_out_of_proportion_are_dropped(spark):
    df = spark.createDataFrame([("corta", "x" * 2000), ("corta", " mejor "), ("corta", ""), ("corta", None), ("q" * 600, "y" * 2000)], "q string, c string")
    assert [r["r"] for r in df.select(answers.rewritten(F.col("q"), F.col("c")).alias("r")).collect()] == ["corta", "mejor", "corta", "corta", "y" * 2000]


def test_answers_by_route(spark):
    asked = spark.createDataFrame([(1, "hola"), (2, "que es"), (3, "distancia minima")], "query_id int, question string")
    hits = spark.createDataFrame([(3, 1, "norma.pdf", 4, "La distancia\nes 3 m"), (3, 2, "guia.pdf", None, "y" * 400)], "query_id int, rank int, source string, page int, text string")
    got = {r["query_id"]: r for r in answers.answered(asked, hits).collect()}
    assert got[1]["answer"].startswith("¡Hola!") and got[2]["route"] == "ambiguous" and got[1]["sources"] == ""
    assert "La distancia es 3 m" in got[3]["answer"] and got[3]["answer"].endswith("...") and got[3]["sources"] == "1. norma · pág. 4\n2. guia"
    none = answers.extractive(asked, hits.limit(0)).collect()
    assert {r["answer"] for r in none} == {answers.NO_EVIDENCE}


def test_search_loop_is_bounded(spark):
    asked, seen = spark.createDataFrame([(1, "a"), (2, "b")], "query_id int, text string"), []

    def search(questions):
        seen.append(questions.count())
        return questions.where("query_id = 1").select("query_id", F.lit(7).alias("doc_id"))

    rows = answers.searched_until_found(asked, search, lambda c, turn: c, rounds=3).collect()
    assert seen == [2, 1, 1] and [(r["query_id"], r["round"]) for r in rows] == [(1, 1)]


def test_failing_models_give_nulls(spark):
    class Broken:
        def write(self, prompts):
            raise RuntimeError("down")

    df = spark.createDataFrame([("x\ny",), (None,)], "p string")
    assert [r["o"] for r in df.select(adapters.written(F.col("p"), adapters.EchoWriter()).alias("o")).collect()] == ["y", None]
    assert [r["o"] for r in df.select(adapters.written(F.col("p"), Broken()).alias("o")).collect()] == [None, None]


def test_retries_only_when_busy():
    waits, calls = [], []

    def busy():
        calls.append(1)
        if len(calls) < 3:
            raise RuntimeError("503 busy")
        return "ok"

    assert adapters.with_retries(busy, wait=waits.append) == "ok" and waits == [2.0, 4.0]
    with pytest.raises(ValueError):
        adapters.with_retries(lambda: (_ for _ in ()).throw(ValueError("401")), wait=waits.append)


def test_parsers_and_pages(spark, tmp_path):
    (tmp_path / "b.txt").write_text("uno\f\fdos")
    (tmp_path / "a.txt").write_text("solo")
    rows = adapters.pages(spark, str(tmp_path), pattern="*.txt").orderBy("path", "page").collect()
    assert [(r["path"][-5:], r["page"], r["text"]) for r in rows] == [("a.txt", 1, "solo"), ("b.txt", 1, "uno"), ("b.txt", 3, "dos")]
    with pytest.raises(ValueError):
        adapters.parser("nope")
    spark.dataSource.register(adapters.GeneratedPages)
    assert spark.read.format("generated_pages").option("documents", 3).load().count() == 9


def test_settings():
    s = Settings.load({"FOLIOSCOPE_TOP_K": '"7"', "FOLIOSCOPE_ENRICHMENT": "off", "FOLIOSCOPE_DISTANCE_THRESHOLD": "0.3"})
    assert (s.top_k, s.enrichment, s.distance_threshold, s.rrf_k) == (7, False, 0.3, 60)


def test_embedder_is_deterministic(spark):
    df = spark.createDataFrame([(1, "a b"), (2, "b a"), (3, None)], "id int, t string").select("id", adapters.embedded(F.col("t"), adapters.HashingEmbedder(8)).alias("v"))
    rows = {r["id"]: r["v"] for r in df.collect()}
    assert rows[1] == rows[2] and len(rows[3]) == 8 and not any(rows[3])

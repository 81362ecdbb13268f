"""Readings, transcripts, remote answers and what is built on them."""

import pytest
from pyspark.sql import functions as F

from folioscope.sources import media


def test_readings_and_transcripts(spark):
    files = spark.createDataFrame([("a", b"hola a todos los presentes"), ("b", b"\xff\xfe"), ("c", None), ("d", b"1 2")], "path string, content binary")
    texts = {r["path"]: r["text"] for r in media.image_texts(files, lambda raw: raw.decode()).collect()}
    assert texts == {"a": "hola a todos los presentes", "b": "", "c": "", "d": "1 2"}
    got = {r["path"]: (r["text"], r["retried"]) for r in media.transcripts(files, lambda raw: raw.decode(), lambda raw: "mejor").collect()}
    assert got == {"a": ("hola a todos los presentes", False), "b": ("mejor", True), "c": ("", True), "d": ("mejor", True)}


def test_remote_answers_try_once_more_with_a_fresh_session():
    opened, calls = [], []

    def call(session, question):
        calls.append(session)
        if session == "s0":
            raise OSError("HTTP 500")
        if question == "bad":
            raise ValueError("no such notebook")
        return question.upper()

    remote = media.RemoteAnswers(call, lambda: opened.append(1) or f"s{len(opened) - 1}")
    assert remote.ask("a") == "A" and calls == ["s0", "s1"] and remote.ask("b") == "B"
    with pytest.raises(ValueError):
        remote.ask("bad")
    assert len(opened) == 2


def test_model_intents_are_null_on_failure(spark):
    rows = spark.createDataFrame([(1, "x" * 900), (2, "fail"), (3, None)], "id int, q string")
    model = lambda t: {"intent": str(len(t)), "confidence": 1 / (0 if t == "fail" else 2)}
    got = {r["id"]: r["m"] for r in rows.select("id", media.model_intents(F.col("q"), model, "intent string, confidence double").alias("m")).collect()}
    assert got[1]["intent"] == "500" and got[2] is None and got[3]["intent"] == "0"


def test_image_answers_and_similarity(spark):
    docs = spark.createDataFrame([(1, "altura minima de la red"), (2, "otra cosa distinta"), (3, "la red")], "doc_id long, text string")
    readings = spark.createDataFrame([(1, "¿Cual es la altura minima de la red?\nA. 3 m"), (2, ""), (3, "zzz yyy xxx www vvv")], "query_id long, text string")
    got = {r["query_id"]: r for r in media.image_answers(readings, docs).collect()}
    assert got[1]["status"] == "ok" and got[1]["evidence"].startswith("1") and got[1]["answer"] == "A"
    assert got[2]["status"] == "no_question" and got[3]["status"] == "no_evidence" and got[3]["answer"] == "?"
    assert media.Similarity(docs).similarity_search("altura minima", 1)[0]["metadata"] == {"doc_id": 1}


def test_files_and_trees(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.txt").write_text("uno\fdos " + "x " * 600)
    assert media.index_file(spark, str(tmp_path / "in" / "a.txt")) == {"file": "a.txt", "chunks": 3}
    (tmp_path / "out").mkdir()
    (tmp_path / "out" / "old.txt").write_text("x")
    assert media.upload_tree(spark, str(tmp_path / "in"), str(tmp_path / "out")) == ["a.txt"] and (tmp_path / "out" / "old.txt").exists()
    media.replace_tree(spark, str(tmp_path / "in"), str(tmp_path / "out"))
    assert (tmp_path / "out" / "a.txt").exists() and not (tmp_path / "out" / "old.txt").exists()


def test_users_and_cells(spark):
    rows = spark.createDataFrame([("7", "una celda larga de verdad"), (None, None), ("8", "incomprensiblemente")], "u string, t string")
    got = rows.select(media.allowed(F.col("u"), ("7", " 9 ")).alias("a"), media.allowed(F.col("u"), ()).alias("n"), media.wrapped_cells(F.col("t"), 10).alias("w")).collect()
    assert [r["a"] for r in got] == [True, False, False] and not any(r["n"] for r in got)
    assert got[0]["w"] == ["una celda", "larga de", "verdad"] and got[1]["w"] == [""] and got[2]["w"] == ["incomprens", "iblemente"]

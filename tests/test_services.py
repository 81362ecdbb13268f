"""History, binaries, index builds, traces, tools and the question service."""

import pytest
from pyspark.sql import functions as F

from folioscope.functions import markup
from folioscope.operators import search, services
from folioscope.operators.lexical_index import LexicalIndex
from folioscope.sources import tables as src


def test_history_keeps_and_drops_sessions(spark, tmp_path):
    path = str(tmp_path / "history")
    rows = [("s1", "u", "user", "hola", None), ("s1", "u", "assistant", "", None), ("s2", "u", "user", "x", None), ("s1", "u", "assistant", "dime", None)]
    services.add_messages(spark.createDataFrame(rows, services.HISTORY), path)
    assert services.delete_session(spark, path, "s1") == 2 and services.delete_session(spark, path, "none") == 0
    left = spark.read.schema(services.HISTORY).parquet(path).collect()
    assert [(r["session_id"], r["content"]) for r in left] == [("s2", "x")] and left[0]["created_at"] is not None


def test_binaries_and_listings(spark, tmp_path):
    (tmp_path / "in" / "assets").mkdir(parents=True)
    (tmp_path / "in" / "a.bin").write_bytes(b"123")
    (tmp_path / "in" / "assets" / "b.bin").write_bytes(b"4567")
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(str(tmp_path / "in"))
    saved = services.save_binaries(files, str(tmp_path / "out"))
    assert sorted(r["name"] for r in saved.collect()) == ["a.bin", "b.bin"] and spark.read.parquet(str(tmp_path / "out")).count() == 2
    assert {r["kind"]: (r["n"], r["bytes"]) for r in services.listed(src.listing(spark, str(tmp_path / "in")), "/in/").collect()} == {"core": (1, 3), "assets": (1, 4)}


def test_registered_files(spark):
    docs = spark.createDataFrame([("a", "a.pdf"), ("b", "b.pdf")], "doc_id string, file string")
    files = spark.createDataFrame([("a.pdf",), ("x.pdf",)], "name string")
    found, missing = services.registered(docs, files)
    assert [r["doc_id"] for r in found.collect()] == ["a"] and [r["doc_id"] for r in missing.collect()] == ["b"]
    with pytest.raises(FileNotFoundError):
        services.registered(docs, files, only="b")


def test_index_is_rebuilt_only_for_another_snapshot(spark, sf, tmp_path):
    docs, path = src.table(spark, sf, "documents"), str(tmp_path / "index")
    first, built = LexicalIndex.current(docs, path)
    again, rebuilt = LexicalIndex.current(docs, path)
    assert built and not rebuilt
    asked = src.table(spark, sf, "benchmark").withColumnRenamed("item_id", "query_id")
    rows = lambda df: sorted(map(tuple, df.select("query_id", "doc_id", "score", "rank").collect()))
    assert rows(search.best(again.scores(asked), 4)) == rows(search.bm25(docs, asked, 4))
    assert LexicalIndex.current(docs.where("doc_id > 0"), path)[1]
    manifest = services.build_index(docs, str(tmp_path), "v1").first()
    assert manifest["n"] == docs.count() and manifest["n_terms"] > 0 and manifest["n_postings"] >= manifest["n_terms"]


def test_service(spark, sf, tmp_path):
    service = services.Service(src.table(spark, sf, "documents"), str(tmp_path / "index"))
    assert service.rebuilt and service.health() == {"status": "ok", "documents": 200} and not service.rebuild()
    text = src.table(spark, sf, "benchmark").first()["text"]
    rows = service.query([text], session=None).collect()
    assert rows and {r["session_id"] for r in rows} == {"api_query"}
    with pytest.raises(ValueError):
        service.query(["  "])


def test_recent_results_and_embedding_once(spark):
    calls = []
    recent = services.Recent(lambda t: calls.append(t) or t.upper(), size=2)
    assert [recent(t) for t in (" a", "A ", "b", "c", "a")] == ["A", "A", "B", "C", "A"] and calls == ["a", "b", "c", "a"] and recent.hits == 1
    rows = spark.createDataFrame([(1, " Hola"), (2, "hola "), (3, None)], "id int, text string")
    got = services.embedded_once(rows, lambda c: F.length(c)).collect()
    assert sorted((r["id"], r["embedding"]) for r in got if r["text"]) == [(1, 4), (2, 4)] and len(got) == 3


def test_traces_and_tools(spark):
    trace, off = services.Trace(), services.Trace(enabled=False)
    with pytest.raises(ZeroDivisionError), trace.span("bad"):
        1 / 0  # noqa: B018
    with trace.span("count"):
        df, seen = trace.observed(spark.range(7), "rows_of_range")
        df.collect()
    assert seen.get == {"rows": 7} and [s["name"] for s in trace.spans] == ["bad", "count"] and trace.spans[0]["error"]
    with off.span("x") as entry:
        assert entry is None and off.observed(spark.range(1), "n")[1] is None and off.spans == []
    safe = services.tool(lambda t: str(10 // len(t)))
    rows = spark.createDataFrame([("ab",), ("",), (None,)], "t string").select(safe(F.col("t")).alias("o")).collect()
    assert rows[0]["o"] == "5" and all(r["o"].startswith("error: ZeroDivisionError") for r in rows[1:])


def test_stage_files_and_tables(spark, sf, tmp_path):
    docs = src.table(spark, sf, "documents").limit(3)
    paths = services.write_stages({"text": docs.select("doc_id", "text")}, str(tmp_path))
    assert spark.read.json(paths["text"]).count() == 3
    assert services.drop_table(spark, "never_there") is False


def test_vectors_that_are_null_or_ragged_are_near_nothing(spark):
    rows = [(1, [1.0, 0.0]), (2, None), (3, [1.0]), (4, [0.9, 0.1]), (5, [None, 1.0])]
    items = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = search.knn(items, items.withColumnRenamed("vec_id", "query_id"), 5).collect()
    assert {(r["query_id"], r["vec_id"]) for r in got} == {(1, 1), (1, 4), (4, 1), (4, 4)}


def test_markup_facts():
    html = markup._html
    assert html("a <b>b</b> <div>c</div> <600V") == "a <b>b</b> c &lt;600V"
    assert html('<pre class="x">a  <i>\n</pre> **d**') == '<pre class="x">a  <i>\n</pre> <b>d</b>'
    assert html("3*4 a_b_c **open") == "3*4 a_b_c **open" and html("**a *b* c**") == "<b>a <i>b</i> c</b>"
    assert markup._plain("<pre>t</pre> &eacute;&lt;") == "```t``` é<" and markup._web("a\nb\n\n\nc") == "<p>a<br>b</p>\n<p>c</p>"
    for text in ("# t\n- a `x` [l](https://u) _e_ <b>", "plain", ""):
        assert "".join(n.source for n in markup.nodes(text)) == text
    spans = markup.message_spans("a" * 30 + "\n\n" + "b" * 30 + "\n\n" + "<pre>" + "c\n" * 20 + "</pre>", 70)
    assert spans == [(0, 62), (64, 115)]

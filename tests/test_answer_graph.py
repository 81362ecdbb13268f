"""Ways through the graph that the benchmark questions don't take."""

from folioscope.operators import answer_graph as graph
from folioscope.operators.answers import NO_EVIDENCE
from folioscope.settings import Settings

ASKED = "query_id long, question string, source_setting string, media string, is_admin boolean, model_intent string, model_confidence double"
HITS = "query_id long, doc_id long, rank int, source string, page long, text string"


def run(spark, questions, hits=(), dense=(), notebook=None, files=None, drafts=None, **settings):
    frame = lambda rows, schema: spark.createDataFrame(list(rows), schema)
    second = lambda rows: None if rows is None else frame(rows, "query_id long, answer string, status string")
    out = graph.answered(
        frame(questions, ASKED), frame(dense, "query_id long, vec_id long, distance double, rank int"), graph.Sources(frame(hits, HITS), second(notebook), second(files)),
        Settings(**settings), None if drafts is None else frame(drafts, "query_id long, draft string, draft_status string"),
    )
    return {r["query_id"]: r for r in out.collect()}


def q(i, text="distancia minima de seguridad", setting="chroma", media=None, admin=False, intent=None, sure=None):
    return (i, text, setting, media, admin, intent, sure)


def test_media_no_evidence_and_other_sources(spark):
    asked = [q(1, media="image"), q(2), q(3, setting="gemini"), q(4, setting="gemini"), q(5, setting="notebooklm"), q(6, "corta", "notebooklm"), q(7, setting="both")]
    got = run(spark, asked, [(7, 1, 1, "a", 1, "uno"), (6, 1, 1, "a", 1, "seis")], notebook=[(5, " n5 ", "ok"), (7, None, "timeout")], files=[(3, "f3", "ok"), (4, "f4", "quota")], drafts=[(1, "leo la imagen", "ok")])
    assert (got[1]["status"], got[1]["answer"], got[1]["exit"]) == ("media_only", "leo la imagen", "enrich")
    assert (got[2]["status"], got[2]["route"], got[2]["exit"], got[2]["answer"]) == ("no_evidence", "no_context", "no_context", NO_EVIDENCE)
    assert (got[3]["files_status"], got[3]["index_status"], got[3]["answer"]) == ("ok", "off", "f3")
    assert (got[4]["files_status"], got[4]["status"]) == ("quota", "no_evidence")
    assert (got[5]["notebook_status"], got[5]["answer"]) == ("ok", "n5")
    # Too short for the second source, which is the only one that was set: the index answers.
    assert (got[6]["notebook_status"], got[6]["index_status"], got[6]["n_hits"]) == ("off", "ok", 1)
    assert (got[7]["notebook_status"], got[7]["index_status"]) == ("timeout", "ok") and "uno" in got[7]["answer"]


def test_top_k_pages_once_and_evidence_turns_a_question(spark):
    hits = [(i, d, d, "s", d % 3 if i == 3 else d, f"texto {d}") for i in (1, 2, 3) for d in range(1, 15)]
    asked = [q(1), q(2, "dame todos los requisitos", admin=True), q(3), q(4, intent="fuera_de_dominio", sure=0.9), q(5, intent="fuera_de_dominio", sure=0.9)]
    got = run(spark, asked, hits, dense=[(4, 9, 0.44, 3), (5, 9, 0.46, 1), (5, 8, 0.1, 4)])
    assert [got[i]["n_hits"] for i in (1, 2, 3)] == [4, 12, 3] and got[2]["exit"] == "suggest"
    assert got[2]["answer"].startswith("[exhaustiva · regex · simple]\n") and got[2]["answer"].endswith("- s, p12")
    assert (got[4]["origin"], got[4]["intent"], got[4]["status"]) == ("model+evidence_guard", "puntual", "no_evidence")
    assert (got[5]["route"], got[5]["exit"], got[5]["status"]) == ("out_of_domain", "stylist", "fixed")
    few = run(spark, asked[:2], hits, top_k=2, top_k_full=5)
    assert [few[i]["n_hits"] for i in (1, 2)] == [2, 5] and run(spark, []) == {}

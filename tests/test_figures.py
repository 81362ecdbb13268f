"""Recursive chunks and the command line."""

import random

from pyspark.sql import functions as F

from folioscope import cli
from folioscope.operators import figures


def test_recursive_chunks_lose_nothing(spark):
    rng = random.Random(5)
    texts = ["".join(rng.choice(["word ", "longerword ", "end. ", "\n", "\n\n", "x" * 30]) for _ in range(rng.randint(0, 200))) for _ in range(30)] + ["y" * 500, "", None]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id int, t string").select("id", figures.recursive_chunks(F.col("t"), 120, 20).alias("c"))
    for r in df.collect():
        text = texts[r["id"]] or ""
        assert all(0 < len(c) <= 120 and c in text for c in r["c"])
        at = 0
        for word in text.split():
            while at < len(r["c"]) and word.strip(".") and word.strip(".")[:120] not in r["c"][at]:
                at += 1
            assert len(word) > 100 or at < len(r["c"]) or not word.strip(".")


def test_command_line(spark, sf, tmp_path, capsys):
    assert cli.main(["list"]) == 0 and "bm25_topk" in capsys.readouterr().out
    out = str(tmp_path / "r")
    assert cli.main(["run", "count_by_state", sf, "--out", out]) == 0 and spark.read.parquet(out).count() == 4
    assert cli.main(["explain", "count_by_state", sf]) == 0 and "Aggregate" in capsys.readouterr().out


def test_command_line_builds_and_publishes(spark, sf, tmp_path, capsys, monkeypatch):
    root, target = str(tmp_path / "build"), str(tmp_path / "store")
    assert cli.main(["profile", sf]) == 0 and "src0" in capsys.readouterr().out
    assert cli.main(["build", sf, root]) == 0 and "chunks=200" in capsys.readouterr().out
    assert cli.main(["build", sf, root]) == 0 and "chunks=0" in capsys.readouterr().out
    # A gate above what can be reached is closed; the settings of the environment are what the build reads.
    monkeypatch.setenv("FOLIOSCOPE_RECALL_GATE", "1.1")
    assert cli.main(["publish", sf, root, target]) == 1 and "closed recall" in capsys.readouterr().out
    assert cli.main(["publish", sf, root, target, "--force", "--version", "v1"]) == 0
    monkeypatch.setenv("FOLIOSCOPE_RECALL_GATE", "0")
    monkeypatch.setenv("FOLIOSCOPE_CHUNK_TOKENS", "100")
    assert cli.main(["all", sf, root, target, "--version", "v2"]) == 0
    out = capsys.readouterr().out
    assert "cleaned=0, chunks=200, counts=200" in out and "v2" in out
    assert cli.main(["versions", target]) == 0 and capsys.readouterr().out.split("\n")[:2] == ["v1", "v2 *"]

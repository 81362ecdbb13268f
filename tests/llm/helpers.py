"""Inputs that every corpus operator has to stand."""

import random

from pyspark.sql import types as T

SCHEMA = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType())])
_WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omikron pi rho sigma tau".split()


def texts(seed=3, n=40):
    rng = random.Random(seed)
    out = [None, "", " ", "\n", "a", "Ünïcode çà 漢字 \U0001f600", "one two three four", "same words " * 60, "x" * 5000, "line one here\nline one here\n\nline two\r\nline one here"]
    for _ in range(n):
        words = [rng.choice(_WORDS) + str(rng.randint(0, 30)) for _ in range(rng.randint(5, 120))]
        text = " ".join(words)
        out.append(text)
        if rng.random() < 0.4:
            at = rng.randrange(len(words))
            out.append(" ".join([*words[:at], "changed", *words[at + 1 :]]))
        if rng.random() < 0.2:
            out.append(text)
    return out


def documents(spark, rows=None, extra=()):
    """A documents table; ``rows``: texts, or (id, text) pairs."""
    rows = texts() if rows is None else rows
    pairs = [r if isinstance(r, tuple) else (i, r) for i, r in enumerate(rows)]
    df = spark.createDataFrame([(i, t, "en", f"src{(i or 0) % 3}" if (i or 0) % 7 else None, len(t or "")) for i, t in pairs], SCHEMA)
    for name in extra:
        df = df.selectExpr("*", f"'clash' AS {name}")
    return df

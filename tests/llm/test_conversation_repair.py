import hashlib
import itertools
import os
import random
import re
import zlib

import duckdb

from folioscope.llm.conversation_repair import ORACLE_SQL, Repair, damaged, op12_conversation_repair, repair_conversations, repaired_turns

SCHEMA = "conv_id long, turn long, role string, text string"
BLANK = re.compile(r"[^\x20\x09-\x0D]")


def faults(rows):
    seen, out = set(), []
    for role, text in rows:
        words = BLANK.findall(text)
        out.append("blank" if not words else "duplicate" if (role, text) in seen else "" if words[-1] in ".!?" else "truncated")
        seen.add((role, text))
    return out


def cheapest(rows):
    """Every sequence of edits with up to two insertions at a place, tried out."""
    kinds, found = faults(rows), []
    added = [(), ("user",), ("assistant",), ("user", "assistant"), ("assistant", "user")]
    for edits in itertools.product(*[("D",) if k in ("blank", "duplicate") else ("K", "D", "user", "assistant") for k in kinds]):
        for more in itertools.product(added, repeat=len(rows) + 1):
            said, audit, cost = [], "", 0
            for i in range(len(rows) + 1):
                said += [(r, "") for r in more[i]]
                audit += "I" * len(more[i])
                cost += 3 * len(more[i])
                if i < len(rows):
                    role, text = rows[i]
                    cost += {"K": 0, "D": 4}.get(edits[i], 3) + 3 * (kinds[i] == "truncated" and edits[i] != "D")
                    audit += edits[i] if edits[i] in "KD" else "R"
                    if edits[i] != "D":
                        said.append((role if edits[i] == "K" else edits[i], text))
            if re.fullmatch("(s?(ua)+)?", "".join(r[:1] or "?" for r, _ in said)):
                found.append((cost, audit, "\n".join(f"{r}:{t}" for r, t in said)))
    return min(found)


def conversations(n, seed, most):
    rng = random.Random(seed)
    roles, texts = ["user", "assistant", "system", "tool", ""], ["a.", "b!", "c", " \t", "", "long one?\n", "d"]
    return [[(rng.choice(roles), rng.choice(texts)) for _ in range(rng.randint(0, most))] for _ in range(n)]


def test_pass_against_every_sequence_of_edits():
    for rows in conversations(60, 5, 3):
        own = Repair()
        for (role, text), kind in zip(rows, faults(rows), strict=True):
            own.turn(role, text, ["", "blank", "duplicate", "truncated"].index(kind))
        cost, audit, said = cheapest(rows)
        got = own.result()
        assert (got["cost"], got["audit"], got["repaired_sha256"]) == (cost, audit, hashlib.sha256(said.encode()).hexdigest()), rows


def test_a_long_conversation_puts_aside_what_is_settled():
    """The audit cut at many places equals the audit that is never cut."""
    rows = [r for part in conversations(90, 8, 9) for r in part]
    cut, whole = Repair(), Repair()
    for i, (role, text) in enumerate(rows):
        for own in (cut, whole):
            own.turns = own.turns if own is cut else 0
            own.turn(role, f"{text}{i}", 3 if i % 5 == 0 else 1 if i % 11 == 0 else 0)
    assert cut.result() == whole.result() and len(cut.result()["audit"]) >= len(rows) and len(cut.states[3][1]) < len(rows) // 2


def test_query_against_sql(spark, tmp_path):
    con = duckdb.connect()
    rows = spark.read.parquet("/root/testdata/sf0.01/conversations.parquet").unionByName(
        spark.createDataFrame(
            [(None, 1, "user", "x."), (None, None, None, None), (-1, None, "user", "a."), (-1, 2, "user", "a."), (-1, 2, "user", "a."), (-1, 9, "assistant", "a."), (-2, 1, "user", "long " * 30_000)]
            + [(-3 - i, t, r, x) for i, c in enumerate(conversations(200, 3, 9)) for t, (r, x) in enumerate(c)],
            SCHEMA,
        )
    )
    rows.selectExpr("*", "'clash' AS audit", "1 AS there", "2 AS mark").coalesce(1).write.parquet(f"{tmp_path}/conversations.parquet")
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM read_parquet('{tmp_path}/conversations.parquet/*.parquet')")
    got = op12_conversation_repair(spark, str(tmp_path))
    expected = con.execute(ORACLE_SQL)
    names = [c[0] for c in expected.description]
    assert sorted(names) == sorted(got.columns)
    assert sorted(map(str, got.select(*names).collect())) == sorted(map(str, spark.createDataFrame(expected.fetchall(), got.select(*names).schema).collect()))
    assert got.count() == rows.select("conv_id").distinct().count()


def test_damage(spark):
    rows = [(c, t, r, "Yes. No! What? ok") for c in range(40) for t, r in enumerate(("user", "assistant", "user"))]
    got = {}
    for r in damaged(spark.createDataFrame(rows, SCHEMA)).collect():
        got.setdefault((r["conv_id"], r["turn"]), []).append((r["role"], r["text"], r["there"]))
    for c, t, role, text in rows:
        kind = zlib.crc32(f"{c}:{t}".encode()) % 20
        one = ("user" if kind == 4 else role, "" if kind == 1 else "Yes No What ok" if kind == 2 else text, None if kind == 0 else True)
        assert got[c, t] == [one] * (2 if kind == 3 else 1)


def test_repaired_turns(spark, sf):
    given = spark.read.parquet(f"{sf}/conversations.parquet").selectExpr("conv_id", "turn", "CASE WHEN (conv_id + turn) % 7 = 0 THEN 'assistant' ELSE role END AS role", "CASE WHEN (conv_id + turn) % 5 = 1 THEN '' ELSE text END AS text")
    given = given.unionByName(spark.createDataFrame([(None, 1, "system", "s."), (None, 2, "assistant", "a."), (777, 1, "user", "")], SCHEMA))
    said = {}
    for r in sorted(repaired_turns(given).collect(), key=lambda r: r["place"]):
        said.setdefault(r["conv_id"], []).append((r["role"], r["text"], r["edit"], r["turn"]))
    for r in repair_conversations(given).collect():
        own = said.get(r["conv_id"], [])
        assert hashlib.sha256("\n".join(f"{a}:{b}" for a, b, _, _ in own).encode()).hexdigest() == r["repaired_sha256"]
        assert [e for _, _, e, _ in own] == [e for e in r["audit"] if e != "D"] and all((t is None) == (e == "I") for _, _, e, t in own)
    assert 777 not in said and [r for r, *_ in said[None]] == ["system", "user", "assistant"]


def test_one_conversation_with_most_rows_and_empty(spark):
    rows = spark.range(3000).selectExpr("CASE WHEN id % 3 = 0 THEN id ELSE 0 END AS conv_id", "id AS turn", "CASE WHEN id % 2 = 0 THEN 'user' ELSE 'assistant' END AS role", "'same words.' AS text")
    hot = next(r for r in repair_conversations(rows).collect() if r["conv_id"] == 0)
    assert hot["duplicate"] == 2001 - 2 and hot["audit"].count("D") == hot["duplicate"] and hot["cost"] == 4 * hot["duplicate"] + (3 if hot["audit"].count("I") else 0)
    empty = repair_conversations(rows.limit(0))
    assert empty.collect() == [] and repaired_turns(rows.limit(0)).collect() == []


def test_not_slow_with_many_open_audits():
    """Roles of no use keep two audits apart from the first turn on."""
    own = Repair()
    for _ in range(3000):
        own.turn("tool", "x.", 0)
    assert own.result()["cost"] == 9000 and set(own.result()["audit"]) == {"R"}
    assert os.path.commonprefix([s[1] for s in own.states if s]) == ""

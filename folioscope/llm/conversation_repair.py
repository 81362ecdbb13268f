"""Operator 12: repairing the structure of conversations with the fewest edits.

A conversation is well formed if the initials of its roles read ``(s?(ua)+)?``.  A forward Viterbi pass over
the four states of that grammar (nothing yet, after s, after u, after a) carries, for each state, the least
(cost, audit) and the digest of the turns repaired so far.  Each turn is kept (0), given the role user or
assistant (3) or deleted (4); a blank turn or one that repeats an earlier one has to go, and a truncated one
that stays costs 3 more.  After each turn the layer is closed by at most two inserted empty turns (3 each),
since a third would lead back to where one leads.  The audit has the initials of the edits; two audits of one
cost never have one as the beginning of the other, so the least of a state is all that has to be carried.

Spark sorts the turns of each conversation, and a task reads them as a stream: memory holds four states and the
audits as far as they differ, not the conversation, so one conversation may hold any share of the rows.  Its
digest is a hash of its turns in order and so is one task's work.  Repeats are found by counting and joining
keys, which Spark combines before the shuffle and can split, and enter the stream as marks.

Defined results: null role and text are one space each; a turn without a role can't be kept as it is; turns without a number come first; turns of one number
come in the order of role and of the text's digest; a null conversation id is a conversation; repeated rows are
repeats of a turn; an empty table gives an empty table; a very long text is only hashed, in whole; only the
columns named are read, so others cannot clash.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from os.path import commonprefix

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from folioscope.llm._common import checkpoint, table
from folioscope.llm._kernels import slices

RETYPE, DELETE, INSERT, CUT = 3, 4, 3, 3
BLANKS = " \t\n\x0b\x0c\r"
FINE, BLANK, DUPLICATE, TRUNCATED = range(4)
START, SYSTEM, USER, ASSISTANT = range(4)
#: The state that a role initial leads to, by state.
NEXT = ({"s": SYSTEM, "u": USER}, {"u": USER}, {"a": ASSISTANT}, {"u": USER})
NAMES = {USER: "user", ASSISTANT: "assistant"}
LEGAL = {"su", "ua", "au"}
#: Turns after which what all audits begin with is put aside.
TRIM = 64


class Repair:
    """The pass over one conversation, turn by turn."""

    def __init__(self) -> None:
        self.counts = [0, 0, 0, 0]
        self.illegal = self.turns = 0
        self.before: str | None = None
        self.low = self.high = None
        self.distinct = 0
        self.done: list[str] = []
        #: (cost, audit, digest, whether it opens with a system turn) by state.
        self.states: list[tuple | None] = self._closed([(0, "", hashlib.sha256(), False), None, None, None])

    @staticmethod
    def _said(digest, state: int, role: str, text: str):
        out = digest.copy()
        out.update(f"{'' if state == START else chr(10)}{role}:{text}".encode())
        return out

    def _closed(self, states: list[tuple | None]) -> list[tuple | None]:
        for _ in range(2):
            for state, own in enumerate(list(states)):
                if own is not None:
                    to = ASSISTANT if state == USER else USER
                    cost, audit = own[0] + INSERT, own[1] + "I"
                    if states[to] is None or (cost, audit) < states[to][:2]:
                        states[to] = (cost, audit, self._said(own[2], state, NAMES[to], ""), own[3])
        return states

    def number(self, turn: int | None) -> None:
        if turn is not None and turn != self.high:
            self.low = turn if self.low is None else self.low
            self.high = turn
            self.distinct += 1

    def turn(self, role: str, text: str, fault: int) -> None:
        initial = role[:1]
        self.illegal += self.before is not None and self.before + initial not in LEGAL
        self.before = initial
        self.counts[fault] += 1
        more = CUT if fault == TRUNCATED else 0
        best: list[tuple | None] = [None] * 4

        def offer(to: int, cost: int, audit: str, state: int, said: str | None) -> None:
            if best[to] is None or (cost, audit) < best[to][:2]:
                best[to] = (cost, audit, state, said)

        for state, own in enumerate(self.states):
            if own is None:
                continue
            cost, audit = own[0], own[1]
            offer(state, cost + DELETE, audit + "D", state, None)
            if fault not in (BLANK, DUPLICATE):
                if (to := NEXT[state].get(initial)) is not None:
                    offer(to, cost + more, audit + "K", state, role)
                to = ASSISTANT if state == USER else USER
                offer(to, cost + RETYPE + more, audit + "R", state, NAMES[to])
        made: list[tuple | None] = [None] * 4
        for to, found in enumerate(best):
            if found is not None:
                cost, audit, state, said = found
                own = self.states[state]
                made[to] = (cost, audit, own[2] if said is None else self._said(own[2], state, said, text), own[3] or to == SYSTEM)
        self.states = self._closed(made)
        self.turns += 1
        if self.turns % TRIM == 0:
            start, system, _, end = self.states
            # After an answer all can be said that is open at the start (one deletion more) or after a system turn.
            if end and start and start[0] > end[0] + DELETE:
                self.states[START] = None
            if end and system and system[0] > end[0]:
                self.states[SYSTEM] = None
            shared = commonprefix([s[1] for s in self.states if s is not None])
            self.done.append(shared)
            self.states = [s and (s[0], s[1][len(shared) :], *s[2:]) for s in self.states]

    def result(self) -> dict:
        cost, audit, digest, system = min((s for s in (self.states[START], self.states[ASSISTANT]) if s is not None), key=lambda s: s[:2])
        gaps = self.high - self.low + 1 - self.distinct if self.distinct else 0
        return {"gaps": gaps, "blank": self.counts[BLANK], "duplicate": self.counts[DUPLICATE], "truncated": self.counts[TRUNCATED], "illegal": self.illegal, "cost": cost, "audit": "".join(self.done) + audit, "repaired_sha256": digest.hexdigest(), "opens": system}


RESULT = T.StructType(
    [T.StructField(n, T.LongType()) for n in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    + [T.StructField("audit", T.StringType()), T.StructField("repaired_sha256", T.StringType()), T.StructField("opens", T.BooleanType())]
)


def _walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted turns and marks of many conversations in, one row for each conversation out."""
    schema, names, own, last, marked, key = None, [f.name for f in RESULT], None, None, None, None
    out: list[tuple] = []

    def packed() -> pa.RecordBatch:
        columns = [pa.array([c for c, _ in out], schema.field("conv").type), *(pa.array([r[n] for _, r in out]) for n in names)]
        return pa.RecordBatch.from_arrays(columns, names=["conv", *names])

    for batch in batches:
        schema = batch.schema
        for part in slices(batch, "text"):
            for conv, turn, role, digest, mark, text, flaw in zip(*(c.to_pylist() for c in part.columns), strict=True):
                if own is None or conv != last:
                    if own is not None:
                        out.append((last, own.result()))
                        if len(out) >= 2000:
                            yield packed()
                            out = []
                    own, last, marked, key = Repair(), conv, None, None
                here = (turn, role, digest)
                if mark == 0:
                    marked = here
                elif flaw is not None:
                    own.number(turn)
                    # The same turn again stands just before; the same words of another turn have left a mark.
                    again = here in (key, marked)
                    own.turn(role, text, BLANK if flaw == BLANK else DUPLICATE if again else flaw)
                    key = here
    if own is not None:
        out.append((last, own.result()))
        yield packed()


def _turns(conversations: DataFrame, there: Column, conv: Column, turn: Column, role: Column, text: Column) -> DataFrame:
    """The columns of the stream; ``flaw`` is null where a conversation has no turn."""
    last = F.substring(F.rtrim(text, F.lit(BLANKS)), -1, 1)
    flaw = F.when(last == "", BLANK).when(~last.isin(*".!?"), TRUNCATED).otherwise(FINE)
    return conversations.select(conv.alias("conv"), turn.alias("turn"), role.alias("role"), F.unhex(F.sha2(text, 256)).alias("digest"), F.lit(1).alias("mark"), text.alias("text"), F.when(there, flaw).alias("flaw"))


def _results(turns: DataFrame) -> DataFrame:
    key = ["conv", "role", "digest"]
    slim = turns.where(F.col("flaw").isNotNull()).select(*key, "turn")
    first = slim.groupBy(*key).agg(F.count("*").alias("n"), F.min(F.struct("turn")).alias("first")).where("n > 1")
    same = F.col("s.conv").eqNullSafe(F.col("f.conv")) & (F.col("s.role") == F.col("f.role")) & (F.col("s.digest") == F.col("f.digest"))
    later = slim.alias("s").join(first.alias("f"), same).where(F.struct(F.col("s.turn").alias("turn")) > F.col("f.first")).select("s.*").distinct()
    marks = later.select("conv", "turn", "role", "digest", F.lit(0).alias("mark"), F.lit("").alias("text"), F.lit(None).cast("int").alias("flaw"))
    schema = T.StructType([T.StructField("conv", turns.schema["conv"].dataType), *RESULT.fields])
    return turns.unionByName(marks).repartition("conv").sortWithinPartitions("conv", "turn", "role", "digest", "mark").mapInArrow(_walk, schema)


def _plain(name: str) -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(" "))


def repair_conversations(conversations: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """One row for each conversation: faults, least cost, audit of the edits and digest of the repaired turns."""
    turns = _turns(conversations, F.lit(True), F.col(conv_col), F.col(turn_col).cast("long"), _plain(role_col), _plain(text_col))
    return _results(turns).withColumnRenamed("conv", conv_col)


def repaired_turns(conversations: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """The turns of the repaired conversations: conv_id, place, edit (K, R or I), turn (null if inserted), role and text."""
    turns = _turns(conversations, F.lit(True), F.col(conv_col), F.col(turn_col).cast("long"), _plain(role_col), _plain(text_col))
    by_conv = W.partitionBy("conv")
    numbered = turns.withColumn("n", F.row_number().over(by_conv.orderBy("turn", "role", "digest"))).select("conv", "n", "turn", "role", "text")
    edits = checkpoint(_results(turns).select("conv", "opens", "audit")).select("conv", "opens", F.posexplode(F.split("audit", "")).alias("at", "edit")).where("edit != ''")
    so_far = lambda letter: F.sum((F.col("edit") != letter).cast("int")).over(by_conv.orderBy("at"))
    edits = edits.select("*", F.when(F.col("edit") != "I", so_far("I")).alias("n"), so_far("D").alias("place")).where("edit != 'D'")
    user = F.pmod(F.col("place") - F.col("opens").cast("int"), F.lit(2)) == 1
    found = edits.alias("e").join(numbered.alias("t"), F.col("e.conv").eqNullSafe(F.col("t.conv")) & (F.col("e.n") == F.col("t.n")), "left")
    role = F.when(F.col("edit") == "K", F.col("role")).when(user, "user").otherwise("assistant")
    return found.select(F.col("e.conv").alias(conv_col), "place", "edit", "turn", role.alias("role"), F.coalesce("text", F.lit("")).alias("text"))


def damaged(conversations: DataFrame) -> DataFrame:
    """Rows with planted faults, by a checksum of conversation and turn; a dropped row stays with ``there`` null."""
    kind = F.pmod(F.crc32(F.concat(_plain("conv_id"), F.lit(":"), _plain("turn"))), F.lit(20))
    role, text = _plain("role"), _plain("text")
    return conversations.select(
        "conv_id",
        "turn",
        F.when(kind == 4, "user").otherwise(role).alias("role"),
        F.when(kind == 1, "").when(kind == 2, F.translate(text, ".!?", "")).otherwise(text).alias("text"),
        F.explode_outer(F.array_repeat(F.lit(True), F.when(kind == 0, 0).when(kind == 3, 2).otherwise(1))).alias("there"),
    )


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = damaged(table(spark, sf_dir, "conversations"))
    turns = _turns(rows, F.col("there").isNotNull(), F.col("conv_id"), F.col("turn"), F.col("role"), F.col("text"))
    return _results(turns).withColumnRenamed("conv", "conv_id").drop("opens")


def sql_crc32(value: str) -> str:
    """DuckDB: the unsigned CRC-32 of a string's UTF-8 bytes."""
    codes = f"list_transform(range(octet_length(encode({value}))), lambda i: ('0x' || substr(hex(encode({value})), 2 * i::BIGINT + 1, 2))::BIGINT)"
    eight = "list_reduce(list_concat([xor(c, b)], [0::BIGINT, 0, 0, 0, 0, 0, 0, 0]), lambda x, z: xor(x >> 1, 3988292384 * (x & 1)))"
    return f"xor(list_reduce(list_concat([4294967295::BIGINT], {codes}), lambda c, b: {eight}), 4294967295)"


def _best(states: str) -> str:
    """DuckDB: of a list of (state, cost, audit, text), the least of each state."""
    return "list_filter([" + ", ".join(f"list_sort(list_filter({states}, lambda x: x.st = {i}))[1]" for i in range(4)) + "], lambda x: x IS NOT NULL)"


_LEAD = "p.t || CASE WHEN p.st = 0 THEN '' ELSE chr(10) END"
_TO, _TO_NAME = "CASE WHEN p.st = 2 THEN 3 ELSE 2 END", "CASE WHEN p.st = 2 THEN 'assistant' ELSE 'user' END"
_INSERTED = f"list_transform({{0}}, lambda p: {{{{'st': {_TO}, 'c': p.c + 3, 'e': p.e || 'I', 't': {_LEAD} || {_TO_NAME} || ':'}}}})"
_KEPT = "CASE WHEN p.st = 0 AND left(r.role, 1) = 's' THEN 1 WHEN p.st != 2 AND left(r.role, 1) = 'u' THEN 2 WHEN p.st = 2 AND left(r.role, 1) = 'a' THEN 3 END"
_STEP = f"""list_concat(
  list_transform(w.layer, lambda p: {{'st': p.st, 'c': p.c + 4, 'e': p.e || 'D', 't': p.t}}),
  list_filter(list_transform(w.layer, lambda p: {{'st': CASE WHEN NOT r.gone THEN {_KEPT} END, 'c': p.c + r.more, 'e': p.e || 'K', 't': {_LEAD} || r.role || ':' || r.text}}), lambda x: x.st IS NOT NULL),
  list_filter(list_transform(w.layer, lambda p: {{'st': CASE WHEN NOT r.gone THEN {_TO} END, 'c': p.c + 3 + r.more, 'e': p.e || 'R', 't': {_LEAD} || {_TO_NAME} || ':' || r.text}}), lambda x: x.st IS NOT NULL))"""

ORACLE_SQL = f"""
WITH RECURSIVE
given AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, {sql_crc32("coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ')")} % 20 AS kind FROM conversations),
hurt AS (
  SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
         CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
  FROM (SELECT *, unnest(range(CASE kind WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)) FROM given)),
placed AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(text)) AS n FROM hurt),
judged AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY n) > 1 AS again, lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY n) || left(role, 1) AS pair,
         right(regexp_replace(text, '[\\x20\\x09-\\x0D]+$', ''), 1) AS final FROM placed),
rows AS (SELECT *, final = '' OR again AS gone, CASE WHEN final NOT IN ('.', '!', '?') THEN 3 ELSE 0 END AS more FROM judged),
counted AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0)::BIGINT AS gaps, count(*) FILTER (final = '')::BIGINT AS blank, count(*) FILTER (final != '' AND again)::BIGINT AS duplicate,
         count(*) FILTER (NOT gone AND more > 0)::BIGINT AS truncated, count(*) FILTER (pair NOT IN ('su', 'ua', 'au'))::BIGINT AS illegal
  FROM rows GROUP BY conv_id),
walk AS (
  SELECT DISTINCT conv_id, 0::BIGINT AS n, [{{'st': 0, 'c': 0, 'e': '', 't': ''}}, {{'st': 2, 'c': 3, 'e': 'I', 't': 'user:'}}, {{'st': 3, 'c': 6, 'e': 'II', 't': 'user:' || chr(10) || 'assistant:'}}] AS layer FROM conversations
  UNION ALL
  SELECT conv_id, n, {_best("layer")} FROM (
    SELECT conv_id, n, list_concat(layer, {_INSERTED.format("layer")}) AS layer FROM (
      SELECT conv_id, n, {_best("layer")} AS layer FROM (
        SELECT conv_id, n, list_concat(layer, {_INSERTED.format("layer")}) AS layer FROM (
          SELECT conv_id, n, {_best("layer")} AS layer FROM (
            SELECT w.conv_id, r.n, {_STEP} AS layer FROM walk w JOIN rows r ON w.conv_id IS NOT DISTINCT FROM r.conv_id AND r.n = w.n + 1)))))),
last AS (SELECT conv_id, list_sort(list_transform(list_filter(layer, lambda x: x.st IN (0, 3)), lambda x: {{'c': x.c, 'e': x.e, 't': x.t}}))[1] AS won FROM walk QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY n DESC) = 1)
SELECT l.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate, coalesce(truncated, 0)::BIGINT AS truncated,
       coalesce(illegal, 0)::BIGINT AS illegal, won.c::BIGINT AS cost, won.e AS audit, sha256(won.t) AS repaired_sha256
FROM last l LEFT JOIN counted c ON l.conv_id IS NOT DISTINCT FROM c.conv_id
"""

"""Operator 3: language-model scoring with a probabilistic suffix tree over tokens.

A text is its words, A-Z lower-cased, and one end; the end also stands before the first word.  The tree
holds contexts of up to ``DEPTH`` tokens.  A string of tokens is in the tree's tables if it is counted
``LOWEST`` times or more, so they grow with the corpus.  A follower of a context stays if its
probability there diverges from the one under the context's suffix by ``GAIN`` nats over its
occurrences.  The mass that a context's followers leave goes to the
distribution of its suffix; the root is the add-one distribution of all training tokens.  A token is
scored by the longest suffix of what precedes it that is in the tree.

Counts cover all training rows, those with crc32(doc_id as text) mod 7 not 2.  No part of the tree is
collected or broadcast.  A task parts its texts into chunks, each of them kept as its tokens: their hashes,
and for each place the number of its token, the most frequent first, so that it takes a byte or two.
A chunk sends its distinct strings of k tokens
with their counts to the parts that own them and gets the totals back.  It sends a string of k + 1 tokens
only if both of its strings of k are frequent, which holds for every frequent one.  One of the chunks that
sent a string is told to account for it; so each follower that stays is added once to the mass that its
context has used, which is summed and sent back in the same way.  With counts and masses a chunk has the
probabilities of its own tokens.  Answers are packed: a bit for each string asked for, and a number only
for those that are frequent or have a mass.  Tokens are known by 64-bit hashes.

Defined results: a null text is empty and has only its end; a null id counts as held out; repeated rows
give repeated results, as do rows that share an id; a very long text is a chunk of its own; ties do not arise; without training rows every token has log10 probability 0 at the root; an
empty table gives an empty table; only the id and text columns are read, so other columns cannot clash.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from folioscope.llm._common import checkpoint, conf_int, id_field, table
from folioscope.llm._kernels import mix, slices, text_bytes, word_hashes

DEPTH, GAIN, DISCOUNT, ESCAPE = 3, 6.0, 0.75, 0.02
LOWEST = 2
CHUNK_BYTES, OWNER_BYTES = 4 << 20, 8 << 20
END = np.uint64(0x5851F42D4C957F2D)
_A, _B = np.uint64(0xD1342543DE82EF95), np.uint64(0x2545F4914F6CDD1D)


def tokens_of(column) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct tokens' hashes, ascending, the token of each place of (end, words, end) of every row, and the row offsets."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    # ASCII white space is what parts words; what is left of it at the edges are empty strings.
    parts = pc.ascii_split_whitespace(pc.ascii_lower(column.fill_null("")))
    words = parts.flatten()
    row = np.repeat(np.arange(len(column)), pc.list_value_length(parts).to_numpy())
    full = pc.greater(pc.binary_length(words), 0)
    row, coded = row[full.to_numpy(zero_copy_only=False)], words.filter(full).dictionary_encode()
    data, offsets = text_bytes(coded.dictionary)
    hashes = np.append(word_hashes(data, np.ones(len(data), dtype=bool), offsets[:-1], offsets[1:], lower=False), END)
    one, rank = np.unique(hashes, return_inverse=True)
    edge = np.concatenate([[0], np.cumsum(np.bincount(row, minlength=len(column)) + 2)])
    out = np.full(edge[-1], rank[-1], dtype=np.int32)
    out[np.arange(len(row)) + 2 * row + 1] = rank[coded.indices.to_numpy()]
    return one, out, edge


def distinct(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A stable order of the hashes, and where a new one begins in it.

    The place goes into the low bits, so that numbers are sorted and not indices; if two hashes differ in
    these bits alone, they are sorted the plain way.
    """
    n = len(hashes)
    low = np.uint64((1 << max(1, n.bit_length())) - 1)
    key = (hashes & ~low) | np.arange(n, dtype=np.uint64)
    key.sort()
    order = (key & low).astype(np.int64)
    ranked = hashes[order]
    new = np.ones(n, dtype=bool)
    new[1:] = ranked[1:] != ranked[:-1]
    top = key & ~low
    if (new[1:] & (top[1:] == top[:-1])).any():
        order = np.argsort(hashes, kind="stable")
        ranked = hashes[order]
        new[1:] = ranked[1:] != ranked[:-1]
    return order, new


def join(prefix: np.ndarray, suffix: np.ndarray) -> np.ndarray:
    """The hash of a string of k + 1 tokens from those of its first and its last k."""
    return mix(prefix * _A + suffix * _B)


def _part(x: np.ndarray, parts: int) -> np.ndarray:
    return ((x >> np.uint64(33)) * np.uint64(parts) >> np.uint64(31)).astype(np.int64)


_MASS = 10  # kind of the masses at depth 0; kinds below are the numbers of tokens of counted strings


def packed_hashes(hashes: np.ndarray) -> bytes:
    """Ascending hashes as six bytes of each step; the two bytes above of the few larger steps follow."""
    steps = np.diff(hashes, prepend=np.uint64(0))
    large = np.flatnonzero(steps >> np.uint64(48)).astype("<u4")
    low = steps.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6]
    return np.array([len(hashes), len(large)], dtype="<u4").tobytes() + low.tobytes() + large.tobytes() + (steps[large] >> np.uint64(48)).astype("<u2").tobytes()


def unpacked_hashes(raw: bytes) -> np.ndarray:
    n, m = np.frombuffer(raw, "<u4", 2).tolist()
    steps = np.zeros((n, 8), dtype=np.uint8)
    steps[:, :6] = np.frombuffer(raw, np.uint8, 6 * n, 8).reshape(n, 6)
    steps = steps.view("<u8").ravel()
    steps[np.frombuffer(raw, "<u4", m, 8 + 6 * n)] += np.frombuffer(raw, "<u2", m, 8 + 6 * n + 4 * m).astype(np.uint64) << np.uint64(48)
    return np.cumsum(steps, dtype=np.uint64)


def packed_places(which: np.ndarray, uses: np.ndarray) -> bytes:
    """The number of each place's token among all by falling use, one byte of all numbers after the other; compressed."""
    number = np.empty(len(uses), dtype="<u4")
    number[np.argsort(-uses, kind="stable")] = np.arange(len(uses), dtype="<u4")
    return pa.compress(np.ascontiguousarray(number[which].view(np.uint8).reshape(-1, 4).T).tobytes(), codec="zstd", asbytes=True)


def unpacked_places(raw: bytes, uses: np.ndarray) -> np.ndarray:
    planes = pa.decompress(raw, decompressed_size=4 * int(uses.sum()), codec="zstd", asbytes=True)
    number = np.ascontiguousarray(np.frombuffer(planes, np.uint8).reshape(4, -1).T).view("<u4").ravel()
    return np.argsort(-uses, kind="stable").astype(np.int32)[number]


def packed(values: np.ndarray, own: np.ndarray, kind: int) -> bytes:
    """Answers in the order of the strings asked for: bits, then the numbers of those that have one, and whether the asker accounts for them; compressed."""
    have = values > 0 if kind == 1 or kind > _MASS else values >= LOWEST
    if kind > _MASS:  # what a context's followers leave, or minus what they use if that is too much
        left = np.where(values > 1 - ESCAPE, -values, 1 - values)
        return zlib.compress(np.uint32(len(values)).tobytes() + b"m" + np.packbits(have).tobytes() + left[have].astype("<f4").tobytes(), 1)
    wide = bool(len(values)) and values.max() >= 1 << 32
    numbers = values[have].astype("<u8" if wide else "<u4")
    numbers = numbers.view(np.uint8).reshape(-1, numbers.itemsize).T.tobytes()  # the highest bytes, mostly zeros, together
    return zlib.compress(np.uint32(len(values)).tobytes() + (b"w" if wide else b"n") + np.packbits(have).tobytes() + numbers + np.packbits(own[have]).tobytes(), 1)


def unpacked(raw: list[bytes], kind: int) -> tuple[np.ndarray, np.ndarray]:
    """(values, whether the asker accounts for them); for masses what is left of 1, or minus what is used."""
    values, owns = [np.zeros(0, "<f8" if kind > _MASS else np.int64)], [np.zeros(0, dtype=bool)]
    nothing = 1 if kind > _MASS else 0
    for x in map(zlib.decompress, raw):
        n = int(np.frombuffer(x, "<u4", 1)[0])
        at = 5 + (n + 7) // 8
        have = np.unpackbits(np.frombuffer(x, np.uint8, at - 5, 5), count=n).astype(bool)
        kept = int(have.sum())
        form = {b"m": "<f4", b"w": "<u8", b"n": "<u4"}[x[4:5]]
        value, own = np.full(n, nothing, dtype=values[0].dtype), np.zeros(n, dtype=bool)
        width = np.dtype(form).itemsize
        value[have] = np.frombuffer(x, form, kept, at) if kind > _MASS else np.ascontiguousarray(np.frombuffer(x, np.uint8, kept * width, at).reshape(width, kept).T).view(form).ravel()
        if kind <= _MASS:
            own[have] = np.unpackbits(np.frombuffer(x, np.uint8, offset=at + kept * width), count=kept).astype(bool)
        values.append(value)
        owns.append(own)
    return np.concatenate(values), np.concatenate(owns)


def tokenized(chunk: int, t: pa.Table, ids: pa.DataType) -> pa.RecordBatch:
    """The row that keeps a chunk of (id, text, held_out) rows as its tokens."""
    one, which, edge = tokens_of(t.column("text"))
    uses = np.bincount(which, minlength=len(one)).astype("<i4")
    listed = lambda c, kind: pa.ListArray.from_arrays(pa.array([0, t.num_rows], pa.int32()), t.column(c).combine_chunks().cast(kind))
    return pa.RecordBatch.from_arrays([pa.array([chunk], pa.int64()), listed("doc_id", ids), listed("held_out", pa.bool_()), *(pa.array([x], pa.binary()) for x in (edge.astype("<i8").tobytes(), packed_hashes(one), pa.compress(uses.tobytes(), codec="zstd", asbytes=True), packed_places(which, uses)))], names=["chunk", "ids", "held", "edge", "hashes", "uses", "places"])


class Chunk:
    """A chunk's strings of tokens, with what the answers so far say about them."""

    def __init__(self, t: pa.Table, answers: pa.Table | None = None):
        raw = lambda c: t.column(c)[0].as_py()
        self.edge, self.one = np.frombuffer(raw("edge"), "<i8"), unpacked_hashes(raw("hashes"))
        self.rows = len(self.edge) - 1
        uses = np.frombuffer(pa.decompress(raw("uses"), decompressed_size=4 * len(self.one), codec="zstd", asbytes=True), "<i4")
        self.which = unpacked_places(raw("places"), uses)
        self.ids, self.held = (t.column(c)[0].values for c in ("ids", "held"))
        self.at = np.arange(len(self.which))
        self.gram = self.one[self.which]
        self.place = self.at - np.repeat(self.edge[:-1], np.diff(self.edge))
        self.train = np.repeat(~self.held.to_numpy(zero_copy_only=False), np.diff(self.edge)) & (self.place > 0)
        self.answers = {}
        if answers is not None:
            order = answers.sort_by([("kind", "ascending"), ("part", "ascending")])
            kinds, packs = order.column("kind").to_numpy(), order.column("answers").to_pylist()
            self.answers = {int(k): unpacked([packs[i] for i in np.flatnonzero(kinds == k)], int(k)) for k in np.unique(kinds)}
        self.count, self.total = np.zeros(0), np.zeros(0)

    def longer(self, k: int) -> None:
        """From strings of k - 1 tokens to those of k: the places where one that may be frequent ends, its distinct hashes, and which of these each place has."""
        often = self.count >= LOWEST
        ok = np.zeros(len(often), dtype=bool)
        ok[1:] = often[1:] & often[:-1] & (self.place[1:] >= k - 1)
        self.at = np.flatnonzero(ok)
        strings = join(self.gram[self.at - 1], self.gram[self.at])
        order, new = distinct(strings)
        self.one = strings[order[new]]
        self.which = np.empty(len(order), dtype=np.int32)
        self.which[order] = np.cumsum(new) - 1
        self.gram = np.zeros_like(self.gram)
        self.gram[self.at] = strings

    def counts(self) -> np.ndarray:
        return np.bincount(self.which, self.train[self.at].astype(float), minlength=len(self.one)).astype("<i4")

    def take_counts(self, k: int) -> np.ndarray:
        """Sets the count of the string that ends at each place; which distinct strings this chunk accounts for."""
        got, own = self.answers.get(k) or unpacked([], k)
        self.total, self.count = self.count, np.zeros(len(self.gram), dtype=np.int64)
        self.count[self.at] = got[self.which]
        return own

    def run(self, rounds: int, tokens: int, distinct: int):
        """What the chunk asks after ``rounds`` rounds, as (kind, hashes, values); without anything left to ask, the root's and the tree's probabilities."""
        if not rounds:
            return [(1, self.one, self.counts())]
        self.take_counts(1)
        root = value = (self.count + 1.0) / (tokens + distinct + 1)
        for depth in range(1, DEPTH + 1):
            strings = np.full(len(self.gram), -1, dtype=np.int32)  # of ``depth`` tokens, by place
            strings[self.at] = self.which
            named = self.one
            self.longer(depth + 1)
            if rounds == depth:
                asked = [(depth + 1, self.one, self.counts())]
                return asked + ([(_MASS + depth - 1, *mass)] if depth > 1 else [])
            own = self.take_counts(depth + 1)
            # Contexts: frequent strings of ``depth`` tokens with a token after them.
            at = np.flatnonzero((self.place >= depth) & (np.concatenate([[0], self.total[:-1]]) >= LOWEST))
            used = np.zeros(len(named), dtype=bool)
            used[strings[at - 1]] = True
            context, which = named[used], (np.cumsum(used) - 1)[strings[at - 1]]
            count, total = self.count[at], np.concatenate([[0], self.total[:-1]])[at]
            often = np.flatnonzero(count >= LOWEST)
            times = count[often].astype(float)
            most = np.maximum(total[often], times)
            keep = times * np.log(np.maximum(times / most / value[at[often]], 1e-300)) >= GAIN
            share = np.zeros(len(at))
            share[often[keep]] = (1 - ESCAPE) * (times[keep] - DISCOUNT) / most[keep]
            if rounds == depth + 1:
                first = np.zeros(len(self.one), dtype=np.int64)
                first[self.which[::-1]] = self.at[::-1]
                mine = np.zeros(len(self.gram), dtype=bool)
                mine[first[own]] = True
                mine = mine[at]
                mass = (context, np.bincount(which[mine], share[mine], minlength=len(context)).astype("<f4"))
                if depth == DEPTH:
                    return [(_MASS + depth, *mass)]
                continue
            left = (self.answers.get(_MASS + depth) or unpacked([], _MASS + depth))[0]
            scale = np.where(left < 0, (1 - ESCAPE) / np.maximum(-left, 1e-300), 1.0)  # counts of a context at text ends
            rest = np.where(left < 0, ESCAPE, left)
            value = value.copy()
            value[at] = share * scale[which] + rest[which] * value[at]
        return root, value


_ASKED = "chunk long, kind int, part int, hashes binary, values binary"
_ANSWERS = "chunk long, kind int, part int, answers binary, tokens long, distinct long"


def answer(batches):
    """Totals of the values that chunks sent for the same hash, to each chunk in the order of its hashes."""
    asked: dict[int, list[tuple]] = {}
    for b in batches:
        for kind, *row in zip(b.column(1).to_pylist(), b.column(0).to_pylist(), *(b.column(c).to_pylist() for c in (2, 3, 4)), strict=True):
            asked.setdefault(kind, []).append(row)
    for kind in sorted(asked):
        rows = sorted(asked.pop(kind), key=lambda r: r[:2])
        chunk, part = (np.array([r[c] for r in rows], dtype=kept) for c, kept in ((0, np.int64), (1, np.int32)))
        hashes = [unpacked_hashes(r[2]) for r in rows]
        values = np.concatenate([np.frombuffer(r[3], "<f4" if kind > _MASS else "<i4") for r in rows])
        del rows
        edge = np.concatenate([[0], np.cumsum([len(h) for h in hashes])])
        order, new = distinct(np.concatenate(hashes))
        del hashes
        first = np.flatnonzero(new)
        total = np.add.reduceat(values[order].astype("<f8" if kind > _MASS else np.int64), first) if len(first) else values[:0].astype(np.int64)
        got, own = np.empty(len(order), dtype=total.dtype), np.zeros(len(order), dtype=bool)
        got[order] = np.repeat(total, np.diff(np.append(first, len(order))))
        own[order[first]] = True
        n = len(edge) - 1
        sums = [np.zeros(n, dtype=np.int64) for _ in range(2)]
        if kind == 1:
            sums[0][0], sums[1][0] = int(total.sum()), int((total > 0).sum())
        for i in range(0, n, 256):
            s = range(i, min(i + 256, n))
            yield pa.RecordBatch.from_arrays([pa.array(chunk[s.start : s.stop]), pa.array(np.full(len(s), kind, np.int32)), pa.array(part[s.start : s.stop]), pa.array([packed(got[edge[j] : edge[j + 1]], own[edge[j] : edge[j + 1]], kind) for j in s], pa.binary()), *(pa.array(x[s.start : s.stop]) for x in sums)], names=["chunk", "kind", "part", "answers", "tokens", "distinct"])


def score_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", hold: int = 2, folds: int = 7) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of every whole text."""
    spark = docs.sparkSession
    shuffled = conf_int(spark, "spark.sql.shuffle.partitions", 200)
    fold = F.pmod(F.crc32(F.col(id_col).cast("string")), F.lit(folds))
    docs = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"), F.coalesce(fold == hold, F.lit(True)).alias("held_out"))
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    # Chunks and the parts that own strings follow the text; with little of it there are no more than it fills.
    chunks = max(math.ceil(size / CHUNK_BYTES), min(4 * shuffled, math.ceil(size / (1 << 18))), 1)
    parts = max(math.ceil(size / OWNER_BYTES), min(shuffled, math.ceil(size / (1 << 20))), 1)
    budget = max(math.ceil(size / chunks), 1)
    id_type = to_arrow_type(docs.schema["doc_id"].dataType)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A task's texts in chunks of about ``budget`` bytes; a longer text is one of its own."""
        held, full, number = [], 0, TaskContext.get().partitionId() << 32
        for batch in batches:
            for some in slices(batch, "text", budget):
                size = some.column(1).nbytes
                if held and full + size > budget:
                    yield tokenized(number, pa.Table.from_batches(held), id_type)
                    held, full, number = [], 0, number + 1
                held.append(some)
                full += size
        if held:
            yield tokenized(number, pa.Table.from_batches(held), id_type)

    state = T.StructType([T.StructField("chunk", T.LongType()), T.StructField("ids", T.ArrayType(docs.schema["doc_id"].dataType)), T.StructField("held", T.ArrayType(T.BooleanType())), *(T.StructField(c, T.BinaryType()) for c in ("edge", "hashes", "uses", "places"))])
    # The copy in the checkpoint stays dealt out by chunk, so that a round shuffles answers only.
    dealt = checkpoint(docs.mapInArrow(deal, state).repartition(shuffled, "chunk"), keep=True)
    answers, tokens, distinct = None, 0, 0

    def asking(rounds: int, tokens: int, distinct: int):
        def ask(t: pa.Table, answers: pa.Table | None = None) -> pa.Table:
            chunk, out = t.column("chunk")[0].as_py(), []
            for kind, hashes, values in Chunk(t, answers).run(rounds, tokens, distinct):
                cut = np.searchsorted(_part(hashes, parts), np.arange(parts + 1))
                own = np.flatnonzero(np.diff(cut))  # the parts that are asked for something
                pack = lambda x, form: pa.array([form(x[cut[p] : cut[p + 1]]) for p in own], pa.binary())  # noqa: E731, B023
                out.append(pa.table({"chunk": pa.array(np.full(len(own), chunk)), "kind": pa.array(np.full(len(own), kind, np.int32)), "part": pa.array(own.astype(np.int32)), "hashes": pack(hashes, packed_hashes), "values": pack(values, np.ndarray.tobytes)}))
            return pa.concat_tables(out)

        return ask

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ask = asking(0, 0, 0)
        for batch in batches:
            for i in range(batch.num_rows):
                yield from ask(pa.Table.from_batches([batch.slice(i, 1)])).to_batches()

    for rounds in range(DEPTH + 2):
        if not rounds:
            asked = dealt.mapInArrow(first, _ASKED)
        else:
            asked = dealt.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(asking(rounds, tokens, distinct), _ASKED)
        got = checkpoint(asked.repartition(parts, "part").mapInArrow(answer, _ANSWERS))
        if not rounds:
            sums = got.agg(F.sum("tokens").alias("t"), F.sum("distinct").alias("d")).first()
            tokens, distinct = int(sums["t"] or 0), int(sums["d"] or 0)
        answers = got if not rounds else answers.unionByName(got)

    fields = T.StructType([id_field(docs), T.StructField("held_out", T.BooleanType()), T.StructField("n_tokens", T.LongType()), T.StructField("n_known", T.LongType()), T.StructField("base_score", T.DoubleType()), T.StructField("score", T.DoubleType())])

    def judge(t: pa.Table, answers: pa.Table) -> pa.Table:
        own = Chunk(t, answers)
        root, value = own.run(DEPTH + 2, tokens, distinct)
        n, real = own.rows, own.place > 0
        row = np.repeat(np.arange(n), np.diff(own.edge))
        add = lambda x: np.bincount(row[real], x[real], minlength=n)
        return pa.table({
            "doc_id": own.ids, "held_out": own.held, "n_tokens": pa.array(np.diff(own.edge) - 1), "n_known": pa.array(add(root * (tokens + distinct + 1) > 1.5).astype(np.int64)),
            "base_score": pa.array(add(np.log10(root))), "score": pa.array(add(np.log10(value))),
        })

    scored = dealt.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(judge, fields)
    return scored.select(F.col("doc_id").alias(id_col), "held_out", "n_tokens", "n_known", F.lit(tokens).cast("long").alias("train_tokens"), "base_score", "score")


def op3_suffix_tree_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_texts(table(spark, sf_dir, "documents"))

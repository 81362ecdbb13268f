"""Operator 8: removal of repeated byte strings by merging shard Burrows-Wheeler transforms.

Every byte covered by a ``length``-byte string that also starts earlier (smaller id, or earlier in the
same document) is removed.

1. Sharding.  Windows of ``length`` bytes with the same smallest hash of their 32-byte strings form runs;
   equal windows have equal smallest hashes, so all places of a repeated string meet under one key.
   Runs with equal bytes are settled at once: all but the first repeat an earlier one whole.  Keys
   with two or more different runs are left, as is the first of equal runs that have their smallest hash
   at more than one place, since these can repeat themselves; only the bytes of what is left are fetched.
2. Merging.  The runs left are dealt by key into collections of bounded size and each collection into
   shards.  A shard's transform comes from its own sorted rotations.  The transforms are then merged by
   iterative interleave refinement: each step deals the current interleave by the symbols that the
   transforms put before it, after which it is ordered by one more symbol; where symbol or previous
   block changes, a new block begins, and the step at which it does is the common prefix of the two
   neighbours.  No suffix is sorted again.  After length / 2 steps (a symbol is two bytes, each run is
   read at even and at odd positions) the places whose common prefix is still open form the repeated
   intervals: the suffixes that share ``length`` bytes or more.
3. The first window of each interval stays, all others are removed.

Runs that repeat within one task's texts are settled there, so a string that is very frequent sends few
runs from each task to the one that owns its key.

Defined results: a null text has no bytes; rows that repeat an id and its text get the same result, as
one document; texts that share an id are ordered by their hash; a null id comes last; ids of any size are
ranked, not multiplied; a very long text is cut into runs like any other; an empty table gives an empty
table; only the id and text columns are read, so other columns cannot clash.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from folioscope.llm._common import checkpoint, conf_int, id_field, table
from folioscope.llm._kernels import _BASE, _BYTE, mix, powers, slices, text_bytes

LENGTH, SEED = 100, 32
RUN = 96
COLLECTION = 1 << 19
SHARDS = 4
#: Bytes of text whose equal runs a task settles by itself, and bytes of text for each partition of runs.
TOGETHER, HOLD = 8 << 20, 16 << 20
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_inverse = np.ones(1, dtype=np.uint64)


def _inverse_powers(n: int) -> np.ndarray:
    global _inverse
    if len(_inverse) < n:
        more = np.full(max(n, 2 * len(_inverse)), _INVERSE, dtype=np.uint64)
        more[0] = 1
        _inverse = np.multiply.accumulate(more)
    return _inverse[:n]


def _slide(x: np.ndarray, width: int, pick) -> np.ndarray:
    """``pick`` over every ``width`` neighbours."""
    out, have = x.copy(), 1
    while have < width:
        step = min(have, width - have)
        out[: len(out) - step] = pick(out[: len(out) - step], out[step:])
        have += step
    return out[: max(0, len(x) - width + 1)]


def flat(lengths: np.ndarray) -> np.ndarray:
    return np.arange(int(lengths.sum())) - np.repeat(np.cumsum(lengths) - lengths, lengths)


def window_runs(data: np.ndarray, offsets: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, ...]:
    """(row, first window, number of windows, key, hash of the run's bytes, whether the key comes more than once in it) of the runs of windows with one smallest hash."""
    n = len(data)
    if n < length:
        return (np.zeros(0, np.int64),) * 3 + (np.zeros(0, np.uint64),) * 2 + (np.zeros(0, bool),)
    total = np.concatenate([[np.uint64(0)], np.cumsum(_BYTE[data] * powers(n), dtype=np.uint64)])
    back = _inverse_powers(n + 1)
    seeds = mix((total[SEED:] - total[:-SEED]) * back[: n - SEED + 1])
    least = _slide(seeds, length - SEED + 1, np.minimum)
    starts, ends = offsets[:-1], offsets[1:]
    have = np.flatnonzero(ends - starts >= length)
    size = ends[have] - starts[have] - length + 1
    window = np.repeat(starts[have], size) + flat(size)
    row = np.repeat(have, size)
    value = least[window]
    new = np.ones(len(window), dtype=bool)
    new[1:] = (value[1:] != value[:-1]) | (row[1:] != row[:-1])
    first = np.flatnonzero(new)
    count = np.diff(np.append(first, len(window)))
    pieces = (count + RUN - 1) // RUN  # periodic text has long runs; any cut is right
    number = flat(pieces)
    first = np.repeat(first, pieces) + number * RUN
    count = np.minimum(RUN, np.repeat(count, pieces) - number * RUN)
    begin = window[first]
    end = begin + count - 1 + length
    bytes_ = mix((total[end] - total[begin]) * back[begin] + count.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    # Equal windows of one run have its smallest hash at different places, each of them the least of some window.
    edge = np.zeros(length - SEED, dtype=np.uint64)
    least_at = np.flatnonzero(seeds == _slide(np.concatenate([edge, least, edge]), length - SEED + 1, np.maximum))
    low, high = np.searchsorted(least_at, begin), np.searchsorted(least_at, end - SEED, side="right")
    own = np.repeat(np.arange(len(begin)), high - low)
    hit = seeds[least_at[np.repeat(low, high - low) + flat(high - low)]] == value[first][own]
    inner = np.bincount(own[hit], minlength=len(begin)) > 1
    return row[first], begin - starts[row[first]], count, value[first], bytes_, inner


def rotations(symbols: np.ndarray, after: np.ndarray, longest: int) -> np.ndarray:
    """Order of all rotations of the cyclic strings that ``after`` links, ties by place."""
    key = symbols.astype(np.uint64)
    place = after
    for _ in range(3):
        key = key << np.uint64(16) | symbols[place]
        place = after[place]
    order = np.argsort(key, kind="stable")
    ranked = key[order]
    fresh = np.ones(len(order), dtype=bool)
    fresh[1:] = ranked[1:] != ranked[:-1]
    rank = np.empty(len(order), dtype=np.int64)
    step = 4
    jump = place
    while True:
        rank[order] = np.maximum.accumulate(np.where(fresh, np.arange(len(order)), 0))
        alone = fresh & np.append(fresh[1:], True)
        left = np.flatnonzero(~alone)
        if not len(left) or step >= 2 * longest:
            return order
        own = order[left]
        both = rank[own] << 32 | rank[jump[own]]
        again = np.argsort(both, kind="stable")
        order[left] = own[again]
        both = both[again]
        new = np.ones(len(both), dtype=bool)
        new[1:] = both[1:] != both[:-1]
        fresh[left] |= new
        jump = jump[jump]
        step *= 2


class Shard:
    """The transform of a set of runs, each read as two-byte symbols from its first and from its second byte."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        begin, size = offsets[:-1], np.diff(offsets)
        begin = np.column_stack([begin, begin + 1]).ravel()
        count = np.column_stack([size // 2, (size - 1) // 2]).ravel()
        edge = np.concatenate([[0], np.cumsum(count + 1)])
        #: Byte position of each symbol; -1 for the end of a string.
        self.at = np.repeat(begin, count + 1) + 2 * flat(count + 1)
        last = edge[1:] - 1
        self.at[last] = -1
        safe = np.maximum(self.at, 0)
        symbols = (data[safe].astype(np.uint16) << np.uint16(8) | data[np.minimum(safe + 1, len(data) - 1)]) + np.uint16(1)
        symbols[last] = 0
        after = np.arange(1, len(symbols) + 1)
        after[last] = edge[:-1]
        before = np.arange(-1, len(symbols) - 1)
        before[edge[:-1]] = last
        self.order = rotations(symbols, after, int(count.max()) + 1)
        self.transform = symbols[before[self.order]]


def merge(shards: list[Shard], steps: int) -> tuple[np.ndarray, np.ndarray]:
    """Interleave of the shards after ``steps`` refinements and the common prefix, in symbols, of each place and the one before it; ``steps`` where it is that long or longer."""
    before = np.concatenate([s.transform for s in shards])
    interleave = np.repeat(np.arange(len(shards), dtype=np.uint8), [len(s.transform) for s in shards])
    block = np.zeros(len(before), dtype=np.int32)
    common = np.full(len(before), steps, dtype=np.int16)
    symbols = np.empty_like(before)
    edge = np.empty(len(before), dtype=bool)
    for step in range(steps):
        symbols[np.argsort(interleave, kind="stable")] = before
        order = np.argsort(symbols, kind="stable")
        interleave, block, ranked = interleave[order], block[order], symbols[order]
        edge[0] = True
        edge[1:] = (ranked[1:] != ranked[:-1]) | (block[1:] != block[:-1])
        common[edge & (common == steps)] = step
        block = np.cumsum(edge, dtype=np.int32)
    return interleave, common


def repeated_windows(data: np.ndarray, offsets: np.ndarray, windows: np.ndarray, rank: np.ndarray, length: int = LENGTH) -> np.ndarray:
    """Which windows also start earlier.  ``windows``: windows of each run; ``rank``: place of each run's first window in the order of starts, plus the window's number."""
    runs = len(windows)
    cuts = np.unique(np.concatenate([np.searchsorted(offsets, np.linspace(0, offsets[-1], SHARDS + 1)[1:-1]), [0, runs]]))
    shards, starts = [], []
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        shard = Shard(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
        shards.append(shard)
        starts.append(np.where(shard.at[shard.order] >= 0, shard.at[shard.order] + offsets[a], -1))
    steps = length // 2
    interleave, common = merge(shards, steps)
    block = np.cumsum(common < steps)  # repeated intervals
    start = np.empty(len(block), dtype=np.int64)
    start[np.argsort(interleave, kind="stable")] = np.concatenate(starts)
    row = np.searchsorted(offsets, start, side="right") - 1
    real = (start >= 0) & (start - offsets[np.maximum(row, 0)] < windows[np.maximum(row, 0)])
    start, row, block = start[real], row[real], block[real]
    number = start - offsets[row]
    where = rank[row] + number
    new = np.ones(len(block), dtype=bool)
    new[1:] = block[1:] != block[:-1]
    first = np.flatnonzero(new)
    least = np.minimum.reduceat(where, first) if len(first) else where
    later = where > np.repeat(least, np.diff(np.append(first, len(block))))
    edge = np.concatenate([[0], np.cumsum(windows)])
    out = np.zeros(edge[-1], dtype=bool)
    out[edge[row[later]] + number[later]] = True
    return out


def _keys(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """doc_id, key (an integer in the order of documents, one for each id and text) and text."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    most = rows.groupBy("doc_id").count().agg(F.max("count"), F.max(F.col("doc_id").isNull())).first()
    if (most[0] or 1) == 1 and not most[1] and isinstance(docs.schema[id_col].dataType, T.IntegralType):
        # An expression of its own, so that both readings of the rows prune alike and share one shuffle.
        return rows.withColumn("key", F.coalesce(F.col("doc_id").cast("long"), F.lit(0).cast("long")))
    # Ranks by ranges of (id, hash of the text): a rank in each range, and the sums of the ranges before it.
    hashed = rows.withColumn("_h", F.xxhash64("text"))
    kinds = hashed.select("doc_id", "_h").distinct().repartitionByRange(F.col("doc_id").asc_nulls_last(), F.col("_h").asc())
    ranged = checkpoint(kinds.withColumn("_p", F.spark_partition_id()))
    sums = W.orderBy("_p").rowsBetween(W.unboundedPreceding, -1)
    first = ranged.groupBy("_p").agg(F.count("*").alias("_n")).select("_p", F.coalesce(F.sum("_n").over(sums), F.lit(0)).alias("_first"))
    inside = W.partitionBy("_p").orderBy(F.col("doc_id").asc_nulls_last(), "_h")
    ranked = ranged.withColumn("_n", F.row_number().over(inside)).join(F.broadcast(first), "_p").select("doc_id", "_h", (F.col("_first") + F.col("_n")).cast("long").alias("key"))
    placed = hashed.alias("a").join(ranked.alias("b"), F.col("a.doc_id").eqNullSafe(F.col("b.doc_id")) & (F.col("a._h") == F.col("b._h")))
    return placed.select(F.col("a.doc_id").alias("doc_id"), "key", "text")


def shared_runs(docs: DataFrame, parts: int, length: int) -> DataFrame:
    """key, start, size and seed of runs: size > 0 a span of bytes that repeats an earlier one whole, size < 0 a run of -size windows to compare under ``seed``."""

    def packed(held: list[tuple]) -> pa.RecordBatch:
        """Runs dealt by their seeds.  Of equal runs from different places the first goes on for all; the others, settled, are dealt by their keys (``inner`` is 2)."""
        key, begin, count, seed, same, inner = (np.concatenate(x) for x in zip(*held, strict=True))
        order = np.lexsort((begin, key, same, seed))
        key, begin, count, seed, same, inner = (x[order] for x in (key, begin, count, seed, same, inner))
        again = np.zeros(len(seed), dtype=bool)
        again[1:] = (seed[1:] == seed[:-1]) & (same[1:] == same[:-1])
        place = np.zeros(len(seed), dtype=bool)  # the same place once more, in a row that comes twice
        place[1:] = again[1:] & (key[1:] == key[:-1]) & (begin[1:] == begin[:-1])
        key, begin, count, seed, same, inner, again = (x[~place] for x in (key, begin, count, seed, same, inner, again))
        inner = np.where(again, 2, inner).astype("u1")
        dealt = np.where(again, mix(key.view(np.uint64)), seed)
        part_of = ((dealt >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)).astype(np.int64)
        order = np.argsort(part_of, kind="stable")
        at = np.searchsorted(part_of[order], np.arange(parts + 1))
        full = np.flatnonzero(np.diff(at))
        columns = [x[order] for x in (key.astype("<i8"), begin.astype("<i4"), count.astype("u1"), seed, same, inner)]
        return pa.RecordBatch.from_arrays([pa.array(full.astype(np.int32)), *(pa.array([x[at[p] : at[p + 1]].tobytes() for p in full], pa.binary()) for x in columns)], names=["part", "keys", "begins", "counts", "seeds", "sames", "inners"])

    def deal(batches):
        held, size = [], 0
        for batch in batches:
            for part in slices(batch, budget=1 << 20):
                keys = part.column(0).to_numpy()
                data, offsets = text_bytes(part.column(1))
                row, begin, count, seed, same, inner = window_runs(data, offsets, length)
                held.append((keys[row], begin, count, seed, same, inner.astype("u1")))
                size += len(data)
                if size > TOGETHER:
                    yield packed(held)
                    held, size = [], 0
        if size:
            yield packed(held)

    def settle(batches):
        got = [[] for _ in range(6)]
        for b in batches:
            for c, kind in enumerate(("<i8", "<i4", "u1", np.uint64, np.uint64, "u1")):
                got[c] += [np.frombuffer(x, kind) for x in b.column(c + 1).to_pylist()]
        if not got[0]:
            return
        key, begin, count, seed, same, inner = (np.concatenate(x) for x in got)
        del got
        done = np.flatnonzero(inner == 2)
        for i in range(0, len(done), 1 << 17):
            s = done[i : i + (1 << 17)]
            yield pa.RecordBatch.from_arrays([pa.array(key[s]), pa.array(begin[s].astype(np.int32)), pa.array(count[s].astype(np.int32) - 1 + length), pa.array(seed[s].view(np.int64))], names=["key", "start", "size", "seed"])
        key, begin, count, seed, same, inner = (x[inner != 2] for x in (key, begin, count, seed, same, inner))
        order = np.argsort(seed, kind="stable")
        ranked = seed[order]
        more = np.zeros(len(seed) + 1, dtype=bool)
        more[1:-1] = ranked[1:] == ranked[:-1]
        order = order[more[1:] | more[:-1] | (inner[order] > 0)]
        key, begin, count, seed, same, inner = (x[order] for x in (key, begin, count, seed, same, inner))
        order = np.lexsort((begin, key, same, seed))
        key, begin, count, seed, same, inner = (x[order] for x in (key, begin, count, seed, same, inner))
        own = np.ones(len(seed), dtype=bool)  # a document that comes in several rows counts once
        own[1:] = (key[1:] != key[:-1]) | (begin[1:] != begin[:-1]) | (seed[1:] != seed[:-1])
        key, begin, count, seed, same, inner = (x[own] for x in (key, begin, count, seed, same, inner))
        new_seed = np.ones(len(seed), dtype=bool)
        new_seed[1:] = seed[1:] != seed[:-1]
        new_same = new_seed.copy()
        new_same[1:] |= same[1:] != same[:-1]
        first = np.flatnonzero(new_seed)
        kinds = np.repeat(np.add.reduceat(new_same.astype(np.int64), first), np.diff(np.append(first, len(seed)))) if len(first) else np.zeros(0, np.int64)
        size = np.where(new_same, -count.astype(np.int64), count.astype(np.int64) - 1 + length)
        keep = ~new_same | (kinds > 1) | (inner > 0)
        for i in range(0, len(keep), 1 << 17):
            s = np.flatnonzero(keep[i : i + (1 << 17)]) + i
            if len(s):
                yield pa.RecordBatch.from_arrays([pa.array(key[s]), pa.array(begin[s].astype(np.int32)), pa.array(size[s].astype(np.int32)), pa.array(seed[s].view(np.int64))], names=["key", "start", "size", "seed"])

    dealt = docs.select("key", "text").mapInArrow(deal, "part int, keys binary, begins binary, counts binary, seeds binary, sames binary, inners binary")
    return dealt.repartition(parts, "part").mapInArrow(settle, "key long, start int, size int, seed long")


def _spans(column) -> tuple[np.ndarray, np.ndarray]:
    """(struct of arrays, row offsets) of a list column, null lists empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    lengths = np.nan_to_num(pc.list_value_length(column).to_numpy(zero_copy_only=False)).astype(np.int64)
    return column.flatten(), np.concatenate([[0], np.cumsum(lengths)])


def fetched(docs: DataFrame, marks: DataFrame) -> DataFrame:
    """key, start, windows, seed and bytes of the runs to compare."""

    def run(batches):
        for batch in batches:
            for part in slices(batch, budget=1 << 20):
                data, offsets = text_bytes(part.column(1))
                spans, edge = _spans(part.column(2))
                size = spans.field(1).to_numpy()
                row = np.repeat(np.arange(part.num_rows), np.diff(edge))
                take = np.flatnonzero(size < 0)
                if not len(take):
                    continue
                start, windows = spans.field(0).to_numpy()[take], -size[take]
                begin = offsets[row[take]] + start
                width = windows.astype(np.int64) - 1 + LENGTH
                own = data[np.repeat(begin, width) + flat(width)]
                where = np.concatenate([[0], np.cumsum(width)]).astype(np.int32)
                raw = pa.Array.from_buffers(pa.binary(), len(take), [None, pa.py_buffer(where), pa.py_buffer(own)])
                yield pa.RecordBatch.from_arrays([pa.array(part.column(0).to_numpy()[row[take]]), pa.array(start), pa.array(windows), pa.array(spans.field(2).to_numpy()[take]), raw], names=["key", "start", "windows", "seed", "bytes"])

    # The same columns as where the spans are applied, so that both shuffles are done once.
    rows = docs.join(marks.where("compare"), "key").select("key", "text", "spans", "doc_id", "compare")
    return rows.mapInArrow(run, "key long, start int, windows int, seed long, bytes binary")


def merged(runs: DataFrame, parts: int, length: int) -> DataFrame:
    """key, start and size of the spans that repeat an earlier one, found by merging transforms."""

    def compare(t: pa.Table):
        seed = t.column("seed").to_numpy()
        t = t.take(pa.array(np.lexsort((t.column("start").to_numpy(), t.column("key").to_numpy(), seed))))
        key, start, windows = (t.column(c).to_numpy() for c in ("key", "start", "windows"))
        new = np.ones(len(key), dtype=bool)  # a document that comes in several rows counts once
        new[1:] = (key[1:] != key[:-1]) | (start[1:] != start[:-1])
        data, offsets = text_bytes(t.column("bytes").combine_chunks())
        if not new.all():
            keep = np.flatnonzero(new)
            width = np.diff(offsets)[keep]
            data, key, start, windows = data[np.repeat(offsets[keep], width) + flat(width)], key[keep], start[keep], windows[keep]
            offsets = np.concatenate([[0], np.cumsum(width)])
        # The order of starts, without a number that could overflow: runs by (key, start), windows counted on.
        order = np.lexsort((start, key))
        rank = np.empty(len(key), dtype=np.int64)
        rank[order] = np.concatenate([[0], np.cumsum(windows[order])])[:-1]
        hit = repeated_windows(data, offsets, windows.astype(np.int64), rank, length)
        run = np.repeat(np.arange(len(key)), windows)
        number = flat(windows)
        lone = np.flatnonzero(hit)
        if not len(lone):
            return None
        head = np.ones(len(lone), dtype=bool)
        head[1:] = (lone[1:] != lone[:-1] + 1) | (run[lone[1:]] != run[lone[:-1]])
        a = lone[head]
        b = lone[np.append(np.flatnonzero(head)[1:] - 1, len(lone) - 1)]
        return pa.RecordBatch.from_arrays([pa.array(key[run[a]]), pa.array((start[run[a]] + number[a]).astype(np.int32)), pa.array((number[b] - number[a] + length).astype(np.int32))], names=["key", "start", "size"])

    def run(batches):
        held, size, last = [], 0, None
        for batch in batches:  # sorted by seed; a collection ends between two seeds
            seed = batch.column(3).to_numpy()
            cuts = np.flatnonzero(np.append(True, seed[1:] != seed[:-1])).tolist() + [len(seed)]
            width = np.concatenate([[0], np.cumsum(batch.column(2).to_numpy().astype(np.int64) - 1 + length)])
            begin = 0
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                if size + int(width[a] - width[begin]) > COLLECTION and seed[a] != last:
                    if a > begin:
                        held.append(batch.slice(begin, a - begin))
                    if held and (out := compare(pa.Table.from_batches(held))) is not None:
                        yield out
                    held, size, begin = [], 0, a
                last = seed[a]
            if begin < len(seed):
                held.append(batch.slice(begin))
                size += int(width[-1] - width[begin])
        if held and (out := compare(pa.Table.from_batches(held))) is not None:
            yield out

    return runs.repartition(parts, "seed").sortWithinPartitions("seed").mapInArrow(run, "key long, start int, size int")


def suffix_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, with_text: bool = False) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 and, if ``with_text``, kept (the bytes left)."""
    if length != LENGTH:
        raise ValueError("runs are fetched for the length in LENGTH")
    spark = docs.sparkSession
    rows = _keys(docs, id_col, text_col)
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(2 * conf_int(spark, "spark.sql.shuffle.partitions", 200), -(-size // HOLD))
    marks = shared_runs(rows, parts, length).groupBy("key").agg(F.collect_list(F.struct("start", "size", "seed")).alias("spans"), (F.min("size") < 0).alias("compare"))
    later = merged(fetched(rows, marks), parts, length).groupBy("key").agg(F.collect_list(F.struct("start", "size")).alias("more"))
    fields = [id_field(rows), *(T.StructField(c, T.LongType()) for c in ("n_bytes", "n_removed", "n_spans")), T.StructField("kept_sha256", T.StringType())]
    fields += [T.StructField("kept", T.BinaryType())] * with_text

    def finish(batches):
        for batch in batches:
            for part in slices(batch, budget=1 << 20):
                data, offsets = text_bytes(part.column(1))
                delta = np.zeros(len(data) + 1, dtype=np.int32)
                for c in (2, 3):
                    spans, edge = _spans(part.column(c))
                    start, size = spans.field(0).to_numpy(), spans.field(1).to_numpy()
                    row = np.repeat(np.arange(part.num_rows), np.diff(edge))
                    use = size > 0
                    begin = offsets[row[use]] + start[use]
                    np.add.at(delta, begin, 1)
                    np.add.at(delta, begin + size[use], -1)
                gone = np.cumsum(delta[:-1]) > 0
                edge = np.zeros(len(data), dtype=bool)
                edge[offsets[:-1][np.diff(offsets) > 0]] = True
                head = gone.copy()
                head[1:] &= ~gone[:-1] | edge[1:]
                removed, runs = (np.concatenate([[0], np.cumsum(x, dtype=np.int64)]) for x in (gone, head))
                left = data[~gone]
                cut = offsets - removed[offsets]
                bytes_ = [left[a:b].tobytes() for a, b in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True)]
                columns = [part.column(0), *(pa.array(x[1:] - x[:-1]) for x in (offsets, removed[offsets], runs[offsets])), pa.array([hashlib.sha256(x).hexdigest() for x in bytes_], pa.string())]
                yield pa.RecordBatch.from_arrays(columns + [pa.array(bytes_, pa.binary())] * with_text, names=[f.name for f in fields])

    whole = rows.join(marks, "key", "left").join(later, "key", "left").select("doc_id", "text", "spans", "more", "key", "compare")
    out = whole.mapInArrow(finish, T.StructType(fields))
    return out.withColumnRenamed("doc_id", id_col)


def op8_bwt_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup(table(spark, sf_dir, "documents"))

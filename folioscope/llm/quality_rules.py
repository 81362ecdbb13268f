"""Operator 5: quality rules from suffix-array repetition.

A suffix array over the words of each text (prefix doubling, all texts of a batch at once) gives the
longest common prefix of neighbouring suffixes.  Its intervals are the maximal repeated word strings;
the union of their occurrences is the covered part of the text.  A text fails if too much of it is
covered or if its longest repeat is too long.  The plain counts beside it are per-text statistics.

Defined results: a null or empty text has zero counts, fails the base rules (fewer than 50 words) and
isn't kept; repeated rows give repeated results; an empty table gives an empty table; only the id and
text columns are read, so other columns cannot clash.  A text is judged whole, however long it is.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from folioscope.llm._common import id_field, map_text, table
from folioscope.llm._kernels import mix, shingle_hashes, text_bytes, word_bounds, word_hashes

_SYMBOL = np.zeros(256, dtype=bool)
_SYMBOL[list(b"#*$%&|<>")] = True


def per_row(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sums of ``values`` between consecutive offsets."""
    total = np.concatenate([[0], np.cumsum(values, dtype=np.int64)])
    return total[offsets[1:]] - total[offsets[:-1]]


def repeated(keys: np.ndarray) -> np.ndarray:
    """Whether each key occurs more than once."""
    order = np.argsort(keys, kind="stable")
    ranked = keys[order]
    same = np.zeros(len(keys) + 1, dtype=bool)
    same[1:-1] = ranked[1:] == ranked[:-1]
    out = np.empty(len(keys), dtype=bool)
    out[order] = same[1:] | same[:-1]
    return out


def longest_repeats(words: np.ndarray, rows: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """For every word position, the length in words of the longest string from there that occurs elsewhere in its row.

    ``ends``: one past the last word of each position's row.
    """
    n = len(words)
    if not n:
        return np.zeros(0, np.int64)
    key = mix(words + mix(rows.astype(np.uint64)))
    sa = np.argsort(key, kind="stable")
    ranked = key[sa]
    fresh = np.ones(n, dtype=bool)
    fresh[1:] = ranked[1:] != ranked[:-1]
    levels: list[np.ndarray] = []
    step, place = 1, np.arange(n)
    while True:
        rank = np.empty(n, dtype=np.int32)
        rank[sa] = np.maximum.accumulate(np.where(fresh, place, 0))
        levels.append(rank)
        alone = fresh & np.append(fresh[1:], True)
        open_at = np.flatnonzero(~alone)
        if not len(open_at):
            break
        own = sa[open_at]
        then = own + step
        inside = then < ends[own]
        second = np.where(inside, rank[np.minimum(then, n - 1)].astype(np.int64) + 1, 0)
        both = rank[own].astype(np.int64) << 32 | second
        order = np.argsort(both, kind="stable")
        sa[open_at] = own[order]
        both = both[order]
        new = np.ones(len(both), dtype=bool)
        new[1:] = both[1:] != both[:-1]
        fresh[open_at] |= new
        step *= 2
    size = np.zeros(n, dtype=np.int64)
    if n == 1:
        return size
    pair = np.flatnonzero(levels[0][sa[1:]] == levels[0][sa[:-1]])
    a, b = sa[pair], sa[pair + 1]
    most = np.minimum(ends[a] - a, ends[b] - b)
    lcp = np.zeros(len(pair), dtype=np.int64)
    for k in range(len(levels) - 1, -1, -1):
        wide = 1 << k
        may = np.flatnonzero(lcp + wide <= most)
        x, y = a[may] + lcp[may], b[may] + lcp[may]
        lcp[may[levels[k][x] == levels[k][y]]] += wide
    np.maximum.at(size, a, lcp)
    np.maximum.at(size, b, lcp)
    return size


def covered(starts: np.ndarray, lengths: np.ndarray, n: int) -> np.ndarray:
    """Which of n positions lie in one of the spans."""
    edge = np.zeros(n + 1, dtype=np.int64)
    np.add.at(edge, starts, 1)
    np.add.at(edge, starts + lengths, -1)
    return np.cumsum(edge[:-1]) > 0


def quality_rules(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    min_repeat: int = 8,
    max_covered: float = 0.3,
    max_longest: int = 100,
) -> DataFrame:
    """One row for each document: counts, base verdict, repetition and whether it is kept.

    A repeat counts from ``min_repeat`` words; a text with more than ``max_covered`` of its words in
    repeats, or a repeat of more than ``max_longest`` words, isn't kept.
    """
    counts = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    fields = [id_field(docs, id_col), *(T.StructField(c, T.LongType()) for c in counts), T.StructField("base_failed", T.BooleanType()), T.StructField("repeat_covered", T.LongType()), T.StructField("longest_repeat", T.LongType()), T.StructField("kept", T.BooleanType())]

    def step(batch: pa.RecordBatch) -> pa.RecordBatch:
        data, offsets = text_bytes(batch.column(1))
        n = batch.num_rows
        is_word, starts, ends, rows = word_bounds(data, offsets)
        words = word_hashes(data, is_word, starts, ends, lower=False)
        n_words = np.bincount(rows, minlength=n)
        last = np.cumsum(n_words)
        word_chars = per_row(is_word & ((data & 0xC0) != 0x80), offsets)
        n_symbols = per_row(_SYMBOL[data], offsets)

        edges = np.unique(np.concatenate([offsets, np.flatnonzero(data == 10) + 1]))
        line_start, line_end = edges[:-1], edges[1:]
        line_row = np.searchsorted(offsets[1:], line_start, side="right")
        line_end = line_end - (data[line_end - 1] == 10) if len(line_end) else line_end
        has = line_end > line_start
        line_start, line_end, line_row = line_start[has], line_end[has], line_row[has]
        ink = np.concatenate([[0], np.cumsum(is_word, dtype=np.int64)])
        has = ink[line_end] > ink[line_start]
        line_start, line_end, line_row = line_start[has], line_end[has], line_row[has]
        inside = np.zeros(len(data) + 1, dtype=np.int64)
        np.add.at(inside, line_start, 1)
        np.add.at(inside, line_end, -1)
        lines = word_hashes(data, np.cumsum(inside[:-1]) > 0, line_start, line_end, lower=False)
        key = mix(lines + mix(line_row.astype(np.uint64)))
        _, first = np.unique(key, return_index=True)
        again = np.ones(len(key), dtype=bool)
        again[first] = False
        n_dup_lines = np.bincount(line_row[again], minlength=n)

        enough = n_words[rows] >= 3
        three, owner = shingle_hashes(words[enough], rows[enough], n, 3)
        twice = repeated(mix(three + mix(owner.astype(np.uint64))))
        first_word = (last - n_words)[owner] + np.arange(len(owner)) - np.searchsorted(owner, owner, side="left")
        hit = covered(first_word[twice], np.full(int(twice.sum()), 3), len(words))
        n_repeat_words = np.bincount(rows[hit], minlength=n)
        base_failed = (n_words < 50) | (100 * n_repeat_words > 50 * n_words)

        size = longest_repeats(words, rows, last[rows])
        long = np.flatnonzero(size >= min_repeat)
        cover = np.bincount(rows[covered(long, size[long], len(words))], minlength=n)
        longest = np.zeros(n, dtype=np.int64)
        np.maximum.at(longest, rows, size)
        kept = ~base_failed & (cover <= max_covered * n_words) & (longest <= max_longest)
        columns = [batch.column(0), *(pa.array(x.astype(np.int64)) for x in (n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words)), pa.array(base_failed), pa.array(cover.astype(np.int64)), pa.array(longest), pa.array(kept)]
        return pa.RecordBatch.from_arrays(columns, names=[f.name for f in fields])

    return map_text(docs.select(id_col, docs[text_col].cast("string").alias("text")), lambda: step, T.StructType(fields))


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(table(spark, sf_dir, "documents"))

"""Vectorised text kernels over Arrow string columns, shared by the corpus operators.

Everything works on whole batches of UTF-8 bytes with numpy, so the cost of a document does not
include a Python step per word.  Words are maximal runs of ``[^\\x20\\x09-\\x0D]``; nulls are empty.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

_SEPARATORS = (0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D)
_IS_WORD = np.ones(256, dtype=bool)
_IS_WORD[list(_SEPARATORS)] = False
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BYTE = np.random.default_rng(20240607).integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_STEP = np.array([0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3], dtype=np.uint64)

_powers = np.ones(1, dtype=np.uint64)


def powers(n: int) -> np.ndarray:
    """The first n powers of the rolling base, modulo 2**64."""
    global _powers
    if len(_powers) < n:
        more = np.full(max(n, 2 * len(_powers)), _BASE, dtype=np.uint64)
        more[0] = 1
        _powers = np.multiply.accumulate(more)
    return _powers[:n]


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    h = h ^ (h >> np.uint64(30))
    h = h * _M1
    h ^= h >> np.uint64(27)
    h *= _M2
    h ^= h >> np.uint64(31)
    return h


def slices(batch: pa.RecordBatch, column: str = "text", budget: int = 2 << 20):
    """Parts of a batch with about ``budget`` bytes of text each; a longer text is a part of its own."""
    data, offsets = text_bytes(batch.column(batch.schema.get_field_index(column)))
    begin, n = 0, batch.num_rows
    while begin < n:
        end = int(np.searchsorted(offsets, offsets[begin] + budget, side="right")) - 1
        end = min(max(end, begin + 1), n)
        yield batch.slice(begin, end - begin)
        begin = end


def text_bytes(column) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string column and the row offsets into them (a null has no bytes)."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    kind = np.int64 if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type) else np.int32
    n = len(column)
    if not n:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, where, raw = column.buffers()
    offsets = np.frombuffer(where, dtype=kind)[column.offset : column.offset + n + 1].astype(np.int64)
    data = np.frombuffer(raw, dtype=np.uint8)[offsets[0] : offsets[-1]] if raw is not None else np.zeros(0, np.uint8)
    return data, offsets - offsets[0]


def word_bounds(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(is word byte, start, end, row) of every word."""
    is_word = _IS_WORD[data]
    edge = np.zeros(len(data) + 1, dtype=bool)
    edge[offsets] = True
    before = np.empty(len(data), dtype=bool)
    after = np.empty(len(data), dtype=bool)
    if len(data):
        before[0], after[-1] = False, False
        before[1:], after[:-1] = is_word[:-1], is_word[1:]
    starts = np.flatnonzero(is_word & (~before | edge[:-1]))
    ends = np.flatnonzero(is_word & (~after | edge[1:])) + 1
    rows = np.searchsorted(offsets[1:], starts, side="right")
    return is_word, starts, ends, rows


def word_hashes(data: np.ndarray, is_word: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool = True) -> np.ndarray:
    """A 64-bit hash of every word, A-Z lower-cased if ``lower``.

    Each piece of a word is mixed with its place before the sum, so that no rule of algebra makes two words equal, as one
    does for polynomials modulo 2**64.
    """
    if not len(starts):
        return np.zeros(0, np.uint64)
    own = data[is_word]
    if lower:
        own = _LOWER[own]
    size = ends - starts
    first = np.cumsum(size) - size
    # Eight bytes at a time: each piece is mixed with its place in the word.
    pieces = (size + 7) >> 3
    begin = np.cumsum(pieces) - pieces
    within = np.arange(int(pieces.sum())) - np.repeat(begin, pieces)
    shift = np.tile(np.arange(256, dtype=np.uint8), len(own) // 256 + 1)[: len(own)] - np.repeat((first & 7).astype(np.uint8), size)
    shift = (shift & np.uint8(7)) << np.uint8(3)
    packed = np.add.reduceat(own.astype(np.uint64) << shift, np.repeat(first, pieces) + 8 * within)
    return mix(np.add.reduceat(mix(packed + (within.astype(np.uint64) + np.uint64(1)) * _BASE), begin) + size.astype(np.uint64) * _M2)


def shingle_hashes(words: np.ndarray, rows: np.ndarray, n_rows: int, k: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """(hash, row) of every window of k words; a row with fewer words has its whole sequence as one."""
    count = np.bincount(rows, minlength=n_rows)
    parts, owners = [], []
    if len(words) >= k:
        total = np.zeros(len(words) - k + 1, dtype=np.uint64)
        for j in range(k):
            total += words[j : len(words) - k + 1 + j] * _STEP[j % 5] * powers(j + 1)[j]
        whole = rows[: len(words) - k + 1] == rows[k - 1 :]
        parts.append(mix(total[whole]))
        owners.append(rows[: len(words) - k + 1][whole])
    short = np.flatnonzero((count > 0) & (count < k))
    if len(short):
        first = np.cumsum(count) - count
        total = np.zeros(len(short), dtype=np.uint64)
        for j in range(k - 1):
            have = count[short] > j
            total[have] += words[first[short][have] + j] * _STEP[j % 5] * powers(j + 1)[j]
        parts.append(mix(total + count[short].astype(np.uint64) * _M1))
        owners.append(short)
    if not parts:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    return np.concatenate(parts), np.concatenate(owners)


def row_sets(hashes: np.ndarray, rows: np.ndarray, n_rows: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashes of every row, ascending inside a row, and the row offsets into them."""
    order = np.lexsort((hashes, rows))
    hashes, rows = hashes[order], rows[order]
    keep = np.ones(len(hashes), dtype=bool)
    keep[1:] = (hashes[1:] != hashes[:-1]) | (rows[1:] != rows[:-1])
    hashes, rows = hashes[keep], rows[keep]
    return hashes, np.concatenate([[0], np.cumsum(np.bincount(rows, minlength=n_rows))])

"""A batch of regions read from the boxes of their words: lines, phrases, columns by gaps, cells by rulings.

Regions come as Arrow lists of words (x0, y0, x1, y1, text) and of rulings (at, low, high, upright), and every step is
one pass of numpy over the words of many regions.  Coordinates are compared by their ranks, with NaN above all
numbers, as Spark sorts them; texts that lie at one place follow each other in the order of their bytes, nulls left out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Words, and pairs of a word and a ruling's part, that are held at a time; a region and a word are never divided.
WORDS, PAIRS = 200_000, 2_000_000


def _above(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (a > b) | (np.isnan(a) & ~np.isnan(b))


def _opens(*keys: np.ndarray) -> np.ndarray:
    """Whether a sorted row differs from the one before it."""
    new = np.ones(len(keys[0]), bool)
    new[1:] = np.logical_or.reduce([k[1:] != k[:-1] for k in keys])
    return new


def _ranked(*columns: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """The sorted values of all columns, and the ranks of each column in them."""
    values, ranks = np.unique(np.concatenate(columns) + 0.0, return_inverse=True)
    return values, np.split(ranks.astype(np.int64), np.cumsum([len(c) for c in columns])[:-1])


def _banded(part: np.ndarray, low: np.ndarray, high: np.ndarray, values: np.ndarray, gap: float) -> np.ndarray:
    """The band, counted over all parts, of boxes sorted by part, low and high; bands are more than ``gap`` apart."""
    new = _opens(part)
    reached = np.maximum.accumulate(part * len(values) + high)[:-1] - part[1:] * len(values)
    inner = ~new[1:]
    new[1:][inner] = _above(values[low[1:][inner]], values[reached[inner]] + gap)
    # Boxes that are equal are in the band of the last of them.
    equal = np.append(np.flatnonzero(_opens(part, low, high))[1:], len(part)) - 1
    return np.cumsum(new)[equal][np.cumsum(_opens(part, low, high)) - 1]


def _joined(group: np.ndarray, first: np.ndarray, second: np.ndarray, text: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """The order by group, first, second and text, where in it the groups begin, and the texts of each group."""
    order = np.lexsort((second, first, group))
    same = ~_opens(group[order], first[order], second[order])
    if same.any():
        tied = order[same | np.append(same[1:], False)]
        rank = np.zeros(len(group), np.int64)
        rank[tied] = pc.rank(text.take(pa.array(tied)), sort_keys="ascending", null_placement="at_start", tiebreaker="dense").to_numpy()
        order = np.lexsort((rank, second, first, group))
    starts = np.flatnonzero(_opens(group[order]))
    words = text.take(pa.array(order))
    counts = np.add.reduceat(words.is_valid().to_numpy(zero_copy_only=False).astype(np.int64), starts)
    return order, starts, pc.binary_join(_lists(counts, words.drop_null()), " ")


def _lists(counts: np.ndarray, values: pa.Array, none: np.ndarray | None = None) -> pa.ListArray:
    offsets = pa.array(np.append(0, np.cumsum(counts)), pa.int32())
    return pa.ListArray.from_arrays(offsets, values, mask=None if none is None else pa.array(none))


def _grid(n: int, region: np.ndarray, line: np.ndarray, column: np.ndarray, y0: np.ndarray, x0: np.ndarray, text: pa.Array) -> pa.ListArray:
    """The grid of each of ``n`` regions, null where it has no cell; lines are numbered over all regions."""
    if not len(region):
        return pa.nulls(n, pa.list_(pa.list_(pa.string())))
    across = int(column.max()) + 1
    order, starts, cells = _joined(line * across + column, y0, x0, text)
    at = order[starts]
    new = _opens(line[at])
    row, of = np.cumsum(new) - 1, region[at][new]
    width = np.zeros(n, np.int64)
    np.maximum.at(width, region, column + 1)
    begins = np.append(0, np.cumsum(width[of]))
    picked = np.full(begins[-1], len(cells))
    picked[begins[row] + column[at]] = np.arange(len(cells))
    rows = _lists(width[of], pa.concat_arrays([cells, pa.array([""], pa.string())]).take(pa.array(picked)))
    return _lists(np.bincount(of, minlength=n), rows, width == 0)


class _Words:
    """The words of ``n`` regions that have all their coordinates, neither null nor NaN; places as ranks in ``xs`` and ``ys``."""

    def __init__(self, lists: pa.Array):
        self.n, flat = len(lists), lists.flatten()
        corners = [pc.struct_field(flat, c).cast(pa.float64()) for c in ("x0", "y0", "x1", "y1")]
        corners = [c.to_numpy(zero_copy_only=False) for c in corners]
        whole = ~np.isnan(corners).any(axis=0)
        counts = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
        self.region = np.repeat(np.arange(self.n), counts)[whole]
        self.text = pc.struct_field(flat, "text").cast(pa.string()).filter(pa.array(whole))
        x0, y0, x1, y1 = (c[whole] for c in corners)
        self.xs, (self.x0, self.x1) = _ranked(x0, x1)
        self.ys, (self.y0, self.y1) = _ranked(y0, y1)
        self.x, self.y = (x0 + x1) / 2, (y0 + y1) / 2


class _Phrases:
    """The words of a line, joined where the space between them is small; in the order of lines."""

    def __init__(self, w: _Words, space: float, leading: float):
        order = np.lexsort((w.y1, w.y0, w.region))
        line = np.empty(len(order), np.int64)
        line[order] = _banded(w.region[order], w.y0[order], w.y1[order], w.ys, leading)
        order = np.lexsort((w.x1, w.x0, line))
        phrase = np.empty(len(order), np.int64)
        phrase[order] = _banded(line[order], w.x0[order], w.x1[order], w.xs, space)
        order, starts, self.text = _joined(phrase, w.x0, w.y0, w.text)
        self.region, self.line = w.region[order][starts], line[order][starts]
        self.x0, self.y0 = np.minimum.reduceat(w.x0[order], starts), np.minimum.reduceat(w.y0[order], starts)
        self.x1, self.y1 = np.maximum.reduceat(w.x1[order], starts), np.maximum.reduceat(w.y1[order], starts)

    def lines(self, n: int) -> pa.ListArray:
        """The texts of each region's lines."""
        order, starts, text = _joined(self.line, self.x0, np.zeros_like(self.x0), self.text)
        return _lists(np.bincount(self.region[order][starts], minlength=n), text)

    def block(self, w: _Words) -> np.ndarray:
        """The phrases in their region's largest run of lines that have two phrases or more; the first of equal runs."""
        starts = np.flatnonzero(_opens(self.line))
        wide = np.repeat(np.diff(np.append(starts, len(self.line))) > 1, np.diff(np.append(starts, len(self.line))))
        at = np.flatnonzero(wide)
        if not len(at):
            return at
        region, line = self.region[at], self.line[at]
        # Lines that follow each other have one difference of their number and the wide lines so far.
        run = np.cumsum(_opens(region, line - np.cumsum(_opens(line)))) - 1
        starts = np.flatnonzero(_opens(run))
        across = w.xs[np.maximum.reduceat(self.x1[at], starts)] - w.xs[np.minimum.reduceat(self.x0[at], starts)]
        down = w.ys[np.maximum.reduceat(self.y1[at], starts)] - w.ys[np.minimum.reduceat(self.y0[at], starts)]
        order = np.lexsort((-line[starts], across * down, region[starts]))
        last = np.append(_opens(region[starts][order])[1:], True)
        best = np.zeros(len(starts), bool)
        best[order[last]] = True
        return at[best[run]]

    def by_gaps(self, w: _Words, crossed: float) -> pa.ListArray:
        """Columns are parted by gaps that run through the lines of the block.

        The lines that cover each x are counted by a sweep over the begins and ends of the phrases; the stretches
        that more lines cover than may cross a gap are columns, and those that touch are one.
        """
        at, size = self.block(w), len(w.xs)
        region, x0, x1 = self.region[at], self.x0[at], self.x1[at]
        steps, which = np.unique(np.concatenate((region * size + x0, region * size + x1)), return_inverse=True)
        covering = np.cumsum(np.bincount(which, np.repeat((1, -1), len(at)), len(steps)).astype(np.int64))
        allowed = np.floor(crossed * np.bincount(region[_opens(self.line[at])], minlength=w.n))
        covered = np.flatnonzero((covering[:-1] > allowed[steps[:-1] // size]) & (steps[:-1] // size == steps[1:] // size)) if len(steps) else steps
        new = np.ones(len(covered), bool)
        new[1:] = covered[1:] != covered[:-1] + 1
        ends = steps[covered[np.append(new[1:], True)] + 1] if len(covered) else covered
        spans = np.bincount(ends // size, minlength=w.n)
        # A phrase goes to the first column that it doesn't lie wholly to the right of.
        column = np.searchsorted(ends, region * size + x0, "right") - (np.cumsum(spans) - spans)[region]
        column, has = np.minimum(column, spans[region] - 1), spans[region] > 0
        at = at[has]
        return _grid(w.n, self.region[at], self.line[at], column[has], self.y0[at], self.x0[at], self.text.take(pa.array(at)))


class _Rulings:
    """The rulings of ``n`` regions; strokes that lie close are one ruling of several parts."""

    def __init__(self, lists: pa.Array, stroke: float):
        n, flat = len(lists), lists.flatten()
        at, low, high = (pc.struct_field(flat, c).cast(pa.float64()) for c in ("at", "low", "high"))
        upright = pc.struct_field(flat, "upright")
        has = pc.and_(at.is_valid(), upright.is_valid()).to_numpy(zero_copy_only=False)
        counts = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
        #: Flat rulings of a region are at twice its number, upright ones follow.
        way = (2 * np.repeat(np.arange(n), counts) + pc.fill_null(upright, False).to_numpy(zero_copy_only=False))[has]
        drawn = pc.and_(low.is_valid(), high.is_valid()).to_numpy(zero_copy_only=False)[has]
        values, (rank,) = _ranked(at.to_numpy(zero_copy_only=False)[has])
        order = np.lexsort((rank, way))
        way, rank = way[order], rank[order]
        new = _opens(_banded(way, rank, rank, values, stroke)) if len(way) else np.zeros(0, bool)
        number, lines = np.cumsum(new) - 1, np.bincount(way[new], minlength=2 * n)
        self.line = number - (np.cumsum(lines) - lines)[way]
        self.at = values[rank[new]][number]
        self.low, self.high = (np.where(drawn, c.to_numpy(zero_copy_only=False)[has], np.nan)[order] for c in (low, high))
        self.drawn = drawn[order]
        self.parts = np.bincount(way, minlength=2 * n)
        self.begins = np.cumsum(self.parts) - self.parts
        self.ruled = (lines.reshape(n, 2) >= 3).all(axis=1)

    def place(self, way: np.ndarray, at: np.ndarray, across: np.ndarray) -> np.ndarray:
        """The number of the last line before ``at`` that reaches ``across``; -1 outside of the lines."""
        out, parts = np.empty(len(way), np.int64), self.parts[way]
        for some in _runs(parts, PAIRS):
            size = parts[some]
            word = np.repeat(np.arange(len(size)), size)
            part = np.arange(len(word)) + np.repeat(self.begins[way[some]] - (np.cumsum(size) - size), size)
            to, over = at[some][word], across[some][word]
            reaches = ~_above(self.at[part], to) & self.drawn[part] & ~_above(self.low[part], over) & ~_above(over, self.high[part])
            out[some] = np.maximum.reduceat(np.where(reaches, self.line[part], -1), np.cumsum(size) - size)
        last = self.begins[way] + parts - 1
        return np.where(_above(at, self.at[last]), -1, out)

    def cells(self, w: _Words) -> pa.ListArray:
        """A cell lies between the nearest rulings to its left and above that reach its place."""
        at = np.flatnonzero(self.ruled[w.region])
        region = w.region[at]
        line, column = self.place(2 * region, w.y[at], w.x[at]), self.place(2 * region + 1, w.x[at], w.y[at])
        inside = (line >= 0) & (column >= 0)
        at, region, line, column = at[inside], region[inside], line[inside], column[inside]
        down = int(line.max(initial=0)) + 1
        return _grid(w.n, region, region * down + line, column, w.y0[at], w.x0[at], w.text.take(pa.array(at)))


def _runs(sizes: np.ndarray, most: int) -> Iterator[slice]:
    """Slices of rows whose sizes add up to ``most``, or that are one row."""
    ends, begin = np.cumsum(sizes), 0
    while begin < len(sizes):
        end = max(begin + 1, int(np.searchsorted(ends, (ends[begin - 1] if begin else 0) + most, "right")))
        yield slice(begin, end)
        begin = end


#: What a region's boxes are read as.
READ = pa.struct([("ruled", pa.list_(pa.list_(pa.string()))), ("spaced", pa.list_(pa.list_(pa.string()))), ("lines", pa.list_(pa.string()))])


def _read(words: pa.Array, rulings: pa.Array, space: float, leading: float, crossed: float, stroke: float) -> pa.StructArray:
    w = _Words(words)
    if not len(w.region):
        return pa.array([{"ruled": None, "spaced": None, "lines": []}] * w.n, READ)
    found = _Phrases(w, space, leading)
    parts = _Rulings(rulings, stroke).cells(w), found.by_gaps(w, crossed), found.lines(w.n)
    return pa.StructArray.from_arrays([p.cast(f.type) for p, f in zip(parts, READ, strict=True)], fields=list(READ))


def read(words: pa.Array, rulings: pa.Array, space: float, leading: float, crossed: float, stroke: float) -> pa.Array:
    """``READ`` of each region: its grid by rulings and by gaps, null where there is none, and the texts of its lines."""
    sizes = sum(pc.fill_null(pc.list_value_length(a), 0).to_numpy(zero_copy_only=False).astype(np.int64) for a in (words, rulings))
    cut = lambda a, some: a.slice(some.start, some.stop - some.start)
    with np.errstate(invalid="ignore", over="ignore"):
        parts = [_read(cut(words, some), cut(rulings, some), space, leading, crossed, stroke) for some in _runs(sizes, WORDS)]
    return pa.concat_arrays(parts) if parts else pa.array([], READ)

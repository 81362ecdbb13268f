"""Operator 6: a quality classifier from a linear-chain conditional random field over lines.

Every line with a word is labelled good or bad from features of its own and of its neighbouring lines.
The field is fitted on a bounded sample of labelled documents (at most ``train_docs``, those with the
smallest hashes, and at most ``train_lines`` lines of them); only rows with crc32(doc_id as text) mod 5
not 0 are used.  The labels of lines are latent: a document's label is what each of its lines shows, with
a chance of error that is learnt too.  Expectation-maximisation goes between the lines' posteriors given
what they show (forward-backward over the whole document, so a line that looks like its bad neighbours
turns bad in a good document) and the field's weights.  A document's score is the length-weighted mean of
its lines' forward-backward marginals, put on the scale of the labels by a logistic curve fitted on the
same sample.  The model, a few hundred numbers, is all that is sent to the executors.

Defined results: a null text, or one without a word, gets the share of good documents in the sample;
without labelled rows every score is 0.5; labels that are null are left out, and of several labels for
an id the smallest holds; repeated rows give repeated results; ties in the order of the sample go by id;
of rows that share a training id, the one whose text has the
smallest hash is learnt from; a very long text is scored whole, and learnt from only if its lines fit into the sample; an empty table
gives an empty table; only the columns named are read, so other columns cannot clash; lang and source are
never read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from folioscope.llm._common import checkpoint, id_field, map_text, table
from folioscope.llm._kernels import mix, shingle_hashes, text_bytes, word_bounds, word_hashes
from folioscope.llm.quality_rules import covered, per_row, repeated

TRAIN_DOCS, TRAIN_LINES = 4000, 200_000
ROUNDS = 3
BINS = np.array([0.05, 0.15, 0.3, 0.5, 0.7, 0.85, 0.95])
THRESHOLD = 0.3
PENALTY = 1.0


def _class(characters: bytes) -> np.ndarray:
    out = np.zeros(256, dtype=bool)
    out[list(characters)] = True
    return out


_DIGIT, _UPPER, _STOP = _class(b"0123456789"), _class(bytes(range(65, 91))), _class(b".,;:!?'\"-()")
_LETTER = _UPPER | _class(bytes(range(97, 123))) | _class(bytes(range(128, 256)))
_ODD = ~(_LETTER | _DIGIT | _STOP | _class(b" \t\n\r\x0b\x0c"))
_PIPE, _WIDE, _DOT = _class(b"|"), _class(bytes(range(192, 256))), _class(b".!?")


def line_features(column) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(features, words, row) of every line that has a word, in order."""
    data, offsets = text_bytes(column)
    n = len(offsets) - 1
    is_word, starts, ends, rows = word_bounds(data, offsets)
    if not len(starts):
        return np.zeros((0, 24)), np.zeros(0, np.int64), np.zeros(0, np.int64)
    words = word_hashes(data, is_word, starts, ends)
    edge = np.zeros(len(data) + 1, dtype=bool)
    edge[offsets] = True
    edge[1:][data == 10] = True
    line = np.cumsum(edge[:-1])[starts]
    fresh = np.ones(len(line), dtype=bool)
    fresh[1:] = line[1:] != line[:-1]
    first = np.flatnonzero(fresh)
    count = np.diff(np.append(first, len(line)))
    last = first + count - 1
    row, at = rows[first], np.cumsum(fresh) - 1
    begin, end = starts[first], ends[last]

    def share(kind: np.ndarray, base: np.ndarray | None = None) -> np.ndarray:
        total = np.concatenate([[0], np.cumsum(kind[data], dtype=np.int64)])
        got = (total[end] - total[begin]).astype(float)
        return got / np.maximum(1, base if base is not None else (end - begin))

    def mean(flags: np.ndarray) -> np.ndarray:
        return np.bincount(at, flags, minlength=len(first)) / count

    size = (ends - starts).astype(float)
    doc_words = np.bincount(rows, minlength=n)
    letters = share(_LETTER) * (end - begin)
    again = np.zeros(len(words), dtype=bool)
    again[1:] = (words[1:] == words[:-1]) & (rows[1:] == rows[:-1])

    def distinct(owner: np.ndarray, k: int) -> np.ndarray:
        _, one = np.unique(mix(words + mix(owner.astype(np.uint64))), return_index=True)
        return np.bincount(owner[one], minlength=k)

    in_line = distinct(at, len(first)) / count
    in_doc = (distinct(rows, n) / np.maximum(1, doc_words))[row]
    whole = np.zeros(len(data) + 1, dtype=np.int64)
    np.add.at(whole, begin, 1)
    np.add.at(whole, end, -1)
    text = word_hashes(data, np.cumsum(whole[:-1]) > 0, begin, end)
    copy = repeated(mix(text + mix(row.astype(np.uint64)))).astype(float)
    three, owner = shingle_hashes(words[doc_words[rows] >= 3], rows[doc_words[rows] >= 3], n, 3)
    twice = repeated(mix(three + mix(owner.astype(np.uint64))))
    place = (np.cumsum(doc_words) - doc_words)[owner] + np.arange(len(owner)) - np.searchsorted(owner, owner, side="left")
    echo = covered(place[twice], np.full(int(twice.sum()), 3), len(words)).astype(float)
    lines = np.bincount(row, minlength=n)
    copies = (np.bincount(row, copy, minlength=n) / np.maximum(1, lines))[row]
    echoes = (np.bincount(rows, echo, minlength=n) / np.maximum(1, doc_words))[row]
    odd = per_row(_ODD[data], offsets) / np.maximum(1, np.diff(offsets))
    features = np.column_stack([
        np.log1p(count), np.log1p(end - begin), mean(size), np.log1p(np.maximum.reduceat(size, first)),
        share(_ODD), share(_DIGIT), share(_UPPER, letters), share(_WIDE), share(_STOP), share(_PIPE),
        mean(again), in_line, in_doc, copy, mean(_UPPER[data[starts]]), _DOT[data[end - 1]], mean(size == 1),
        mean(echo), echoes, copies, np.log1p(doc_words[row]), np.log1p(lines[row]), odd[row], np.log1p(doc_words[row] / np.maximum(1, lines[row])),
    ])
    return features, count, row


class LineField:
    """Two states, bad and good; unary weights for the bins of the line before, the line itself and the line after."""

    def __init__(self, edges: np.ndarray, weights: np.ndarray, scale: tuple[float, float], prior: float):
        self.edges, self.weights, self.scale, self.prior = edges, weights, scale, prior

    @staticmethod
    def cells(edges: np.ndarray, features: np.ndarray, row: np.ndarray) -> np.ndarray:
        """Indices of the unary weights of every line: three for each feature."""
        n, f = features.shape
        width = edges.shape[1] + 2
        own = np.column_stack([np.searchsorted(edges[j], features[:, j], side="right") for j in range(f)]) if n else np.zeros((0, f), int)
        none = np.full((1, f), width - 1)
        before, after = np.concatenate([none, own[:-1]])[:n], np.concatenate([own[1:], none])[:n]
        start = np.ones(n, dtype=bool)
        start[1:] = row[1:] != row[:-1]
        before[start] = width - 1
        after[np.append(start[1:], True)[:n]] = width - 1
        base = np.arange(f) * width
        return np.concatenate([own + base, before + base + f * width, after + base + 2 * f * width], axis=1)

    @staticmethod
    def chain(unary: np.ndarray, turn: np.ndarray, first: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Forward-backward over all rows at once: (marginal of good, expected stays in bad and in good by row, log partition by row).

        ``unary``: log weight of good against bad for each line; ``turn``: log weights of staying bad and staying good.
        """
        n = len(unary)
        order = np.argsort(-count, kind="stable")
        first, count = first[order], count[order]
        steps = int(count[0]) if len(count) else 0
        active = np.searchsorted(-count, -np.arange(steps), side="left")  # rows with more than t lines
        top = np.maximum(unary, 0)
        emit = np.exp(np.column_stack([-top, unary - top]))
        move = np.exp(np.array([[turn[0], 0.0], [0.0, turn[1]]]))
        ahead, behind, norm = np.zeros((n, 2)), np.ones((n, 2)), np.ones(n)
        for t in range(steps):
            i = first[: active[t]] + t
            a = emit[i] if t == 0 else (ahead[i - 1] @ move) * emit[i]
            norm[i] = a.sum(axis=1)
            ahead[i] = a / norm[i, None]
        for t in range(steps - 2, -1, -1):
            i = first[: active[t + 1]] + t
            behind[i] = (emit[i + 1] * behind[i + 1]) @ move.T / norm[i + 1, None]
        marginal = ahead * behind
        marginal /= marginal.sum(axis=1, keepdims=True)
        inner = np.ones(n, dtype=bool)
        inner[first] = False
        j = np.flatnonzero(inner)
        pair = ahead[j - 1] * emit[j] * behind[j] / norm[j, None]
        stays = np.column_stack([pair[:, 0] * move[0, 0], pair[:, 1] * move[1, 1]]).sum(axis=0)
        return marginal[:, 1], stays, np.log(norm) + top

    @classmethod
    def fit(cls, features: np.ndarray, words: np.ndarray, row: np.ndarray, label: np.ndarray, steps: int = 40) -> LineField:
        """``label``: 0 or 1 for each row; every row has a line."""
        edges = np.quantile(features, BINS, axis=0).T
        cells = cls.cells(edges, features, row)
        width = 3 * features.shape[1] * (edges.shape[1] + 2)
        n, count = len(label), np.bincount(row, minlength=len(label))
        first = np.cumsum(count) - count
        shown = label[row].astype(float)
        # Expected labels and stays; at first each line is what its document's label says.
        good = shown
        stay = np.array([((count - 1) * (label == 0)).sum(), ((count - 1) * (label == 1)).sum()], dtype=float)
        weights = np.zeros(width + 2)
        for turn in range(ROUNDS):
            weights = minimise(lambda w: cls.loss(w, cells, first, count, good, stay, n), weights, steps)  # noqa: B023
            if turn + 1 < ROUNDS:
                # The chance that a good and that a bad line shows the label good, off 0 and 1.
                show_good = np.clip((good * shown).sum() / max(good.sum(), 1e-9), 0.05, 0.95)
                show_bad = np.clip(((1 - good) * shown).sum() / max((1 - good).sum(), 1e-9), 0.05, 0.95)
                says = np.where(shown > 0, np.log(show_good / show_bad), np.log((1 - show_good) / (1 - show_bad)))
                good, stay, _ = cls.chain(weights[:width][cells].sum(axis=1) + says, weights[width:], first, count)
        field = cls(edges, weights, (0.0, 1.0), float(label.mean()))
        raw = np.log(field.means(features, words, row, n))
        x = raw - np.log1p(-np.exp(raw))
        a, b = 0.0, 1.0
        for _ in range(25):  # Newton steps of a logistic curve in one variable
            p = 1 / (1 + np.exp(-(a + b * x)))
            s = p * (1 - p) + 1e-9
            g = np.array([(label - p).sum(), ((label - p) * x).sum() - 1e-2 * (b - 1)])
            h = np.array([[s.sum(), (s * x).sum()], [(s * x).sum(), (s * x * x).sum() + 1e-2]])
            da, db = np.linalg.solve(h + 1e-6 * np.eye(2), g)
            a, b = a + float(np.clip(da, -2, 2)), b + float(np.clip(db, -2, 2))
        field.scale = (a, max(b, 1e-3))
        return field

    @classmethod
    def loss(cls, w: np.ndarray, cells: np.ndarray, first: np.ndarray, count: np.ndarray, good: np.ndarray, stay: np.ndarray, n: int) -> tuple[float, np.ndarray]:
        """Penalised negative log-likelihood of expected line labels and stays for each document, and its slope."""
        width = len(w) - 2
        unary, turn = w[:width][cells].sum(axis=1), w[width:]
        got, stays, logs = cls.chain(unary, turn, first, count)
        value = (logs.sum() - (unary * good).sum() - (turn * stay).sum()) + PENALTY * (w @ w) / 2
        slope = np.empty_like(w)
        slope[:width] = np.bincount(cells.ravel(), np.repeat(got - good, cells.shape[1]), minlength=width)
        slope[width:] = stays - stay
        return value / n, (slope + PENALTY * w) / n

    def means(self, features: np.ndarray, words: np.ndarray, row: np.ndarray, n: int) -> np.ndarray:
        """Length-weighted mean marginal of good for each row, kept off 0 and 1; rows without a line get one half."""
        count = np.bincount(row, minlength=n)
        have = np.flatnonzero(count)
        out = np.full(n, 0.5)
        if len(have):
            size = count[have]
            unary = self.weights[:-2][self.cells(self.edges, features, row)].sum(axis=1)
            good, _, _ = self.chain(unary, self.weights[-2:], np.cumsum(size) - size, size)
            out[have] = np.bincount(row, good * words, minlength=n)[have] / np.bincount(row, words, minlength=n)[have]
        return np.clip(out, 1e-6, 1 - 1e-6)

    def score(self, features: np.ndarray, words: np.ndarray, row: np.ndarray, n: int) -> np.ndarray:
        mean = self.means(features, words, row, n)
        out = 1 / (1 + np.exp(-(self.scale[0] + self.scale[1] * np.log(mean / (1 - mean)))))
        out[np.bincount(row, minlength=n) == 0] = self.prior
        return out


def minimise(loss, w: np.ndarray, steps: int, memory: int = 8) -> np.ndarray:
    """L-BFGS with backtracking."""
    value, slope = loss(w)
    past: list[tuple[np.ndarray, np.ndarray, float]] = []
    for _ in range(steps):
        q, used = slope.copy(), []
        for s, y, r in reversed(past):
            used.append(r * (s @ q))
            q -= used[-1] * y
        if past:
            s, y, r = past[-1]
            q *= (s @ y) / (y @ y)
        for (s, y, r), a in zip(past, reversed(used), strict=True):
            q += s * (a - r * (y @ q))
        fall, size = slope @ q, 1.0 if past else 1.0 / max(1.0, np.abs(slope).sum())
        for _ in range(25):
            new = w - size * q
            new_value, new_slope = loss(new)
            if new_value <= value - 1e-4 * size * fall:
                break
            size /= 2
        else:
            break
        s, y = new - w, new_slope - slope
        if s @ y > 1e-12:
            past = [*past[-memory + 1 :], (s, y, 1 / (s @ y))]
        done = value - new_value < 1e-6 * max(1.0, abs(value))
        w, value, slope = new, new_value, new_slope
        if done:
            break
    return w


def fold(id_column, n: int):
    return F.pmod(F.crc32(id_column.cast("string")), F.lit(n))


def fit_quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", train_docs: int = TRAIN_DOCS, train_lines: int = TRAIN_LINES) -> LineField | None:
    """Fit on the ``train_docs`` labelled training documents with the smallest hashes, as far as their lines fit into ``train_lines``."""
    known = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull() & (fold(F.col(id_col), 5) != 0)).groupBy(id_col).agg(F.min(label_col).cast("int").alias("_label"))
    chosen = known.orderBy(F.xxhash64(id_col), id_col).limit(train_docs)
    picked = docs.select(id_col, docs[text_col].cast("string").alias("text")).join(F.broadcast(chosen), id_col).select(F.xxhash64(id_col).alias("at"), F.col("_label").alias("label"), "text", F.xxhash64("text").alias("of"))
    schema = "at long, label int, of long, n long, lines binary, words binary"

    def step(batch: pa.RecordBatch) -> pa.RecordBatch:
        features, words, row = line_features(batch.column(2))
        edge = np.searchsorted(row, np.arange(batch.num_rows + 1))
        part = [slice(edge[i], edge[i + 1]) for i in range(batch.num_rows)]
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(3), pa.array(np.diff(edge)), pa.array([features[p].astype("<f4").tobytes() for p in part], pa.binary()), pa.array([words[p].astype("<i8").tobytes() for p in part], pa.binary())], names=["at", "label", "of", "n", "lines", "words"])

    # Of rows that share an id, one is learnt from, so that the driver gets ``train_docs`` rows at most.
    lines = map_text(picked, lambda: step, T._parse_datatype_string(schema)).where("n > 0")
    found = checkpoint(lines.groupBy("at").agg(F.min(F.struct("of", "label", "n", "lines", "words")).alias("r")).select("at", "r.*"))
    sizes = sorted((r["at"], r["n"]) for r in found.select("at", "n").collect())
    left, take = train_lines, []
    for at, n in sizes:
        if n <= left:
            take.append(at)
            left -= n
    rows = sorted((r["label"], bytes(r["lines"]), bytes(r["words"])) for r in found.where(F.col("at").isin(take)).collect()) if len(take) < len(sizes) else sorted((r["label"], bytes(r["lines"]), bytes(r["words"])) for r in found.collect())
    if not rows:
        return None
    words = [np.frombuffer(r[2], "<i8") for r in rows]
    features = np.concatenate([np.frombuffer(r[1], "<f4").reshape(len(w), -1) for r, w in zip(rows, words, strict=True)]).astype(float)
    return LineField.fit(features, np.concatenate(words), np.repeat(np.arange(len(rows)), [len(w) for w in words]), np.array([r[0] for r in rows]))


def score_quality(docs: DataFrame, model: LineField | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and score of every whole text."""
    fields = T.StructType([id_field(docs, id_col), T.StructField("score", T.DoubleType())])

    def step(batch: pa.RecordBatch) -> pa.RecordBatch:
        n = batch.num_rows
        score = model.score(*line_features(batch.column(1)), n) if model else np.full(n, 0.5)
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(score)], names=fields.names)

    return map_text(docs.select(id_col, docs[text_col].cast("string").alias("text")), lambda: step, fields)


def op6_quality_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = score_quality(docs, fit_quality(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", F.coalesce(fold(F.col("doc_id"), 5) == 0, F.lit(False)).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def keep_quality(docs: DataFrame, model: LineField | None, threshold: float = THRESHOLD, text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns, whose text scores ``threshold`` or more."""

    def step(batch: pa.RecordBatch) -> pa.RecordBatch:
        column = batch.column(batch.schema.get_field_index(text_col))
        return batch.filter(pa.array(model.score(*line_features(column), batch.num_rows) >= threshold)) if model else batch

    return map_text(docs, lambda: step, docs.schema, column=text_col)

"""Operator 13: language identification with a linear-chain conditional random field over words.

Every word of a text is labelled with a language.  A word's weights come from hashed features: the word itself
(lexicon), runs of 2, 3 and 4 bytes that touch its begin or end (affixes) and runs inside it (n-grams).  Learned
transitions carry the context, so that a word which both languages share goes with its neighbours, and a text may
switch.  Forward-backward gives the marginals of each word; a text's language has the greatest mean marginal,
weighted by the words' lengths, and that mean is its score.

The field is fitted on a bounded sample: at most ``train_pieces`` pieces of up to 400 characters, an equal number of
each language, from anywhere in the whole texts of the documents with the smallest hashes.  Laid out in lines of up
to ``LINE`` words, they follow each other in a random order in one chain, so switches are learnt too.  Only rows with
crc32(doc_id as text) mod 5 not 0 and a language are used.

A batch of texts is one chain with a new start at each text.  Products of the transfer matrices over blocks of
about the square root of its length give each block's first message, and all blocks then go forward and backward
side by side; the result is that of the plain recursion over the whole text, however long it is.

Defined results: ``und`` and score 0 for a null or empty text, one without a letter, or when nothing was learnt;
ties go to the language that sorts first; repeated rows give repeated results; a text is labelled whole; an empty
table gives an empty table; only id, text and lang are read, so other columns cannot clash.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from folioscope.llm._common import checkpoint, id_field, map_text, table
from folioscope.llm._kernels import mix, text_bytes
from folioscope.llm.quality_crf import fold, minimise

TRAIN_PIECES = 2400
#: Pieces of up to 400 characters, cut between words where there is a place for it; they cover a whole text.
PIECE = r"(?s)\S(?:.{0,399}(?!\S)|.{0,399})"
LINE, BUCKETS, PENALTY, STEPS = 12, 1 << 16, 0.05, 30
UNKNOWN = "und"
#: Documents that the sample is taken from, in multiples of its pieces.
SPARE = 4

_LETTER = np.zeros(256, dtype=bool)
_LETTER[[*range(65, 91), *range(97, 123), *range(128, 256)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_EDGE = np.uint8(32)
_MIX = np.uint64(0x9E3779B97F4A7C15)


def words_of(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(lower-cased bytes, start, end, row) of the runs of letters; bytes from 128 on count as letters."""
    data = _LOWER[data]
    letter = _LETTER[data]
    edge = np.zeros(len(data) + 1, dtype=bool)
    edge[offsets] = True
    before, after = np.zeros(len(data), dtype=bool), np.zeros(len(data), dtype=bool)
    before[1:], after[:-1] = letter[:-1], letter[1:]
    starts = np.flatnonzero(letter & (~before | edge[:-1]))
    ends = np.flatnonzero(letter & (~after | edge[1:])) + 1
    return data, starts, ends, np.searchsorted(offsets[1:], starts, side="right")


def word_kinds(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(index of each word's kind, features of all kinds in a row, first feature of each kind): equal words are one kind."""
    none = np.zeros(0, np.int64)
    if not len(starts):
        return none, none, none
    size = ends - starts
    # Words between edge bytes, one after the other: _the_and_
    span = size + 1
    first = np.cumsum(span) - span + 1
    laid = np.full(int(span.sum()) + 1, _EDGE, dtype=np.uint8)
    owner = np.repeat(np.arange(len(starts)), size)
    inner = np.arange(len(owner)) - np.repeat(np.cumsum(size) - size, size)
    laid[first[owner] + inner] = data[starts[owner] + inner]
    whole = np.add.reduceat(mix(laid[first[owner] + inner].astype(np.uint64) + (inner.astype(np.uint64) + np.uint64(1)) * _MIX), np.cumsum(size) - size)
    _, one, kind = np.unique(mix(whole + size.astype(np.uint64)), return_index=True, return_inverse=True)
    first, size, whole = first[one], size[one], whole[one]
    parts, counts = [mix(whole) % np.uint64(BUCKETS)], [np.ones(len(one), np.int64)]
    owners = [np.arange(len(one))]
    for n in (2, 3, 4):
        # Runs of n bytes from the edge before the word to the edge after it.
        count = np.maximum(0, size + 3 - n)
        own = np.repeat(np.arange(len(one)), count)
        at = first[own] - 1 + np.arange(len(own)) - np.repeat(np.cumsum(count) - count, count)
        code = np.full(len(own), n, dtype=np.uint64)
        for j in range(n):
            code = code << np.uint64(8) | laid[at + j].astype(np.uint64)
        parts.append(mix(code) % np.uint64(BUCKETS))
        owners.append(own)
        counts.append(count)
    order = np.argsort(np.concatenate(owners), kind="stable")
    total = np.sum(counts, axis=0)
    return kind, np.concatenate(parts)[order].astype(np.int64), np.cumsum(total) - total


def forward_backward(emit: np.ndarray, fresh: np.ndarray, turn: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """(marginals, expected transitions, log partition) of a chain that starts anew where ``fresh``.

    ``emit``: positive weights of the labels at each place; ``turn``: positive weights of their transitions.
    """
    n, k = emit.shape
    if not n:
        return np.zeros((0, k)), np.zeros((k, k)), 0.0
    top = emit.max(axis=1, keepdims=True)
    emit, logs = emit / top, float(np.log(top).sum())
    width = int(np.ceil(np.sqrt(n)))
    blocks = -(-n // width)
    wide = np.ones((blocks * width, k))
    wide[:n] = emit
    start = np.ones(blocks * width, dtype=bool)
    start[:n] = fresh
    start[0] = True
    wide, start = wide.reshape(blocks, width, k), start.reshape(blocks, width)
    once = np.ones((k, k))

    def move(t: int) -> np.ndarray:
        return np.where(start[:, t, None, None], once, turn)

    product = np.broadcast_to(np.eye(k), (blocks, k, k))
    for t in range(width):
        product = (product @ move(t)) * wide[:, t, None, :]
        product = product / product.sum(axis=(1, 2), keepdims=True)
    enter, leave = np.full((blocks, k), 1 / k), np.ones((blocks, k))
    for b in range(1, blocks):
        enter[b] = enter[b - 1] @ product[b - 1]
        enter[b] /= enter[b].sum()
    for b in range(blocks - 2, -1, -1):
        leave[b] = product[b + 1] @ leave[b + 1]
        leave[b] /= leave[b].sum()
    ahead, behind, pairs, message = np.empty_like(wide), np.empty_like(wide), np.zeros((k, k)), enter
    norm = np.empty((blocks, width))
    for t in range(width):
        message = np.where(start[:, t, None], 1.0, message @ turn) * wide[:, t]
        norm[:, t] = message.sum(axis=1)
        message = message / norm[:, t, None]
        ahead[:, t] = message
    message = leave
    for t in range(width - 1, -1, -1):
        behind[:, t] = message
        came = enter if t == 0 else ahead[:, t - 1]
        after = wide[:, t] * message
        pair = came[:, :, None] * turn * after[:, None, :]
        real = ~start[:, t]
        pairs += (pair[real] / pair[real].sum(axis=(1, 2), keepdims=True)).sum(axis=0)
        message = np.where(start[:, t, None], 1.0, after @ turn.T)
        message = message / message.sum(axis=1, keepdims=True)
    marginal = (ahead * behind).reshape(-1, k)[:n]
    return marginal / marginal.sum(axis=1, keepdims=True), pairs, logs + float(np.log(norm.reshape(-1)[:n]).sum())


class WordField:
    """Weights of hashed features by language, and of the transitions between languages."""

    def __init__(self, names: list[str], weights: np.ndarray, turn: np.ndarray):
        self.names, self.weights, self.turn = names, weights.astype(np.float32), turn

    @classmethod
    def fit(cls, names: list[str], texts: list[bytes], labels: np.ndarray, steps: int = STEPS, seed: int = 7) -> WordField:
        k, offsets = len(names), np.concatenate([[0], np.cumsum([len(t) for t in texts])])
        data, starts, ends, row = words_of(np.frombuffer(b"".join(texts), np.uint8), offsets)
        kind, features, first = word_kinds(data, starts, ends)
        # Lines of one text each, in a random order: a chain that switches language now and then.
        fresh = np.ones(len(row), dtype=bool)
        fresh[1:] = row[1:] != row[:-1]
        place = np.arange(len(row)) - np.maximum.accumulate(np.where(fresh, np.arange(len(row)), 0))
        line = np.cumsum(fresh | (place % LINE == 0)) - 1
        shuffled = np.random.default_rng(seed).permutation(int(line[-1]) + 1)
        order = np.argsort(shuffled[line], kind="stable")
        kind, label = kind[order], labels[row[order]]
        start = np.zeros(len(kind), dtype=bool)
        start[0] = True
        said = np.zeros((len(kind), k))
        said[np.arange(len(kind)), label] = 1
        seen = np.zeros((k, k))
        np.add.at(seen, (label[:-1], label[1:]), 1)
        size = np.diff(np.append(first, len(features)))
        at = np.repeat(np.arange(len(first)), size)
        n_kinds, used = len(first), BUCKETS * k

        def loss(w: np.ndarray) -> tuple[float, np.ndarray]:
            weights, turn = w[:used].reshape(BUCKETS, k), w[used:].reshape(k, k)
            unary = np.add.reduceat(weights[features], first)[kind]
            top = unary.max(axis=1, keepdims=True)
            marginal, pairs, logs = forward_backward(np.exp(unary - top), start, np.exp(turn))
            value = logs + top.sum() - (unary * said).sum() - (turn * seen).sum() + PENALTY * (w @ w) / 2
            miss = marginal - said
            slope = np.empty_like(w)
            for j in range(k):
                by_kind = np.bincount(kind, miss[:, j], minlength=n_kinds)
                slope[:used].reshape(BUCKETS, k)[:, j] = np.bincount(features, by_kind[at], minlength=BUCKETS)
            slope[used:] = (pairs - seen).ravel()
            return value / len(kind), (slope + PENALTY * w) / len(kind)

        w = minimise(loss, np.zeros(used + k * k), steps)
        return cls(names, w[:used].reshape(BUCKETS, k), w[used:].reshape(k, k))

    def label(self, column) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(marginals, start, end, row) of every word of an Arrow column of texts; positions are bytes of the whole column."""
        data, offsets = text_bytes(column)
        data, starts, ends, row = words_of(data, offsets)
        kind, features, first = word_kinds(data, starts, ends)
        if not len(row):
            return np.zeros((0, len(self.names))), starts, ends, row
        unary = np.add.reduceat(self.weights[features], first).astype(float)
        emit = np.exp(unary - unary.max(axis=1, keepdims=True))[kind]
        fresh = np.ones(len(row), dtype=bool)
        fresh[1:] = row[1:] != row[:-1]
        return forward_backward(np.maximum(emit, 1e-30), fresh, np.exp(self.turn))[0], starts, ends, row

    def means(self, column) -> np.ndarray:
        """Length-weighted mean marginals of every text; 0 where it has no word."""
        marginal, starts, ends, row = self.label(column)
        n, size = len(column), (ends - starts).astype(float)
        total = np.column_stack([np.bincount(row, marginal[:, j] * size, minlength=n) for j in range(len(self.names))])
        return total / np.maximum(1, np.bincount(row, size, minlength=n))[:, None]


def has_letter(column) -> np.ndarray:
    """Whether each text has a letter in the sense of Unicode."""
    data, offsets = text_bytes(column)
    plain = np.concatenate([[0], np.cumsum(_LETTER[data] & (data < 128))])
    out = plain[offsets[1:]] > plain[offsets[:-1]]
    for i in np.flatnonzero(~out & (np.diff(offsets) > 0)):
        out[i] = any(c.isalpha() for c in column[int(i)].as_py())
    return out


def fit_languages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", train_pieces: int = TRAIN_PIECES) -> WordField | None:
    """Fit on ``train_pieces`` pieces of texts at most, shared equally by the languages.

    With more languages than pieces, the languages that sort first have one each.
    """
    text = docs[text_col].cast("string")
    known = docs.where(docs[lang_col].isNotNull() & docs[id_col].isNotNull() & (fold(docs[id_col], 5) != 0) & text.rlike(r"\p{L}"))
    rows = known.select(docs[lang_col].cast("string").alias("lang"), F.xxhash64(docs[id_col], text).alias("at"), text.alias("text"))
    counts = rows.groupBy("lang").count().orderBy("lang").limit(train_pieces).collect()
    if not counts:
        return None
    share = max(1, train_pieces // len(counts))
    # Hashes are spread evenly, so the smallest ones, a few times the share, are enough to choose from; copies count once.
    part = F.create_map(*(F.lit(x) for r in counts for x in (r["lang"], min(1.0, SPARE * share / r["count"]))))
    near = rows.where((F.col("at") / float(1 << 63) + 1) / 2 <= part[F.col("lang")])
    pieces = near.select("lang", F.explode(F.regexp_extract_all("text", F.lit(PIECE), F.lit(0))).alias("text")).where(F.col("text").rlike(r"\p{L}"))
    once = pieces.groupBy("lang", F.xxhash64("text").alias("at")).agg(F.min("text").alias("text"))
    picked = checkpoint(once.withColumn("_rank", F.row_number().over(W.partitionBy("lang").orderBy("at"))).where(F.col("_rank") <= share)).collect()
    names = sorted({r["lang"] for r in picked})
    texts = sorted((names.index(r["lang"]), r["text"].encode()) for r in picked)
    return WordField.fit(names, [t for _, t in texts], np.array([k for k, _ in texts]))


def identified(docs: DataFrame, model: WordField | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, lang_pred and score of every whole text."""
    fields = T.StructType([id_field(docs, id_col), T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        field = sent.value

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            n, column = batch.num_rows, batch.column(1)
            names, score = np.full(n, UNKNOWN, dtype=object), np.zeros(n)
            if field is not None:
                mean, letters = field.means(column), has_letter(column)
                names = np.where(letters, np.array(field.names, dtype=object)[mean.argmax(axis=1)], UNKNOWN)
                score = np.where(letters, np.clip(mean.max(axis=1), 0, 1), 0.0)
            return pa.RecordBatch.from_arrays([batch.column(0), pa.array(names, pa.string()), pa.array(score)], names=fields.names)

        return step

    return map_text(docs.select(id_col, docs[text_col].cast("string").alias("text")), make, fields)


def labelled_words(docs: DataFrame, model: WordField, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id and ``words``, an array of (word, lang, score) in order, of every text: the switches inside it."""
    words = T.ArrayType(T.StructType([T.StructField("word", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("score", T.DoubleType())]))
    fields = T.StructType([id_field(docs, id_col), T.StructField("words", words)])

    def step(batch: pa.RecordBatch) -> pa.RecordBatch:
        data, _ = text_bytes(batch.column(1))
        marginal, starts, ends, row = model.label(batch.column(1))
        raw, best = data.tobytes(), marginal.argmax(axis=1) if len(row) else []
        out: list[list[dict]] = [[] for _ in range(batch.num_rows)]
        for i, a, b, r in zip(range(len(row)), starts, ends, row, strict=True):
            out[r].append({"word": raw[a:b].decode(), "lang": model.names[best[i]], "score": float(marginal[i, best[i]])})
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.list_(pa.struct([("word", pa.string()), ("lang", pa.string()), ("score", pa.float64())])))], names=fields.names)

    return map_text(docs.select(id_col, docs[text_col].cast("string").alias("text")), lambda: step, fields)


def op13_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = identified(docs, fit_languages(docs))
    return out.select("doc_id", F.coalesce(fold(F.col("doc_id"), 5) == 0, F.lit(False)).alias("held_out"), "lang_pred", "score")

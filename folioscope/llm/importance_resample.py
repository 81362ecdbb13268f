"""Operator 11: resampling documents by their importance for a target corpus.

Features are runs of 1 to ``longest`` consecutive words, hashed into buckets by the CRC-32 of their text.  Each
task walks its texts through a word trie of its own: a node is a run of words and holds its count and the CRC of
its text so far, so a run's bucket follows from its first words' node without hashing these again.  A trie that
has grown to ``TRIE_NODES`` nodes adds its counts to the task's bucket totals and starts anew, so memory doesn't
follow the vocabulary.  Spark adds up the bucket totals of all tasks; the gain of a bucket is the log of how much
likelier it is in the target corpus.  A second walk scores each document through nodes with gains attached.

Scores are whole numbers; the score at which the draw ends is found from the number of documents at each score.
Only the documents from there on are sorted, by range partitions, and ranked by the sizes of these, so nothing is
ordered in one task.  The gains (one number for each bucket) and the score counts (whole numbers between bounds
that follow from the formula) are all that the driver sees.

Defined results: a null text, or one without a word, has no feature and weight 0; it can't be drawn; a null id
draws with the text of a null, ``seed:``; equal scores are drawn by id, nulls first, and repeated rows in any
order, as they are equal; rows of one id and score that differ in their text come by the number of features and
the weight; a very long text is counted and scored whole, in parts; an empty corpus draws nothing, and an empty
target has gains that follow from the formula; only the columns named are read, so others cannot clash.
"""

from __future__ import annotations

import math
import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from folioscope.llm._common import LOWER, UPPER, checkpoint, id_field, map_text, table
from folioscope.llm.conversation_repair import sql_crc32

LONGEST, BUCKETS = 1, 10_000
LEAST_WORDS, PERCENT, SEED = 20, 10, 2024
TRIE_NODES = 1 << 18
#: Words of a text that are held at once.
CHUNK = 1 << 16
WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
_LOWER = bytes.maketrans(UPPER.encode(), LOWER.encode())


class Node(dict):
    """A run of words in a trie: what may follow it, the CRC-32 of its text, and its count or gain."""

    __slots__ = ("crc", "depth", "trie", "value")

    def __init__(self, trie: Trie, crc: int, depth: int):
        self.trie, self.crc, self.depth, self.value = trie, crc, depth, 0
        trie.made(self)

    def __missing__(self, word: bytes) -> Node:
        node = self[word] = Node(self.trie, zlib.crc32(word if not self.depth else b" " + word, self.crc), self.depth + 1)
        return node


class Trie:
    """Runs of up to ``longest`` words.  With ``gains`` nodes have their bucket's gain, else counts that go to ``totals``."""

    def __init__(self, longest: int, buckets: int, gains: list[int] | None = None, most: int = TRIE_NODES):
        self.longest, self.buckets, self.gains, self.most = longest, buckets, gains, most
        self.totals = np.zeros(buckets, np.int64)
        self.clear()

    def clear(self) -> None:
        self.size, self.counted = 0, []
        self.root = Node(self, 0, 0)

    def made(self, node: Node) -> None:
        self.size += 1
        if self.gains is not None:
            node.value = self.gains[node.crc % self.buckets]
        elif node.depth:
            self.counted.append(node)

    def flush(self) -> None:
        """Add the counts of all nodes to the totals, and forget the nodes."""
        n = len(self.counted)
        np.add.at(self.totals, np.fromiter((x.crc for x in self.counted), np.int64, n) % self.buckets, np.fromiter((x.value for x in self.counted), np.int64, n))
        self.clear()

    def walk(self, text: bytes) -> tuple[int, int, int]:
        """(words, features, summed gain) of a text; without gains its features are counted."""
        words, features, gain, held = 0, 0, 0, []
        found = WORD.finditer(text.translate(_LOWER))
        while True:
            # Runs may begin in one chunk and end in the next: the last words of a chunk are held over.
            fresh = [m.group() for _, m in zip(range(CHUNK), found, strict=False)]
            if self.size > self.most:
                self.flush()
            words += len(fresh)
            if self.longest == 1:
                features += len(fresh)
                if self.gains is None:
                    for word in fresh:
                        self.root[word].value += 1
                else:
                    gain += sum(self.root[word].value for word in fresh)
            else:
                line = held + fresh
                for i in range(len(line)):
                    node = self.root
                    for j, word in enumerate(line[i : i + self.longest], i + 1):
                        node = node[word]
                        if j > len(held):
                            features += 1
                            if self.gains is None:
                                node.value += 1
                            else:
                                gain += node.value
                held = line[-(self.longest - 1) :]
            if len(fresh) < CHUNK:
                return words, features, gain


def _texts(df: DataFrame, text_col: str, *more: Column) -> DataFrame:
    return df.select(*more, df[text_col].cast("string").alias("text"))


def bucket_totals(df: DataFrame, text_col: str = "text", longest: int = LONGEST, buckets: int = BUCKETS) -> DataFrame:
    """bucket and total of all features of a corpus."""
    schema = T.StructType([T.StructField("bucket", T.IntegerType()), T.StructField("total", T.LongType())])

    def run(batches):
        trie = Trie(longest, buckets)
        for batch in batches:
            for text in batch.column(0):
                if text.is_valid:
                    trie.walk(text.as_buffer().to_pybytes())
        trie.flush()
        at = np.flatnonzero(trie.totals)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(trie.totals[at])], names=schema.names)

    return _texts(df, text_col).mapInArrow(run, schema).groupBy("bucket").agg(F.sum("total").alias("total"))


def bucket_gains(corpus: DataFrame, target: DataFrame, buckets: int = BUCKETS) -> list[int]:
    """floor(1000 * ln of how much likelier a bucket is in the target), with one added to every bucket."""

    def dense(totals: DataFrame) -> list[int]:
        out = [0] * buckets
        for r in totals.collect():
            out[r["bucket"]] = r["total"]
        return out

    s, t = dense(corpus), dense(target)
    own, other = float(sum(s) + buckets), float(sum(t) + buckets)
    return [math.floor(1000 * math.log((b + 1) * own / ((a + 1) * other))) for a, b in zip(s, t, strict=True)]


def weighted(df: DataFrame, gains: list[int], id_col: str = "doc_id", text_col: str = "text", longest: int = LONGEST) -> DataFrame:
    """id, n_words, n_features and weight, the floored mean gain, of every document."""
    sent = df.sparkSession.sparkContext.broadcast(gains)
    fields = T.StructType([id_field(df, id_col), *(T.StructField(n, T.LongType()) for n in ("n_words", "n_features", "weight"))])

    def make():
        trie = Trie(longest, len(sent.value), sent.value)

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            rows = [trie.walk(text.as_buffer().to_pybytes()) if text.is_valid else (0, 0, 0) for text in batch.column(1)]
            words, features, gain = (np.array(c, np.int64) for c in zip(*rows, strict=True))
            return pa.RecordBatch.from_arrays([batch.column(0), pa.array(words), pa.array(features), pa.array(np.where(features > 0, gain // np.maximum(features, 1), 0))], names=fields.names)

        return step

    return map_text(_texts(df, text_col, F.col(id_col)), make, fields)


def noisy(weight: Column, id_column: Column, seed: int = SEED) -> Column:
    """The weight and floor(1000 * Gumbel noise) drawn by the id."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(id_column.cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    return weight + F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0)))


def ranked_draw(scored: DataFrame, percent: int = PERCENT, least: int = LEAST_WORDS, id_col: str = "doc_id") -> DataFrame:
    """``rank`` of the highest scores among the documents with ``least`` words; null for the others.

    ``scored`` has the columns of ``weighted`` and score, and is read several times.
    """
    may = F.col("n_words") >= least
    counts = scored.where(may).groupBy("score").count().collect()
    total = sum(r["count"] for r in counts)
    left = draw = percent * total // 100
    last = None
    for r in sorted(counts, key=lambda r: -r["score"]):
        if left > 0:
            last = r["score"]
        left -= r["count"]
    if last is None:
        return scored.withColumn("rank", F.lit(None).cast("long"))
    above = may & (F.col("score") >= last)
    order = [F.col("score").desc(), F.col(id_col).asc_nulls_first(), F.col("n_features"), F.col("weight"), F.col("_row")]
    # The place of a row in its table tells equal rows apart, so that they can lie in several partitions.
    numbered = checkpoint(scored.where(above).withColumn("_row", F.monotonically_increasing_id()))
    placed = checkpoint(numbered.orderBy(*order).withColumn("_at", F.monotonically_increasing_id()))
    part = F.shiftright("_at", 33)
    before = W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    sizes = placed.groupBy(part.alias("_part")).count().select("_part", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_before"))
    rank = F.col("_before") + F.col("_at").bitwiseAND(F.lit((1 << 33) - 1)) + 1
    drawn = placed.withColumn("_part", part).join(F.broadcast(sizes), "_part").withColumn("rank", F.when(rank <= draw, rank)).drop("_part", "_at", "_row", "_before")
    return drawn.unionByName(scored.where(~above).withColumn("rank", F.lit(None).cast("long")))


def importance_resample(corpus: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", target_col: str = "text", longest: int = LONGEST, buckets: int = BUCKETS, percent: int = PERCENT, least: int = LEAST_WORDS, seed: int = SEED) -> DataFrame:
    """id, n_words, n_features, weight, score and rank (null unless drawn) of every document."""
    gains = bucket_gains(bucket_totals(corpus, text_col, longest, buckets), bucket_totals(target, target_col, longest, buckets), buckets)
    scored = checkpoint(weighted(corpus, gains, id_col, text_col, longest).withColumn("score", noisy(F.col("weight"), F.col(id_col), seed)))
    return ranked_draw(scored, percent, least, id_col)


def resampled(corpus: DataFrame, target: DataFrame, id_col: str = "doc_id", **options) -> DataFrame:
    """The drawn documents, all columns, with their rank as ``_rank``; rows that share an id go or stay together."""
    drawn = importance_resample(corpus, target, id_col, **options).where("rank IS NOT NULL")
    first = drawn.groupBy(F.col(id_col).alias("_id")).agg(F.min("rank").alias("_rank"))
    return corpus.join(first, corpus[id_col].eqNullSafe(first["_id"])).drop("_id")


def op11_importance_resample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return importance_resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("n_words")


def _sql_words(source: str) -> str:
    return f"SELECT n, unnest(regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')) AS word FROM {source}"


ORACLE_SQL = f"""
WITH docs AS (SELECT row_number() OVER () AS n, doc_id, text FROM documents),
items AS (SELECT row_number() OVER () AS n, text FROM benchmark),
own AS MATERIALIZED (SELECT n, word, count(*) AS c FROM ({_sql_words("docs")}) GROUP BY ALL),
other AS MATERIALIZED (SELECT word, count(*) AS c FROM ({_sql_words("items")}) GROUP BY ALL),
words AS MATERIALIZED (SELECT word, {sql_crc32("word")} % {BUCKETS} AS bucket FROM (SELECT word FROM own UNION SELECT word FROM other)),
s AS (SELECT bucket, sum(c) AS c FROM own JOIN words USING (word) GROUP BY bucket),
t AS (SELECT bucket, sum(c) AS c FROM other JOIN words USING (word) GROUP BY bucket),
sums AS (SELECT (SELECT coalesce(sum(c), 0) FROM s)::DOUBLE + {BUCKETS} AS s_all, (SELECT coalesce(sum(c), 0) FROM t)::DOUBLE + {BUCKETS} AS t_all),
gains AS (SELECT bucket, floor(1000 * ln((coalesce(t.c, 0) + 1) * s_all / ((coalesce(s.c, 0) + 1) * t_all)))::BIGINT AS gain FROM s FULL JOIN t USING (bucket), sums),
means AS (SELECT n, sum(c)::BIGINT AS n_features, floor(sum(c * gain)::DOUBLE / sum(c))::BIGINT AS weight FROM own JOIN words USING (word) JOIN gains USING (bucket) GROUP BY n),
scored AS (
  SELECT doc_id, coalesce(n_features, 0)::BIGINT AS n_features, coalesce(weight, 0)::BIGINT AS weight,
         coalesce(weight, 0)::BIGINT + floor(-1000 * ln(-ln((('0x' || sha256('{SEED}:' || coalesce(doc_id::VARCHAR, ''))[1:8])::BIGINT + 0.5) / 4294967296.0::DOUBLE)))::BIGINT AS score
  FROM docs LEFT JOIN means USING (n)),
placed AS (SELECT *, row_number() OVER (PARTITION BY n_features >= {LEAST_WORDS} ORDER BY score DESC, doc_id NULLS FIRST, n_features, weight) AS place, count(*) FILTER (n_features >= {LEAST_WORDS}) OVER () AS many FROM scored)
SELECT doc_id, n_features, weight, score, CASE WHEN n_features >= {LEAST_WORDS} AND place <= {PERCENT} * many // 100 THEN place END::BIGINT AS rank FROM placed
"""

"""Nearest neighbours through an inverted file: vectors in lists by their nearest centroid, residuals as codes.

Centroids and code books are fitted on a bounded sample, which also tells how many lists have to be probed.  A vector's residual from its centroid is cut in
stretches, and each stretch is named by the nearest of 16 patterns: half a byte for a few dimensions.  A query
goes to its ``probes`` nearest lists; in each, distances are summed up from a table of 16 entries a stretch, the
best ``keep`` candidates are compared exactly, and the best ``k`` of all lists remain.

Queries and lists meet in a join by list.  A list is cut into blocks of ``BLOCK`` vectors and its queries into
as many as a task takes, so neither a list that holds a third of all vectors nor one that all queries ask
fills a task.  The index is stored sorted by list, so that a probe reads the row groups of its lists.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscope.lineage import cut
from folioscope.operators.search import ranked

SAMPLE, LISTS, STRETCH, PATTERNS, ROUNDS = 20_000, 64, 4, 16, 12
#: Share of neighbours that the lists a query probes have to hold, and the queries and neighbours it is measured with.
RECALL, TRIED, NEIGHBOURS = 0.97, 500, 10
BLOCK, ASKED = 50_000, 2_000


def _means(points: np.ndarray, n: int, rng: np.random.Generator, rounds: int = ROUNDS) -> np.ndarray:
    """Centres of ``n`` groups of points; a group that has lost all its points takes one of the farthest."""
    centres = points[rng.permutation(len(points))[:n]].astype(np.float64)
    if len(centres) < n:
        centres = np.concatenate([centres, np.zeros((n - len(centres), points.shape[1]))])
    for _ in range(rounds):
        away = ((points**2).sum(1)[:, None] - 2 * points @ centres.T) + (centres**2).sum(1)
        near = away.argmin(1)
        count = np.bincount(near, minlength=n)
        total = np.zeros_like(centres)
        np.add.at(total, near, points)
        far = np.argsort(-away[np.arange(len(points)), near])
        centres = np.where(count[:, None] > 0, total / np.maximum(1, count)[:, None], centres)
        empty = np.flatnonzero(count == 0)[: len(far)]
        centres[empty] = points[far[: len(empty)]]
    return centres


def unit(rows: np.ndarray) -> np.ndarray:
    norms = np.sqrt((rows**2).sum(axis=1, keepdims=True))
    return np.divide(rows, norms, out=np.zeros_like(rows), where=norms > 0)


def _matrix(column: pd.Series, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(rows of unit length, whether a row is a vector): nulls, other lengths and elements that are no number are none."""
    out, good = np.zeros((len(column), width)), np.zeros(len(column), dtype=bool)
    for i, v in enumerate(column):
        if v is not None and len(v) == width:
            row = np.asarray(v, dtype=np.float64)
            if np.isfinite(row).all():
                out[i], good[i] = row, True
    return unit(out), good


@dataclass
class Quantizer:
    centroids: np.ndarray
    #: patterns by stretch
    books: list[np.ndarray]
    #: lists that a query goes to
    probes: int = 8

    @classmethod
    def fit(cls, sample: np.ndarray, lists: int = LISTS, stretch: int = STRETCH, seed: int = 5, recall: float = RECALL) -> Quantizer:
        rng = np.random.default_rng(seed)
        centroids = _means(sample, max(1, min(lists, len(sample))), rng)
        rest = sample - centroids[cls(centroids, []).lists(sample, 1)[:, 0]]
        books = [_means(rest[:, a : a + stretch], PATTERNS, rng) for a in range(0, sample.shape[1], stretch)]
        out = cls(centroids, books)
        out.probes = out.needed(sample, recall)
        return out

    def needed(self, sample: np.ndarray, recall: float) -> int:
        """The fewest lists that hold ``recall`` of the nearest neighbours of some vectors of the sample among all of it."""
        tried = sample[:TRIED]
        likeness = tried @ sample.T
        likeness[np.arange(len(tried)), np.arange(len(tried))] = -np.inf
        k = min(NEIGHBOURS, len(sample) - 1)
        if k < 1:
            return 1
        near = np.argpartition(-likeness, k - 1, axis=1)[:, :k]
        order = self.lists(tried, len(self.centroids))
        place = np.empty_like(order)
        np.put_along_axis(place, order, np.arange(order.shape[1])[None, :], axis=1)
        at = np.take_along_axis(place, self.lists(sample, 1)[:, 0][near], axis=1)
        return int(np.sort(at, axis=None)[min(at.size - 1, int(np.ceil(recall * at.size)) - 1)]) + 1

    @property
    def width(self) -> int:
        return self.centroids.shape[1]

    def lists(self, rows: np.ndarray, probes: int) -> np.ndarray:
        away = (self.centroids**2).sum(1) - 2 * rows @ self.centroids.T
        return np.argsort(away, axis=1, kind="stable")[:, :probes]

    def codes(self, rest: np.ndarray) -> np.ndarray:
        out, a = np.zeros((len(rest), len(self.books)), dtype=np.uint8), 0
        for j, book in enumerate(self.books):
            part = rest[:, a : a + book.shape[1]]
            out[:, j] = ((book**2).sum(1) - 2 * part @ book.T).argmin(1)
            a += book.shape[1]
        return out

    def estimates(self, query: np.ndarray, codes: np.ndarray, list_no: int) -> np.ndarray:
        """Squared distances of a query to the vectors that the codes in a list stand for."""
        rest, out, a = query - self.centroids[list_no], np.zeros(len(codes)), 0
        for j, book in enumerate(self.books):
            out += ((rest[a : a + book.shape[1]] - book) ** 2).sum(1)[codes[:, j]]
            a += book.shape[1]
        return out


@dataclass
class VectorIndex:
    #: list_no, block, item, codes (binary), v (the vector)
    entries: DataFrame
    quantizer: Quantizer
    item: str

    @classmethod
    def build(cls, items: DataFrame, item: str = "vec_id", vector: str = "embedding", lists: int = LISTS, sample: int = SAMPLE, stretch: int = STRETCH) -> VectorIndex:
        """Every vector is indexed; ``sample`` of them, those with the least hashes of their ids, fit the lists and codes."""
        rows = items.select(F.col(item).cast("long").alias("item"), F.col(vector).cast("array<double>").alias("v")).where("v IS NOT NULL AND item IS NOT NULL")
        picked = rows.orderBy(F.xxhash64("item"), "item").limit(sample).select("v").toPandas()["v"]
        width = max((len(v) for v in picked), default=0)
        points, good = _matrix(picked, width)
        if not good.any():
            raise ValueError("no vector to fit the index on")
        q = Quantizer.fit(points[good], lists, stretch)
        sent = items.sparkSession.sparkContext.broadcast(q)

        def coded(frames):
            own = sent.value
            for frame in frames:
                unit_rows, good = _matrix(frame["v"], own.width)
                if not good.any():
                    continue
                frame, unit_rows = frame[good], unit_rows[good]
                near = own.lists(unit_rows, 1)[:, 0]
                codes = own.codes(unit_rows - own.centroids[near])
                yield pd.DataFrame({"list_no": near.astype(np.int32), "item": frame["item"].to_numpy(), "codes": [c.tobytes() for c in codes], "v": list(frame["v"])})

        listed = rows.mapInPandas(coded, "list_no int, item long, codes binary, v array<double>")
        return cls(cls._blocked(listed), q, item)

    @staticmethod
    def _blocked(listed: DataFrame) -> DataFrame:
        listed = cut(listed)
        sizes = listed.groupBy("list_no").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
        return listed.join(F.broadcast(sizes), "list_no").select("list_no", F.pmod(F.xxhash64("item"), F.col("blocks")).cast("int").alias("block"), "item", "codes", "v")

    def search(self, queries: DataFrame, k: int, probes: int | None = None, keep: int = 64, query: str = "query_id", vector: str = "embedding") -> DataFrame:
        """query, item, distance (millionths of 1 - cosine) and rank of the k nearest found; no query goes through the driver."""
        probes = probes or self.quantizer.probes
        sent, columns = queries.sparkSession.sparkContext.broadcast(self.quantizer), [query, self.item, "distance"]

        def probed(frames):
            own = sent.value
            for frame in frames:
                rows, good = _matrix(frame["v"], own.width)
                if not good.any():
                    continue
                lists = own.lists(rows[good], probes)
                yield pd.DataFrame({"query": np.repeat(frame["query"].to_numpy()[good], lists.shape[1]), "list_no": lists.ravel().astype(np.int32), "q": [r for r in rows[good] for _ in range(lists.shape[1])]})

        asked = queries.select(F.col(query).cast("long").alias("query"), F.col(vector).cast("array<double>").alias("v")).where("v IS NOT NULL")
        asked = cut(asked.mapInPandas(probed, "query long, list_no int, q array<double>"))
        blocks = self.entries.groupBy("list_no").agg((F.max("block") + 1).alias("blocks"))
        groups = asked.groupBy("list_no").agg(F.ceil(F.count("*") / ASKED).cast("int").alias("groups"))
        left = asked.join(F.broadcast(groups), "list_no").withColumn("part", F.pmod(F.xxhash64("query"), F.col("groups")).cast("int")).join(F.broadcast(blocks), "list_no")
        left = left.select("list_no", "part", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), "query", "q")
        right = self.entries.join(F.broadcast(groups), "list_no").select("list_no", F.explode(F.sequence(F.lit(0), F.col("groups") - 1)).alias("part"), "block", "item", "codes", "v")

        def compared(key, few: pd.DataFrame, many: pd.DataFrame) -> pd.DataFrame:
            own = sent.value
            if not len(few) or not len(many):
                return pd.DataFrame({c: pd.Series(dtype="int64") for c in columns})
            codes = np.frombuffer(b"".join(many["codes"]), np.uint8).reshape(len(many), -1)
            rows, _ = _matrix(many["v"], own.width)
            names, out = many["item"].to_numpy(), []
            for name, q in zip(few["query"], few["q"], strict=True):
                q = np.asarray(q)
                guess = own.estimates(q, codes, int(key[0]))
                # All that are as near as the last one kept by their codes: equal codes can't tell which is nearer.
                best = np.flatnonzero(guess <= np.partition(guess, keep - 1)[keep - 1]) if len(guess) > keep else np.arange(len(guess))
                distance = np.floor((1 - rows[best] @ q) * 1e6 + 0.5).astype(np.int64)
                order = np.lexsort((names[best], distance))[:k]
                out.append(pd.DataFrame({columns[0]: name, columns[1]: names[best][order], "distance": distance[order]}))
            return pd.concat(out)

        keys = ["list_no", "part", "block"]
        found = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(compared, f"{query} long, {self.item} long, distance long")
        return ranked(found, query, [F.col("distance"), F.col(self.item)]).where(F.col("rank") <= k)

    def write(self, path: str) -> None:
        """Entries sorted by list, then the quantizer; an index without a quantizer isn't there yet."""
        self.entries.repartitionByRange("list_no", "block").sortWithinPartitions("list_no", "block").write.parquet(f"{path}/entries")
        q, spark = self.quantizer, self.entries.sparkSession
        rows = [("centroids", 0, q.centroids.ravel().tolist(), q.width, q.probes, self.item), *(("book", j, b.ravel().tolist(), b.shape[1], q.probes, self.item) for j, b in enumerate(q.books))]
        spark.createDataFrame(rows, "kind string, place int, v array<double>, width int, probes int, item string").coalesce(1).write.parquet(f"{path}/quantizer")

    @classmethod
    def read(cls, spark: SparkSession, path: str) -> VectorIndex:
        rows = sorted(spark.read.parquet(f"{path}/quantizer").collect(), key=lambda r: (r["kind"], r["place"]))
        parts = [np.array(r["v"]).reshape(-1, r["width"]) for r in rows if r["kind"] == "book"]
        centre = next(r for r in rows if r["kind"] == "centroids")
        return cls(spark.read.parquet(f"{path}/entries"), Quantizer(np.array(centre["v"]).reshape(-1, centre["width"]), parts, centre["probes"]), centre["item"])

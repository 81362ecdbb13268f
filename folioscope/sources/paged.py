"""Paged documents as a data source: files with an index of their pages, read by page ranges.

A file holds its pages one after the other and ends with the offsets of all pages, their number and a mark, so
that any page can be read without those before it.  A page has a text and images with their places.  Planning
reads the last bytes of each file; a task reads the bytes of one range of pages.  Conditions on the path and the
page number leave out files and ranges before anything is read.

``spark.read.format("paged").option("range", 50).load(folder)`` gives each range to a task of its own; with
``option("task", bytes)`` a task reads ranges, of several files too, until it has so many bytes.  Both after ``register``; any store that pyarrow opens.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import groupby

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual

MARK, SUFFIX, RANGE = b"PAGES001", ".paged", 50
#: Bytes of the ranges that ``read_paged`` gives to a task, so that the tasks follow the bytes and not the files.
TASK_BYTES = 4 << 20
IMAGES = "array<struct<x0:double,y0:double,x1:double,y1:double,digest:string>>"
SCHEMA = f"path string, page int, text string, digest string, images {IMAGES}"


def _opened(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if re.match(r"[a-z0-9]+:", path) else (fs.LocalFileSystem(), path)


def cleaned(text: str) -> str:
    """As ``clean_text`` cleans a column."""
    out = re.sub(r"\r\n?", "\n", text)
    out = re.sub(r"\n{3,}", "\n\n", re.sub(r"[\t\f\x0b]", " ", out))
    return re.sub(r" ?\n ?", "\n", re.sub(r" {2,}", " ", out)).strip(" \t\n\x0b\f\r")


def short_digest(data: bytes) -> str:
    """16 hex digits of the sha-256."""
    return hashlib.sha256(data).hexdigest()[:16]


def packed(pages: list[dict]) -> bytes:
    """The bytes of a file: pages are {text, images: [[x0, y0, x1, y1, hex bytes], ...]}."""
    bodies = [json.dumps({"text": p.get("text") or "", "images": p.get("images") or []}).encode() for p in pages]
    ends, at = [0], 0
    for b in bodies:
        at += len(b)
        ends.append(at)
    return b"".join(bodies) + b"".join(e.to_bytes(8, "little") for e in ends) + len(bodies).to_bytes(8, "little") + MARK


def write_paged(pages: DataFrame, folder: str) -> int:
    """Write (document, page, text) rows as a file for each document; the number of files."""
    from pyarrow import fs

    where, base = _opened(folder)
    where.create_dir(base, recursive=True)

    def save(frame: pd.DataFrame) -> pd.DataFrame:
        own, root = _opened(folder)
        name = f"{root}/{frame['document'].iloc[0]}{SUFFIX}"
        body = packed([{"text": t} for t in frame.sort_values("page")["text"]])
        with own.open_output_stream(f"{name}.part") as out:
            out.write(body)
        own.move(f"{name}.part", name)
        return pd.DataFrame({"path": [name]})

    assert isinstance(where, fs.FileSystem)
    return pages.groupBy("document").applyInPandas(save, "path string").count()


@dataclass
class PageRange(InputPartition):
    path: str
    first: int
    last: int

    def __init__(self, path: str, first: int, last: int):
        super().__init__((path, first, last))
        self.path, self.first, self.last = path, first, last


@dataclass
class PageRanges(InputPartition):
    ranges: list[PageRange]

    def __init__(self, ranges: list[PageRange]):
        super().__init__([(r.path, r.first, r.last) for r in ranges])
        self.ranges = ranges


class PagedReader(DataSourceReader):
    def __init__(self, options: dict):
        self.folder, self.range, self.task = options["path"], int(options.get("range", RANGE)), int(options.get("task", 0))
        self.first, self.last, self.paths = 1, 1 << 31, None

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:  # noqa: N802 - a name that the engine calls
        """Bounds of the page number and lists of paths are taken over; the rest is left to the engine."""
        for f in filters:
            name, value = getattr(f, "attribute", None), getattr(f, "value", None)
            if name == ("page",) and isinstance(f, EqualTo):
                self.first, self.last = max(self.first, value), min(self.last, value)
            elif name == ("page",) and isinstance(f, (GreaterThan, GreaterThanOrEqual)):
                self.first = max(self.first, value + isinstance(f, GreaterThan))
            elif name == ("page",) and isinstance(f, (LessThan, LessThanOrEqual)):
                self.last = min(self.last, value - isinstance(f, LessThan))
            elif name == ("path",) and isinstance(f, (EqualTo, In)):
                wanted = {value} if isinstance(f, EqualTo) else set(value)
                self.paths = wanted if self.paths is None else self.paths & wanted
            else:
                yield f

    def files(self) -> list[str]:
        from pyarrow import fs

        where, base = _opened(self.folder)
        found = where.get_file_info(fs.FileSelector(base, recursive=True))
        return sorted(f.path for f in found if f.is_file and f.path.endswith(SUFFIX) and (self.paths is None or f.path in self.paths))

    @staticmethod
    def count(source) -> int:
        """Pages of an open file, by its last bytes."""
        source.seek(source.size() - 16)
        tail = source.read(16)
        if tail[8:] != MARK:
            raise ValueError("not a paged document")
        return int.from_bytes(tail[:8], "little")

    def partitions(self) -> list[PageRange] | list[PageRanges]:
        where, _ = _opened(self.folder)
        out, sizes = [], []
        for path in self.files():
            with where.open_input_file(path) as source:
                n, size = self.count(source), source.size()
            last = min(n, self.last)
            own = [PageRange(path, a, min(last, a + self.range - 1)) for a in range(self.first, last + 1, self.range)]
            out += own
            sizes += [size * (r.last - r.first + 1) / n for r in own]
        if not self.task:
            return out
        packs, held = [], 0.0
        for one, size in zip(out, sizes, strict=True):
            if not packs or held + size > self.task:
                packs.append([])
                held = 0.0
            packs[-1].append(one)
            held += size
        return [PageRanges(p) for p in packs]

    def read(self, partition: PageRange | PageRanges) -> Iterator[tuple]:
        where, _ = _opened(self.folder)
        ranges = partition.ranges if isinstance(partition, PageRanges) else [partition]
        for path, own in groupby(ranges, key=lambda r: r.path):
            with where.open_input_file(path) as source:
                n = self.count(source)
                for r in own:
                    yield from self.pages(source, n, r)

    @staticmethod
    def pages(source, n: int, own: PageRange) -> Iterator[tuple]:
        """The rows of one range of an open file of n pages."""
        source.seek(source.size() - 16 - 8 * (n + 1) + 8 * (own.first - 1))
        raw = source.read(8 * (own.last - own.first + 2))
        ends = [int.from_bytes(raw[i : i + 8], "little") for i in range(0, len(raw), 8)]
        for k in range(len(ends) - 1):
            source.seek(ends[k])
            page = json.loads(source.read(ends[k + 1] - ends[k]))
            text = cleaned(page["text"])
            images = [(*map(float, i[:4]), short_digest(bytes.fromhex(i[4]))) for i in page["images"]]
            if text or images:
                yield own.path, own.first + k, text, short_digest(text.encode()), images


class PagedSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "paged"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> PagedReader:
        return PagedReader(self.options)


def register(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(PagedSource)


def read_paged(spark: SparkSession, folder: str, pages: int = RANGE, task: int = TASK_BYTES) -> DataFrame:
    """(path, page, text, digest, images) of all pages that have a text or an image, in ranges of ``pages`` pages, some ``task`` bytes of them to a task."""
    register(spark)
    return spark.read.format("paged").option("range", str(pages)).option("task", str(task)).load(folder)


def repeated_images(pages: DataFrame, least: int = 3, share: float = 0.01) -> DataFrame:
    """(path, digest, n_pages) of images on more than ``max(least, share)`` of a file's pages, as logos are."""
    total = pages.groupBy("path").agg(F.count("*").alias("_all"))
    found = pages.select("path", "page", F.explode("images").alias("i")).groupBy("path", F.col("i.digest").alias("digest")).agg(F.countDistinct("page").alias("n_pages"))
    return found.join(total, "path").where(F.col("n_pages") > F.greatest(F.lit(float(least)), share * F.col("_all"))).drop("_all")


def index_folder(spark: SparkSession, folder: str, target: str, embed, size: int = 3200, overlap: int = 600) -> int:
    """Pages to chunks to vectors to Parquet: (path, page, chunk_no, text, embedding); the number of chunks."""
    from folioscope.operators.structure import windows

    pages = read_paged(spark, folder).select(F.struct("path", "page").alias("at"), "text")
    chunks = windows(pages, size, overlap, "at").select("at.*", F.col("window_no").alias("chunk_no"), "text")
    chunks.withColumn("embedding", embed(F.col("text"))).write.mode("overwrite").parquet(target)
    return spark.read.parquet(target).count()

"""Keyed state with timers: a cache of answers that live for a time, heartbeats of what falls silent, and sinks that survive a restart.

State lives in the store of the stream's checkpoint, so a restarted query goes on where it was.  Times are event
times: what a query answers doesn't depend on when it runs.  Rows of a key are taken in the order of time and id
inside a batch; rows later than the watermark are dropped by the engine.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StatefulProcessor

from folioscope.lineage import shared_folder

STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def _ordered(rows: Iterator[pd.DataFrame]) -> pd.DataFrame:
    return pd.concat(list(rows)).sort_values(["at", "id"], kind="stable")


def likeness(a: list[float], b: list[float]) -> float:
    """Cosine; 0 for a vector of zeros or of another length."""
    if len(a) != len(b):
        return 0.0
    norm = math.sqrt(sum(x * x for x in a)) * math.sqrt(sum(x * x for x in b))
    return sum(x * y for x, y in zip(a, b, strict=True)) / norm if norm else 0.0


class AnswerCache(StatefulProcessor):
    """For each group (a notebook, a user) the last answers by question, at most ``size`` of them and none older than ``ttl`` ms.

    A question that is there by its key is an exact hit, else the most alike one at ``least`` or more is a
    semantic one (the earliest of equals); a hit doesn't make an answer live longer.  A miss is answered and
    kept, for which the oldest answer goes if there are ``size``.  A timer at the end of the oldest answer's
    life frees the state of a group that nobody asks any more.
    """

    def __init__(self, ttl: int, size: int, least: float):
        self.ttl, self.size, self.least = ttl, size, least

    def init(self, handle) -> None:
        self.handle = handle
        self.kept = handle.getMapState("kept", "question string", "at long, id long, vector array<double>")

    def _load(self) -> dict[str, tuple[int, int, list[float]]]:
        return {k[0]: (v[0], v[1], list(v[2])) for k, v in self.kept.iterator()} if self.kept.exists() else {}

    def _timer(self, entries: dict) -> None:
        for t in list(self.handle.listTimers()):
            self.handle.deleteTimer(t)
        if entries:
            self.handle.registerTimer(min(e[0] for e in entries.values()) + self.ttl)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803 - names that the engine calls
        before = self._load()
        entries, out = dict(before), []
        for r in _ordered(rows).itertuples():
            entries = {k: e for k, e in entries.items() if r.at - e[0] < self.ttl}
            vector = list(r.vector) if r.vector is not None else []
            if r.question in entries:
                out.append((key[0], r.id, "exact", entries[r.question][1]))
                continue
            near = [(-s, e[0], e[1]) for e in entries.values() if (s := likeness(vector, e[2])) >= self.least]
            if near:
                out.append((key[0], r.id, "semantic", min(near)[2]))
                continue
            if len(entries) >= self.size:
                del entries[min(entries, key=lambda k: entries[k][:2])]
            entries[r.question] = (int(r.at), int(r.id), vector)
            out.append((key[0], r.id, "miss", r.id))
        for k in before.keys() - entries.keys():
            self.kept.removeKey((k,))
        for k, e in entries.items():
            if before.get(k) != e:
                self.kept.updateValue((k,), e)
        self._timer(entries)
        yield pd.DataFrame(out, columns=["group", "id", "kind", "source"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        entries, now = self._load(), expiredTimerInfo.getExpiryTimeInMs()
        for k in [k for k, e in entries.items() if now - e[0] >= self.ttl]:
            self.kept.removeKey((k,))
            del entries[k]
        self._timer(entries)
        return iter(())

    def close(self) -> None:
        pass


class Heartbeats(StatefulProcessor):
    """A beat for each ``silence`` ms that pass after a group's last event without another, up to ``most`` in a row.

    Beats between two events come when the second arrives, those after the last one by timers as the watermark
    passes them; either way the same beats come, each once.
    """

    def __init__(self, silence: int, most: int):
        self.silence, self.most = silence, most

    def init(self, handle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "at long, id long, beats long")

    def _beats(self, key, at: int, id_: int, done: int, until: int) -> list[tuple]:
        """The beats after ``done`` whose time is ``until`` at the latest."""
        n = min(self.most, (until - at) // self.silence)
        return [(key[0], id_, j, at + j * self.silence) for j in range(done + 1, n + 1)]

    def _frame(self, rows: list[tuple]) -> pd.DataFrame:
        return pd.DataFrame(rows, columns=["group", "after", "beat", "at"])

    def _timer(self, at: int, done: int) -> None:
        for t in list(self.handle.listTimers()):
            self.handle.deleteTimer(t)
        if done < self.most:
            self.handle.registerTimer(at + (done + 1) * self.silence)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        state, out = self.last.get() if self.last.exists() else None, []
        for r in _ordered(rows).itertuples():
            if state is not None and r.at < state[0]:
                continue  # older than what has been seen: it ends no silence
            if state is not None:
                out += self._beats(key, *state, int(r.at) - 1)
            state = (int(r.at), int(r.id), 0)
        self.last.update(state)
        self._timer(state[0], state[2])
        yield self._frame(out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        at, id_, done = self.last.get()
        out = self._beats(key, at, id_, done, max(timerValues.getCurrentWatermarkInMs(), expiredTimerInfo.getExpiryTimeInMs()))
        done += len(out)
        self.last.update((at, id_, done))
        self._timer(at, done)
        yield self._frame(out)

    def close(self) -> None:
        pass


def _stateful(events: DataFrame, processor: StatefulProcessor, schema: str, delay: str) -> DataFrame:
    """``events`` (group, id, at in ms, ts, ...) through a processor."""
    events.sparkSession.conf.set(*STORE)
    return events.withWatermark("ts", delay).groupBy("group").transformWithStateInPandas(processor, schema, "append", "EventTime")


def cached_answers(asked: DataFrame, ttl: int, size: int = 256, least: float = 0.93, delay: str = "1 hour") -> DataFrame:
    """(group, id, kind, source): whether a question (group, id, at, ts, question, vector) is an exact or semantic hit or a miss, and whose answer it gets."""
    return _stateful(asked, AnswerCache(ttl, size, least), "group long, id long, kind string, source long", delay)


def heartbeats(events: DataFrame, silence: int, most: int = 100, delay: str = "1 hour") -> DataFrame:
    """(group, after, beat, at): the beats after each event (group, id, at, ts)."""
    return _stateful(events, Heartbeats(silence, most), "group long, after long, beat long, at long", delay)


def run_to_files(stream: DataFrame, path: str, checkpoint: str, **options: str):
    """Everything that is there now, appended to Parquet files exactly once; started again with the same folders it goes on."""
    return stream.writeStream.format("parquet").outputMode("append").option("checkpointLocation", checkpoint).options(**options).trigger(availableNow=True).start(path)


def finished(spark: SparkSession, stream: DataFrame) -> DataFrame:
    """The whole result of an append-mode stream over what is there now, read from the shared folder."""
    root = f"{shared_folder(spark)}/streams/{uuid.uuid4().hex}"
    run_to_files(stream, f"{root}/rows", f"{root}/checkpoint").awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{root}/rows")

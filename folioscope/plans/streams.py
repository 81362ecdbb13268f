"""Queries over event time: each runs as a stream over what is there now, and the SQL is the batch answer."""

from __future__ import annotations

from pyspark.sql import functions as F

from folioscope.sources.tables import table
from folioscope.streaming import events as ops
from folioscope.streaming import stateful


def _cents(column):
    return F.floor(column * 100 + 0.5).cast("long")


def _batch(spark, sf):
    return table(spark, sf, "events")


def _valued(events):
    return events.withColumn("value", _cents(F.col("value")))


def tumbling_hours(spark, sf):
    return ops.windowed(_valued(_batch(spark, sf)), "1 hour")


def sliding_hours(spark, sf):
    return ops.windowed(_valued(_batch(spark, sf)), "1 hour", "15 minutes")


def user_sessions(spark, sf):
    return ops.sessions(_batch(spark, sf), "30 minutes")


def stream_tumbling_hours(spark, sf):
    """The same as a stream; complete mode, so that the last windows are there too."""
    out = ops.run_once(spark, ops.windowed(_valued(ops.event_stream(spark, sf)), "1 hour"), "stream_tumbling_hours", "complete")
    return out.withColumn("start", F.col("start").cast("timestamp_ntz"))


def stream_deduplicated(spark, sf):
    out = ops.deduplicated(ops.event_stream(spark, sf), ["event_id"]).select("event_id", "user_id", "event_type")
    return ops.run_once(spark, out, "stream_deduplicated")


def stream_enriched(spark, sf):
    return ops.run_once(spark, ops.enriched(ops.event_stream(spark, sf), table(spark, sf, "customer")).withColumn("value", _cents(F.col("value"))), "stream_enriched")


def purchases_after_views(spark, sf):
    events = _batch(spark, sf)
    return ops.paired(events.where("event_type = 'view'"), events.where("event_type = 'purchase'"))


def heartbeat_gaps(spark, sf):
    """Silences of a user of more than a day between two events."""
    from pyspark.sql import Window as W

    before = F.lag("ts").over(W.partitionBy("user_id").orderBy("ts", "event_id"))
    micros = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    gap = (micros("ts") - micros("before")).alias("gap_us")
    return _batch(spark, sf).withColumn("before", before).select("event_id", "user_id", gap).where("gap_us > 86400000000")


def latest_per_user(spark, sf):
    """Keyed state with a time to live: the last value of each user that is less than a day old at the end."""
    events = _batch(spark, sf)
    end = events.agg(F.max("ts").alias("_end"))
    last = events.groupBy("user_id").agg(F.max(F.struct("ts", "event_id", "value")).alias("l"))
    return last.crossJoin(F.broadcast(end)).where(F.expr("l.ts > _end - INTERVAL 1 DAY")).select("user_id", "l.event_id", _cents(F.col("l.value")).alias("value"))


DAY, QUARTER = 86_400_000, 6 * 3_600_000
CACHED, LEAST = 8, 0.995


def _timed(spark, sf):
    """Events as (group, id, at, ts, event_type, value, k)."""
    at = F.floor(F.unix_micros("ts") / 1000).cast("long")
    return ops.event_stream(spark, sf).select(F.col("user_id").alias("group"), F.col("event_id").alias("id"), at.alias("at"), "ts", "event_type", "value", F.get_json_object("props", "$.k").cast("int").alias("k"))


def stream_answer_cache(spark, sf):
    """Events as questions of their user: the same kind and tens of value is the same question; alike ones have alike small vectors."""
    tens = F.floor(F.col("value") / 10).cast("long").cast("string")
    vector = F.array((F.col("k") % 7 + 1).cast("double"), (F.floor("value") % 5 + 1).cast("double"), (F.length("event_type") % 3 * 4 + 1).cast("double"))
    asked = _timed(spark, sf).select("group", "id", "at", "ts", F.concat_ws(":", "event_type", tens).alias("question"), vector.alias("vector"))
    return stateful.finished(spark, stateful.cached_answers(asked, DAY, CACHED, LEAST)).select(F.col("group").alias("user_id"), F.col("id").alias("event_id"), "kind", "source")


def stream_heartbeats(spark, sf):
    """A beat for every six hours without an event of a user, ten at most, up to an hour before the end."""
    out = stateful.finished(spark, stateful.heartbeats(_timed(spark, sf).select("group", "id", "at", "ts"), QUARTER, 10))
    return out.select(F.col("group").alias("user_id"), F.col("after").alias("event_id"), "beat", F.col("at").alias("at_ms"))


_SIM = "(e.a * x.a + e.b * x.b + e.c * x.c)::DOUBLE / (sqrt((x.a * x.a + x.b * x.b + x.c * x.c)::DOUBLE) * sqrt((e.a * e.a + e.b * e.b + e.c * e.c)::DOUBLE))"
_CACHE_SQL = f"""
WITH RECURSIVE q AS (
  SELECT user_id, event_id AS id, epoch_us(ts) // 1000 AS ms, event_type || ':' || floor(value / 10)::BIGINT AS question, (json_extract_string(props, '$.k')::INT % 7 + 1)::BIGINT AS a, floor(value)::BIGINT % 5 + 1 AS b, length(event_type)::BIGINT % 3 * 4 + 1 AS c,
    row_number() OVER (PARTITION BY user_id ORDER BY epoch_us(ts) // 1000, event_id) AS n FROM events),
w AS (
  SELECT user_id, 0::BIGINT AS n, 0::BIGINT AS id, '' AS kind, 0::BIGINT AS source, CAST([] AS STRUCT(ms BIGINT, id BIGINT, question VARCHAR, a BIGINT, b BIGINT, c BIGINT)[]) AS kept FROM (SELECT DISTINCT user_id FROM q)
  UNION ALL
  SELECT user_id, n, id, CASE WHEN exact IS NOT NULL THEN 'exact' WHEN near IS NOT NULL THEN 'semantic' ELSE 'miss' END, CASE WHEN exact IS NOT NULL THEN exact.id WHEN near IS NOT NULL THEN near.id ELSE id END,
    CASE WHEN exact IS NOT NULL OR near IS NOT NULL THEN live ELSE list_append(CASE WHEN len(live) >= {CACHED} THEN list_sort(live)[2:] ELSE live END, me) END
  FROM (SELECT user_id, n, id, live, me, list_filter(live, lambda e: e.question = me.question)[1] AS exact,
      list_sort(list_filter(list_transform(live, lambda e: {{'s': -({_SIM.replace("x.", "me.")}), 'ms': e.ms, 'id': e.id}}), lambda e: -e.s >= {LEAST}))[1] AS near
    FROM (SELECT q.user_id, q.n, q.id, {{'ms': q.ms, 'id': q.id, 'question': q.question, 'a': q.a, 'b': q.b, 'c': q.c}} AS me, list_filter(w.kept, lambda e: q.ms - e.ms < {DAY}) AS live FROM w JOIN q ON q.user_id = w.user_id AND q.n = w.n + 1)))
SELECT user_id, id AS event_id, kind, source FROM w WHERE n > 0"""
_BEAT_SQL = f"""
WITH e AS (SELECT user_id, event_id, epoch_us(ts) // 1000 AS ms FROM events),
g AS (SELECT *, lead(ms) OVER (PARTITION BY user_id ORDER BY ms, event_id) AS following, (SELECT max(ms) FROM e) - 3600000 AS mark FROM e),
n AS (SELECT *, greatest(0, least(10, CASE WHEN following IS NULL THEN (mark - ms) // {QUARTER} ELSE (following - 1 - ms) // {QUARTER} END)) AS beats FROM g),
u AS (SELECT *, unnest(range(1, beats + 1)) AS beat FROM n)
SELECT user_id, event_id, beat, ms + beat * {QUARTER} AS at_ms FROM u"""
_CENTS = "CAST(floor(value * 100 + 0.5) AS BIGINT)"
_TUMBLING = f"SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n, sum({_CENTS})::BIGINT AS total FROM events GROUP BY ALL"
ORACLES = {
    "stream_answer_cache": _CACHE_SQL,
    "stream_heartbeats": _BEAT_SQL,
    "tumbling_hours": _TUMBLING,
    "sliding_hours": f"SELECT time_bucket(INTERVAL 15 MINUTES, ts) - to_minutes(15 * k) AS start, event_type, count(*) AS n, sum({_CENTS})::BIGINT AS total FROM events, range(4) r(k) GROUP BY ALL",
    "user_sessions": """WITH g AS (SELECT user_id, ts, coalesce((ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) >= INTERVAL 30 MINUTES)::INT, 1) AS s FROM events),
n AS (SELECT *, sum(s) OVER (PARTITION BY user_id ORDER BY ts) AS k FROM g) SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 30 MINUTES AS stop, count(*) AS n FROM n GROUP BY user_id, k""",
    "stream_tumbling_hours": _TUMBLING,
    "stream_deduplicated": "SELECT event_id, user_id, event_type FROM events",
    "stream_enriched": f"SELECT event_id, user_id, c_mktsegment, {_CENTS} AS value FROM events JOIN customer ON user_id = c_custkey",
    "purchases_after_views": "SELECT v.event_id AS view_id, p.event_id AS purchase_id FROM events v JOIN events p ON v.user_id = p.user_id AND v.event_type = 'view' AND p.event_type = 'purchase' AND p.ts BETWEEN v.ts AND v.ts + INTERVAL 1 HOUR",
    "heartbeat_gaps": "SELECT * FROM (SELECT event_id, user_id, epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id)) AS gap_us FROM events) WHERE gap_us > 86400000000",
    "latest_per_user": f"WITH l AS (SELECT user_id, max(row(ts, event_id, value)) AS l FROM events GROUP BY user_id) SELECT user_id, event_id, {_CENTS} AS value FROM events JOIN (SELECT user_id, max(ts) AS t FROM events GROUP BY user_id) USING (user_id) WHERE ts = t AND ts > (SELECT max(ts) FROM events) - INTERVAL 1 DAY QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) = 1",
}
QUERIES = {name: globals()[name] for name in ORACLES}

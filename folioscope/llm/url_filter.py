"""Operator 1: URL filters as a sort-merge range join.

A rule is a host and a path.  It fits its host and all subdomains if the path of the url starts with
the rule's.  Each url gives one probe for each suffix of its host: the labels reversed, a zero and the
path, so that a rule fits a probe exactly if the rule's own key is a prefix of it, which makes the rule an
interval of probe keys.  Probes and rules are dealt into key ranges (the bounds come from a fixed
number of probes with the smallest hashes), rules also into every range that their interval meets.
Inside a range one sorted sweep keeps the stack of the nested rules that are open.

Defined results: a null url or one without ``://`` has an empty host and path and fits no rule; the
longest rule (host and path together) wins, then the longer host, then block; urls that no rule fits
get ``default``; equal urls are judged once and joined back, so repeated rows keep their rows; rules
with a null host or path are left out; a very long url is a key like any other; an empty table or rule
set is allowed; only the id and url columns are read, so other columns cannot clash.
"""

from __future__ import annotations

from bisect import bisect_right

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from folioscope.llm._common import conf_int, lower_ascii, table

RULES = (("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/"))
_TOP = "\U0010ffff"
_SAMPLED = 32


def rule_table(spark: SparkSession, rules=RULES) -> DataFrame:
    return spark.createDataFrame(list(rules), "verdict string, host string, path string")


def _reversed(host):
    return F.array_join(F.reverse(F.split(host, r"\.")), ".")


def url_filter(urls: DataFrame, rules: DataFrame, id_col: str = "page_id", url_col: str = "url", default: str = "allow") -> DataFrame:
    """id, host, path, rule and verdict of every row of ``urls``."""
    spark = urls.sparkSession
    after = F.coalesce(F.regexp_extract(F.col(url_col).cast("string"), r"(?s)^.*?://(.*)$", 1), F.lit(""))
    rows = urls.select(F.col(id_col), after.alias("_after")).select(
        id_col,
        lower_ascii(F.regexp_extract("_after", r"^[^/?#]*", 0)).alias("host"),
        F.regexp_extract("_after", r"^[^/?#]*([^?#]*)", 1).alias("path"),
    )
    probes = (
        rows.where(F.col("host") != "")
        .groupBy("host", "path")
        .agg(F.lit(True).alias("_one"))
        .withColumn("_labels", F.reverse(F.split("host", r"\.")))
        .select("host", "path", F.explode(F.expr("transform(sequence(1, size(_labels)), n -> concat(array_join(slice(_labels, 1, n), '.'), char(0), path))")).alias("key"))
    )
    ranked = (
        rules.where(F.col("host").isNotNull() & F.col("path").isNotNull())
        .select(lower_ascii(F.col("host")).alias("host"), "path", "verdict")
        .groupBy("host", "path")
        .agg(F.max("verdict").alias("verdict"))  # block over allow
        .select(F.concat(_reversed(F.col("host")), F.lit("\x00"), "path").alias("key"), F.concat("host", "path").alias("rule"), F.length("host").alias("host_size"), "verdict")
    )
    parts = conf_int(spark, "spark.sql.shuffle.partitions", 200)
    wanted = 4 * parts
    found = sorted({r[0] for r in probes.select("key", F.xxhash64("key").alias("_h")).orderBy("_h").limit(_SAMPLED * parts).collect()})
    bounds = [found[i * len(found) // wanted] for i in range(1, wanted)] if found else []
    bounds = sorted(set(bounds))

    @F.pandas_udf(T.IntegerType())
    def part_of(key: pd.Series) -> pd.Series:
        return key.map(lambda k: bisect_right(bounds, k)).astype("int32")

    @F.pandas_udf(T.IntegerType())
    def part_after(key: pd.Series) -> pd.Series:
        return key.map(lambda k: bisect_right(bounds, k + _TOP)).astype("int32")

    null = lambda kind: F.lit(None).cast(kind)
    events = (
        ranked.select(F.explode(F.sequence(part_of("key"), part_after("key"))).alias("part"), "key", F.lit(0).alias("kind"), null("string").alias("host"), null("string").alias("path"), "rule", "host_size", "verdict")
        .unionByName(probes.select(part_of("key").alias("part"), "key", F.lit(1).alias("kind"), "host", "path", null("string").alias("rule"), null("int").alias("host_size"), null("string").alias("verdict")))
        .repartition(wanted, "part")
        .sortWithinPartitions("part", "key", "kind")
    )
    schema = "host string, path string, rule string, host_size int, verdict string"

    def sweep(batches):
        part, stack = None, []  # open rules, each key a prefix of the next
        for batch in batches:
            out = []
            for p, key, kind, host, path, rule, size, verdict in zip(*(batch[c] for c in ("part", "key", "kind", "host", "path", "rule", "host_size", "verdict")), strict=True):
                if p != part:
                    part, stack = p, []
                while stack and not key.startswith(stack[-1][0]):
                    stack.pop()
                if kind == 0:
                    stack.append((key, rule, size, verdict))
                elif stack:
                    out.append((host, path, *stack[-1][1:]))
            if out:
                yield pd.DataFrame(out, columns=["host", "path", "rule", "host_size", "verdict"])

    best = (
        events.mapInPandas(sweep, schema)
        .groupBy("host", "path")
        .agg(F.max(F.struct(F.length("rule").alias("size"), "host_size", F.col("verdict"), F.col("rule"))).alias("_best"))
    )
    found = rows.where("host != ''").join(best, ["host", "path"], "left").select(
        id_col, "host", "path", F.col("_best.rule").alias("rule"), F.coalesce("_best.verdict", F.lit(default)).alias("verdict")
    )
    # Urls without a host, however many, fit no rule and need no join.
    return found.unionByName(rows.where("host = ''").select(id_col, "host", "path", null("string").alias("rule"), F.lit(default).alias("verdict")))


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter(table(spark, sf_dir, "pages"), rule_table(spark))


ORACLE_SQL = r"""
WITH rules(verdict, host, path) AS (VALUES ('allow', 'org', '/'), ('block', 'example.org', '/es/'), ('block', 'example.org', '/en/1'), ('allow', 'com', '/fr/'), ('block', 'com', '/de/')),
parts AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
rows AS (
  SELECT row_number() OVER () AS n, page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM parts),
best AS (
  SELECT n, arg_max(r.host || r.path, length(r.host || r.path)) AS rule, arg_max(r.verdict, length(r.host || r.path)) AS verdict
  FROM rows u JOIN rules r ON (u.host = r.host OR ends_with(u.host, '.' || r.host)) AND starts_with(u.path, r.path) GROUP BY n)
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM rows LEFT JOIN best USING (n)
"""

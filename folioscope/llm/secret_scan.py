"""Operator 4 (native): secret scans with an incremental blob ledger.

Every version of a text is a blob, addressed by the sha-256 of its content.  The ledger has a row for
each (blob, rule version) that has been scanned, with its findings.  A run scans only the pairs that
the ledger lacks, each once however many paths carry the blob, and joins findings back to all paths.

The span of a match comes from lengths: ``split`` gives the gaps between the matches that
``regexp_extract_all`` gives, both leftmost and non-overlapping.  All steps are DataFrame functions.

The ledger can be a table at a path (``scan_incrementally``); a run appends what it has scanned, a text's
older versions stay in it.  The rule version is a digest of the rules: other rules are scanned anew.

Defined results: a null text is the empty blob without findings; repeated rows give repeated results;
spans that start at one place come in the order of the kinds; a very long or very rich text is scanned
whole, in time that does not grow with the square of its findings; an empty table gives an empty table;
paths are carried in a struct of their own, so other columns cannot clash; positions are code points, the
end exclusive, in the whole text.
"""

from __future__ import annotations

import hashlib
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscope.llm._common import checkpoint, table, text_column


class Rule(NamedTuple):
    kind: str
    pattern: str
    group: int = 0
    least: int = 1
    #: A cheap test that every text with a match passes.
    hint: str = ""


def _either(word: str) -> str:
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)


_NAMES = "|".join(map(_either, ("password", "passwd", "secret", "token"))) + "|" + _either("api") + "_?" + _either("key")
#: In the order of their ranks.  Runs of the classes of access and hex are maximal, so their least length can stand in the pattern.
BASE = (
    Rule("assign", rf"""({_NAMES})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6, f"(?:{_NAMES})"),
    Rule("access", r"AKIA[A-Z0-9]{16,}"),
    Rule("hex", r"[0-9a-f]{24,}"),
)
MORE = (
    Rule("pem", r"-----BEGIN [A-Z ]{0,32}PRIVATE KEY-----"),
    Rule("github", r"gh[opsu]_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
)


def rule_version(rules) -> str:
    """A digest of the rules, so that another set of rules is another version."""
    return hashlib.sha256(repr([tuple(r) for r in rules]).encode()).hexdigest()[:16]


_SPANS = "array<struct<start:int,rank:int,kind:string,end:int>>"


_RUN = 64


def _let(value: Column, body) -> Column:
    """``body`` of a value that is computed once."""
    return F.transform(F.array(value), body)[0]


def _before(values: Column, fold) -> Column:
    """``fold`` of all values before each place of an array: over whole runs of places first, so that it isn't quadratic."""

    def folded(v: Column) -> Column:
        runs = F.transform(F.sequence(F.lit(0), F.floor((F.size(v) - 1) / _RUN).cast("int")), lambda c: fold(F.slice(v, c * _RUN + 1, _RUN)))
        at = lambda i: F.floor(i / _RUN).cast("int")
        return _let(runs, lambda r: F.transform(v, lambda _, i: fold(F.array(fold(F.slice(r, F.lit(1), at(i))), fold(F.slice(v, at(i) * _RUN + 1, i % _RUN))))))

    return _let(values, folded)


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0), lambda s, x: s + x)


def _most(values: Column) -> Column:
    return F.coalesce(F.array_max(values), F.lit(0))


def _spans(text: Column, rank: int, rule: Rule) -> Column:
    gaps, hits = F.split(text, rule.pattern, -1), F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(0))
    body = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(rule.group)) if rule.group else hits
    nothing = F.array().cast(_SPANS)
    zipped = F.transform(F.arrays_zip(gaps.alias("gap"), hits.alias("hit"), body.alias("body")), lambda x: F.struct(F.length(x["gap"]).alias("gap"), F.length(x["hit"]).alias("hit"), F.length(x["body"]).alias("body")))

    def placed(z: Column) -> Column:
        before = _before(F.transform(z, lambda x: x["gap"] + F.coalesce(x["hit"], F.lit(0))), _sum)
        rows = F.transform(F.arrays_zip(z.alias("z"), before.alias("at")), lambda x: F.struct((x["at"] + x["z"]["gap"]).alias("start"), x["z"]["hit"].alias("hit"), x["z"]["body"].alias("body")))
        kept = F.filter(rows, lambda x: x["body"] >= rule.least)  # the gap after the last hit has none
        return F.transform(kept, lambda x: F.struct(x["start"].alias("start"), F.lit(rank).alias("rank"), F.lit(rule.kind).alias("kind"), (x["start"] + x["hit"]).alias("end")))

    return F.when(F.rlike(text, F.lit(rule.hint or rule.pattern)), _let(zipped, placed)).otherwise(nothing)


def blob_of(text: Column) -> Column:
    return F.sha2(text, 256)


def new_findings(docs: DataFrame, ledger: DataFrame | None = None, rules=BASE + MORE, text_col: str = "text") -> DataFrame:
    """Ledger rows (blob, rule_version, spans) for the blobs that the ledger hasn't seen under this rule version."""
    text, version = text_column(text_col), rule_version(rules)
    blobs = docs.select(blob_of(text).alias("blob"), text.alias("text")).dropDuplicates(["blob"])
    if ledger is not None:
        blobs = blobs.join(ledger.where(F.col("rule_version") == version).select("blob"), "blob", "left_anti")
    spans = F.array_sort(F.concat(*(_spans(F.col("text"), i, r) for i, r in enumerate(rules))))
    return blobs.select("blob", F.lit(version).alias("rule_version"), spans.alias("spans"))


#: Rows of the ledger with findings that may be broadcast, and bytes of their spans.
SMALL, SMALL_BYTES = 100_000, 8 << 20


def with_findings(docs: DataFrame, ledger: DataFrame, rules=BASE + MORE, text_col: str = "text") -> DataFrame:
    """``row``, a struct of all columns of every path, and its blob's ``spans``.

    Only blobs with findings are joined.  They are broadcast if they are few and small, which is checked;
    else the join is by blob, and paths of one blob can be split over tasks.
    """
    known = checkpoint(ledger.where((F.col("rule_version") == rule_version(rules)) & (F.size("spans") > 0)).select("blob", "spans"))
    size = known.agg(F.count("*").alias("n"), F.sum(F.size("spans")).alias("s")).first()
    few = size["n"] <= SMALL and 128 * (size["s"] or 0) + 128 * size["n"] <= SMALL_BYTES
    paths = docs.select(F.struct("*").alias("row"), blob_of(text_column(text_col)).alias("blob"))
    return paths.join(F.broadcast(known) if few else known, "blob", "left").select("row", F.coalesce("spans", F.array().cast(_SPANS)).alias("spans"))


def append_ledger(new: DataFrame, path: str) -> None:
    """Add scanned (blob, rule_version, spans) rows to the ledger stored at ``path``; a repeated append of the same rows does no harm."""
    new.write.mode("append").partitionBy("rule_version").parquet(path)


def read_ledger(spark: SparkSession, path: str) -> DataFrame | None:
    """The stored ledger, each (blob, rule version) once; None where there is none yet."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where):
        return None
    schema = f"blob string, spans {_SPANS}, rule_version string"
    return spark.read.schema(schema).parquet(path).dropDuplicates(["blob", "rule_version"])


def scan_incrementally(docs: DataFrame, path: str, rules=BASE + MORE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``secret_scan`` with the ledger stored at ``path``: scans the unseen (blob, rule version) pairs, appends them, and joins findings back to all paths."""
    spark = docs.sparkSession
    append_ledger(new_findings(docs, read_ledger(spark, path), rules, text_col), path)
    return _report(docs, read_ledger(spark, path), rules, id_col, text_col)


def joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def secret_scan(docs: DataFrame, ledger: DataFrame | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256 and spans of every document."""
    new = new_findings(docs, ledger, text_col=text_col)
    return _report(docs, new if ledger is None else ledger.select(*new.columns).unionByName(new), BASE + MORE, id_col, text_col)


def _report(docs: DataFrame, ledger: DataFrame, rules, id_col: str, text_col: str) -> DataFrame:
    rows = with_findings(docs.select(id_col, text_col), ledger, rules, text_col)
    count = lambda rank: F.size(F.filter("spans", lambda s: s["rank"] == rank)).cast("long")
    return rows.select(
        F.col(f"row.{id_col}").alias(id_col),
        *(count(i).alias(f"n_{r.kind}") for i, r in enumerate(BASE)),
        F.sha2(joined(F.filter("spans", lambda s: s["rank"] < len(BASE))), 256).alias("base_sha256"),
        joined(F.col("spans")).alias("spans"),
    )


def redacted(text: Column, spans: Column, mark: str = "[secret]") -> Column:
    """The text with every span, overlaps merged, replaced by ``mark``."""
    ends = F.transform(spans, lambda s: s["end"])
    # A span that starts before the end of an earlier one goes on with what is covered already.
    fresh = F.filter(F.arrays_zip(F.transform(spans, lambda s: s["start"]).alias("start"), _before(ends, _most).alias("from")), lambda s: s["start"] >= s["from"])
    pieces = F.transform(fresh, lambda s: F.substring(text, s["from"] + 1, s["start"] - s["from"]))
    rest = F.substring(text, F.array_max(ends) + 1, F.length(text))
    return F.when(F.size(spans) == 0, text).otherwise(F.array_join(F.concat(pieces, F.array(rest)), mark))


def op4_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan(table(spark, sf_dir, "documents"))


def _sql_kind(rank: int, rule: Rule) -> str:
    p = rule.pattern.replace("'", "''")
    return (
        f"SELECT n, {rank} AS rank, '{rule.kind}' AS kind, unnest(string_split_regex(text, '{p}')[1:len(regexp_extract_all(text, '{p}'))]) AS gap, "
        f"unnest(regexp_extract_all(text, '{p}')) AS hit, unnest(regexp_extract_all(text, '{p}', {rule.group})) AS body, "
        f"generate_subscripts(regexp_extract_all(text, '{p}'), 1) AS i, {rule.least} AS least FROM docs WHERE regexp_matches(text, '{p}')"
    )


ORACLE_SQL = f"""
WITH docs AS (SELECT row_number() OVER () AS n, doc_id, coalesce(text, '') AS text FROM documents),
hits AS ({" UNION ALL ".join(_sql_kind(i, r) for i, r in enumerate(BASE + MORE))}),
ends AS (SELECT *, sum(length(gap) + length(hit)) OVER (PARTITION BY n, rank ORDER BY i)::BIGINT AS stop FROM hits),
spans AS (SELECT n, rank, kind, stop - length(hit) AS start, kind || ':' || (stop - length(hit)) || ':' || stop AS span FROM ends WHERE length(body) >= least),
sums AS (
  SELECT n, count(*) FILTER (rank = 0) AS n_assign, count(*) FILTER (rank = 1) AS n_access, count(*) FILTER (rank = 2) AS n_hex,
         string_agg(span, ',' ORDER BY start, rank) FILTER (rank < 3) AS base, string_agg(span, ',' ORDER BY start, rank) AS spans
  FROM spans GROUP BY n)
SELECT doc_id, coalesce(n_assign, 0)::BIGINT AS n_assign, coalesce(n_access, 0)::BIGINT AS n_access, coalesce(n_hex, 0)::BIGINT AS n_hex,
       sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM docs LEFT JOIN sums USING (n)
"""

"""``python -m folioscope.cli``: list, run or explain queries; profile documents, build them, validate and publish what was built.

A build goes to a folder of its own and only touches what changed.  ``publish`` asks the gates first; ``all`` builds,
validates and publishes.
"""

from __future__ import annotations

import argparse
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscope.operators.build_chain import BuildChain, gates, standard_stages
from folioscope.operators.merge_log import Publication
from folioscope.plans import catalogue, search
from folioscope.settings import Settings
from folioscope.sources.tables import table


def _chain(spark: SparkSession, root: str) -> BuildChain:
    return BuildChain(spark, root, standard_stages(Settings.load()))


def profile(spark: SparkSession, tables: str) -> DataFrame:
    """For each source its documents, those without a text, and characters."""
    empty = F.length(F.trim(F.coalesce("text", F.lit("")))) == 0
    return table(spark, tables, "documents").groupBy("source").agg(F.count("*").alias("n"), F.count_if(empty).alias("n_empty"), F.sum(F.length("text")).alias("chars")).orderBy("source")


def build(spark: SparkSession, tables: str, root: str) -> dict[str, int]:
    return _chain(spark, root).run(table(spark, tables, "documents").select("doc_id", "source", "text").where("doc_id IS NOT NULL"))


def validate(spark: SparkSession, tables: str, root: str) -> DataFrame:
    """The gates over what was built; tables and pictures are judged where a build has them."""
    none = spark.createDataFrame([], "table_id string, state string, png_key string, key string")
    built = _chain(spark, root).output("chunks")
    vectors = table(spark, tables, "embeddings")
    width = vectors.agg(F.max(F.size("embedding"))).first()[0] or 0
    recall = search.golden_recall(spark, tables).select((F.col("recall") / 1e6).alias("recall"))
    return gates(none if built is None else built, vectors, none, none, recall, Settings.load(), width)


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="folioscope", description=__doc__)
    sub = parser.add_subparsers(dest="command", required=True)
    sub.add_parser("list", help="names of the queries")
    for command in ("run", "explain"):
        one = sub.add_parser(command)
        one.add_argument("query", choices=sorted(catalogue.queries()))
        one.add_argument("tables", help="folder with one parquet table for each name")
        one.add_argument("--out", help="write the result here as parquet instead of showing its first rows")
    sub.add_parser("profile").add_argument("tables")
    for command in ("build", "validate", "publish", "all"):
        one = sub.add_parser(command)
        one.add_argument("tables")
        one.add_argument("root", help="folder of the build")
        if command in ("publish", "all"):
            one.add_argument("target", help="folder of the published versions")
            one.add_argument("--version", help="vYYYYmmdd-HHMMSS of now if not given")
            one.add_argument("--force", action="store_true", help="publish in spite of closed gates")
    sub.add_parser("versions").add_argument("target")
    args = parser.parse_args(argv)
    if args.command == "list":
        print("\n".join(sorted(catalogue.queries())))
        return 0
    spark = SparkSession.builder.appName("folioscope").getOrCreate()
    if args.command in ("run", "explain"):
        df = catalogue.queries()[args.query](spark, args.tables)
        if args.command == "explain":
            df.explain("formatted")
        elif args.out:
            df.write.mode("errorifexists").parquet(args.out)
        else:
            df.show(20, truncate=False)
        return 0
    if args.command == "profile":
        profile(spark, args.tables).show(1000, truncate=False)
        return 0
    if args.command == "versions":
        store = Publication(spark, args.target)
        now = store.current()
        print("\n".join(f"{v}{' *' if v == now else ''}" for v in store.versions()))
        return 0
    if args.command in ("build", "all"):
        print(", ".join(f"{k}={v}" for k, v in build(spark, args.tables, args.root).items()))
    if args.command == "build":
        return 0
    judged = validate(spark, args.tables, args.root)
    rows = judged.orderBy("gate").collect()
    print("\n".join(f"{'ok    ' if r['ok'] else 'closed'} {r['gate']} {r['value']}" for r in rows))
    good = all(r["ok"] for r in rows)
    if args.command == "validate" or not (good or args.force):
        return 0 if good else 1
    version = args.version or datetime.now(timezone.utc).strftime("v%Y%m%d-%H%M%S")
    print(_chain(spark, args.root).publish(args.target, version))
    return 0


if __name__ == "__main__":
    raise SystemExit(main())

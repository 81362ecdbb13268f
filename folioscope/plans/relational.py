"""The standard relational set on the order tables and events."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from folioscope.sources.tables import table


def _cents(column):
    return F.sum(F.floor(column * 100 + 0.5).cast("long"))


def join_broadcast_dim(spark, sf):
    """Revenue by nation; the nation table has a row for each country and is broadcast."""
    return (
        table(spark, sf, "orders").join(table(spark, sf, "customer"), F.col("o_custkey") == F.col("c_custkey")).join(F.broadcast(table(spark, sf, "nation")), F.col("c_nationkey") == F.col("n_nationkey"))
        .groupBy("n_name").agg(F.count("*").alias("n_orders"), _cents(F.col("o_totalprice")).alias("cents"))
    )


def join_shuffle_orders(spark, sf):
    lines = table(spark, sf, "lineitem").where("l_shipdate >= '1995-01-01'").select("l_orderkey", "l_extendedprice", "l_discount")
    joined = lines.join(table(spark, sf, "orders").select("o_orderkey", "o_orderpriority"), F.col("l_orderkey") == F.col("o_orderkey"))
    return joined.groupBy("o_orderpriority").agg(F.count("*").alias("n_lines"), _cents(F.col("l_extendedprice")).alias("cents"))


def pricing_summary(spark, sf):
    return table(spark, sf, "lineitem").groupBy("l_returnflag", "l_linestatus").agg(F.sum("l_quantity").cast("long").alias("quantity"), _cents(F.col("l_extendedprice")).alias("cents"), F.count("*").alias("n"), F.countDistinct("l_suppkey").alias("suppliers"))


def asof_event_prev_purchase(spark, sf):
    """The last purchase of the same user before each error event: one pass over both, in time order, without a join."""
    order = W.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(W.unboundedPreceding, -1)
    events = table(spark, sf, "events").where("event_type IN ('purchase', 'view')")
    last = F.last(F.when(F.col("event_type") == "purchase", F.col("event_id")), ignorenulls=True).over(order)
    return events.withColumn("purchase_id", last).where("event_type = 'view'").select("event_id", "purchase_id")


def customers_without_orders(spark, sf):
    return table(spark, sf, "customer").join(table(spark, sf, "orders"), F.col("c_custkey") == F.col("o_custkey"), "left_anti").select("c_custkey", "c_mktsegment")


def customers_with_orders(spark, sf):
    return table(spark, sf, "customer").join(table(spark, sf, "orders").where("o_totalprice > 100000"), F.col("c_custkey") == F.col("o_custkey"), "left_semi").select("c_custkey")


def registry_reconcile(spark, sf):
    """Documents, labels and vectors side by side, whichever is missing."""
    docs, labels = table(spark, sf, "documents").select("doc_id", "lang"), table(spark, sf, "labels").select("doc_id", "quality")
    vectors = table(spark, sf, "embeddings").select(F.col("vec_id").alias("doc_id"), F.lit(True).alias("vector"))
    every = docs.join(labels, "doc_id", "full").join(vectors, "doc_id", "full")
    there = lambda c: F.col(c).isNotNull().alias(f"has_{c}")
    return every.groupBy(there("lang"), there("quality"), there("vector")).agg(F.count("*").alias("n"))


def doc_rollup_lang_source(spark, sf):
    return table(spark, sf, "documents").rollup("lang", "source").agg(F.count("*").alias("n"), F.sum("n_chars").alias("chars"), F.grouping_id().cast("int").alias("level"))


def orders_cube(spark, sf):
    return table(spark, sf, "orders").cube("o_orderstatus", "o_orderpriority").agg(F.count("*").alias("n"))


def top_orders_per_customer(spark, sf):
    order = W.partitionBy("o_custkey").orderBy(F.col("o_totalprice").desc(), "o_orderkey")
    return table(spark, sf, "orders").withColumn("place", F.row_number().over(order)).where("place <= 3").select("o_custkey", "o_orderkey", "place")


def moving_quantity(spark, sf):
    """Frames by rows and by range over the lines of each part."""
    rows = W.partitionBy("l_partkey").orderBy("l_shipdate", "l_orderkey", "l_linenumber").rowsBetween(-2, 0)
    spans = W.partitionBy("l_partkey").orderBy(F.unix_date(F.col("l_shipdate").cast("date"))).rangeBetween(-30, 0)
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", F.sum("l_quantity").over(rows).cast("long").alias("last_three"), F.count("*").over(spans).alias("in_month"))


def set_ops_docs(spark, sf):
    """The sources and languages of all documents against those of the labelled ones."""
    docs = table(spark, sf, "documents").select("doc_id", "source", "lang")
    a, b = docs.drop("doc_id"), docs.join(table(spark, sf, "labels"), "doc_id", "left_semi").drop("doc_id")
    tag = lambda df, name: df.select(F.lit(name).alias("op"), "source", "lang")
    return tag(a.intersect(b), "intersect").unionByName(tag(a.exceptAll(b), "except_all")).unionByName(tag(a.union(b).distinct(), "union"))


def events_pivot(spark, sf):
    kinds = [r[0] for r in table(spark, sf, "events").select("event_type").distinct().orderBy("event_type").collect()]
    wide = table(spark, sf, "events").groupBy("user_id").pivot("event_type", kinds).agg(F.count(F.lit(1))).fillna(0)
    return wide.unpivot("user_id", kinds, "event_type", "n").where("n > 0")


def revenue_by_month(spark, sf):
    lines = table(spark, sf, "lineitem")
    return lines.groupBy(F.date_format("l_shipdate", "yyyy-MM").alias("month")).agg(F.sum((F.col("l_extendedprice").cast("decimal(18,2)") * (1 - F.col("l_discount").cast("decimal(4,2)"))).cast("decimal(20,4)")).cast("string").alias("revenue"))


def events_json_props(spark, sf):
    return table(spark, sf, "events").groupBy(F.get_json_object("props", "$.k").cast("int").alias("k")).agg(F.count("*").alias("n"), F.countDistinct("user_id").alias("users"))


def part_hierarchy(spark, sf):
    """A recursive query: the ancestors of every number up to 200 under n -> n div 3."""
    return spark.sql("WITH RECURSIVE up(n, a, depth) AS (SELECT CAST(id AS INT), CAST(id AS INT), 0 FROM range(1, 201) UNION ALL SELECT n, CAST(a DIV 3 AS INT), depth + 1 FROM up WHERE a >= 3) SELECT n, max(depth) AS depth FROM up GROUP BY n")


def scalar_subquery(spark, sf):
    """Parts dearer than the average of their brand: the average is joined, not looked up row by row."""
    part = table(spark, sf, "part")
    mean = part.groupBy("p_brand").agg(F.avg("p_retailprice").alias("_mean"))
    return part.join(mean, "p_brand").where(F.col("p_retailprice") > F.col("_mean") * 1.2).select("p_partkey", "p_brand")


def approximate_counts(spark, sf):
    """Sketches, and whether they are within their error bounds of the exact count and median."""
    # The distinct parts are counted apart: beside a distinct count, Spark would keep sketches for each flag and part.
    lines = table(spark, sf, "lineitem").select("l_returnflag", "l_partkey", "l_quantity")
    parts = lines.select("l_returnflag", "l_partkey").distinct().groupBy("l_returnflag").agg(F.approx_count_distinct("l_partkey", 0.02).alias("parts"), F.count("l_partkey").alias("n_parts"))
    sizes = lines.groupBy(F.col("l_returnflag").alias("flag")).agg(F.percentile_approx("l_quantity", 0.5).alias("median"), F.percentile("l_quantity", 0.5).alias("middle"))
    both = parts.join(sizes, F.col("l_returnflag").eqNullSafe(F.col("flag")))
    return both.select("l_returnflag", "n_parts", (F.abs(F.col("parts") - F.col("n_parts")) <= 0.08 * F.col("n_parts")).alias("count_close"), (F.abs(F.col("median") - F.col("middle")) <= 1).alias("median_close"))


def sampled_documents(spark, sf):
    """A sample by a hash of the id: the same on every run and every partitioning."""
    return table(spark, sf, "documents").where(F.pmod(F.xxhash64("doc_id"), F.lit(10)) == 0).select("doc_id")


_FLOOR = "CAST(floor({} * 100 + 0.5) AS BIGINT)"
ORACLES = {
    "approximate_counts": "SELECT l_returnflag, count(DISTINCT l_partkey) AS n_parts, true AS count_close, true AS median_close FROM lineitem GROUP BY 1",
    "join_broadcast_dim": f"SELECT n_name, count(*) AS n_orders, sum({_FLOOR.format('o_totalprice')})::BIGINT AS cents FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name",
    "join_shuffle_orders": f"SELECT o_orderpriority, count(*) AS n_lines, sum({_FLOOR.format('l_extendedprice')})::BIGINT AS cents FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_shipdate >= '1995-01-01' GROUP BY o_orderpriority",
    "pricing_summary": f"SELECT l_returnflag, l_linestatus, sum(l_quantity)::BIGINT AS quantity, sum({_FLOOR.format('l_extendedprice')})::BIGINT AS cents, count(*) AS n, count(DISTINCT l_suppkey) AS suppliers FROM lineitem GROUP BY ALL",
    "asof_event_prev_purchase": "SELECT v.event_id, (SELECT arg_max(p.event_id, row(p.ts, p.event_id)) FROM events p WHERE p.event_type = 'purchase' AND p.user_id = v.user_id AND (p.ts < v.ts OR (p.ts = v.ts AND p.event_id < v.event_id))) AS purchase_id FROM events v WHERE v.event_type = 'view'",
    "customers_without_orders": "SELECT c_custkey, c_mktsegment FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)",
    "customers_with_orders": "SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 100000)",
    "registry_reconcile": "SELECT lang IS NOT NULL AS has_lang, quality IS NOT NULL AS has_quality, vec_id IS NOT NULL AS has_vector, count(*) AS n FROM documents FULL JOIN labels USING (doc_id) FULL JOIN embeddings ON doc_id = vec_id GROUP BY ALL",
    "doc_rollup_lang_source": "SELECT lang, source, count(*) AS n, sum(n_chars)::BIGINT AS chars, grouping_id(lang, source)::INT AS level FROM documents GROUP BY ROLLUP (lang, source)",
    "orders_cube": "SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY CUBE (o_orderstatus, o_orderpriority)",
    "top_orders_per_customer": "SELECT o_custkey, o_orderkey, place::INT AS place FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS place FROM orders) WHERE place <= 3",
    "moving_quantity": """SELECT l_orderkey, l_linenumber, sum(l_quantity) OVER (PARTITION BY l_partkey ORDER BY l_shipdate, l_orderkey, l_linenumber ROWS BETWEEN 2 PRECEDING AND CURRENT ROW)::BIGINT AS last_three,
count(*) OVER (PARTITION BY l_partkey ORDER BY l_shipdate::DATE RANGE BETWEEN INTERVAL 30 DAYS PRECEDING AND CURRENT ROW) AS in_month FROM lineitem""",
    "set_ops_docs": """WITH a AS (SELECT source, lang FROM documents), b AS (SELECT source, lang FROM documents SEMI JOIN labels USING (doc_id))
SELECT 'intersect' AS op, * FROM (SELECT * FROM a INTERSECT SELECT * FROM b) UNION ALL SELECT 'except_all', * FROM (SELECT * FROM a EXCEPT ALL SELECT * FROM b) UNION ALL SELECT 'union', * FROM (SELECT * FROM a UNION SELECT * FROM b)""",
    "events_pivot": "SELECT user_id, event_type, count(*) AS n FROM events GROUP BY ALL",
    "revenue_by_month": "SELECT strftime(l_shipdate, '%Y-%m') AS month, CAST(sum(CAST(l_extendedprice::DECIMAL(18,2) * (1 - l_discount::DECIMAL(4,2)) AS DECIMAL(20,4))) AS VARCHAR) AS revenue FROM lineitem GROUP BY 1",
    "events_json_props": "SELECT CAST(props->>'$.k' AS INT) AS k, count(*) AS n, count(DISTINCT user_id) AS users FROM events GROUP BY 1",
    "part_hierarchy": "WITH RECURSIVE up(n, a, depth) AS (SELECT range::INT, range::INT, 0 FROM range(1, 201) UNION ALL SELECT n, a // 3, depth + 1 FROM up WHERE a >= 3) SELECT n, max(depth) AS depth FROM up GROUP BY n",
    "scalar_subquery": "SELECT p_partkey, p_brand FROM part p WHERE p_retailprice > 1.2 * (SELECT avg(p_retailprice) FROM part q WHERE q.p_brand = p.p_brand)",
}
QUERIES = {name: globals()[name] for name in [*ORACLES, "sampled_documents"]}

"""Queries over stored state: merge logs, published versions, incremental builds, ancestries and the vector index.

What they store goes to a folder of its own under the shared folder, so that runs don't meet.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from folioscope.lineage import shared_folder
from folioscope.operators import ancestry
from folioscope.operators.build_chain import BuildChain, gates, standard_stages
from folioscope.operators.merge_log import KeyedLog, Publication, embedded, embedding_cache
from folioscope.operators.vector_index import VectorIndex
from folioscope.plans.search import ORACLES as SEARCH_SQL
from folioscope.plans.search import golden_recall
from folioscope.sources.tables import table


def _folder(spark) -> str:
    return f"{shared_folder(spark)}/stores/{uuid.uuid4().hex}"


def merged_log(spark, sf):
    """All orders merged in, then the open ones with another priority, then the urgent ones with another status; the log compacted between."""
    orders = table(spark, sf, "orders").select("o_orderkey", "o_orderstatus", "o_orderpriority")
    log = KeyedLog(spark, _folder(spark), ["o_orderkey"], "o_orderkey bigint, o_orderstatus string, o_orderpriority string")
    log.merge(orders)
    log.merge(orders.where("o_orderstatus = 'O'").withColumn("o_orderpriority", F.lit("late")))
    log.compact()
    log.merge(orders.where("o_orderpriority LIKE '1%'").withColumn("o_orderstatus", F.lit("X")))
    return log.read().groupBy("o_orderstatus", "o_orderpriority").agg(F.count("*").alias("n"), F.sum("o_orderkey").alias("keys"))


def _lengths(rows):
    """A stand-in for a model: a vector of the text's characters, words and digits."""
    words, digits = F.size(F.split(F.trim("text"), r"\s+")), F.regexp_count("text", F.lit(r"\d"))
    return rows.withColumn("vec", F.array(F.length("text").cast("float"), words.cast("float"), digits.cast("float")))


def embedding_cache_merge(spark, sf):
    """Embeddings of all documents through a cache that knows those of even id; every row is answered, copies too."""
    docs = table(spark, sf, "documents").select("doc_id", "text")
    cache = embedding_cache(spark, _folder(spark))
    embedded(docs.where("doc_id % 2 = 0"), cache, "model-a", _lengths)
    first = cache.read().count()
    out = embedded(docs, cache, "model-a", _lengths)
    return out.select("doc_id", F.col("embedding")[0].cast("long").alias("n_chars"), F.size("embedding").alias("dimension"), (F.lit(cache.read().count()) > F.lit(first)).alias("grown"))


def published_version(spark, sf):
    """Two versions of the orders published; a reader of the pointer sees the second, whole, and the first is still there."""
    orders, store = table(spark, sf, "orders"), Publication(spark, _folder(spark))
    store.publish({"orders": orders.where("o_orderstatus = 'F'")}, "v1")
    store.publish({"orders": orders}, "v2")
    count = lambda v, name: store.read("orders", v).groupBy("o_orderpriority").agg(F.count("*").alias(name))
    return count(None, "n_now").join(count("v1", "n_before"), "o_orderpriority", "left")


def build_chain(spark, sf):
    """Documents built at each stage of three runs: the first, one after nothing changed, and one after every fiftieth did and every hundred-and-first went."""
    docs = table(spark, sf, "documents").select("doc_id", "source", "text").where("doc_id IS NOT NULL")
    chain = BuildChain(spark, _folder(spark), standard_stages())
    later = docs.where("doc_id % 101 != 1").withColumn("text", F.when(F.col("doc_id") % 50 == 0, F.concat(F.coalesce("text", F.lit("")), F.lit(" changed"))).otherwise(F.col("text")))
    runs = [chain.run(docs), chain.run(docs), chain.run(later)]
    rows = [(s.name, *(r[s.name] for r in runs), chain.output(s.name).select("doc_id").distinct().count()) for s in chain.stages]
    return spark.createDataFrame(rows, "stage string, first long, again long, later long, n_docs long")


def publication_gates(spark, sf):
    """The gates over the chunks, vectors, tables (one for each order with lines, in the state it is in) and golden questions that there are."""
    docs, vectors = table(spark, sf, "documents"), table(spark, sf, "embeddings")
    state = F.when(F.col("o_orderstatus") == "P", "revision").otherwise("extraida")
    tables = table(spark, sf, "orders").select(F.col("o_orderkey").alias("table_id"), state.alias("state"), F.concat(F.lit("o"), "o_orderkey").alias("png_key"))
    assets = table(spark, sf, "lineitem").select(F.concat(F.lit("o"), "l_orderkey").alias("key"))
    recall = golden_recall(spark, sf).select((F.col("recall") / 1e6).alias("recall"))
    out = gates(docs, vectors, tables, assets, recall, dimension=64)
    return out.select("gate", F.floor(F.col("value") * 1e6 + 0.5).cast("long").alias("value"), "ok")


def _chain(spark, sf):
    """Each order with the order of the same customer before it."""
    before = F.lag("o_orderkey").over(W.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey"))
    return table(spark, sf, "orders").select("o_orderkey", before.alias("previous"))


def order_roots(spark, sf):
    return ancestry.roots(_chain(spark, sf), "o_orderkey", "previous")


def order_ancestors(spark, sf):
    pairs = ancestry.ancestors(_chain(spark, sf), "o_orderkey", "previous")
    return pairs.groupBy("ancestor").agg(F.count("*").alias("n_below"), F.max("distance").alias("deepest"))


def _index(spark, sf):
    return VectorIndex.build(table(spark, sf, "embeddings"))


def ivf_topk(spark, sf):
    asked = table(spark, sf, "embeddings").where("vec_id % 20 = 0").withColumnRenamed("vec_id", "query_id")
    return _index(spark, sf).search(asked, 4)


def ivf_recall(spark, sf):
    """Whether the index finds nine tenths of what a comparison with all vectors finds."""
    from folioscope.plans.search import knn_topk

    exact = knn_topk(spark, sf).select("query_id", "vec_id")
    hit = exact.join(ivf_topk(spark, sf).select("query_id", "vec_id", F.lit(1).alias("hit")), ["query_id", "vec_id"], "left")
    return hit.agg(F.countDistinct("query_id").alias("n_queries"), (F.avg(F.coalesce("hit", F.lit(0))) >= 0.9).alias("reached"))


_PREVIOUS = "p AS (SELECT o_orderkey AS child, lag(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS parent FROM orders)"
ORACLES = {
    "merged_log": """WITH m AS (SELECT o_orderkey, CASE WHEN o_orderpriority LIKE '1%' THEN 'X' ELSE o_orderstatus END AS o_orderstatus, CASE WHEN o_orderpriority LIKE '1%' THEN o_orderpriority WHEN o_orderstatus = 'O' THEN 'late' ELSE o_orderpriority END AS o_orderpriority FROM orders)
SELECT o_orderstatus, o_orderpriority, count(*) AS n, sum(o_orderkey)::BIGINT AS keys FROM m GROUP BY ALL""",
    "embedding_cache_merge": "SELECT doc_id, length(coalesce(text, ''))::BIGINT AS n_chars, 3 AS dimension, true AS grown FROM documents",
    "published_version": "SELECT o_orderpriority, count(*) AS n_now, nullif(count(*) FILTER (o_orderstatus = 'F'), 0) AS n_before FROM orders GROUP BY 1",
    "build_chain": """WITH s(stage) AS (VALUES ('cleaned'), ('chunks'), ('counts')), w AS (SELECT * FROM documents WHERE regexp_matches(coalesce(text, ''), '\\S')),
c AS (SELECT count(*) AS n, count(*) FILTER (doc_id % 50 = 0 AND doc_id % 101 <> 1) AS changed, count(*) FILTER (doc_id % 101 <> 1) AS left_ FROM documents WHERE doc_id IS NOT NULL),
v AS (SELECT count(*) AS left_ FROM documents WHERE doc_id % 101 <> 1 AND (doc_id % 50 = 0 OR regexp_matches(coalesce(text, ''), '\\S')))
SELECT stage, n AS first, 0::BIGINT AS again, changed AS later, CASE WHEN stage = 'cleaned' THEN c.left_ ELSE v.left_ END AS n_docs FROM s, c, v""",
    "publication_gates": f"""WITH g AS ({SEARCH_SQL["golden_recall"]}), t AS (SELECT count(*) FILTER (o_orderstatus = 'P') AS revision, count(*) FILTER (o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)) AS missing FROM orders)
SELECT 'chunks' AS gate, count(*) * 1000000 AS value, count(*) > 0 AS ok FROM documents UNION ALL SELECT 'dimension', count(*) FILTER (len(embedding) <> 64) * 1000000, count(*) FILTER (len(embedding) <> 64) = 0 FROM embeddings
UNION ALL SELECT 'missing_pictures', missing * 1000000, missing = 0 FROM t UNION ALL SELECT 'revision', revision * 1000000, revision = 0 FROM t UNION ALL SELECT 'recall', recall, recall >= 800000 FROM g""",
    "order_roots": f"""WITH RECURSIVE {_PREVIOUS}, r AS (SELECT child, child AS root, 0::BIGINT AS depth FROM p WHERE parent IS NULL UNION ALL SELECT p.child, r.root, r.depth + 1 FROM r JOIN p ON p.parent = r.child)
SELECT child AS o_orderkey, root, depth FROM r""",
    "order_ancestors": f"""WITH RECURSIVE {_PREVIOUS}, a AS (SELECT child, child AS ancestor, 0::BIGINT AS distance FROM p UNION ALL SELECT a.child, p.parent, a.distance + 1 FROM a JOIN p ON p.child = a.ancestor WHERE p.parent IS NOT NULL)
SELECT ancestor, count(*) AS n_below, max(distance) AS deepest FROM a GROUP BY ancestor""",
    "ivf_recall": "SELECT count(*) AS n_queries, true AS reached FROM embeddings WHERE vec_id % 20 = 0",
}
QUERIES = {name: globals()[name] for name in [*ORACLES, "ivf_topk"]}

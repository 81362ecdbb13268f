"""Queries over registries, grids, plans and gates."""

from __future__ import annotations

from pyspark.sql import functions as F

from folioscope.operators import grids
from folioscope.operators import registry as ops
from folioscope.sources.tables import inline, inline_sql, table

TABLES = "(1, 'd1', '392.10(A)', 'extraida'), (2, 'd1', '220.55', 'revision'), (3, 'd2', '2.3.26.2.2.1', 'verificada'), (4, 'd2', '2.3.26.2.2.1.a', 'extraida'), (5, 'd3', '9.9.9', 'revision'), (6, 'd3', '220.55', 'verificada')"
REFS = "('392.10 (a)'), ('392.10'), ('2.3.26.2.2.1'), ('9.9.9.a'), ('22'), ('220.55.7'), ('77')"
STATES = "(1, 10, 10, false), (2, 10, 12, false), (3, 40, 44, false), (4, CAST(NULL AS INT), 5, false), (5, CAST(NULL AS INT), 5, true), (6, 7, CAST(NULL AS INT), false), (7, CAST(NULL AS INT), CAST(NULL AS INT), false)"
LOCAL = "('v1/a.bin', 10), ('v1/b.bin', 20), ('v1/c.bin', 30)"
REMOTE = "('v1/a.bin', 10), ('v1/b.bin', 21), ('v1/old.bin', 5), ('v0/x.bin', 1)"
KEYS = "('store/v20240101-000000/a'), ('store/v20240101-000000/b'), ('store/v20240301-120000/a'), ('store/current')"
CELLS = "(1, 'a', 'b', '1', '2', '3', '4'), (2, 'a', '', '1', '2', '3', '4'), (3, 'a', 'b', '1', '', '', ''), (4, 'a', 'b', '1', '', '3', ''), (5, '', '', '1', '2', '3', '4')"
GRIDS = (
    ("zinc", [["RECUBRIMIENTO DE ZINC", "PROMEDIO", "", "MÍNIMO", ""], ["", "gr/m²", "µm", "gr/m²", "µm"], ["Pletinas y láminas", "458", "65,4", "381", "54,5"], ["Pernos", "381", None, "305", "43,6"]]),
    ("flat", [["A", "B"], ["1", "2"], ["3", "4"]]),
    ("short", [["A", "B", ""], ["", "x", "y"]]),
    ("levels", [["AISLAMIENTO", "", ""], ["INTERIOR", "", "EXTERIOR"], ["kV", "m", ""], ["1", "2", "3"], ["4", "—", "6"]]),
    ("prose", [["(1) Conduct", "ores individua", "les. Debe perm"], ["itirse la ins-", "talacion en cana", "les que no sean"], ["mas de lo indi", "cado en la ta", "bla siguiente"]]),
)


def _registry(spark):
    return inline(spark, TABLES, "ord, doc_id, table_id, state")


def upsert_merge(spark, sf):
    """Labels of all documents by their length replace the labels that there are; an old toxic flag is kept."""
    old = table(spark, sf, "labels").select("doc_id", F.col("quality").cast("int").alias("quality"), F.col("toxic").cast("int").alias("toxic"))
    new = table(spark, sf, "documents").select("doc_id", (F.col("n_chars") >= 500).cast("int").alias("quality"), F.lit(9).cast("int").alias("toxic"))
    return ops.merged(old, new, ["doc_id"], ("toxic",))


def count_by_state(spark, sf):
    return _registry(spark).groupBy("state").agg(F.count("*").alias("n"))


def page_profile_counts(spark, sf):
    docs = table(spark, sf, "documents")
    return docs.groupBy("source").agg(F.count_if(F.col("n_chars") < 500).alias("n_short"), F.count_if(F.col("n_chars") >= 5000).alias("n_long"), F.count_if(F.contains("text", F.lit("|"))).alias("n_tabular"), F.count("*").alias("n"))


def chunks_per_source(spark, sf):
    return table(spark, sf, "documents").groupBy("source", "lang").agg(F.count("*").alias("n"), F.sum("n_chars").alias("chars"))


def missing_labels(spark, sf):
    return table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id", "left_anti").select("doc_id", "source")


def publish_plan(spark, sf):
    return ops.upload_plan(inline(spark, LOCAL, "key, size"), inline(spark, REMOTE, "key, size"))


def prune_plan(spark, sf):
    return ops.prune_plan(inline(spark, LOCAL, "key, size"), inline(spark, REMOTE, "key, size"))


def list_versions(spark, sf):
    return ops.versions(inline(spark, KEYS, "key"))


def quality_gates(spark, sf):
    """One row for each gate: how many rows stand against it."""
    docs, vectors, labels = (table(spark, sf, n) for n in ("documents", "embeddings", "labels"))
    checks = [
        docs.agg(F.lit("empty_text").alias("gate"), F.count_if(F.length(F.trim("text")) == 0).alias("n")),
        vectors.agg(F.lit("dimension").alias("gate"), F.count_if(F.size("embedding") != 64).alias("n")),
        docs.join(labels, "doc_id", "left_anti").agg(F.lit("unlabelled").alias("gate"), F.count("*").alias("n")),
        labels.agg(F.lit("toxic").alias("gate"), F.count_if(F.col("toxic") == 1).alias("n")),
    ]
    out = checks[0]
    for c in checks[1:]:
        out = out.unionByName(c)
    return out.withColumn("ok", F.col("n") == 0)


def incremental_skip(spark, sf):
    """Documents whose text changed since a run that knew the even ids and an older text of every tenth."""
    now = table(spark, sf, "documents").select("doc_id", F.sha2("text", 256).alias("digest"))
    known = now.where("doc_id % 2 = 0").withColumn("digest", F.when(F.col("doc_id") % 10 == 0, F.sha2("digest", 256)).otherwise(F.col("digest")))
    return ops.changed(now, known, "doc_id", "digest")


def image_census(spark, sf):
    """Texts that occur more often than max(3, 1 % of a source's documents), as repeated images do."""
    docs = table(spark, sf, "documents")
    total = docs.groupBy("source").agg(F.count("*").alias("_all"))
    return docs.groupBy("source", F.sha2("text", 256).alias("digest")).agg(F.count("*").alias("n")).join(total, "source").where(F.col("n") > F.greatest(F.lit(3), F.col("_all") * 0.01)).drop("_all")


def table_ref_prefix(spark, sf):
    return grids.lookup(inline(spark, REFS, "ref"), _registry(spark))


def table_state(spark, sf):
    return inline(spark, STATES, "id, geo, vis, truncated").select("id", grids.table_state(F.col("geo"), F.col("vis"), F.col("truncated")).alias("state"))


def grid_consistent(spark, sf):
    rows = inline(spark, CELLS, "id, h1, h2, a1, a2, b1, b2")
    return rows.select("id", grids.is_consistent(F.array("h1", "h2"), F.array(F.array("a1", "a2"), F.array("b1", "b2"))).alias("consistent"))


def _grids(spark):
    raw = spark.createDataFrame(list(GRIDS), "name string, grid array<array<string>>")
    return raw.withColumn("g", grids.clean_grid(F.col("grid"))).withColumn("m", grids.merged_headers(F.col("g")))


def merge_headers(spark, sf):
    return _grids(spark).select("name", F.array_join("m.headers", " | ").alias("headers"), F.size("m.body").alias("n_rows"))


def prose_reject(spark, sf):
    return _grids(spark).select("name", grids.is_prose(F.col("m.headers"), F.col("m.body")).alias("prose"))


def grid_text(spark, sf):
    return _grids(spark).select("name", grids.text_grid(F.col("m.headers"), F.col("m.body")).alias("text"))


def markdown_table(spark, sf):
    regions = table(spark, sf, "region").select(F.struct("r_regionkey", "r_name").alias("r")).agg(F.array_sort(F.collect_list("r")).alias("rows"))
    body = F.transform("rows", lambda r: F.array(r["r_regionkey"].cast("string"), r["r_name"]))
    return regions.select(grids.to_markdown(F.lit("Regions"), F.array(F.lit("key"), F.lit("name")), body).alias("markdown"))


def budgeted_calls(spark, sf):
    """The longest documents of each source are granted until its budget of five is spent."""
    return ops.with_budget(table(spark, sf, "documents").select("source", "doc_id", (-F.col("n_chars")).alias("cost")), ["cost", "doc_id"], 5, "source").where("granted").select("source", "doc_id")


def recent_files(spark, sf):
    """The newest orders, the number asked for kept between 1 and 200."""
    n = min(max(500, 1), 200)
    return table(spark, sf, "orders").orderBy(F.col("o_orderdate").desc(), "o_orderkey").limit(n).select("o_orderkey", "o_orderdate")


def retrieval_stats(spark, sf):
    from folioscope.plans.search import knn_threshold

    return knn_threshold(spark, sf).groupBy("query_id").agg(F.min("distance").alias("best"), F.max("distance").alias("worst"), F.count("*").alias("n"))


def alias_resolve(spark, sf):
    """The first registered document one of whose aliases a question contains, without comparing all pairs of a large registry: aliases are few and broadcast."""
    asked = inline(spark, "(1, 'que dice el codigo electrico'), (2, 'reglamento tecnico vigente'), (3, 'otra cosa'), (4, 'codigo y reglamento')", "id, question")
    known = inline(spark, "(1, 'rt', 'reglamento|retec'), (2, 'ce', 'codigo electrico|codigo')", "ord, doc_id, aliases").select("ord", "doc_id", F.explode(F.split("aliases", r"\|")).alias("alias"))
    best = asked.join(F.broadcast(known), F.expr("contains(question, alias)")).groupBy("id").agg(F.min(F.struct("ord", "doc_id"))["doc_id"].alias("doc_id"))
    return asked.select("id").join(best, "id", "left")


_PREFIX = f"""WITH r AS (SELECT ref, lower(replace(ref, ' ', '')) AS k FROM {inline_sql(REFS, 'ref')}),
t AS (SELECT *, lower(replace(table_id, ' ', '')) AS i, CASE state WHEN 'verificada' THEN 3 WHEN 'extraida' THEN 2 WHEN 'revision' THEN 1 ELSE 0 END AS s FROM {inline_sql(TABLES, 'ord, doc_id, table_id, state')}),
m AS (SELECT *, CASE WHEN i = k THEN 3 WHEN starts_with(i, k) THEN 2 ELSE 1 END AS fit FROM r JOIN t ON starts_with(i, k) OR starts_with(k, i))
SELECT ref, table_id, state, CASE fit WHEN 3 THEN 'exact' WHEN 2 THEN 'stored_extends_ref' ELSE 'ref_extends_stored' END AS match
FROM (SELECT *, row_number() OVER (PARTITION BY ref ORDER BY fit DESC, s DESC, length(i) DESC, ord) AS n FROM m) WHERE n = 1"""

ORACLES = {
    "retrieval_stats": """WITH pairs AS (SELECT q.vec_id AS query_id, i.vec_id, CAST(floor((1 - list_cosine_similarity(q.embedding::DOUBLE[], i.embedding::DOUBLE[])) * 1e6 + 0.5) AS BIGINT) AS distance FROM embeddings q, embeddings i WHERE q.vec_id % 20 = 0),
near AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, vec_id) AS rank FROM pairs WHERE distance <= 450000) WHERE rank <= 12) SELECT query_id, min(distance) AS best, max(distance) AS worst, count(*) AS n FROM near GROUP BY query_id""",
    "upsert_merge": """WITH o AS (SELECT doc_id, quality::INT AS quality, toxic::INT AS toxic FROM labels), n AS (SELECT doc_id, (n_chars >= 500)::INT AS quality FROM documents)
SELECT coalesce(n.doc_id, o.doc_id) AS doc_id, coalesce(n.quality, o.quality) AS quality, coalesce(o.toxic, 9) AS toxic FROM o FULL JOIN n ON o.doc_id = n.doc_id""",
    "count_by_state": f"SELECT state, count(*) AS n FROM {inline_sql(TABLES, 'ord, doc_id, table_id, state')} GROUP BY state",
    "page_profile_counts": "SELECT source, count(*) FILTER (n_chars < 500) AS n_short, count(*) FILTER (n_chars >= 5000) AS n_long, count(*) FILTER (contains(text, '|')) AS n_tabular, count(*) AS n FROM documents GROUP BY source",
    "chunks_per_source": "SELECT source, lang, count(*) AS n, sum(n_chars)::BIGINT AS chars FROM documents GROUP BY ALL",
    "missing_labels": "SELECT doc_id, source FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)",
    "publish_plan": f"SELECT l.key, CASE WHEN r.size = l.size THEN 'skip' ELSE 'upload' END AS action FROM {inline_sql(LOCAL, 'key, size')} l LEFT JOIN {inline_sql(REMOTE, 'key, size')} r ON l.key = r.key",
    "prune_plan": f"SELECT key FROM {inline_sql(REMOTE, 'key, size')} EXCEPT SELECT key FROM {inline_sql(LOCAL, 'key, size')}",
    "list_versions": f"SELECT DISTINCT split_part(key, '/', 2) AS version FROM {inline_sql(KEYS, 'key')} WHERE split_part(key, '/', 2) LIKE 'v%'",
    "quality_gates": """WITH g AS (SELECT 'empty_text' AS gate, count(*) FILTER (length(trim(text)) = 0) AS n FROM documents UNION ALL SELECT 'dimension', count(*) FILTER (len(embedding) <> 64) FROM embeddings
UNION ALL SELECT 'unlabelled', count(*) FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels) UNION ALL SELECT 'toxic', count(*) FILTER (toxic = 1) FROM labels) SELECT gate, n, n = 0 AS ok FROM g""",
    "incremental_skip": "SELECT doc_id, sha256(text) AS digest FROM documents WHERE doc_id % 2 <> 0 OR doc_id % 10 = 0",
    "image_census": "SELECT source, digest, n FROM (SELECT source, sha256(text) AS digest, count(*) AS n FROM documents GROUP BY ALL) JOIN (SELECT source, count(*) AS a FROM documents GROUP BY source) USING (source) WHERE n > greatest(3, 0.01 * a)",
    "table_ref_prefix": _PREFIX,
    "table_state": f"""SELECT id, CASE WHEN geo IS NOT NULL AND vis IS NOT NULL THEN CASE WHEN abs(geo - vis) <= greatest(1, floor(0.1 * greatest(geo, vis))) THEN 'verificada' ELSE 'revision' END
WHEN vis IS NOT NULL THEN CASE WHEN truncated THEN 'revision' ELSE 'extraida' END WHEN geo IS NOT NULL THEN 'extraida' ELSE 'solo_imagen' END AS state FROM {inline_sql(STATES, 'id, geo, vis, truncated')}""",
    "grid_consistent": f"SELECT id, (h1 <> '')::INT + (h2 <> '')::INT >= 2 AND (a1 <> '')::INT + (a2 <> '')::INT + (b1 <> '')::INT + (b2 <> '')::INT >= 1.8 AS consistent FROM {inline_sql(CELLS, 'id, h1, h2, a1, a2, b1, b2')}",
    "merge_headers": "SELECT * FROM (VALUES ('zinc', 'RECUBRIMIENTO DE ZINC | PROMEDIO gr/m² | PROMEDIO µm | MÍNIMO gr/m² | MÍNIMO µm', 2), ('flat', 'A | B', 2), ('short', 'A | B | ', 1), ('levels', 'AISLAMIENTO INTERIOR kV | AISLAMIENTO INTERIOR m | AISLAMIENTO EXTERIOR', 2), ('prose', '(1) Conduct | ores individua | les. Debe perm', 2)) t(name, headers, n_rows)",
    "prose_reject": "SELECT * FROM (VALUES ('zinc', false), ('flat', false), ('short', false), ('levels', false), ('prose', true)) t(name, prose)",
    "markdown_table": "SELECT '**Regions**' || chr(10) || chr(10) || '| key | name |' || chr(10) || '|---|---|' || chr(10) || string_agg('| ' || r_regionkey || ' | ' || r_name || ' |', chr(10) ORDER BY r_regionkey) AS markdown FROM region",
    "budgeted_calls": "SELECT source, doc_id FROM (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) AS n FROM documents) WHERE n <= 5",
    "recent_files": "SELECT o_orderkey, o_orderdate FROM orders ORDER BY o_orderdate DESC, o_orderkey LIMIT 200",
    "alias_resolve": "SELECT * FROM (VALUES (1, 'ce'), (2, 'rt'), (3, NULL), (4, 'rt')) t(id, doc_id)",
}
QUERIES = {name: globals()[name] for name in [*ORACLES, "grid_text"]}

"""Operator 7 (native): I-Match document fingerprints.

Terms are lower-cased runs of characters other than ASCII blanks and punctuation.  The lexicon holds the terms whose share of
documents lies in a band, that is, whose inverse document frequency does.  As each of its terms is in
at least ``least`` of the documents, it has at most (mean distinct terms of a document) / ``least``
terms, however large the corpus is; it is broadcast if it is small, which is checked.  A document's distinct terms in the lexicon
are sorted and hashed once for each of several randomised lexicon subsets, whose chances differ so
that short and long documents both have subsets with a few of their terms.  With them goes the
smallest hash of all of its terms in each of 16 subsets, so that documents whose terms are outside the band, as those of a group of
copies that makes up more of the corpus than the band allows, keep what they have in common.  The
likeness of two fingerprints is the share of equal hashes among the subsets that hold a term of either.

Documents are put in ranges of their ids, about ``RANGE`` rows each, so that each has its follower beside
it and the text is shuffled once; the last of a range takes the first of the next.  An id, or the null
id, that fills more than a range is split by a hash of the text.  All steps are DataFrame functions.

Defined results: a null text is empty; two documents without a term have likeness 1; documents with the
same id follow each other by a hash of the text, then by text; a null id counts as the smallest; a single
document is followed by itself; a very long text is a row like any other; an empty table gives an empty
table; only the id and text columns are read, so other columns cannot clash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from folioscope.llm._common import checkpoint, conf_int, table, text_column

LEAST, MOST = 0.001, 0.05
#: One in so many terms of the lexicon is in the subset.
CHANCES = (2, 2, 4, 4, 8, 8, 16, 16, 32, 32, 64, 64, 128, 128, 256, 256)
#: Subsets of a document's own terms.
OWN = 16
#: Rows in a range of ids, about; terms of a lexicon that may be broadcast.
RANGE, SMALL = 50_000, 500_000
_SPLIT = r"[\x00-\x20!-/:-@\[-`{-\x7F]+"


def terms(text: Column) -> Column:
    """Distinct terms, with the empty string among them exactly once."""
    return F.array_distinct(F.concat(F.split(F.lower(text), _SPLIT, -1), F.array(F.lit(""))))


def lexicon(docs: DataFrame, n_docs: int, least: float = LEAST, most: float = MOST, seed: int = 11) -> DataFrame:
    """term, hash and the bit mask of its subsets, for terms in the band."""
    low, high = max(2, least * n_docs), max(2, most * n_docs)
    counted = docs.select(F.explode(terms(F.col("text"))).alias("term")).where("term != ''").groupBy("term").count().where(F.col("count").between(low, high))
    bits = [F.when(F.pmod(F.xxhash64("term", F.lit(seed + i)), F.lit(c)) == 0, F.lit(1 << i)).otherwise(F.lit(0)) for i, c in enumerate(CHANCES)]
    mask = bits[0]
    for b in bits[1:]:
        mask = mask + b
    return counted.select("term", F.xxhash64("term").alias("hash"), mask.cast("int").alias("mask"))


def _below(bounds: list, value: Column) -> Column:
    """How many of the sorted bounds are below a value: over the heads of runs of bounds, then inside a run."""
    step = max(1, int(len(bounds) ** 0.5))
    runs = [bounds[i : i + step] for i in range(0, len(bounds), step)]
    if not runs:
        return F.lit(0)
    count = lambda array: F.size(F.filter(array, lambda b: b < value))
    head = count(F.array(*(F.lit(r[0]) for r in runs)))
    inside = count(F.element_at(F.array(*(F.array(*map(F.lit, r)) for r in runs)), F.greatest(head, F.lit(1))))
    return F.when(head == 0, F.lit(0)).otherwise((head - 1) * step + inside)


def with_follower(docs: DataFrame) -> DataFrame:
    """part, place, doc_id, text and the text of the next document by descending id, with its part and place."""
    spark = docs.sparkSession
    size = docs.agg(F.count("*").alias("n"), F.count("doc_id").alias("ids")).first()
    wanted = max(4 * conf_int(spark, "spark.sql.shuffle.partitions", 200), size["n"] // RANGE)
    got = docs.agg(F.percentile_approx("doc_id", [i / wanted for i in range(1, wanted)], 20 * wanted).alias("b")).first()["b"] or []
    bounds = sorted(set(got))
    # An id that is the bound of several ranges, and null ids, are dealt to as many parts by the hash of the text.
    often = sorted(b for b in bounds if got.count(b) > 1) if len(bounds) < len(got) else []
    share = lambda n: F.floor((F.xxhash64("text") / float(1 << 64) + 0.5) * n).cast("long")
    sub = F.lit(0).cast("long")
    for b in often:
        n = got.count(b) + 1
        under = _below(bounds, F.col("doc_id")) == bounds.index(b)  # lower ids of the same range come after it
        sub = F.when(F.col("doc_id") == b, share(n)).when(under, F.lit(n).cast("long")).otherwise(sub)
    nulls = max(1, (size["n"] - size["ids"]) // max(1, size["n"] // wanted))
    # Parts in the order of the documents: ranges from the last, null ids at the end.
    rank = F.when(F.col("doc_id").isNull(), F.lit(len(bounds) + 1)).otherwise(len(bounds) - _below(bounds, F.col("doc_id"))).cast("long")
    part = rank * (1 << 20) + F.when(F.col("doc_id").isNull(), share(nulls)).otherwise(sub)
    order = W.partitionBy("part").orderBy(F.col("doc_id").desc_nulls_last(), "_h", "text")
    rows = docs.withColumn("part", part).withColumn("_h", F.xxhash64("text")).withColumn("place", F.row_number().over(order)).withColumn("next_text", F.lead("text").over(order))
    every = W.orderBy("part")
    whole = every.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    heads = rows.where("place = 1").select(
        F.col("part").alias("_part"),
        F.coalesce(F.lead("part").over(every), F.first("part").over(whole)).alias("_next_part"),
        F.coalesce(F.lead("text").over(every), F.first("text").over(whole)).alias("_next_text"),
    )
    last = F.col("next_text").isNull()
    return rows.join(heads, rows["part"] == heads["_part"]).select(
        "part", "place", "doc_id", "text",
        F.when(last, F.col("_next_text")).otherwise(F.col("next_text")).alias("next_text"),
        F.when(last, F.col("_next_part")).otherwise(F.col("part")).alias("next_part"),
        F.when(last, F.lit(1)).otherwise(F.col("place") + 1).alias("next_place"),
    )


#: xxhash64 of no terms is its seed, whose first digits these are.
_NONE = "00000000"


def _short(hashes: Column) -> Column:
    return F.substring(F.lpad(F.hex(F.xxhash64(hashes)), 16, "0"), 1, 8)


def with_own(df: DataFrame) -> DataFrame:
    """``rest``: the 8-digit hash of the least of all ``_terms`` in each of ``OWN`` subsets that part them, joined."""
    lowest = F.lit(-(1 << 63)).cast("long")
    # The subset's number in the highest bits, then the hash in its order: the least of each subset is the first of its run.
    turned = F.transform(F.array_remove("_terms", ""), lambda t: F.shiftleft(F.xxhash64(t), 60).bitwiseOR(F.shiftrightunsigned(F.xxhash64(t).bitwiseXOR(lowest), 4)))
    df = df.withColumn("_sorted", F.sort_array(turned))
    subset = lambda k: F.shiftrightunsigned(k, 60)
    df = df.withColumn("_own", F.filter("_sorted", lambda k, i: (i == 0) | (subset(k) != subset(F.get("_sorted", i - 1))))).drop("_sorted")
    back = lambda k: F.shiftleft(k, 4).bitwiseOR(subset(k)).bitwiseXOR(lowest)
    least = [F.get(F.transform(F.filter("_own", lambda k: subset(k) == i), back), 0) for i in range(OWN)]  # noqa: B023
    return df.withColumn("rest", F.concat_ws(".", *(_short(x) for x in least))).drop("_own")


def fingerprint(found: Column, rest: Column) -> Column:
    """One 8-digit hash for each subset of the sorted terms (``_NONE`` without a term), joined, and ``rest``."""

    def one(i: int) -> Column:
        return _short(F.transform(F.filter(found, lambda t: F.getbit(t["mask"], F.lit(i)) == 1), lambda t: t["hash"]))

    return F.concat_ws(".", *(one(i) for i in range(len(CHANCES))), rest)


def likeness(a: Column, b: Column) -> Column:
    pairs = F.filter(F.arrays_zip(F.split(a, r"\.").alias("a"), F.split(b, r"\.").alias("b")), lambda p: (p["a"] != _NONE) | (p["b"] != _NONE))
    same = F.size(F.filter(pairs, lambda p: p["a"].eqNullSafe(p["b"])))
    return F.when(a == b, F.lit(1.0)).otherwise(F.coalesce(F.try_divide(same.cast("double"), F.size(pairs).cast("double")), F.lit(0.0)))


def document_fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: float = LEAST, most: float = MOST) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited and near_next of every document."""
    own = docs.select(F.col(id_col).alias("doc_id"), text_column(text_col).alias("text"))
    known = checkpoint(lexicon(own, docs.count(), least, most))
    few = known.count() <= SMALL
    # The empty term stands for the document itself, so that one without terms in the lexicon keeps a row.
    known = known.unionByName(own.sparkSession.range(1).select(F.lit("").alias("term"), F.lit(None).cast("long").alias("hash"), F.lit(0).alias("mask")))
    known = F.broadcast(known) if few else known
    cut = F.floor(F.length("text") / 3).cast("int")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), F.length("text") - cut), F.substring(F.col("next_text"), F.lit(1), cut))
    keys = ["part", "place"]
    once = ["doc_id", "next_part", "next_place", "n_chars", "edited_sha256"]
    cut_up = (
        with_follower(own)
        .withColumn("edited", edited)
        .withColumns({"n_chars": F.length("text").cast("long"), "edited_sha256": F.sha2("edited", 256)})
        .select(*keys, *once, F.explode(F.array(F.struct(F.lit(0).alias("kind"), F.col("text").alias("text")), F.struct(F.lit(1).alias("kind"), F.col("edited").alias("text")))).alias("_x"))
        .select(*keys, *once, F.col("_x.kind").alias("kind"), terms(F.col("_x.text")).alias("_terms"))
    )
    pairs = (
        with_own(cut_up)
        .select(*keys, *once, "kind", "rest", F.explode("_terms").alias("term"))
        .join(known, "term")
        # What belongs to the document goes with its empty term alone, so that the other rows stay narrow.
        .select(*keys, "kind", "hash", "mask", *(F.when(F.col("term") == "", F.col(c)).alias(c) for c in [*once, "rest"]))
    )
    of = lambda kind: F.sort_array(F.collect_list(F.when((F.col("kind") == kind) & F.col("hash").isNotNull(), F.struct("hash", "mask"))))
    rest = lambda kind: F.max(F.when(F.col("kind") == kind, F.col("rest")))
    both = pairs.groupBy(*keys).agg(*(F.max(c).alias(c) for c in once), of(0).alias("_a"), of(1).alias("_b"), rest(0).alias("_rest_a"), rest(1).alias("_rest_b"))
    rows = checkpoint(both.select(*keys, *once, fingerprint(F.col("_a"), F.col("_rest_a")).alias("fingerprint"), fingerprint(F.col("_b"), F.col("_rest_b")).alias("edited_fingerprint")))
    follower = rows.select(F.col("part").alias("next_part"), F.col("place").alias("next_place"), F.col("fingerprint").alias("_next"))
    return rows.join(follower, ["next_part", "next_place"], "left").select(
        F.col("doc_id").alias(id_col), "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint",
        likeness(F.col("fingerprint"), F.col("edited_fingerprint")).alias("near_edited"),
        likeness(F.col("fingerprint"), F.col("_next")).alias("near_next"),
    )


def op7_term_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return document_fingerprints(table(spark, sf_dir, "documents"))

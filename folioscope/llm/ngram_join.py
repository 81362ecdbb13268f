"""Operator 2: n-gram Jaccard join over a token-group matrix.

Documents with the same shingle set are one node.  Two nodes link when their sets overlap by at least
3/4 of their union.  Every set is ordered by (frequent or not, hash); linked sets share a token of
their prefixes, the first n - ceil(3n/4) + 1 tokens, so prefix postings find every candidate.

1. Posting lists with two or more nodes are kept.  Each list pairs its nodes with its smallest one, a
   star, whose likely pairs are verified.  Linked nodes are of one group; a node whose likely pairs
   fail goes to the group of the likeliest.  This partitions similar documents into groups without all
   pairs of a group.  In a list of ``LONG`` or more nodes the smallest one may link with few of the others:
   there each node joins the group of the list's smallest node of its size, linked or not, so that the
   nodes of long lists are in few groups.
2. The matrix of tokens and groups stores which tokens the prefixes of each group hold together.  The
   number of a node's prefix tokens in a group's union bounds its overlap with every member, given the
   range of the members' sizes; only groups that the bound leaves open are opened for the node.
3. The nodes around a group, its members and those that it is open to, are verified against its
   centre, the member of most stars, and ``REPS`` more members, the same for all.  That joins nearly all.
4. A node x that is still apart from the centre C is known by its differences D, the tokens that only
   one of x and C has.  x and y link if their differences from each other are at most a seventh of both
   sizes; those are D(x) + D(y) less twice what D(x) and D(y) share.  As x is too far from C, both have
   to share some of D, and the farther out they are, the more: prefixes of D, the rarest tokens of the
   group first, with the positions in both find every candidate, and they are few.
5. Verified links give the components.

The order only steers the cost: frequent tokens are those counted in ``FREQUENT`` or more sets, at most
``MOST_FREQUENT`` of them, kept as a bit array; two tokens that share a bit are both treated as frequent,
by every document alike.  Partitions follow the number of shingles, so a task holds a bounded part of them.

Defined results: a null text, or one without a word, has an empty set and is its own component;
repeated rows are exact copies of each other, and rows that share an id link by their texts; a row with
a null id links like any other, but a component's id is null only if all its documents have none; a very
long text is one set, held by one task; ties between leaders go to the smaller node; an empty table gives
an empty table; only the id and text columns are read, so other columns cannot clash.  Tokens and nodes
are 64-bit hashes of shingles and sets.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from folioscope.llm._common import checkpoint, compact, conf_int, id_field, table
from folioscope.llm._kernels import mix, shingle_hashes, slices, text_bytes, word_bounds, word_hashes
from folioscope.llm.components import components

FREQUENT, MOST_FREQUENT = 5, 2_000_000
LOW = np.uint64(int(0.35 * (1 << 63)))
REPS = 7
LONG = 64
HELD = 1_000_000
HOLD = 2_000_000
SMALL = 200_000


def sets_of(column, k: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes (63 bits) of every row, ascending inside a row, and the row offsets."""
    data, offsets = text_bytes(column)
    n = len(offsets) - 1
    is_word, starts, ends, rows = word_bounds(data, offsets)
    hashes, owner = shingle_hashes(word_hashes(data, is_word, starts, ends), rows, n, k)
    hashes >>= np.uint64(1)
    count = np.bincount(owner, minlength=n)
    if len(owner) and (owner[1:] < owner[:-1]).any():
        hashes = hashes[np.argsort(owner, kind="stable")]
    edge = np.concatenate([[0], np.cumsum(count)])
    for a, b in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True):
        hashes[a:b].sort()
    keep = np.ones(len(hashes), dtype=bool)
    keep[1:] = hashes[1:] != hashes[:-1]
    keep[edge[:-1][count > 0]] = True
    edge = np.concatenate([[0], np.cumsum(keep, dtype=np.int64)])[edge]
    return hashes[keep], edge


def node_ids(hashes: np.ndarray, edge: np.ndarray) -> np.ndarray:
    """A 64-bit hash of every row's set, 0 for an empty one."""
    total = np.concatenate([[np.uint64(0)], np.cumsum(mix(hashes), dtype=np.uint64)])
    out = mix(total[edge[1:]] - total[edge[:-1]] + np.diff(edge).astype(np.uint64))
    out[np.diff(edge) == 0] = 0
    return out.view(np.int64)


def prefix_size(n: np.ndarray) -> np.ndarray:
    return n - (3 * n + 3) // 4 + 1


def flat(lengths: np.ndarray) -> np.ndarray:
    """0, 1, ... inside each run of the given lengths."""
    return np.arange(int(lengths.sum())) - np.repeat(np.cumsum(lengths) - lengths, lengths)


def first_of_each(nodes: np.ndarray) -> np.ndarray:
    _, first = np.unique(nodes, return_index=True)
    return np.sort(first)


def document_nodes(docs: DataFrame, k: int) -> DataFrame:
    """(doc_id, h, n, node) of every document; h is a hash of the text."""
    fields = T.StructType([id_field(docs), T.StructField("h", T.LongType()), T.StructField("n", T.LongType()), T.StructField("node", T.LongType())])

    def run(batches):
        for batch in batches:
            for part in slices(batch):
                hashes, edge = sets_of(part.column(2), k)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(np.diff(edge)), pa.array(node_ids(hashes, edge))], names=fields.names)

    return docs.select("doc_id", F.xxhash64("text").alias("h"), "text").mapInArrow(run, fields)


def token_counts(docs: DataFrame, parts: int, k: int) -> DataFrame:
    """part, tokens, counts: in how many different sets of a partition each token is.

    A prefix takes the smallest quarter of a set's rare tokens, so tokens above ``LOW`` are hardly ever in
    one: of those, only the ones that several sets of a partition hold are counted.
    """

    def packed(held: list[np.ndarray]) -> pa.RecordBatch:
        token, count = np.unique(np.concatenate(held), return_counts=True)
        keep = (count > 1) | (token < LOW)
        token, count = token[keep], count[keep]
        part = (token >> np.uint64(32)) * np.uint64(parts) >> np.uint64(31)
        at = np.searchsorted(part, np.arange(parts + 1))
        full = np.flatnonzero(np.diff(at))
        return pa.RecordBatch.from_arrays([
            pa.array(full.astype(np.int32)), pa.array([token[at[p] : at[p + 1]].tobytes() for p in full], pa.binary()), pa.array([np.minimum(count[at[p] : at[p + 1]], 65535).astype("<u2").tobytes() for p in full], pa.binary()),
        ], names=["part", "tokens", "counts"])

    def run(batches):
        held, size, seen = [], 0, set()
        for batch in batches:
            for part in slices(batch):
                hashes, edge = sets_of(part.column(0), k)
                nodes, n = node_ids(hashes, edge), np.diff(edge)
                fresh = np.array([i for i in first_of_each(nodes).tolist() if nodes[i] not in seen], dtype=np.int64)
                seen.update(nodes[fresh].tolist())
                held.append(hashes[np.repeat(edge[fresh], n[fresh]) + flat(n[fresh])])
                size += len(held[-1])
                if size > HELD:
                    yield packed(held)
                    held, size, seen = [], 0, set()
        if size:
            yield packed(held)

    return docs.select("text").mapInArrow(run, "part int, tokens binary, counts binary")


def frequent_bits(packed: DataFrame, parts: int) -> np.ndarray:
    """A bit for (the top bits of) every frequent token; no bit set if there is none."""

    def run(batches):
        token, count = [], []
        for b in batches:
            token += [np.frombuffer(x, np.uint64) for x in b.column(0).to_pylist()]
            count += [np.frombuffer(x, "<u2") for x in b.column(1).to_pylist()]
        if token:
            one, at = np.unique(np.concatenate(token), return_inverse=True)
            total = np.bincount(at, np.concatenate(count))
            one, total = one[total >= FREQUENT], total[total >= FREQUENT]
            if len(one):
                yield pa.RecordBatch.from_arrays([pa.array([one.tobytes()], pa.binary()), pa.array([total.astype("<i8").tobytes()], pa.binary())], names=["tokens", "counts"])

    summed = checkpoint(packed.repartition(parts, "part").select("tokens", "counts").mapInArrow(run, "tokens binary, counts binary"))
    # Only the tokens above the level that leaves at most MOST_FREQUENT of them come to the driver.
    sizes = {0: summed.agg(F.sum(F.octet_length("tokens")) / 8).first()[0] or 0}
    level = FREQUENT
    while sizes[0] > MOST_FREQUENT:
        level *= 2
        kept = _above(summed, level)
        sizes[0] = kept.agg(F.sum(F.octet_length("tokens")) / 8).first()[0] or 0
    rows = (_above(summed, level) if level > FREQUENT else summed.select("tokens")).collect()
    tokens = np.concatenate([np.frombuffer(bytes(r["tokens"]), np.uint64) for r in rows]) if rows else np.zeros(0, np.uint64)
    bits = np.zeros(1 << max(16, int(len(tokens) * 16).bit_length()), dtype=bool)
    bits[_slot(tokens, len(bits))] = True
    return np.packbits(bits)


def _above(summed: DataFrame, level: int) -> DataFrame:
    def run(batches):
        for b in batches:
            for t, c in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                yield pa.RecordBatch.from_arrays([pa.array([np.frombuffer(t, np.uint64)[np.frombuffer(c, "<i8") >= level].tobytes()], pa.binary())], names=["tokens"])

    return summed.mapInArrow(run, "tokens binary")


def _slot(tokens: np.ndarray, size: int) -> np.ndarray:
    return (mix(tokens) >> np.uint64(64 - (size.bit_length() - 1))).astype(np.int64)


def posting_lists(docs: DataFrame, bits: np.ndarray, parts: int, k: int) -> DataFrame:
    """token, node, n, place, leader, leader_n, near of every prefix token that several nodes hold.

    place is the token's in the node's set, the leader the list's smallest node, and near, null in a list of fewer than ``LONG`` nodes, the smallest of about the node's size.
    """
    shared = docs.sparkSession.sparkContext.broadcast(bits.tobytes())

    def deal(batches):
        known = np.unpackbits(np.frombuffer(shared.value, np.uint8)).astype(bool)
        held: list[tuple] = []

        def packed():
            token, node, n, at_ = (np.concatenate(x) for x in zip(*held, strict=True))
            part = (token << np.uint64(1) >> np.uint64(33)) * np.uint64(parts) >> np.uint64(31)
            order = np.argsort(part, kind="stable")
            columns = [x[order] for x in (token, node, n, at_)]
            at = np.searchsorted(part[order], np.arange(parts + 1))
            full = np.flatnonzero(np.diff(at))
            return pa.RecordBatch.from_arrays([pa.array(full.astype(np.int32)), *(pa.array([x[at[p] : at[p + 1]].tobytes() for p in full], pa.binary()) for x in columns)], names=["part", "tokens", "nodes", "sizes", "places"])

        size = 0
        for batch in batches:
            for part in slices(batch):
                hashes, edge = sets_of(part.column(0), k)
                nodes, n = node_ids(hashes, edge), np.diff(edge)
                rare = ~known[_slot(hashes, len(known))]
                row = np.repeat(np.arange(len(n)), n)
                # Rare tokens first, both kinds by hash: how many of them stand before each token.
                ahead = np.concatenate([[0], np.cumsum(rare, dtype=np.int64)])
                rares = ahead[edge[1:]] - ahead[edge[:-1]]
                place = np.where(rare, ahead[:-1] - ahead[edge[:-1]][row], rares[row] + np.arange(len(hashes)) - edge[:-1][row] - (ahead[:-1] - ahead[edge[:-1]][row]))
                one = np.zeros(len(n), dtype=bool)
                one[first_of_each(nodes)] = True
                take = (place < prefix_size(n)[row]) & one[row]
                held.append((hashes[take], nodes[row[take]], n[row[take]].astype(np.int32), place[take].astype(np.int32)))
                size += int(take.sum())
                if size > HELD // 2:
                    yield packed()
                    held, size = [], 0
        if size:
            yield packed()

    def gather(batches):
        held = [[], [], [], []]
        for b in batches:
            for c, kind in enumerate((np.uint64, np.int64, np.int32, np.int32)):
                held[c] += [np.frombuffer(v, kind) for v in b.column(c + 1).to_pylist()]
        if not held[0]:
            return
        token, node, n, place = (np.concatenate(x) for x in held)
        del held
        order = np.argsort(token)
        ranked = token[order]
        more = np.zeros(len(token) + 1, dtype=bool)
        more[1:-1] = ranked[1:] == ranked[:-1]
        order = order[more[1:] | more[:-1]]
        token, node, n, place = token[order], node[order], n[order], place[order]
        order = np.lexsort((node, token))
        token, node, n, place = token[order], node[order], n[order], place[order]
        new = np.ones(len(token), dtype=bool)
        new[1:] = (token[1:] != token[:-1]) | (node[1:] != node[:-1])
        token, node, n, place = token[new], node[new], n[new], place[new]
        start = np.ones(len(token), dtype=bool)
        start[1:] = token[1:] != token[:-1]
        first = np.flatnonzero(start)
        size = np.diff(np.append(first, len(token)))
        lead = np.repeat(first, size)
        keep = np.repeat(size > 1, size)
        # Sizes of one class allow a link.  Inside a class the nodes ascend, so the first is the smallest.
        kind = np.floor(np.log(n) / np.log(4 / 3)).astype(np.int64)
        by = np.lexsort((node, kind, lead))
        head = np.ones(len(token), dtype=bool)
        head[1:] = (lead[by][1:] != lead[by][:-1]) | (kind[by][1:] != kind[by][:-1])
        near = np.empty_like(node)
        near[by] = node[by][np.flatnonzero(head)[np.cumsum(head) - 1]]
        short = np.repeat(size < LONG, size)
        for i in range(0, len(token), 1 << 18):
            s = np.flatnonzero(keep[i : i + (1 << 18)]) + i
            if len(s):
                yield pa.RecordBatch.from_arrays([pa.array(token[s].view(np.int64)), pa.array(node[s]), pa.array(n[s].astype(np.int64)), pa.array(place[s].astype(np.int64)), pa.array(node[lead[s]]), pa.array(n[lead[s]].astype(np.int64)), pa.array(near[s], mask=short[s])], names=["token", "node", "n", "place", "leader", "leader_n", "near"])

    dealt = docs.select("text").mapInArrow(deal, "part int, tokens binary, nodes binary, sizes binary, places binary")
    return dealt.repartition(parts, "part").mapInArrow(gather, "token long, node long, n long, place long, leader long, leader_n long, near long")


def may_link(n_a, n_b):
    """Whether sizes allow a link."""
    return (4 * F.least(n_a, n_b)) >= 3 * F.greatest(n_a, n_b)


def needed(n_a, n_b):
    """Prefix tokens that linked sets of these sizes share at least: 3/7 of both sizes less what may follow a prefix."""
    follow = lambda n: F.ceil(3 * n / 4) - 1
    return F.greatest(F.lit(1), F.ceil(3 * (n_a + n_b) / 7 - F.lit(1e-9)) - F.greatest(follow(n_a), follow(n_b)))


def whole_sets(wanted: DataFrame, nodes: DataFrame, docs: DataFrame, k: int) -> DataFrame:
    """(node, tokens) of the ``wanted`` nodes, a checkpoint.  A node's text is found by an id and a hash of the text, so rows without an id count."""
    wanted = compact(nodes.join(wanted.select("node").distinct(), "node", "left_semi").select(F.col("doc_id").alias("_id"), "h", "node"))
    few = wanted.count() <= SMALL
    rows = docs.select("doc_id", "text", F.xxhash64("text").alias("h")).alias("d")
    same = F.col("d.h").eqNullSafe(F.col("w.h")) & F.col("d.doc_id").eqNullSafe(F.col("w._id"))
    picked = rows.join(F.broadcast(wanted).alias("w") if few else wanted.alias("w"), same).select("node", "text")

    def sets(batches):
        for batch in batches:
            for part in slices(batch):
                hashes, edge = sets_of(part.column(1), k)
                raw = [hashes[a:b].tobytes() for a, b in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(raw, pa.binary()), pa.array(node_ids(hashes, edge))], names=["node", "tokens", "is"])

    found = picked.mapInArrow(sets, "node long, tokens binary, is long").where("node = is").drop("is")
    return checkpoint(found.dropDuplicates(["node"]))


def verified(pairs: DataFrame, whole: DataFrame) -> DataFrame:
    """The pairs (a, b) of nodes whose whole sets link, a checkpoint."""

    def compare(batches):
        for b in batches:
            keep = []
            for x, y in zip(b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(100 * both >= 75 * (len(x) + len(y) - both))
            mask = np.flatnonzero(keep)
            if len(mask):
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(mask)), b.column(1).take(pa.array(mask))], names=["a", "b"])

    left = whole.select(F.col("node").alias("a"), F.col("tokens").alias("x"))
    right = whole.select(F.col("node").alias("b"), F.col("tokens").alias("y"))
    return compact(pairs.select("a", "b").distinct().join(left, "a").join(right, "b").select("a", "b", "x", "y").mapInArrow(compare, "a long, b long"))


def similar_groups(stars: DataFrame, roots: DataFrame) -> DataFrame:
    """(node, grp) of the nodes of stars (a leads, b, shared): that of the linked component, else of the likeliest leader's, else the node's own."""
    likely = stars.groupBy("b").agg(F.max(F.struct("shared", (-F.col("a")).alias("minus"), "a")).alias("m")).select(F.col("b").alias("node"), F.col("m.a").alias("leader"))
    nodes = stars.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    first = nodes.join(roots.select("node", "root"), "node", "left").join(likely, "node", "left").select("node", "root", "leader")
    of = first.select(F.col("node").alias("leader"), F.coalesce("root", "leader", "node").alias("_at"))
    return first.join(of, "leader", "left").select("node", F.coalesce("root", "_at", "node").alias("grp"))


def joined_groups(grouped: DataFrame, lists: DataFrame) -> DataFrame:
    """(node, grp): the groups of ``grouped``, those that meet in long lists made one; also of the nodes that only long lists group.

    Each group, or node without one, joins that of the ``near`` node with which it shares most.
    """
    meet = compact(lists.where("near != node").groupBy("near", "node").agg(F.count("*").alias("shared")))
    if meet.isEmpty():
        return grouped
    known = grouped.select("node", "grp")
    ends = meet.join(known, "node", "left").withColumn("a", F.coalesce("grp", "node")).drop("grp")
    ends = ends.join(known.select(F.col("node").alias("near"), "grp"), "near", "left").withColumn("b", F.coalesce("grp", "near"))
    best = ends.where("a != b").groupBy("a").agg(F.max(F.struct("shared", (-F.col("b")).alias("minus"), "b")).alias("m")).select("a", "m.b")
    roots = compact(components(best)).select(F.col("node").alias("grp"), "root")
    every = known.unionByName(meet.select(F.explode(F.array("near", "node")).alias("node")).distinct().join(known, "node", "left_anti").select("node", F.col("node").alias("grp")))
    return every.join(roots, "grp", "left").select("node", F.coalesce("root", "grp").alias("grp"))


def open_groups(lists: DataFrame, groups: DataFrame, parts: int) -> DataFrame:
    """(node, grp, size): groups of as many or more nodes that the token-group bounds leave open to a node of another.

    Sets of n and m tokens link only if they share 3/7 of n + m, so the first token that they share comes
    early enough in both: one at ``place`` in a set of n serves for partners of (4n - 7 place) / 3 at most.
    Pairs with such a token are bounded by the prefix tokens of the node in the group's union.
    """
    known = lists.select("token", "node", "n", F.floor((4 * F.col("n") - 7 * F.col("place")) / 3).alias("reach")).join(groups, "node", "left").select(
        "token", "node", "n", "reach", F.coalesce("grp", "node").alias("grp"), F.coalesce("size", F.lit(1)).alias("size"), F.coalesce("low", "n").alias("low"), F.coalesce("high", "n").alias("high")
    )
    known = checkpoint(known)

    def matrix(batches):
        """For each token, every node against each larger group in its list; pairs are made once inside the partition."""
        columns = [b for b in batches if b.num_rows]
        if not columns:
            return
        t = pa.Table.from_batches(columns).combine_chunks()
        del columns
        names = ("token", "node", "n", "reach", "grp", "size", "low", "high")
        token, node, n, reach, grp, size, low, high = (t.column(c).to_numpy() for c in names)
        order = np.lexsort((grp, size, token))
        token, node, n, reach, grp, size, low, high = (x[order] for x in (token, node, n, reach, grp, size, low, high))
        start = np.ones(len(token), dtype=bool)
        start[1:] = token[1:] != token[:-1]
        head = np.ones(len(token), dtype=bool)
        head[1:] = start[1:] | (grp[1:] != grp[:-1])
        heads = np.flatnonzero(head)
        farthest = np.maximum.reduceat(reach, heads)
        of = np.cumsum(head) - 1  # the group entry of each row
        tokens = np.cumsum(start) - 1
        last = np.searchsorted(tokens[heads], tokens, side="right")  # group entries of a row's token end here
        later = last - of - 1
        out_node, out_head = [], []
        total = np.concatenate([[0], np.cumsum(later)])
        begin = 0
        while begin < len(token):  # a bounded number of entries at a time
            end = max(begin + 1, int(np.searchsorted(total, total[begin] + (1 << 19), side="right")) - 1)
            rows = np.repeat(np.arange(begin, end), later[begin:end])
            own = of[rows] + 1 + flat(later[begin:end])
            entry = heads[own]
            fits = (4 * np.minimum(n[rows], high[entry]) >= 3 * np.maximum(n[rows], low[entry])) & (n[rows] <= farthest[own]) & (np.maximum(low[entry], (3 * n[rows] + 3) // 4) <= reach[rows])
            out_node.append(rows[fits])
            out_head.append(entry[fits])
            if sum(map(len, out_node)) > 1 << 20 or end == len(token):
                rows, entry = np.concatenate(out_node), np.concatenate(out_head)
                if len(rows):
                    order = np.lexsort((grp[entry], node[rows]))
                    rows, entry = rows[order], entry[order]
                    new = np.ones(len(rows), dtype=bool)
                    new[1:] = (node[rows][1:] != node[rows][:-1]) | (grp[entry][1:] != grp[entry][:-1])
                    r, e = rows[new], entry[new]
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in (node[r], n[r], grp[e], size[e], low[e], high[e])], names=["node", "n", "grp", "size", "low", "high"])
                out_node, out_head = [], []
            begin = end

    pairs = compact(known.repartition(parts, "token").mapInArrow(matrix, "node long, n long, grp long, size long, low long, high long").distinct())
    union = known.select("grp", "token").distinct()
    counted = pairs.join(known.select("node", "token"), "node").join(union, ["grp", "token"]).groupBy("node", "n", "grp", "size", "low", "high").agg(F.count("*").alias("shared"))
    least = F.greatest(F.col("low"), F.ceil(3 * F.col("n") / 4))
    most = F.least(F.col("high"), F.floor(4 * F.col("n") / 3))
    # Between these two sizes the bound is larger; one less covers the rounding.
    left = counted.where((least <= most) & (F.col("shared") >= F.greatest(F.lit(1), F.least(needed(F.col("n"), least), needed(F.col("n"), most)) - 1)))
    return left.select("node", "grp", "size")


def difference_pairs(around: DataFrame, centres: DataFrame, whole: DataFrame, so_far: DataFrame) -> DataFrame:
    """Pairs (a, b) that may link, of nodes around a group: a is apart from the centre, and b from a.

    ``around``: (grp, node); ``centres``: (grp, centre); ``so_far``: (node, root) of the linked components.
    """
    rooted = around.join(so_far, "node", "left").select("grp", "node", F.coalesce("root", "node").alias("root"))
    middle = centres.join(so_far, centres["centre"] == so_far["node"], "left").select("grp", "centre", F.coalesce("root", "centre").alias("centre_root"))
    rooted = rooted.join(middle, "grp").withColumn("apart", F.col("root") != F.col("centre_root")).where(F.col("node") != F.col("centre"))
    have = rooted.groupBy("grp").agg(F.max("apart").alias("_any"), F.count("*").alias("_size")).where("_any").select("grp", (1 + F.floor(F.col("_size") / 1000)).cast("int").alias("_salts"))
    rooted = rooted.join(have, "grp").select("grp", "node", "root", "apart", F.pmod(F.xxhash64("node"), F.col("_salts")).cast("int").alias("salt"))
    # The centre's set goes once to each part of its group, so no task gets a whole group.
    middles = middle.join(have, "grp").join(whole, F.col("centre") == whole["node"]).select("grp", F.explode(F.sequence(F.lit(0), F.col("_salts") - 1)).alias("salt"), F.col("tokens").alias("middle"))
    rows = rooted.join(whole, "node").join(middles, ["grp", "salt"]).select("grp", "node", "root", "apart", "tokens", "middle")

    def differences(batches):
        for batch in batches:
            for i in range(0, batch.num_rows, 256):
                part = batch.slice(i, 256)
                out, sizes = [], []
                for x, c in zip(part.column(4).to_pylist(), part.column(5).to_pylist(), strict=True):
                    x, c = np.frombuffer(x, np.uint64), np.frombuffer(c, np.uint64)
                    out.append(np.setxor1d(x, c, assume_unique=True))
                    sizes.append(len(x))
                d = np.array([len(x) for x in out])
                at = pa.array(np.repeat(np.arange(part.num_rows), d))
                columns = [part.column(j).take(at) for j in range(4)]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(np.array(sizes, dtype=np.int64)).take(at), pa.array(d.astype(np.int64)).take(at), pa.array(np.concatenate(out).view(np.int64) if len(out) else np.zeros(0, np.int64))], names=["grp", "node", "root", "apart", "n", "d", "token"])

    entries = checkpoint(rows.mapInArrow(differences, "grp long, node long, root long, apart boolean, n long, d long, token long"))
    often = entries.groupBy("grp", "token").agg(F.count("*").alias("_often"), F.max("apart").alias("_any")).where("_often > 1 and _any")
    # How far out the nearest to the centre are: what a partner has to share at least follows from it.
    near = entries.groupBy("grp").agg(F.min(7 * F.col("d") - F.col("n")).alias("_near"), F.min(F.when(F.col("apart"), 7 * F.col("d") - F.col("n"))).alias("_near_apart"))
    order = W.partitionBy("grp", "node").orderBy("_often", "token")
    placed = entries.join(often, ["grp", "token"], "left").withColumn("_often", F.coalesce("_often", F.lit(1))).withColumn("at", F.row_number().over(order)).where("_any").join(near, "grp")
    share = lambda own, other: F.greatest(F.lit(1), F.ceil((own + other) / 14 - F.lit(1e-9)))
    out = 7 * F.col("d") - F.col("n")
    placed = placed.where(F.col("at") <= F.col("d") - share(out, F.when(F.col("apart"), F.col("_near")).otherwise(F.col("_near_apart"))) + 1)
    a = placed.where("apart").select("grp", "token", F.col("node").alias("a"), F.col("root").alias("root_a"), F.col("n").alias("n_a"), F.col("d").alias("d_a"), F.col("at").alias("at_a"))
    b = placed.select("grp", "token", F.col("node").alias("b"), F.col("root").alias("root_b"), F.col("n").alias("n_b"), F.col("d").alias("d_b"), F.col("at").alias("at_b"))
    least = share(7 * F.col("d_a") - F.col("n_a"), 7 * F.col("d_b") - F.col("n_b"))
    fits = (F.col("root_a") != F.col("root_b")) & may_link(F.col("n_a"), F.col("n_b")) & (F.col("at_a") <= F.col("d_a") - least + 1) & (F.col("at_b") <= F.col("d_b") - least + 1)
    return a.join(b, ["grp", "token"]).where(fits).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def ngram_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 5, with_group: bool = False) -> DataFrame:
    """doc_id, n_shingles and component_id of every document; if ``with_group``, also ``h``, xxhash64 of its text, and ``group``, a number of the component (null without shingles)."""
    spark = docs.sparkSession
    docs = docs.select(F.col(id_col).alias("doc_id"), docs[text_col].cast("string").alias("text"))
    own = checkpoint(document_nodes(docs, k))
    shingles = own.agg(F.sum("n")).first()[0] or 0
    parts = max(2 * conf_int(spark, "spark.sql.shuffle.partitions", 200), -(-shingles // HOLD))
    bits = frequent_bits(token_counts(docs, parts, k), parts)
    nodes = own.where("n > 0").groupBy("node").agg(F.min(F.struct(F.col("doc_id").isNull().alias("_none"), "doc_id", "h")).alias("_f"), F.max("n").alias("n")).select("node", "_f.doc_id", "_f.h", "n")
    lists = checkpoint(posting_lists(docs, bits, parts, k))
    stars = compact(
        lists.where((F.col("node") != F.col("leader")) & may_link(F.col("n"), F.col("leader_n")))
        .groupBy("leader", "node", "leader_n", "n").agg(F.count("*").alias("shared"))
        .where(F.col("shared") >= needed(F.col("n"), F.col("leader_n")))
        .select(F.col("leader").alias("a"), F.col("node").alias("b"), "shared")
    )
    links = verified(stars, whole_sets(stars.select(F.explode(F.array("a", "b")).alias("node")), nodes, docs, k))
    so_far = compact(components(links))
    grouped = compact(joined_groups(compact(similar_groups(stars, so_far)), lists).join(nodes.select("node", "n"), "node"))
    sizes = grouped.groupBy("grp").agg(F.count("*").alias("size"), F.min("n").alias("low"), F.max("n").alias("high"))
    groups = grouped.join(sizes, "grp").select("node", "grp", "size", "low", "high")
    left = compact(open_groups(lists, groups, parts))
    # Around each group of two or more: its members and the nodes that it is open to.
    around = compact(left.where("size > 1").select("grp", "node").unionByName(groups.where("size > 1").select("grp", "node")))
    degree = stars.select(F.explode(F.array("a", "b")).alias("node")).groupBy("node").agg(F.count("*").alias("_stars"))
    chosen = groups.where("size > 1").select("grp", "node").join(degree, "node", "left").groupBy("grp").agg(
        F.max(F.struct("_stars", "node")).alias("_c"), *(F.min(F.struct(F.xxhash64("node", F.lit(i)).alias("_h"), "node")).alias(f"_r{i}") for i in range(REPS))
    )
    chosen = compact(chosen.select("grp", F.col("_c.node").alias("centre"), F.array_distinct(F.array("_c.node", *(f"_r{i}.node" for i in range(REPS)))).alias("reps")))
    rooted = around.join(so_far, "node", "left").select("grp", "node", F.coalesce("root", "node").alias("root"))
    middle = chosen.join(so_far, chosen["centre"] == so_far["node"], "left").select("grp", "reps", F.coalesce("root", "centre").alias("_root"))
    asked = rooted.join(middle, "grp").where(F.col("root") != F.col("_root")).select(F.col("node").alias("a"), F.explode("reps").alias("b")).where("a != b")
    # Two nodes in lists of their own need no look if they are around one group: their differences from its centre are compared.
    single = left.where("size = 1").select(F.col("node").alias("a"), F.col("grp").alias("b"))
    both = single.join(around.select(F.col("node").alias("a"), "grp"), "a").join(around.select(F.col("node").alias("b"), "grp"), ["b", "grp"]).select("a", "b").distinct()
    pairs = compact(asked.unionByName(single.join(both, ["a", "b"], "left_anti")).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    whole = whole_sets(pairs.select(F.explode(F.array("a", "b")).alias("node")).unionByName(around.select("node")), nodes, docs, k)
    links = links.unionByName(verified(pairs, whole))
    final = compact(components(links))
    more = verified(difference_pairs(around, chosen.select("grp", "centre"), whole, final), whole)
    if not more.isEmpty():
        final = components(links.unionByName(more))
    placed = own.join(final, "node", "left").withColumn("root", F.coalesce("root", "node"))
    smallest = placed.where("n > 0").groupBy("root").agg(F.min("doc_id").alias("component_id"))
    extra = ["h", "group"] if with_group else []
    names = [F.col("doc_id").alias(id_col), F.col("n").alias("n_shingles"), "component_id", *extra]
    linked = placed.where("n > 0").join(smallest, "root").withColumn("group", F.col("root")).select(*names)
    return linked.unionByName(placed.where("n = 0").withColumns({"component_id": F.col("doc_id"), "group": F.lit(None).cast("long")}).select(*names))


def op2_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_components(table(spark, sf_dir, "documents"))

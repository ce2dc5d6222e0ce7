"""Documents whose sets of five-word shingles have a Jaccard similarity of 0.8 or more, and their components.

Equal sets are one node (a 64-bit hash of the set). First the SimHash fingerprints of all nodes are linked by the
trie self-join; each node of a SimHash component is compared with the component's first node by whole sets, and what
reaches the bound is connected.

SimHash fingerprints of pairs at 0.8 differ in up to about 11 of 64 bits, at which any split into blocks leaves
groups that grow with the square of the table. So the pairs beyond the trie's budget come from MinHash: ``BANDS``
keys of ``ROWS`` minima each; a pair at 0.8 shares no key with probability (1 - 0.8**4)**20 = 3e-5, a more similar
one with less. Every candidate is then compared by its whole sets, so nothing below the bound links.

The nodes of a key are first compared with its head, the node that meets most others over all its keys, so that a
family around one base is compared with that base; nodes that SimHash has connected with it are not compared again.
Two nodes that both reach the bound with a head are connected by it. Of the pairs of a key that the heads leave in
different components, one node at least falls short of the head; such sets can only be near each other if they share
over half of what sets the other apart from the head. ``by_differences`` joins them on that, rarest differences first.
So a pair is left out only if it is connected already or falls short, and the components are those of all pairs
that share a key. Pairs of a key that only have the head's shingles or a common passage in common are not listed.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quorumlab.llm.shared import drop_staged, joined_by_hot, mixed, staged, text_slices
from quorumlab.llm.skew import joined_in_cells, joined_salted

BANDS, ROWS = 20, 4


def shingles(text: str, size: int = 5) -> np.ndarray:
    """Sorted distinct hashes of a text's word shingles; a shorter text is one shingle."""
    words = text.encode().lower().split()  # on bytes both see ASCII only
    n = len(words) - size + 1
    joined, digest = b" ".join(words), xxhash.xxh64_intdigest
    if n < 1:
        return np.array([digest(joined, 42)], np.uint64)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])[:n].tolist()
    return np.unique(np.fromiter((digest(joined[a:b], 42) for a, b in zip(starts, ends[size - 1 :].tolist(), strict=True)), np.uint64, n))


def node_of(found: np.ndarray) -> int:
    return int(np.uint64(xxhash.xxh64_intdigest(found.tobytes(), 7)).view(np.int64))


def signatures(docs: DataFrame, fingerprint, size: int = 5) -> DataFrame:
    """(doc_id, node, fp, n, keys) of every row: its set's hash, its text's fingerprint, the set's size and the keys of its bands."""
    rng = np.random.default_rng(5)
    odd, plus, fold = (rng.integers(0, 1 << 64, BANDS * ROWS, np.uint64) for _ in range(3))
    odd |= np.uint64(1)

    def hashed(batches):
        for batch in batches:
            for first, texts in text_slices(batch):
                sets = [shingles(t, size) for t in texts]
                sizes = np.array(list(map(len, sets)), np.int64)
                every, starts = np.concatenate(sets), np.cumsum(sizes) - sizes
                keys = np.empty((len(sets), BANDS), np.uint64)
                for band in range(BANDS):
                    key = np.full(len(sets), band, np.uint64)
                    for j in range(band * ROWS, band * ROWS + ROWS):
                        key += mixed(np.minimum.reduceat(every * odd[j] + plus[j], starts) ^ fold[j])
                    keys[:, band] = mixed(key)
                flat = pa.array(keys.reshape(-1).view(np.int64))
                columns = [
                    batch.column(0).slice(first, len(texts)),
                    pa.array([node_of(s) for s in sets], pa.int64()),
                    pa.array(np.array([fingerprint(t) for t in texts], np.uint64).view(np.int64)),
                    pa.array(sizes),
                    pa.ListArray.from_arrays(pa.array(np.arange(len(sets) + 1, dtype=np.int32) * BANDS), flat),
                ]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "node", "fp", "n", "keys"])

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(hashed, "doc_id bigint, node bigint, fp bigint, n bigint, keys array<bigint>")


def shingle_sets(docs: DataFrame, nodes: DataFrame, size: int = 5) -> DataFrame:
    """(node, s): the shingle sets of the given (node, least)."""

    def hashed(batches):
        for batch in batches:
            for _, texts in text_slices(batch, limit=100_000):
                sets = [shingles(t, size) for t in texts]
                listed = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, sets)]), pa.int32()), pa.array(np.concatenate(sets).view(np.int64)))
                yield pa.RecordBatch.from_arrays([pa.array([node_of(s) for s in sets], pa.int64()), listed], names=["node", "s"])

    ids = nodes.where("least is not null").select(F.col("least").alias("doc_id")).distinct()
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    rows = rows.join(ids, "doc_id", "left_semi").unionByName(rows.where("doc_id is null"))
    found = rows.mapInArrow(hashed, "node bigint, s array<bigint>").join(nodes.select("node"), "node", "left_semi")
    return found.dropDuplicates(["node"])


def alike(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """Those of ``pairs`` (a, b) whose whole shingle sets reach the similarity."""
    both = pairs
    for side in ("a", "b"):  # the head of a large family stands in many pairs
        counts = pairs.groupBy(side).agg(F.count(F.lit(1)).alias("n"))
        both = joined_salted(both, sets.select(F.col("node").alias(side), F.col("s").alias(f"s{side}")), [side], counts)
    common = F.size(F.array_intersect("sa", "sb"))
    return staged(both.where(common / (F.size("sa") + F.size("sb") - common) >= similarity).select("a", "b"), "near-pairs")


def sizes_fit(n, m, similarity: float):
    return F.least(n, m) / F.greatest(n, m) >= similarity


def by_differences(members: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """(a, b), a < b: the pairs of one head and of different roots that can reach the similarity.

    ``members`` (head, node, n, root) holds nodes other than their head; nodes that reach the similarity with their
    head have its root. ``sets`` holds the sets of nodes and heads.

    Let ``d`` be the number of shingles that either a node or its head has, not both (its differences). Sets of n and
    m members reach the similarity if they differ in at most ``e * (n + m)`` shingles, e = (1 - similarity) /
    (1 + similarity). What two nodes of a head differ in are the differences that only one of them has, so they
    must share ``(d + d' - e * (n + m)) / 2`` of them, over ``(d' + e * (h - m)) / 2`` where the first falls short of
    the head, of h members. Differences are ordered by the number of nodes that have them, rarest first; two nodes
    meet on the first common one, which has that many places after it in both.
    """
    e, slack = (1 - similarity) / (1 + similarity), 1e-6
    head = sets.select(F.col("node").alias("head"), F.col("s").alias("hs"))
    of_head = members.groupBy("head").agg(F.count(F.lit(1)).alias("n"))
    both = joined_salted(members.join(sets.select("node", "s"), "node"), head, ["head"], of_head).withColumn("h", F.size("hs"))
    apart = both.withColumn("t", F.concat(F.array_except("s", "hs"), F.array_except("hs", "s"))).withColumn("d", F.size("t"))
    apart = staged(apart.select("head", "node", "n", "root", "h", "d", F.explode("t").alias("t")), "differences")
    shared = apart.groupBy("head", "t").agg(F.count(F.lit(1)).alias("held")).where("held > 1")
    own = Window.partitionBy("head", "node")
    ranked = apart.join(shared, ["head", "t"])
    alone = F.col("d") - F.count(F.lit(1)).over(own)  # differences that no other node has come first
    ranked = ranked.withColumn("after", F.col("d") - alone - F.row_number().over(own.orderBy("held", "t")) + 1)
    at_least = F.col("d") - e * (1 + 1 / similarity) * F.col("n")  # whatever the size of the other
    near = F.col("after") >= F.greatest((F.col("d") + e * (F.col("h") - F.col("n"))) / 2, at_least) - slack
    short = F.col("d") > e * (F.col("n") + F.col("h")) + slack
    short = short & (F.col("after") >= F.greatest((F.col("d") - e * (F.col("n") + F.col("h"))) / 2, at_least) - slack)
    early = staged(ranked.select("head", "t", "node", "n", "root", "d", "after", near.alias("near"), short.alias("short")).where("near or short"), "rare-differences")
    other = early.where("near").select("head", "t", F.col("node").alias("b"), F.col("n").alias("m"), F.col("root").alias("r"), F.col("d").alias("c"), F.col("after").alias("left"))
    needed = (F.col("d") + F.col("c") - e * (F.col("n") + F.col("m"))) / 2 - slack
    found = joined_in_cells(early.where("short").drop("near", "short"), other, ["head", "t"]).where("node <> b and root <> r")
    found = found.where(sizes_fit(F.col("n"), F.col("m"), similarity)).where(F.least("after", "left") >= needed)
    return found.select(F.least("node", "b").alias("a"), F.greatest("node", "b").alias("b")).distinct()


def linked_pairs(distinct: DataFrame, links, components) -> DataFrame:
    """(a, b): each node of a SimHash component with the component's first node. ``distinct``: node, fp, n.

    A node of several texts (of other order or repeats) stands for the smallest of their fingerprints."""
    prints = staged(distinct.select("fp").distinct(), "distinct-fingerprints")
    joined = components(links(prints)).withColumnRenamed("node", "fp")
    named = staged(distinct.select("node", "n", "fp").join(joined, "fp", "left").select("node", "n", F.coalesce("root", "fp").alias("root")), "fingerprint-roots")
    first = named.groupBy("root").agg(F.min("node").alias("a"), F.count(F.lit(1)).alias("rows")).where("rows > 1")
    pairs = joined_by_hot(named, first.select("root", "a"), "root", first.select("root", F.col("rows").alias("n")))
    return pairs.where("node <> a").select("a", F.col("node").alias("b"))


def near_copies(docs: DataFrame, fingerprint, links, components, *, size: int = 5, similarity: float = 0.8) -> DataFrame:
    """(doc_id, node, component_id) of every row; a component is named by its smallest doc_id.

    ``fingerprint`` gives a text's SimHash, ``links`` the edges among distinct fingerprints (fp) within its budget;
    ``components`` turns edges (a, b) into (node, root).
    """
    rows = staged(signatures(docs, fingerprint, size), "signatures")
    one = [F.min("doc_id").alias("least"), F.min("fp").alias("fp"), F.first("n").alias("n"), F.first("keys").alias("keys"), F.count(F.lit(1)).alias("rows")]
    distinct = staged(rows.groupBy("node").agg(*one), "distinct-sets")
    linked = staged(linked_pairs(distinct, links, components), "simhash-pairs")
    met = linked.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    edges = alike(linked, staged(shingle_sets(docs, distinct.select("node", "least").join(met, "node"), size), "shingle-sets"), similarity)
    joined = staged(components(edges), "simhash-components")
    keyed = distinct.select("node", "n", F.explode("keys").alias("key"))
    sizes = staged(keyed.groupBy("key").agg(F.count(F.lit(1)).alias("rows")).where("rows > 1"), "band-keys")
    counts = sizes.select("key", F.col("rows").alias("n"))
    keyed = staged(joined_by_hot(keyed, sizes, "key", counts), "band-groups")
    reach = keyed.groupBy("node").agg(F.sum("rows").alias("reach"))
    heads = keyed.join(reach, "node").groupBy("key").agg(F.max(F.struct("reach", "node", "n")).alias("head"))
    heads = staged(heads.select("key", F.col("head.node").alias("head"), F.col("head.n").alias("h")), "band-heads")
    groups = staged(joined_by_hot(keyed.drop("rows"), heads, "key", counts).where("node <> head"), "band-groups")
    first = groups.where(sizes_fit(F.col("n"), F.col("h"), similarity))
    first = first.select(F.col("head").alias("a"), F.col("node").alias("b")).distinct()
    for side in ("a", "b"):  # what SimHash has connected needs no comparison
        first = first.join(joined.select(F.col("node").alias(side), F.col("root").alias(f"root_{side}")), side, "left")
    first = staged(first.where("root_a is null or root_b is null or root_a <> root_b").select("a", "b"), "candidate-pairs")
    met = first.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    edges = edges.unionByName(alike(first, staged(shingle_sets(docs, distinct.select("node", "least").join(met, "node"), size), "shingle-sets"), similarity))
    known = components(edges)
    members = groups.select("head", "node", "n").distinct().join(known, "node", "left").withColumn("root", F.coalesce("root", "node"))
    tops = known.select(F.col("node").alias("head"), F.col("root").alias("top"))
    members = staged(members.join(tops, "head", "left").withColumn("top", F.coalesce("top", "head")), "members")
    parted = members.where("root <> top").select("head").distinct()
    members = staged(members.join(parted, "head", "left_semi").drop("top"), "parted-nodes")
    met = members.select(F.explode(F.array("head", "node")).alias("node")).distinct()
    sets = staged(shingle_sets(docs, distinct.select("node", "least").join(met, "node"), size), "shingle-sets")
    second = by_differences(members, sets, similarity)
    second = staged(second.join(first.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")), ["a", "b"], "left_anti"), "candidate-pairs")
    found = components(edges.unionByName(alike(second, sets, similarity)))
    rooted = distinct.select("node", "least").join(found, "node", "left").select("node", "least", F.coalesce("root", "node").alias("root"))
    least = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    rooted = staged(rooted.select("node", "root").join(least, "root").select("node", "component_id"), "node-components")
    for done in (linked, joined, sizes, keyed, heads, groups, first, edges, known, members, sets, second):
        drop_staged(done)
    return joined_by_hot(rows.select("doc_id", "node"), rooted, "node", distinct.select("node", F.col("rows").alias("n")))

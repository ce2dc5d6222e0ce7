"""Near-duplicate documents by SimHash: fingerprints, a binary-trie self-join and its components.

Fingerprints within ``budget`` differing bits link. Splitting the bits into ``budget + 1`` blocks, two
linked fingerprints agree in at least one whole block, so each distinct fingerprint goes to one group
for each block value. A group with more than ``limit`` fingerprints is split again, in the same way,
by the bits that its block leaves open, until no group is larger; equal blocks hold for the whole
group, so nothing is lost and no key gathers more than ``limit`` rows in one place.

Within a group the fingerprints form a binary trie (a sorted array whose ranges are the nodes). The
self-join walks pairs of nodes together, adds the bits in which they differ and drops a pair once the
budget is exceeded. A group reports a link from each fingerprint to the smallest of its local
component, not all pairs. Links between distinct fingerprints are joined to components by repeated
large-star and small-star steps, each kept in the shared folder.

Null and empty texts have fingerprint zero and link like any other. A component is named by its
smallest non-null doc_id (null if it has none). Repeated rows and ids are kept. An empty table gives
no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quorumlab.llm.near_copies import near_copies
from quorumlab.llm.shared import drop_staged, joined_by_hot, staged, text_slices, unused

BITS = 64


def fingerprint(text: str, size: int = 3, piece: int = 1 << 16) -> int:
    """SimHash of a text's word shingles, repeats included: a bit is set if over half of the hashes set it."""
    words = text.encode().lower().split()  # on bytes both see ASCII only
    n = len(words) - size + 1
    if not words:
        return 0
    if n < 1:
        return xxhash.xxh64_intdigest(b" ".join(words), 42)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])[:n].tolist()
    joined, ends = b" ".join(words), ends[size - 1 :].tolist()
    digest, counts = xxhash.xxh64_intdigest, np.zeros(BITS, np.int64)
    for at in range(0, n, piece):
        h = np.array([digest(joined[a:b], 42) for a, b in zip(starts[at : at + piece], ends[at : at + piece], strict=True)], "<u8")
        counts += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, size: int = 3) -> DataFrame:
    """(doc_id, fp) of every row; fp is the fingerprint's 64 bits as a signed long."""

    def hashed(batches):
        for batch in batches:
            for first, texts in text_slices(batch):
                fps = np.array([fingerprint(t, size) for t in texts], np.uint64).view(np.int64)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, len(texts)), pa.array(fps)], names=["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(hashed, "doc_id bigint, fp bigint")


def trie_links(values: np.ndarray, starts: np.ndarray, budget: int) -> np.ndarray:
    """For each value the index of the smallest member of its component within its group.

    ``values`` holds groups one after another, each sorted and distinct; ``starts`` has their first
    indexes. Node pairs are (low, high) ranges of the array at one depth; all pairs of a depth, of all
    groups, move together.
    """
    n = len(values)
    root = np.arange(n)

    def top(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = int(root[i])
        return i

    ends = np.append(starts[1:], n)
    one = np.stack([starts, ends, starts, ends, np.zeros(len(starts), np.int64)], 1)
    one = one[ends - starts > 1]
    for depth in range(BITS - 1, -1, -1):
        if not len(one):
            break
        bit = np.concatenate([[0], np.cumsum((values >> np.uint64(depth)) & np.uint64(1))]).astype(np.int64)

        def children(a: np.ndarray, b: np.ndarray, bit: np.ndarray = bit) -> np.ndarray:
            """Where the ones begin within [a, b): the bit is sorted inside a node."""
            return b - (bit[b] - bit[a])

        a, b, c, d, diff = one.T
        x, y = children(a, b), children(c, d)
        same = (a == c) & (b == d)
        parts = [
            np.stack([a, x, c, y, diff], 1),
            np.stack([x, b, y, d, diff], 1),
            np.stack([a, x, y, d, diff + 1], 1),
            np.stack([x, b, c, y, diff + 1], 1)[~same],  # the mirror of the third within one node
        ]
        one = np.concatenate(parts)
        one = one[(one[:, 0] < one[:, 1]) & (one[:, 2] < one[:, 3]) & (one[:, 4] <= budget)]
        one = one[~((one[:, 0] == one[:, 2]) & (one[:, 1] == one[:, 3]) & (one[:, 1] - one[:, 0] == 1))]
    for a, _, c, _, _ in one.tolist():
        a, c = top(a), top(c)
        root[max(a, c)] = min(a, c)
    return np.array([top(i) for i in range(n)], np.int64)


def blocks(free: list[int], budget: int) -> list[list[int]]:
    """The free bits in ``budget + 1`` blocks."""
    return [x.tolist() for x in np.array_split(np.array(free, np.int64), budget + 1) if len(x)]


def links(distinct: DataFrame, budget: int = 2, limit: int = 1000) -> DataFrame:
    """(a, b): edges among distinct fingerprints that join exactly what lies within the budget, transitively."""

    def mask(bits: list[int]) -> int:
        m = sum(1 << b for b in bits)
        return m - (1 << 64) if m >> 63 else m

    def joined(nodes: np.ndarray, values: np.ndarray, fps: np.ndarray) -> pa.RecordBatch:
        fps = fps.view(np.uint64)
        order = np.lexsort((fps, values, nodes))
        nodes, values, fps = nodes[order], values[order], fps[order]
        starts = np.flatnonzero(np.concatenate([[True], (nodes[1:] != nodes[:-1]) | (values[1:] != values[:-1])]))
        to = trie_links(fps, starts, budget)
        far = np.flatnonzero(to != np.arange(len(to)))
        return pa.RecordBatch.from_arrays([pa.array(fps[far].view(np.int64)), pa.array(fps[to[far]].view(np.int64))], names=["a", "b"])

    def local(batches):
        """Rows come sorted by group; the last group of a batch waits for the next one."""
        held = [np.empty(0, t) for t in (np.int32, np.int64, np.int64)]
        for batch in batches:
            if not batch.num_rows:
                continue
            held = [np.concatenate([h, c.to_numpy()]) for h, c in zip(held, batch.columns, strict=True)]
            node, value = held[0], held[1]
            end = len(node) - int(np.argmin(((node == node[-1]) & (value == value[-1]))[::-1])) if (node[0], value[0]) != (node[-1], value[-1]) else 0
            if end:
                yield joined(*(h[:end] for h in held))
                held = [h[end:] for h in held]
        if len(held[0]):
            yield joined(*held)

    level = [(tuple(range(BITS)), ())]
    waiting, found = distinct.select("fp", F.lit(0).alias("node")), None
    while True:
        # one row per fingerprint and block of its group: the key names the fixed bits and their value
        following, choices = [], []
        for n, (free, fixed) in enumerate(level):
            for block in blocks(list(free), budget):
                now = tuple(sorted((*fixed, *block)))
                following.append((tuple(b for b in free if b not in block), now))
                label = len(following) - 1
                value = F.col("fp").bitwiseAND(F.lit(mask(list(now))))
                choices.append((n, F.struct(F.lit(label).alias("node"), value.alias("value"))))
        own = F.filter(F.array(*(F.when(F.col("node") == n, c) for n, c in choices)), lambda x: x.isNotNull())
        rows = waiting.select("fp", F.explode(own).alias("g"))
        rows = rows.select("fp", "g.node", "g.value")
        sizes = rows.groupBy("node", "value").agg(F.count("*").alias("n")).where("n > 1")
        groups = staged(rows.join(sizes, ["node", "value"]), "trie-groups")
        small = groups.where(F.col("n") <= limit).select("node", "value", "fp")
        small = small.repartition("node", "value").sortWithinPartitions("node", "value")
        edges = staged(small.mapInArrow(local, "a bigint, b bigint"), "trie-links")
        found = edges if found is None else found.unionByName(edges)
        waiting = groups.where(F.col("n") > limit).select("fp", "node")
        if waiting.isEmpty():
            return found
        level = following


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, root): the smallest node that each node of an edge reaches."""
    now = staged(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), "edges")
    for _ in range(rounds):
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where("u <> v").distinct()
        small = large.groupBy("u").agg(F.min("v").alias("m"))
        joined = large.join(small, "u")
        following = joined.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(small.select("u", F.col("m").alias("v"))).distinct()
        following = staged(following, "edges")
        done = following.exceptAll(now).isEmpty() and now.exceptAll(following).isEmpty()
        drop_staged(now)
        now = following
        if done:
            break
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    return now.select(F.col("u").alias("node"), F.col("v").alias("root"))


def near_duplicates(docs: DataFrame, *, size: int = 3, budget: int = 2, limit: int = 1000) -> DataFrame:
    """(doc_id, fingerprint, component_id) of every row of ``docs``."""
    rows = staged(fingerprints(docs, size), "fingerprints")
    distinct = staged(rows.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("n")), "distinct-fingerprints")
    joined = components(links(distinct.select("fp"), budget, limit))
    named = distinct.join(joined, distinct["fp"] == joined["node"], "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    least = named.groupBy("root").agg(F.min("least").alias("component_id"))
    named = staged(named.select("fp", "root").join(least, "root").select("fp", "component_id"), "fingerprint-components")
    return joined_by_hot(rows, named, "fp", distinct.select("fp", "n")).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def deduplicated(docs: DataFrame, *, size: int = 5, similarity: float = 0.8) -> DataFrame:
    """One document of each component of near copies (the one with the smallest doc_id), with the columns of ``docs``.

    Near copies share ``similarity`` of their ``size``-word shingles (Jaccard). The trie's links within two bits are
    compared by that first; MinHash keys give the pairs whose fingerprints lie further apart (see ``near_copies``).
    Of rows that share that doc_id, those of different text stay. Rows without a doc_id cannot stand
    for a component: each of their distinct texts stays once.
    """
    kept, text = unused(docs, "__kept"), unused(docs, "__text")
    found = near_copies(docs, fingerprint, links, components, size=size, similarity=similarity).where("doc_id = component_id")
    docs = docs.withColumn(text, F.xxhash64("text"))
    named = docs.join(found.select(F.col("doc_id").alias(kept)).distinct(), F.col("doc_id") == F.col(kept), "left_semi")
    # both are dealt by doc_id already, so texts are not shuffled again
    nameless = docs.where("doc_id is null").dropDuplicates([text])
    return named.dropDuplicates(["doc_id", text]).unionByName(nameless).drop(text)

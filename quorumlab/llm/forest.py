"""Nearest neighbours by cosine with a hash-prefix forest.

Each of ``TREES`` trees has a hash string of ``BITS`` bits for every vector (the signs of random projections) and keeps
the strings in a sorted array, in which all strings with one prefix are a stretch. A query descends to the longest
prefix it shares in any tree, then ascends in all trees at once, one bit at a time; each level adds the vectors that
share that many bits with it in some tree, and all of them are compared. It stops where a vector as near as the k-th
best found so far would share a prefix of this length in one of the trees with probability ``SURE``: two vectors at an
angle of a share each bit with probability 1 - a / pi. So queries with near neighbours look at few vectors, and those
without go on, to the root if need be; there is no cap. In tables of unrelated directions, as the given ones mostly
are, the best five are hardly nearer than the rest and a good part of each block is compared.

Rows are dealt to blocks with a forest each, and every query meets every block (``blocks``). A first pass compares some
``FIRST`` vectors of each block, and the k-th best of all blocks bounds where the second pass stops in each of them; so
a block without near vectors is left early. Equal vectors are one node that keeps its smallest k + 1 ids, found
before vectors are sent (a limit inside each task), so no group of copies meets in one place.

Vectors that are null or empty, all zero or hold null or non-finite components take no part; nor do rows without an
id. Only vectors of equal length are compared. Rows of one id and vector count once; a query leaves out all rows of
its own id, and query rows of one id with different vectors are ranked together. Fewer than k results if there are
fewer candidates; no rows for an empty table. Other columns are ignored. Scores are computed in doubles from the
vectors as given; those within ``CLOSE`` of the last place are compared in doubles too, the rest in floats.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quorumlab.llm.blocks import against_blocks, blocks_for
from quorumlab.llm.shared import staged

TREES, BITS, SURE, FIRST, CLOSE = 32, 32, 0.97, 200, 1e-5
#: Rows of a block: its vectors of 64 floats and its forest take some 270 MB.
PER_BLOCK = 1 << 19


def usable(vector: Column) -> Column:
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return vector.isNotNull() & fine & F.exists(vector, lambda x: x != 0)


def matrix(column: pa.Array, dims: int) -> np.ndarray:
    values = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dims)
    largest = np.abs(values).max(1, keepdims=True)  # beyond these bounds squares leave the range of doubles
    return np.where((largest > 1e-100) & (largest < 1e100), values, values / largest)


def units(vectors: np.ndarray) -> np.ndarray:
    return vectors / np.sqrt(np.einsum("ij,ij->i", vectors, vectors))[:, None]


class Forest:
    """The vectors of one block and their sorted hash strings, per length of vectors."""

    def __init__(self, vectors: np.ndarray, ids: list[list[int]], trees: int = TREES) -> None:
        self.vectors, self.ids = vectors, ids
        self.near = units(vectors).astype(np.float32)
        rng = np.random.default_rng(12)
        self.planes = rng.standard_normal((trees, vectors.shape[1], BITS)).astype(np.float32)
        self.order = np.empty((trees, len(ids)), np.int32)
        self.strings = np.empty((trees, len(ids)), np.uint32)
        for t in range(trees):
            strings = self.hashed(self.near, t)
            self.order[t] = np.argsort(strings, kind="stable")
            self.strings[t] = strings[self.order[t]]
        self.mark = np.zeros(len(ids), bool)

    def hashed(self, rows: np.ndarray, tree: int) -> np.ndarray:
        return np.packbits(rows @ self.planes[tree] > 0, axis=1).view(">u4").reshape(-1).astype(np.uint32)

    def stretches(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(low, high)[row, tree, length]: where the strings that share a prefix of a length lie in a tree's array."""
        shape = len(rows), len(self.planes), BITS + 1
        low, high = np.empty(shape, np.int64), np.empty(shape, np.int64)
        spare = BITS - np.arange(BITS + 1, dtype=np.uint64)
        for t in range(len(self.planes)):
            prefix = self.hashed(rows, t).astype(np.uint64)[:, None] >> spare
            low[:, t] = np.searchsorted(self.strings[t], (prefix << spare).astype(np.uint32))
            high[:, t] = np.searchsorted(self.strings[t], ((prefix + np.uint64(1) << spare) - np.uint64(1)).astype(np.uint32), "right")
        return low, high

    def levels(self, low: np.ndarray, high: np.ndarray):
        """(length, nodes met for the first time), from the longest shared prefix up to the root, for one query."""
        met = (high - low).sum(0)
        a = z = None
        for length in range(int(np.flatnonzero(met)[-1]), -1, -1):
            left, right = low[:, length], high[:, length]
            parts = []
            for t in range(len(left)):
                if a is None:
                    parts.append(self.order[t, left[t] : right[t]])
                elif right[t] - left[t] > z[t] - a[t]:
                    parts += [self.order[t, left[t] : a[t]], self.order[t, z[t] : right[t]]]
            a, z = left, right
            found = np.concatenate(parts) if parts else np.empty(0, np.int32)
            found = np.unique(found[~self.mark[found]])
            self.mark[found] = True
            yield length, found

    def nearest(self, vector: np.ndarray, own: int, k: int, bound: float | None, low: np.ndarray, high: np.ndarray, sure: float, first: int) -> list[tuple[float, int]]:
        """(score, id) of the best; ``bound``: a score that k rows elsewhere reach, None in the first pass."""
        unit = units(vector[None])[0]
        query, seen = unit.astype(np.float32), []
        best, scores, compared = np.empty(0, np.int32), np.empty(0, np.float32), 0
        for length, found in self.levels(low, high):
            seen.append(found)
            compared += len(found)
            best = np.concatenate([best, found])
            scores = np.concatenate([scores, self.near[found] @ query])
            last = -1.0
            if len(best) > k:  # one more than k, as one may be the query itself
                last = float(np.partition(scores, len(scores) - k - 1)[len(scores) - k - 1])
                keep = scores >= last - CLOSE
                best, scores = best[keep], scores[keep]
            if bound is None:
                if compared >= first and len(best) > k:
                    break
            elif max(last, bound) > -1 and self.certain(max(last, bound), length) >= sure:
                break
        for found in seen:
            self.mark[found] = False
        exact = units(self.vectors[best]) @ unit
        rows = [(s, i) for s, b in zip(exact.tolist(), best.tolist(), strict=True) for i in self.ids[b] if i != own]
        return sorted(rows, key=lambda r: (-r[0], r[1]))[:k]

    def certain(self, score: float, length: int) -> float:
        shared = 1 - math.acos(max(-1.0, min(1.0, score))) / math.pi
        return 1 - (1 - shared**length) ** len(self.planes)


def searched(nodes: DataFrame, queries: DataFrame, blocks: int, k: int, sure: float, first: int) -> DataFrame:
    """(query_id, vec_id, score) of the best of each block; ``queries`` has query_id, query and bound."""

    def built(batches):
        whole = pa.Table.from_batches(batches)
        dims = np.concatenate([b.column("dims").to_numpy() for b in batches])
        forests = {}
        for d in np.unique(dims).tolist():
            part = whole.filter(pa.array(dims == d)).combine_chunks()
            forests[d] = Forest(matrix(part["vector"].chunk(0), d), part["ids"].to_pylist())
        return forests

    def answered(forests, batch):
        out = []
        for at in range(0, len(batch), 256):
            part = batch.slice(at, 256)
            dims = part.column("dims").to_numpy()
            for d in np.unique(dims).tolist():
                if d not in forests:
                    continue
                chosen = part.filter(pa.array(dims == d))
                vectors, forest = matrix(chosen.column("query"), d), forests[d]
                low, high = forest.stretches(units(vectors).astype(np.float32))
                for i, (own, bound) in enumerate(zip(chosen.column("query_id").to_pylist(), chosen.column("bound").to_pylist(), strict=True)):
                    out += [(own, j, s) for s, j in forest.nearest(vectors[i], own, k, bound, low[i], high[i], sure, first)]
        names = ["query_id", "vec_id", "score"]
        yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(zip(*out) if out else [[]] * 3, (pa.int64(), pa.int64(), pa.float64()), strict=True)], names=names)

    return against_blocks(nodes, queries, blocks, built, answered, "query_id bigint, vec_id bigint, score double")


def ranked(found: DataFrame, k: int) -> DataFrame:
    """The k best (query_id, rank, vec_id, score) of each query; Spark limits inside tasks before it sends rows."""
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id"))
    return found.distinct().withColumn("rank", place).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def nearest(rows: DataFrame, queries: DataFrame, *, k: int = 5, sure: float = SURE, first: int = FIRST, per_block: int = PER_BLOCK) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest rows found for each of ``queries``; both have vec_id and embedding."""
    few = Window.partitionBy("vector").orderBy("vec_id")
    sound = rows.where(usable(F.col("embedding")) & F.col("vec_id").isNotNull())
    sound = sound.select(F.col("vec_id").cast("bigint").alias("vec_id"), F.col("embedding").alias("vector")).distinct()
    nodes = sound.withColumn("place", F.row_number().over(few)).where(F.col("place") <= k + 1)
    nodes = nodes.groupBy("vector").agg(F.sort_array(F.collect_list("vec_id")).alias("ids"))
    nodes = staged(nodes.withColumn("dims", F.size("vector")), "vectors")
    blocks = blocks_for(nodes, per_block)
    nodes = nodes.withColumn("block", F.pmod(F.xxhash64("vector"), F.lit(blocks)))
    asked = queries.where(usable(F.col("embedding")) & F.col("vec_id").isNotNull())
    asked = asked.select(F.col("vec_id").cast("bigint").alias("query_id"), F.col("embedding").alias("query")).distinct()
    asked = asked.withColumn("dims", F.size("query"))
    near = searched(nodes, asked.withColumn("bound", F.lit(None).cast("double")), blocks, k, sure, first)
    bounds = staged(ranked(near, k).where(F.col("rank") == k).select("query_id", F.col("score").alias("bound")), "bounds")
    asked = asked.join(bounds, "query_id", "left").withColumn("bound", F.coalesce("bound", F.lit(-1.0)))
    return ranked(searched(nodes, asked, blocks, k, sure, first), k)

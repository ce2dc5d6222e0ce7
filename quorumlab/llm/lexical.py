"""Ranked lexical search: short lists are summed first, long lists are skipped through document by document.

Terms are maximal runs of ASCII letters and digits and of all characters from U+0080 on, A-Z lower-cased. One pass over
the documents keeps, for every document, its number of terms and the frequencies of the terms that items use (found with
a Bloom filter of fixed size, then known by 64 bits of hash). A term's document frequency, the number of documents and of
all terms are counted over the whole table. A term's weight is floor(1000 * ln((2N + 2) / (2df + 1))); a document's
score sums weight * ((10^9 * tf) div (1000 * tf + 8 * m)) over an item's terms, repeats included.

Documents are dealt to blocks of some ``PER_BLOCK`` postings with inverted lists of their own, and every item meets
every block (``blocks``). In a block the shortest lists of an item, up to ``SHORT`` of the block's documents together, are read term by term into
accumulators. These then are one more iterator, with its own bound, beside the item's long lists: windows of ``WINDOW``
documents are visited in the order of documents, and a window is skipped if the accumulators' largest sum in it and
the long lists' largest parts there together fall short of the k-th best score so far. In other windows, all lists are
sought forward to the window and their parts summed. So the result is exact; of each block only the k best go on.

Null and empty texts have no terms and are never found; items without terms have no rows. Rows of one item_id are one
item, whose terms are those of all its different texts (a null item_id too). Repeated document rows are ranked each;
equal scores go by ascending doc_id, rows without one last. Empty tables give no rows; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quorumlab.llm.blocks import against_blocks
from quorumlab.llm.decontaminate import FILTER_BITS, Words, filter_of
from quorumlab.llm.shared import staged, text_slices

#: Postings of a block, which take some 80 bytes each while its lists are built.
PER_BLOCK, WINDOW, SHORT = 1 << 20, 128, 0.25


def item_terms(items: DataFrame) -> DataFrame:
    """(item_id, h, qtf): how often each term stands in each item."""

    def cut(batches):
        for batch in batches:
            keys = batch.column(0)
            for first, texts in text_slices(batch):
                words = Words(texts)
                text = np.repeat(np.arange(len(texts)), words.count)
                yield pa.RecordBatch.from_arrays([keys.slice(first, len(texts)).take(pa.array(text)), pa.array(words.hash.view(np.int64))], names=["item_id", "h"])

    rows = items.where("text is not null").select(F.col("item_id").cast("bigint").alias("item_id"), "text").distinct()
    return rows.mapInArrow(cut, "item_id bigint, h bigint").groupBy("item_id", "h").agg(F.count(F.lit(1)).alias("qtf"))


def document_terms(docs: DataFrame, table: np.ndarray) -> DataFrame:
    """(doc_id, n, terms, tfs) of every row: its number of terms, and those that pass the filter with their frequency."""
    shared = docs.sparkSession.sparkContext.broadcast(table)  # 2 MB, whatever the size of the tables

    def count(batches):
        bits = shared.value
        for batch in batches:
            for first, texts in text_slices(batch):
                words = Words(texts)
                slot = (words.hash & np.uint64(FILTER_BITS - 1)).astype(np.int64)
                at = np.flatnonzero((bits[slot >> 6] >> (slot & 63).astype(np.uint64)) & np.uint64(1))
                text = np.searchsorted(words.first, at, "right") - 1
                order = np.lexsort((words.hash[at], text))
                text, h = text[order], words.hash[at][order]
                new = np.flatnonzero(np.concatenate([[True], (text[1:] != text[:-1]) | (h[1:] != h[:-1])])) if len(h) else np.empty(0, np.int64)
                tf = np.diff(np.concatenate([new, [len(h)]]))
                ends = pa.array(np.concatenate([[0], np.cumsum(np.bincount(text[new], minlength=len(texts)))]).astype(np.int32))
                lists = [pa.ListArray.from_arrays(ends, pa.array(v)) for v in (h[new].view(np.int64), tf.astype(np.int32))]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, len(texts)), pa.array(words.count.astype(np.int64)), *lists], names=["doc_id", "n", "terms", "tfs"])

    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    return rows.mapInArrow(count, "doc_id bigint, n bigint, terms array<bigint>, tfs array<int>")


class Lists:
    """Inverted lists of one block: documents in ascending order of doc_id, and each term's part of their score."""

    def __init__(self, batches: list[pa.RecordBatch]) -> None:
        whole = pa.Table.from_batches(batches).select(["doc_id", "m", "terms", "tfs"]).combine_chunks()
        ids = whole["doc_id"].to_pylist()
        order = np.array(sorted(range(len(ids)), key=lambda i: (ids[i] is None, ids[i] or 0)), np.int64)
        self.ids = [ids[i] for i in order.tolist()]
        place = np.empty(len(ids), np.int64)
        place[order] = np.arange(len(ids))
        lengths = whole["terms"].combine_chunks().value_lengths().to_numpy()
        doc = np.repeat(place, lengths)
        m = np.repeat(whole["m"].to_numpy(), lengths)
        terms, tf = (whole[c].combine_chunks().flatten().to_numpy() for c in ("terms", "tfs"))
        part = 1_000_000_000 * tf.astype(np.int64) // (1000 * tf.astype(np.int64) + 8 * m)
        by_term = np.lexsort((doc, terms))
        self.docs, self.parts, terms = doc[by_term].astype(np.int32), part[by_term], terms[by_term]
        self.terms, starts = np.unique(terms, return_index=True)
        self.bounds = np.concatenate([starts, [len(terms)]])
        self.windows = -(-len(ids) // WINDOW)
        self.largest: dict[int, np.ndarray] = {}

    def of(self, terms: np.ndarray, weights: np.ndarray) -> list[tuple[int, int, int, int]]:
        """(length, start, stop, weight) of the lists of those terms that the block has, shortest first."""
        at = np.searchsorted(self.terms, terms)
        rows = []
        for i, term, weight in zip(at.tolist(), terms.tolist(), weights.tolist(), strict=True):
            if weight and i < len(self.terms) and self.terms[i] == term:
                a, z = int(self.bounds[i]), int(self.bounds[i + 1])
                rows.append((z - a, a, z, weight))
        return sorted(rows)

    def peaks(self, start: int, stop: int) -> np.ndarray:
        """A list's largest part in each window."""
        if start not in self.largest:
            peaks = np.zeros(self.windows, np.int64)
            np.maximum.at(peaks, self.docs[start:stop] // WINDOW, self.parts[start:stop])
            self.largest[start] = peaks
        return self.largest[start]

    def best(self, terms: np.ndarray, weights: np.ndarray, k: int) -> list[tuple[int, int | None]]:
        """The k best (score, doc_id) above 0 of the block, best first."""
        lists, sums, read = self.of(terms, weights), np.zeros(self.windows * WINDOW, np.int64), 0
        while lists and read + lists[0][0] <= SHORT * len(self.ids):  # term by term
            length, a, z, weight = lists.pop(0)
            sums[self.docs[a:z]] += weight * self.parts[a:z]
            read += length
        bound = sums.reshape(self.windows, WINDOW).max(1)
        for _, a, z, weight in lists:
            bound = bound + weight * self.peaks(a, z)
        some = np.flatnonzero(sums)
        least = int(np.partition(sums[some], len(some) - k)[len(some) - k]) if len(some) >= k else 1
        found: list[tuple[int, int]] = []  # (-score, place)
        for w in np.flatnonzero(bound >= least).tolist():  # document by document
            if bound[w] < least:
                continue
            first, score = w * WINDOW, sums[w * WINDOW : (w + 1) * WINDOW].copy()
            for _, a, z, weight in lists:
                i, j = a + np.searchsorted(self.docs[a:z], (first, first + WINDOW))
                score[self.docs[i:j] - first] += weight * self.parts[i:j]
            good = np.flatnonzero(score >= max(least, 1))
            if len(good):
                found = sorted(found + [(-s, first + p) for s, p in zip(score[good].tolist(), good.tolist(), strict=True)])[:k]
                if len(found) == k:
                    least = max(least, -found[-1][0])
        return [(-s, self.ids[p]) for s, p in found]


def ranked_documents(docs: DataFrame, items: DataFrame, *, k: int = 10, floor: int = 25, per_block: int = PER_BLOCK) -> DataFrame:
    """(item_id, rank, doc_id, score): the k best documents of each item; ``floor``: what m has besides length, of 100."""
    asked = staged(item_terms(items), "item-terms")
    vocabulary = asked.select(F.array("h").alias("shingles"))
    rows = staged(document_terms(docs, filter_of(vocabulary)), "document-terms").where("n > 0")
    zero = F.lit(0).cast("bigint")
    sums = [F.coalesce(F.sum(x), zero).alias(name) for x, name in ((F.col("n"), "terms"), (F.size("terms"), "postings"))]
    total = rows.agg(F.count(F.lit(1)).alias("docs"), *sums).first()
    n, length = total["docs"], max(total["terms"], 1)
    df = rows.select(F.explode("terms").alias("h")).groupBy("h").agg(F.count(F.lit(1)).alias("df"))
    weight = F.floor(1000 * F.log(F.lit(2 * n + 2).cast("double") / (2 * F.col("df") + 1).cast("double"))).cast("bigint")
    weighed = asked.join(df, "h").select("item_id", "h", (weight * F.col("qtf")).alias("w"))
    queries = weighed.groupBy("item_id").agg(F.array_sort(F.collect_list(F.struct("h", "w"))).alias("q"))
    queries = queries.select("item_id", F.col("q.h").alias("asked"), F.col("q.w").alias("weights"))
    rows = rows.where(F.size("terms") > 0).withColumn("m", F.expr(f"{floor} + ((({100 - floor} * n) * {n}L) div {length}L)")).drop("n")
    blocks = max(-(-total["postings"] // per_block), docs.sparkSession.sparkContext.defaultParallelism)
    rows = rows.withColumn("block", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(blocks)))

    def answered(lists, batch):
        out = []
        for item, terms, weights in zip(*(batch.column(c).to_pylist() for c in ("item_id", "asked", "weights")), strict=True):
            out += [(item, d, s) for s, d in lists.best(np.array(terms, np.int64), np.array(weights, np.int64), k)]
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (zip(*out) if out else [[]] * 3)], names=["item_id", "doc_id", "score"])

    found = against_blocks(rows, queries, blocks, Lists, answered, "item_id bigint, doc_id bigint, score bigint")
    place = F.row_number().over(Window.partitionBy("item_id").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last()))
    return found.withColumn("rank", place).where(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score")

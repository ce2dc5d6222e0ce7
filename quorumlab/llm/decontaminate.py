"""Benchmark contamination by a prefix-filtered set join, verified on item-sized windows.

Every window of ``window`` consecutive item words (or the whole of a shorter item) is a set of word
shingles. As a window must be contained entirely, one of its shingles suffices as its prefix: the one
that is rarest in the corpus. Documents offer only shingles that some item has, found with a Bloom
filter of fixed size; their frequencies are counted over all documents, windows with a shingle that no
document has are dropped, and the rest join on their rarest shingle. The shingle's place in the window
must fit between the document's ends (positional and length bounds), and the window's words are then
compared with the document's one by one.

Words are maximal runs of ASCII digits and letters (A-Z lower-cased) and of all characters from U+0080
on. Null and empty texts have no words and are never hit. Items with no words have no windows. Repeated
document rows are judged one by one, repeated item rows count once. Empty tables: no documents give no
rows, no items give documents without hits.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quorumlab.llm.shared import SpanHash, mixed, staged, text_slices, unused
from quorumlab.llm.skew import joined_salted

#: Slots of the Bloom filter: a bit array of 2 MB, whatever the size of the tables.
FILTER_BITS = 1 << 24

_hash = SpanHash()


def _word_table() -> np.ndarray:
    table = np.zeros(256, np.uint8)
    for a, b in ((0x30, 0x39), (0x61, 0x7A), (0x80, 0xFF)):
        table[a : b + 1] = 1
    return table


WORD = _word_table()


class Words:
    """The words of some texts: bytes, spans, hashes and the text each stands in."""

    def __init__(self, texts: list[str]) -> None:
        encoded = [t.encode().lower() for t in texts]
        self.data = b"\n".join(encoded) + b"\n"
        points = np.frombuffer(self.data, np.uint8)
        inside = np.concatenate([[0], WORD[points], [0]]).astype(np.int8)
        turn = np.flatnonzero(np.diff(inside))
        self.starts, self.ends = turn[0::2], turn[1::2]
        edges = np.cumsum(np.fromiter(map(len, encoded), np.int64, len(encoded)) + 1)
        self.first = np.searchsorted(self.starts, np.concatenate([[0], edges]))  # first word of each text
        self.count = np.diff(self.first)
        self.hash = _hash(points, self.starts, self.ends)

    def shingles(self, size: int) -> tuple[np.ndarray, np.ndarray]:
        """(hash, first word) of every run of ``size`` words within one text."""
        n = len(self.hash) - size + 1
        if n <= 0:
            return np.empty(0, np.uint64), np.empty(0, np.int64)
        h = np.zeros(n, np.uint64)
        for k in range(size):
            h = h * np.uint64(0x9E3779B97F4A7C15) + self.hash[k : k + n]
        text = np.repeat(np.arange(len(self.count)), self.count)
        at = np.flatnonzero(text[:n] == text[size - 1 :])
        return mixed(h[at] + np.uint64(size)), at

    def written(self, a: int, b: int) -> str:
        return " ".join(self.data[s:e].decode() for s, e in zip(self.starts[a:b].tolist(), self.ends[a:b].tolist(), strict=True))


def item_windows(items: DataFrame, window: int, shingle: int) -> DataFrame:
    """(item_id, words, n, size, shingles): each distinct window of each item with its shingles' hashes by place."""

    def cut(batches):
        for batch in batches:
            keys = batch.column(0).to_pylist()
            for first, texts in text_slices(batch, limit=200_000):
                words = Words(texts)
                rows = []
                for i, (a, n) in enumerate(zip(words.first.tolist(), words.count.tolist(), strict=False)):
                    if not n:
                        continue
                    length = min(n, window)
                    for at in range(a, a + n - length + 1):
                        rows.append((keys[first + i], words.written(at, at + length), length))
                if rows:
                    own = Words([r[1] for r in rows])
                    found = [[] for _ in rows]
                    sizes = [min(r[2], shingle) for r in rows]
                    for size in set(sizes):
                        h, at = own.shingles(size)
                        text = np.searchsorted(own.first, at, "right") - 1
                        for t, x in zip(text.tolist(), h.view(np.int64).tolist(), strict=True):
                            if sizes[t] == size:
                                found[t].append(x)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.string()), pa.array([r[2] for r in rows], pa.int32()), pa.array(sizes, pa.int32()), pa.array(found, pa.list_(pa.int64()))],
                        names=["item_id", "words", "n", "size", "shingles"],
                    )

    fields = "item_id bigint, words string, n int, size int, shingles array<bigint>"
    return items.where("text is not null").select(F.col("item_id").cast("bigint").alias("item_id"), "text").distinct().mapInArrow(cut, fields)


def filter_of(windows: DataFrame) -> np.ndarray:
    """Bit array of all window shingles; at most FILTER_BITS / 64 longs reach the driver."""
    bit = F.col("h").bitwiseAND(F.lit(FILTER_BITS - 1))
    words = windows.select(F.explode("shingles").alias("h")).select((bit / 64).cast("int").alias("at"), F.expr(f"shiftleft(1L, cast(h & 63 as int))").alias("bit"))
    table = np.zeros(FILTER_BITS // 64, np.uint64)
    for r in words.groupBy("at").agg(F.bit_or("bit").alias("bits")).collect():
        table[r["at"]] = np.uint64(r["bits"] & 0xFFFFFFFFFFFFFFFF)
    return table


def scanned(docs: DataFrame, table: np.ndarray, sizes: list[int], window: int, longest: int) -> DataFrame:
    """One row per document: doc_id, n_words and the places whose shingle passes the filter.

    A place has the shingle's hash and the words around it that a window over it can reach.
    """
    shared = docs.sparkSession.sparkContext.broadcast(table)

    def find(batches):
        bits = shared.value
        for batch in batches:
            for first, texts in text_slices(batch):
                words = Words(texts)
                places = [[] for _ in texts]
                for size in sizes:
                    h, at = words.shingles(size)
                    slot = (h & np.uint64(FILTER_BITS - 1)).astype(np.int64)
                    hit = np.flatnonzero((bits[slot >> 6] >> (slot & 63).astype(np.uint64)) & np.uint64(1))
                    text = np.searchsorted(words.first, at[hit], "right") - 1
                    for t, x, p in zip(text.tolist(), h[hit].view(np.int64).tolist(), at[hit].tolist(), strict=True):
                        a, z = int(words.first[t]), int(words.first[t] + words.count[t])
                        # windows of a short shingle are that shingle; longer ones reach ``window`` words around it
                        low, high = (max(a, p - window + size), min(z, p + window)) if size == longest else (p, p + size)
                        places[t].append({"at": p - a, "size": size, "h": x, "low": low - a, "around": words.written(low, high)})
                kind = pa.list_(pa.struct([("at", pa.int64()), ("size", pa.int32()), ("h", pa.int64()), ("low", pa.int64()), ("around", pa.string())]))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(first, len(texts)), pa.array(words.count.astype(np.int64)), pa.array(places, kind)], names=["doc_id", "n_words", "places"]
                )

    kind = docs.schema["doc_id"].dataType.simpleString()
    fields = f"doc_id {kind}, n_words bigint, places array<struct<at:bigint,size:int,h:bigint,low:bigint,around:string>>"
    return docs.select("doc_id", "text").mapInArrow(find, fields)


def contamination(docs: DataFrame, items: DataFrame, *, window: int = 13, shingle: int = 5, share: int = 20) -> DataFrame:
    """Per document row: doc_id (of any type), n_words, n_hit, n_items, items_sha256, contaminated."""
    windows = staged(item_windows(items, window, shingle), "item-windows")
    sizes = [r["size"] for r in windows.select("size").distinct().orderBy("size").collect()]  # 1 to ``shingle``
    found = scanned(docs, filter_of(windows), sizes, window, shingle).withColumn("row", F.monotonically_increasing_id())
    found = staged(found, "document-places")
    places = found.select("row", "n_words", F.explode("places").alias("p")).select("row", "n_words", "p.*")

    # frequency of each shingle that items have, over all documents
    frequency = staged(places.groupBy("size", "h").agg(F.count("*").alias("df")), "shingle-frequencies")
    shingles = windows.select("words", "n", "size", F.posexplode("shingles").alias("place", "h")).distinct()
    ranked = shingles.join(frequency, ["size", "h"], "left")
    rarest = ranked.groupBy("words", "n", "size").agg(
        F.min(F.struct(F.coalesce("df", F.lit(0)).alias("df"), "h", "place")).alias("prefix"),
    )
    prefixes = rarest.where("prefix.df > 0").select("words", "n", "size", "prefix.h", "prefix.place")

    near = joined_salted(places, prefixes, ["size", "h"], frequency, "df")  # a passage may stand in most documents
    start = F.col("at") - F.col("place")
    near = near.withColumn("start", start).where((F.col("start") >= F.col("low")) & (F.col("start") + F.col("n") <= F.col("n_words")))
    around = F.split("around", " ")
    same = F.array_join(F.slice(around, (F.col("start") - F.col("low") + 1).cast("int"), F.col("n")), " ") == F.col("words")
    hits = near.where(same).select("row", "start", "n", "words").distinct()

    span = F.struct("start", (F.col("start") + F.col("n")).alias("stop"))
    covered = F.aggregate(
        F.array_sort(F.collect_set(span)),
        F.struct(F.lit(0).cast("bigint").alias("end"), F.lit(0).cast("bigint").alias("n")),
        lambda s, x: F.struct(F.greatest(s["end"], x["stop"]).alias("end"), (s["n"] + F.greatest(F.lit(0), x["stop"] - F.greatest(s["end"], x["start"]))).alias("n")),
    )
    by_row = hits.groupBy("row").agg(covered["n"].alias("n_hit"))
    named = windows.select("words", F.col("item_id").cast("string").alias("item")).distinct()
    by_item = hits.select("row", "words").distinct().join(named, "words").groupBy("row").agg(F.sort_array(F.collect_set("item")).alias("items"))
    out = found.select("row", "doc_id", "n_words").join(by_row, "row", "left").join(by_item, "row", "left")
    n_hit = F.coalesce("n_hit", F.lit(0))
    none = F.array().cast("array<string>")
    listed = F.coalesce("items", none)
    return out.select(
        "doc_id",
        "n_words",
        n_hit.alias("n_hit"),
        F.size(listed).cast("bigint").alias("n_items"),
        F.sha2(F.array_join(listed, ",").cast("binary"), 256).alias("items_sha256"),
        ((n_hit > 0) & (share * n_hit >= F.col("n_words"))).alias("contaminated"),
    )


def clean_documents(docs: DataFrame, items: DataFrame, *, window: int = 13, shingle: int = 5, share: int = 20) -> DataFrame:
    """The rows of ``docs`` that are not contaminated, each judged by its own doc_id and text.

    Rows are known by SHA-256 of doc_id and text (a null of either differs from every value), so none is taken for
    another; repeated rows share one verdict."""
    key = unused(docs, "__key")
    parts = [F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit("0")) for c in ("doc_id", "text")]
    keyed = docs.withColumn(key, F.unhex(F.sha2(F.concat_ws(";", *parts), 256)))
    bad = contamination(keyed.select(F.col(key).alias("doc_id"), "text"), items, window=window, shingle=shingle, share=share)
    bad = staged(bad.where("contaminated").select(F.col("doc_id").alias(key)).distinct(), "contaminated")
    return keyed.join(bad, key, "left_anti").drop(key).select(*docs.columns)

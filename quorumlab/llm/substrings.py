"""Removal of repeated byte strings, built blockwise with a difference cover.

A byte goes if a string of ``length`` bytes that covers it also starts in a document with a smaller
doc_id. Suffixes need to be told apart to a depth of ``length`` only, so a suffix is a position and its
first ``length`` bytes:

1. Documents are packed into chunks by ascending doc_id (chunk numbers follow doc_id), kept in the
   shared folder.
2. The cover sample: positions whose residue modulo 31 lies in a perfect difference set. Any two
   positions have an offset below 31 at which both are sampled, so two equal strings of 50 bytes share
   a sampled string of 20. Ranking the sample (tied with another document or not) once tells for every
   suffix, without sorting it, whether a long tie is possible; most suffixes end here. The open ones are
   kept as bits beside their chunk, and of equal ones within a chunk only the first is a lead.
3. The leads are sorted one block of suffix buckets at a time, so that shuffle files and memory stay
   within a bound: each chunk hashes its leads, sends those of the block and gets one bit a lead back,
   in the order in which they were sent: is it a tie of an earlier chunk or not.
4. Each chunk turns its bits into removed runs.

Buckets hold ranges of hashes rather than of bytes, as only equality to a depth matters and hashes fill
buckets evenly. The cover sample is a filter, where a false tie costs work and no more. Two open suffixes are
equal if their bucket, 32 further bits of the same hash and a second, independent hash of 64 bits agree.
With 32 buckets or more that is 101 bits; their number grows with the corpus, so that among the n windows of
any corpus a pair agrees by chance with probability n * ``bucket_items`` / 2**97: 1e-12 for 30 GB, 1e-9 for
100 TB.

Null text counts as empty. Documents that share a doc_id are kept together and never remove each
other's bytes; rows with a null doc_id come first and count as one document. An empty table gives no
rows. Texts longer than a chunk form a chunk of their own.
"""

from __future__ import annotations

import copy
import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quorumlab.llm.shared import drop_staged, mixed, staged

#: A perfect difference set modulo 31: every residue is a difference of two members (fixed values).
MODULUS, COVER = 31, (1, 5, 11, 24, 25, 27)
#: Windows are hashed in pieces of this many positions, which stay in a core's cache.
PIECE = 1 << 16
CHUNKS = "chunk bigint, ids array<bigint>, sizes array<int>, data binary"
SENT = "bucket int, chunk bigint, low binary, check binary"
BITS = "chunk bigint, bucket int, bits binary"
#: Few corpora are so small that fewer buckets would do; more of them than cores keep all cores busy.
LEAST_BUCKETS = 32


class WindowHash:
    """64-bit hashes of the ``length`` bytes from given positions, by prefix sums of a polynomial."""

    def __init__(self, seed: int) -> None:
        rng = np.random.default_rng(seed)
        self.bytes = rng.integers(0, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)
        base = int(rng.integers(0, 1 << 62)) * 4 + 3
        self.up, self.down = (self._powers(x) for x in (base, pow(base, -1, 1 << 64)))

    @staticmethod
    def _powers(base: int, size: int = PIECE + 4096) -> np.ndarray:
        out = np.full(size, base, np.uint64)
        out[0] = 1
        return np.multiply.accumulate(out)

    def __call__(self, data: np.ndarray, at: np.ndarray, length: int) -> np.ndarray:
        """``at`` ascends, and every window lies within ``data``."""
        out = np.empty(len(at), np.uint64)
        pieces = np.arange(0, len(data) + PIECE, PIECE)
        edges = np.searchsorted(at, pieces)
        for start, a, b in zip(pieces.tolist(), edges[:-1].tolist(), edges[1:].tolist(), strict=False):
            if a == b:
                continue
            values = self.bytes[data[start : start + PIECE + length - 1]]
            values *= self.up[: len(values)]
            total = np.zeros(len(values) + 1, np.uint64)
            np.cumsum(values, out=total[1:])
            place = at[a:b] - start
            out[a:b] = mixed((total[place + length] - total[place]) * self.down[place])
        return out


FIRST, SECOND = WindowHash(42), WindowHash(43)


def ordered(key: np.ndarray, check: np.ndarray | None = None) -> np.ndarray:
    """Stable order by (key, check), through one sort of the keys' leading bits with their index behind."""
    n = len(key)
    if not n:
        return np.empty(0, np.int64)
    bits = np.uint64(max(1, (n - 1).bit_length()))
    packed = (key >> bits << bits) | np.arange(n, dtype=np.uint64)
    packed.sort()
    order = (packed & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)
    packed >>= bits
    tied = packed[1:] == packed[:-1]
    unsettled = tied & (key[order[1:]] != key[order[:-1]])
    if check is not None:
        unsettled |= tied & (check[order[1:]] != check[order[:-1]])
    if unsettled.any():
        group = np.concatenate([[0], np.cumsum(~tied)])
        again = np.zeros(int(group[-1]) + 1, bool)
        again[group[1:][unsettled]] = True
        at = np.flatnonzero(again[group])
        part = order[at]
        order[at] = part[np.lexsort((part, key[part] if check is None else check[part], key[part]))]
    return order


class Keys:
    """What suffixes are compared by: a key of bucket and 32 bits, and a second hash."""

    def __init__(self, hashes: np.ndarray, check: np.ndarray | None, count: int, hash_bits: int) -> None:
        high, low = hashes >> np.uint64(32), hashes & np.uint64((1 << 32) - (1 << (32 - hash_bits)))
        bucket = (high * np.uint64(count)) >> np.uint64(32)
        # the key's bits lead, so that sorting by leading bits tells most keys apart
        self.shift = np.uint64(64 - 32 - max(1, (count - 1).bit_length()))
        self.value, self.check = ((bucket << np.uint64(32)) | low) << self.shift, check

    def only(self, which: np.ndarray) -> Keys:
        out = copy.copy(self)
        out.value, out.check = self.value[which], None if self.check is None else self.check[which]
        return out

    def bucket(self, which: np.ndarray) -> np.ndarray:
        return (self.value[which] >> self.shift >> np.uint64(32)).astype(np.int64)

    def low(self, which: np.ndarray) -> np.ndarray:
        return (self.value[which] >> self.shift).astype(np.uint32)


class Classes:
    """Equal keys of a chunk, in their order; each class has a lead, its first position."""

    def __init__(self, keys: Keys, owner: np.ndarray) -> None:
        order = ordered(keys.value, keys.check)
        fresh = np.ones(len(order), bool)
        fresh[1:] = keys.value[order[1:]] != keys.value[order[:-1]]
        if keys.check is not None:
            fresh[1:] |= keys.check[order[1:]] != keys.check[order[:-1]]
        self.lead = order[fresh]
        self.place = np.empty(len(order), np.int64)
        self.place[order] = np.cumsum(fresh) - 1
        # positions ascend, so a class's lead has its smallest document
        self.later = owner > owner[self.lead][self.place]
        self.several = np.bincount(self.place[self.later], minlength=len(self.lead)) > 0
        self.bucket = keys.bucket(self.lead)

    def answered(self, flags: list[dict] | None) -> np.ndarray:
        """The returned bit of each class; buckets without an answer hold no ties."""
        out = np.zeros(len(self.lead), bool)
        for f in flags or []:
            a, b = np.searchsorted(self.bucket, [f["bucket"], f["bucket"] + 1])
            out[a:b] = np.unpackbits(np.frombuffer(f["bits"], np.uint8), count=b - a).astype(bool)
        return out


class Chunk:
    """Documents of ascending doc_id; ``owner`` numbers their distinct ids."""

    def __init__(self, row: dict, length: int) -> None:
        self.ids, self.sizes, self.length = row["ids"], np.array(row["sizes"], np.int64), length
        self.data = np.frombuffer(row["data"], np.uint8)
        self.starts = np.cumsum(self.sizes) - self.sizes
        fresh = np.array([i > 0 and self.ids[i] != self.ids[i - 1] for i in range(len(self.ids))], np.int32)
        self.owner = np.cumsum(fresh, dtype=np.int32)

    def owners(self, at: np.ndarray) -> np.ndarray:
        return np.repeat(self.owner, np.diff(np.searchsorted(at, np.append(self.starts, len(self.data)))))

    def _fits(self, length: int) -> np.ndarray:
        """Whether ``length`` bytes from a position stay within its document."""
        ok = np.ones(len(self.data), bool)
        for s, n in zip(self.starts.tolist(), self.sizes.tolist(), strict=True):
            ok[max(s, s + n - length + 1) : s + n] = False
        return ok

    def sample(self) -> tuple[np.ndarray, np.ndarray]:
        """Cover-sample positions and their hashes."""
        depth = self.length - MODULUS + 1
        residue = np.zeros(MODULUS, bool)
        residue[list(COVER)] = True
        chosen = self._fits(depth)
        for s, n in zip(self.starts.tolist(), self.sizes.tolist(), strict=True):
            chosen[s : s + n] &= np.resize(residue, n)
        at = np.flatnonzero(chosen)
        return at, FIRST(self.data, at, depth)

    def open_at(self, tied_at: np.ndarray) -> np.ndarray:
        """Positions that a tied sample position within 31 bytes leaves open."""
        size = len(self.data) + 1
        near = np.bincount(np.maximum(tied_at - (MODULUS - 1), 0), minlength=size) - np.bincount(tied_at + 1, minlength=size)
        return np.flatnonzero((np.cumsum(near)[:-1] > 0) & self._fits(self.length))

    def keys(self, at: np.ndarray, count: int, hash_bits: int) -> Keys:
        return Keys(FIRST(self.data, at, self.length), SECOND(self.data, at, self.length), count, hash_bits)

    def removed(self, at: np.ndarray) -> list[tuple]:
        """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) of each document; repeated strings start at ``at``."""
        edge = np.zeros(len(self.data) + 1, np.int32)
        edge[at] += 1
        edge[at + self.length] -= 1
        gone = np.cumsum(edge)[:-1] > 0
        out = []
        for i, s, n in zip(self.ids, self.starts.tolist(), self.sizes.tolist(), strict=True):
            part = gone[s : s + n]
            spans = int(np.count_nonzero(part[1:] & ~part[:-1])) + int(n > 0 and part[0])
            kept = self.data[s : s + n][~part] if spans else self.data[s : s + n]
            out.append((i, n, int(part.sum()), spans, hashlib.sha256(kept.tobytes()).hexdigest()))
        return out


def chunked(docs: DataFrame, chunk_bytes: int) -> DataFrame:
    """Chunks of whole documents in ascending doc_id order, numbered in that order."""

    def pack(batches):
        number = TaskContext.get().partitionId() << 32
        ids, sizes, data, held = [], [], [], 0

        def out() -> pa.RecordBatch:
            arrays = [pa.array([number], pa.int64()), pa.array([ids], pa.list_(pa.int64())), pa.array([sizes], pa.list_(pa.int32())), pa.array([b"".join(data)], pa.binary())]
            return pa.RecordBatch.from_arrays(arrays, names=["chunk", "ids", "sizes", "data"])

        for batch in batches:
            for i, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                encoded = (text.as_py() or "").encode()
                if held and held + len(encoded) > chunk_bytes and ids[-1] != i:
                    yield out()
                    number, ids, sizes, data, held = number + 1, [], [], [], 0
                ids.append(i)
                sizes.append(len(encoded))
                data.append(encoded)
                held += len(encoded)
        if ids:
            yield out()

    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    return rows.repartitionByRange("doc_id").sortWithinPartitions("doc_id").mapInArrow(pack, CHUNKS)


def rows_of(batches):
    """One chunk at a time."""
    for batch in batches:
        for i in range(batch.num_rows):
            yield batch.slice(i, 1).to_pylist()[0]
        pa.default_memory_pool().release_unused()


def sent_rows(chunk: int, keys: Keys) -> pa.RecordBatch:
    """One row for each bucket that has distinct ``keys`` of the chunk."""
    order = ordered(keys.value, keys.check)
    bucket = keys.bucket(order)
    edge = np.append(np.flatnonzero(np.concatenate([np.ones(min(1, len(bucket)), bool), bucket[1:] != bucket[:-1]])), len(bucket))
    low = keys.low(order)
    check = low[:0] if keys.check is None else keys.check[order]
    parts = list(zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True))
    arrays = [
        pa.array(bucket[edge[:-1]].astype(np.int32)),
        pa.array([chunk] * len(parts), pa.int64()),
        *(pa.array([x[a:b].tobytes() for a, b in parts], pa.binary()) for x in (low, check)),
    ]
    return pa.RecordBatch.from_arrays(arrays, names=["bucket", "chunk", "low", "check"])


def ranked(sent: DataFrame, earlier_only: bool) -> DataFrame:
    """Answer each bucket: does an earlier chunk (or any other chunk) have a key too? No row for a chunk without ties."""

    def answer(table: pa.Table) -> pa.Table:
        chunk = table.column("chunk").to_numpy()
        arrival = np.argsort(chunk, kind="stable").tolist()
        low = [np.frombuffer(table.column("low")[i].as_py(), np.uint32) for i in arrival]
        sizes = np.array([len(x) for x in low])
        key = np.concatenate(low).astype(np.uint64) << np.uint64(32)
        check = np.concatenate([np.frombuffer(table.column("check")[i].as_py(), np.uint64) for i in arrival])
        check = check if len(check) else None
        order = ordered(key, check)  # equal keys stay in chunk order
        same = key[order[1:]] == key[order[:-1]]
        if check is not None:
            same &= check[order[1:]] == check[order[:-1]]
        tie = np.zeros(len(key), bool)
        tie[order[1:]] = same
        if not earlier_only:
            tie[order[:-1]] |= same
        ends = np.cumsum(sizes).tolist()
        bits = [np.packbits(tie[e - n : e]).tobytes() if tie[e - n : e].any() else None for e, n in zip(ends, sizes.tolist(), strict=True)]
        kept = [i for i, b in enumerate(bits) if b is not None]
        bucket = table.column("bucket")[0].as_py()
        return pa.table({"chunk": pa.array(chunk[arrival][kept]), "bucket": pa.array([bucket] * len(kept), pa.int32()), "bits": pa.array([bits[i] for i in kept], pa.binary())})

    return sent.groupBy("bucket").applyInArrow(answer, BITS)


def with_answers(chunks: DataFrame, bits: DataFrame) -> DataFrame:
    """``chunks`` with the list ``answers`` of (bucket, bits)."""
    gathered = bits.groupBy(F.col("chunk").alias("of_chunk")).agg(F.collect_list(F.struct("bucket", "bits")).alias("answers"))
    return chunks.join(gathered.hint("shuffle_hash"), F.col("chunk") == F.col("of_chunk"), "left").drop("of_chunk")


def repeated_bytes(
    docs: DataFrame, *, length: int = 50, chunk_bytes: int = 4 << 20, bucket_items: int = 1 << 20, block_bytes: float = 1.25, least_buckets: int = LEAST_BUCKETS, hash_bits: int = 32
) -> DataFrame:
    """Per document row: doc_id, n_bytes, n_removed, n_spans, kept_sha256.

    ``length`` is at least 40. ``block_bytes``: bytes of keys that one block of buckets may shuffle, as a
    multiple of the text's own bytes; the number of blocks does not grow with the corpus. ``hash_bits``: bits
    of the first hash beside the bucket, for tests.
    """
    chunks = staged(chunked(docs, chunk_bytes), "chunks", row_group=32 << 20)
    total = chunks.agg(F.coalesce(F.sum(F.length("data")), F.lit(0)).cast("bigint")).first()[0]

    def buckets_for(items: float) -> int:
        return max(least_buckets, math.ceil(items / bucket_items))

    # the cover sample: which of its positions are tied
    n_cover = buckets_for(total * len(COVER) / MODULUS)

    def sampled(row: dict) -> tuple[Chunk, np.ndarray, Keys, Classes]:
        chunk = Chunk(row, length)
        at, hashes = chunk.sample()
        keys = Keys(hashes, None, n_cover, 32)
        return chunk, at, keys, Classes(keys, chunk.owners(at))

    def cover(batches):
        for row in rows_of(batches):
            _, _, keys, classes = sampled(row)
            yield sent_rows(row["chunk"], keys.only(classes.lead))

    ties = staged(ranked(chunks.mapInArrow(cover, SENT), earlier_only=False), "cover-ties")

    # the suffixes that stay open, as bits beside their chunk
    def opened(batches):
        for row in rows_of(batches):
            chunk, at, _, classes = sampled(row)
            tied = classes.several | classes.answered(row["answers"])
            at = chunk.open_at(at[tied[classes.place]])
            lead = at[Classes(chunk.keys(at, least_buckets, 32), chunk.owners(at)).lead]
            marks = np.zeros((2, len(chunk.data)), bool)
            marks[0, at], marks[1, lead] = True, True
            arrays = [pa.array([row["chunk"]], pa.int64()), pa.array([row["ids"]], pa.list_(pa.int64())), pa.array([row["sizes"]], pa.list_(pa.int32())), pa.array([row["data"]], pa.binary())]
            arrays += [pa.array([np.packbits(m).tobytes()], pa.binary()) for m in marks] + [pa.array([len(lead)], pa.int64())]
            yield pa.RecordBatch.from_arrays(arrays, names=["chunk", "ids", "sizes", "data", "open", "lead", "leads"])

    known = staged(with_answers(chunks, ties).mapInArrow(opened, f"{CHUNKS}, open binary, lead binary, leads bigint"), "open-suffixes", row_group=32 << 20)
    drop_staged(chunks)
    drop_staged(ties)

    # their buckets, one block of them at a time
    n_leads = known.agg(F.coalesce(F.sum("leads"), F.lit(0))).first()[0]
    n_suffix = buckets_for(n_leads)
    blocks = max(1, math.ceil(n_leads * 12 / (block_bytes * max(1, total))))

    def marked(row: dict, name: str) -> np.ndarray:
        return np.flatnonzero(np.unpackbits(np.frombuffer(row[name], np.uint8), count=len(row["data"])))

    answers = None
    for block in range(blocks):
        low, high = block * n_suffix // blocks, (block + 1) * n_suffix // blocks

        def suffixes(batches, low=low, high=high):
            for row in rows_of(batches):
                chunk, at = Chunk(row, length), marked(row, "lead")
                hashes = FIRST(chunk.data, at, length)
                bucket = ((hashes >> np.uint64(32)) * np.uint64(n_suffix)) >> np.uint64(32)
                here = np.flatnonzero((bucket >= low) & (bucket < high))
                yield sent_rows(row["chunk"], Keys(hashes[here], SECOND(chunk.data, at[here], length), n_suffix, hash_bits))

        sent = known.select("chunk", "ids", "sizes", "data", "lead").mapInArrow(suffixes, SENT)
        found = staged(ranked(sent, earlier_only=True), "suffix-ties")
        answers = found if answers is None else answers.unionByName(found)

    def finish(batches):
        for row in rows_of(batches):
            chunk, at = Chunk(row, length), marked(row, "open")
            classes = Classes(chunk.keys(at, n_suffix, hash_bits), chunk.owners(at))
            repeated = classes.later | classes.answered(row["answers"])[classes.place]
            cols = list(zip(*chunk.removed(at[repeated]), strict=True))
            arrays = [*(pa.array(c, pa.int64()) for c in cols[:4]), pa.array(cols[4], pa.string())]
            yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    whole = with_answers(known.select("chunk", "ids", "sizes", "data", "open"), answers)
    return whole.mapInArrow(finish, "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string")

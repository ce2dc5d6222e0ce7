"""Packing token ids into windows by minimum bin slack.

Each document's ids are cut into full windows; what remains (shorter than a window) waits in a
bounded buffer of its task. For each window the longest waiting rest is placed, and a bitset
subset-sum over the lengths of the others (with their counts) finds the multiset that comes closest
to the free space; backtracking gives the counts. Slack that no multiset fills is filled by cutting
one waiting rest. What a task is left with at its end is cut into sequences whose lengths are
powers of two, which are not padded.

Null text counts as empty (its end id alone). Null or repeated doc_ids are packed like others.
An empty table gives no pieces. Memory per task: one batch and ``waiting`` rests.
"""

from __future__ import annotations

import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quorumlab.llm.shared import text_slices
from quorumlab.llm.token_files import ended_ids

PIECE_SCHEMA = "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint"


def closest_fill(capacity: int, counts: dict[int, int]) -> dict[int, int]:
    """Counts of lengths whose sum is the largest possible up to ``capacity``."""
    within = (1 << (capacity + 1)) - 1
    lengths, reach = [], [1]
    for length in sorted((x for x, n in counts.items() if n and x <= capacity), reverse=True):
        now, left, step = reach[-1], min(counts[length], capacity // length), 1
        while left:
            take = min(step, left)
            now |= (now << (take * length)) & within
            left, step = left - take, step * 2
        lengths.append(length)
        reach.append(now)
        if now >> capacity & 1:
            break
    best, chosen = reach[-1].bit_length() - 1, {}
    for i in range(len(lengths) - 1, -1, -1):
        n = 0
        while not reach[i] >> best & 1:
            best, n = best - lengths[i], n + 1
        if n:
            chosen[lengths[i]] = n
    return chosen


class Packer:
    """Packs (doc_id, start, ids, doc_tokens) pieces; ``out`` gets (piece, sequence, offset)."""

    def __init__(self, window: int, waiting: int, first_sequence: int) -> None:
        self.window, self.waiting, self.sequence = window, waiting, first_sequence
        self.rests: dict[int, list] = defaultdict(list)
        self.n = self.total = 0
        self.out: list[tuple] = []

    def _emit(self, pieces: list[tuple]) -> None:
        offset = 0
        for piece in pieces:
            self.out.append((*piece, self.sequence, offset))
            offset += len(piece[2])
        self.sequence += 1

    def _put(self, piece: tuple) -> None:
        self.rests[len(piece[2])].append(piece)
        self.n += 1
        self.total += len(piece[2])

    def _take(self, length: int) -> tuple:
        piece = self.rests[length].pop()
        if not self.rests[length]:
            del self.rests[length]
        self.n -= 1
        self.total -= length
        return piece

    @staticmethod
    def _cut(piece: tuple, at: int) -> tuple[tuple, tuple]:
        doc, start, ids, n = piece
        return (doc, start, ids[:at], n), (doc, start + at, ids[at:], n)

    def add(self, doc_id, ids: np.ndarray) -> None:
        full = len(ids) // self.window * self.window
        for at in range(0, full, self.window):
            self._emit([(doc_id, at, ids[at : at + self.window], len(ids))])
        if full < len(ids):
            self._put((doc_id, full, ids[full:].copy(), len(ids)))
        while self.n > self.waiting and self.total >= self.window:
            self._fill()

    def _fill(self) -> None:
        pieces = [self._take(max(self.rests))]
        free = self.window - len(pieces[0][2])
        for length, n in closest_fill(free, {x: len(v) for x, v in self.rests.items()}).items():
            pieces += [self._take(length) for _ in range(n)]
            free -= n * length
        if free:
            head, tail = self._cut(self._take(max(self.rests)), free)
            pieces.append(head)
            self._put(tail)
        self._emit(pieces)

    def finish(self) -> None:
        while self.total >= self.window:
            self._fill()
        left = [self._take(x) for x in sorted(self.rests, reverse=True) for _ in range(len(self.rests[x]))]
        size = 1 << max(0, sum(len(p[2]) for p in left).bit_length() - 1)
        while left:
            if size > sum(len(p[2]) for p in left):
                size >>= 1
                continue
            pieces, free = [], size
            while free:
                piece = left.pop(0)
                if len(piece[2]) > free:
                    piece, tail = self._cut(piece, free)
                    left.insert(0, tail)
                pieces.append(piece)
                free -= len(piece[2])
            self._emit(pieces)


def pack_documents(docs: DataFrame, tokenizer: str, *, drops_space: bool = False, end_id: int = 0, window: int = 1024, waiting: int = 256, with_ids: bool = True) -> DataFrame:
    """One row per piece; with ``with_ids`` also its ``ids``. ``window`` is a power of two."""
    fields = PIECE_SCHEMA + ", ids array<int>" * with_ids

    def rows(found: list[tuple]) -> pa.RecordBatch:
        arrays = [
            pa.array([p[0] for p in found], pa.int64()),
            pa.array([p[1] for p in found], pa.int64()),
            pa.array([len(p[2]) for p in found], pa.int64()),
            pa.array([zlib.crc32(np.ascontiguousarray(p[2], "<u4")) for p in found], pa.int64()),
            *(pa.array([p[i] for p in found], pa.int64()) for i in (3, 4, 5)),
        ]
        names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
        if with_ids:
            offsets = np.concatenate([[0], np.cumsum([len(p[2]) for p in found])]).astype(np.int32)
            arrays.append(pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate([p[2] for p in found]) if found else np.empty(0, np.int32))))
            names.append("ids")
        return pa.RecordBatch.from_arrays(arrays, names=names)

    def pack(batches):
        packer = Packer(window, waiting, TaskContext.get().partitionId() << 40)
        for batch in batches:
            keys = batch.column(0).to_pylist()
            for first, texts in text_slices(batch):
                ids, ends = ended_ids(texts, tokenizer, drops_space, end_id)
                start = 0
                for i, end in enumerate(ends.tolist()):
                    packer.add(keys[first + i], ids[start:end])
                    start = end
                if packer.out:
                    yield rows(packer.out)
                    packer.out = []
        packer.finish()
        if packer.out:
            yield rows(packer.out)

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(pack, fields)

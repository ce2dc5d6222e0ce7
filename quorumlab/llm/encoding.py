"""Token ids of whole texts, with each distinct piece of text encoded once per worker.

A text is cut at places where the tokenizer's own pre-tokenizer always cuts, whatever stands
around; the pieces (words with their leading space, runs of digits or symbols, white space) are
hashed with numpy, and only pieces that the worker has not met yet go through the tokenizer.
Where Unicode leaves any doubt (combining marks, letters whose lower case changes class,
scripts above U+3000) no cut is made, so that the piece holds the whole doubtful run.

An added token's literal (such as ``<|endoftext|>``) spans several pieces, so a text that holds one goes
through the tokenizer whole, which gives the literal the token's own id, as the tokenizer file says.

A piece is known by a 64-bit hash, its length and its first and last code points; where two pieces share the
hash and differ in one of these, the texts at hand are encoded whole.
"""

from __future__ import annotations

import os
import unicodedata

import numpy as np

from quorumlab.llm.shared import SpanHash

EDGE, BLANK, SPACE, LETTER, DIGIT, OTHER, QUOTE, DOUBT = range(8)
#: Code points from here on are all doubtful.
KNOWN = 0x3000


def _classes() -> tuple[np.ndarray, np.ndarray]:
    """(class, lower case) of each code point; doubtful ones stay as they are."""
    out, low = np.full(KNOWN + 1, DOUBT, np.uint8), np.arange(KNOWN + 1, dtype=np.uint32)
    for i in range(KNOWN):
        c, kind = chr(i), unicodedata.category(chr(i))
        lower = c.lower()
        if c == " ":
            out[i] = BLANK
        elif c in "\t\n\x0b\x0c\r":
            out[i] = SPACE
        elif c.isspace() or kind in ("Cn", "Co", "Cs", "Cf") or kind[0] in "MZ":
            out[i] = DOUBT
        elif len(lower) != 1 or unicodedata.category(lower)[0] != kind[0] or unicodedata.normalize("NFC", c) != c:
            out[i] = DOUBT
        else:
            out[i] = {"L": LETTER, "N": DIGIT}.get(kind[0], QUOTE if c == "'" else OTHER)
            low[i] = ord(lower)
    return out, low


class PieceEncoder:
    """Encodes lists of texts with one tokenizer file.

    ``drops_space``: the tokenizer ignores white space and case and encodes digits one by one (the word
    vocabulary); otherwise a blank belongs to the word after it (the byte vocabulary).
    ``memory``: pieces kept before the worker starts anew.
    """

    RECENT_BITS = 21

    def __init__(self, path: str, drops_space: bool, memory: int = 1_500_000) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        added = self.tokenizer.get_added_tokens_decoder().values()
        if any(t.normalized or t.lstrip or t.rstrip or t.single_word for t in added):
            raise ValueError(f"{path}: only added tokens that match literally are supported")
        self.added = sorted(t.content for t in added)
        self.drops_space, self.memory = drops_space, memory
        self.classes, self.lower = _classes()
        self.hash = SpanHash()
        self._forget()

    def _forget(self) -> None:
        self.n = self.used = 0
        self.known = np.empty(0, np.uint64)  # sorted hashes
        self.number = np.empty(0, np.int32)  # piece number of each
        self.first = np.empty(1 << 14, np.int32)  # where a piece's ids begin, by piece number
        self.count = np.empty(1 << 14, np.int32)
        self.mark = np.empty(1 << 14, np.uint64)  # length and ends, see marks()
        self.flat = np.empty(1 << 16, np.int32)
        # a table by the hash's low bits answers most look-ups: the last piece met for each of its slots
        self.recent = np.zeros(1 << self.RECENT_BITS, np.uint64)
        self.recent_number = np.zeros(1 << self.RECENT_BITS, np.int32)

    def _cuts(self, kind: np.ndarray) -> np.ndarray:
        """Indexes at which a piece starts; the last one is the end."""
        a, b = kind[:-1], kind[1:]
        solid = (kind >= LETTER) & (kind <= QUOTE)
        blank = (kind == BLANK) | (kind == SPACE)
        sa, sb, wa, wb = solid[:-1], solid[1:], blank[:-1], blank[1:]
        folded = np.where(kind == QUOTE, OTHER, kind)
        cut = (a == EDGE) | (b == EDGE) | (sa & wb)
        cut |= sa & sb & (folded[:-1] != folded[1:]) & ~((a == QUOTE) & (b == LETTER))
        if self.drops_space:
            cut |= (wa != wb) | ((a == DIGIT) & (b == DIGIT))
        else:
            cut |= (a == SPACE) & sb
            cut[:-1] |= wa[:-1] & wb[:-1] & solid[2:]
        return np.concatenate([[0], np.flatnonzero(cut) + 1, [len(kind)]])

    @staticmethod
    def _grown(array: np.ndarray, used: int, size: int) -> np.ndarray:
        if size <= len(array):
            return array
        out = np.empty(max(size, len(array) * 5 // 4), array.dtype)
        out[:used] = array[:used]
        return out

    @staticmethod
    def _marks(points: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Length (22 bits), first and last code point (21 bits each) of spans."""
        first, last, size = (x.astype(np.uint64) for x in (points[starts], points[ends - 1], ends - starts))
        return (size << np.uint64(42)) ^ (first << np.uint64(21)) ^ last

    def _learn(self, hashes: np.ndarray, pieces: list[str], marks: np.ndarray) -> None:
        ids = [e.ids for e in self.tokenizer.encode_batch_fast(pieces, add_special_tokens=False)]
        count = np.fromiter(map(len, ids), np.int64, len(ids))
        total, n = int(count.sum()), self.n + len(pieces)
        self.flat = self._grown(self.flat, self.used, self.used + total)
        self.first, self.count = self._grown(self.first, self.n, n), self._grown(self.count, self.n, n)
        self.flat[self.used : self.used + total] = [x for e in ids for x in e]
        self.first[self.n : n] = self.used + np.cumsum(count) - count
        self.count[self.n : n] = count
        self.mark = self._grown(self.mark, self.n, n)
        self.mark[self.n : n] = marks
        known, number = np.concatenate([self.known, hashes]), np.concatenate([self.number, np.arange(self.n, n, dtype=np.int32)])
        order = np.argsort(known, kind="stable")
        self.known, self.number = known[order], number[order]
        self.used, self.n = self.used + total, n

    def _numbers(self, h: np.ndarray, joined: str, starts: np.ndarray, ends: np.ndarray, marks: np.ndarray) -> np.ndarray:
        """Piece number of each span; new pieces are encoded."""
        slot = (h & np.uint64((1 << self.RECENT_BITS) - 1)).astype(np.int64)
        out = self.recent_number[slot]
        miss = np.flatnonzero((self.recent[slot] != h) | (h == 0))
        if not len(miss):
            return out
        found, at, place = np.unique(h[miss], return_index=True, return_inverse=True)
        spot = np.searchsorted(self.known, found)
        new = np.ones(len(found), bool)
        inside = spot < len(self.known)
        new[inside] = self.known[spot[inside]] != found[inside]
        if self.n and self.n + int(new.sum()) > self.memory:
            self._forget()
            return self._numbers(h, joined, starts, ends, marks)
        if new.any():
            w = miss[at[new]]
            self._learn(found[new], [joined[s:e] for s, e in zip(starts[w].tolist(), ends[w].tolist(), strict=True)], marks[w])
            spot = np.searchsorted(self.known, found)
        number = self.number[spot]
        out[miss] = number[place.reshape(-1)]
        slot = (found & np.uint64((1 << self.RECENT_BITS) - 1)).astype(np.int64)
        self.recent[slot], self.recent_number[slot] = found, number
        return out

    def __call__(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, end of each text's ids)."""
        whole = [i for i, t in enumerate(texts) if any(x in t for x in self.added)]
        if not whole:
            return self._by_pieces(texts)
        rest = list(texts)
        for i in whole:
            rest[i] = ""
        ids, ends = self._by_pieces(rest)
        parts = np.split(ids, ends[:-1])
        found, stops = self._whole([texts[i] for i in whole])
        for i, part in zip(whole, np.split(found, stops[:-1]), strict=True):
            parts[i] = part
        return np.concatenate(parts), np.cumsum(list(map(len, parts)))

    def _whole(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The tokenizer's own answer for whole texts."""
        parts = [np.array(e.ids, np.int32) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        return np.concatenate(parts), np.cumsum(list(map(len, parts)))

    def _by_pieces(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        sizes = np.fromiter(map(len, texts), np.int64, len(texts))
        joined = "\n".join(texts) + "\n"
        points = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
        bounded = np.minimum(points, KNOWN)
        kind = self.classes[bounded]
        edges = np.cumsum(sizes + 1) - 1
        kind[edges] = EDGE
        cuts = self._cuts(kind)
        starts, ends = cuts[:-1], cuts[1:]
        lead = kind[starts]
        keep = (lead != EDGE) & ~((lead <= SPACE) & self.drops_space)
        starts, ends = starts[keep], ends[keep]
        counts = np.zeros(0, np.int64)
        out = np.empty(0, np.int32)
        if len(starts):
            if self.drops_space:
                points = np.where(points < KNOWN, self.lower[bounded], points)
            marks = self._marks(points, starts, ends)
            number = self._numbers(self.hash(points, starts, ends), joined, starts, ends, marks)
            if (self.mark[number] != marks).any():  # two pieces of one hash
                return self._whole(texts)
            counts = self.count[number].astype(np.int64)
            stop = np.cumsum(counts)
            out = self.flat[np.repeat(self.first[number] - (stop - counts), counts) + np.arange(int(stop[-1]))]
        total = np.concatenate([[0], np.cumsum(counts)])
        return out, total[np.searchsorted(starts, edges)]

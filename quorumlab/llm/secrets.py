"""Secret scans: fixed patterns, and character Markov models of random strings against identifiers.

Two first-order Markov models over ``[A-Za-z0-9+/_=-]`` are trained from labelled samples: strings
that the fixed patterns mark as secrets, and ordinary words of at least ``LONG`` characters outside
them. A run of at least ``LONG`` such characters that overlaps no pattern match becomes a ``markov``
span if its log-likelihood ratio is at least ``margin`` nats a character. Without samples of both
kinds there are no ``markov`` spans.

Offsets count code points, ends are exclusive. Null and empty texts have no spans. Repeated rows are
scanned one by one. Empty tables give no rows.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left
from dataclasses import dataclass
from functools import reduce
from itertools import accumulate
from operator import or_

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quorumlab.llm.shared import sampled, text_slices

KINDS = ("assign", "access", "hex", "markov")
KEYWORD = re.compile(r"password|passwd|secret|token|api_?key", re.I | re.A)
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"(?<![0-9a-f])[0-9a-f]{16,}")
LONG = 16
RUN = re.compile(rf"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{{{LONG},}}")
SYMBOLS = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
CODES = np.zeros(128, np.int64)
CODES[[ord(c) for c in SYMBOLS]] = np.arange(len(SYMBOLS)) + 1
WIDTH = len(SYMBOLS) + 1  # 0: before the first character
#: Even share of the transitions of each model.
RANDOM_EVEN, ORDINARY_EVEN = 0.5, 0.02

Span = tuple[int, int, int]  # start, kind, end


def pattern_spans(text: str) -> list[Span]:
    """The base spans, by start and then kind."""
    found: list[Span] = []
    low = text.lower() if ("=" in text or ":" in text) else ""
    if any(k in low for k in ("passw", "secret", "token", "api")):
        found += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m.group(2)) >= 12]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 18]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(found)


def free_runs(text: str, taken: list[Span]) -> list[tuple[int, int]]:
    """Runs that overlap no span of ``taken``, which is sorted by start."""
    runs = [m.span() for m in RUN.finditer(text)]
    if not (taken and runs):
        return runs
    starts, reach = [s for s, _, _ in taken], list(accumulate((e for _, _, e in taken), max))
    before = [bisect_left(starts, b) for _, b in runs]  # spans that start before the run's end
    return [(a, b) for (a, b), n in zip(runs, before, strict=True) if not n or reach[n - 1] <= a]


def secret_values(text: str, spans: list[Span]) -> list[str]:
    """What the base spans hide, cut at characters outside the models' alphabet."""
    values = []
    for start, kind, end in spans:
        part = text[start:end]
        if kind == 0:
            part = ASSIGN.match(text, start).group(2)
        values += [x for x in part.split(".") if len(x) >= 8]
    return values


def pair_codes(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(transition code of each character, first index of each word)."""
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    codes = CODES[np.frombuffer("".join(words).encode(), np.uint8)]
    starts = np.cumsum(sizes) - sizes
    before = np.concatenate([[0], codes[:-1]])
    before[starts] = 0
    return before * WIDTH + codes, starts


@dataclass
class MarkovPair:
    ratio: np.ndarray | None  # log P(random) - log P(ordinary) of each transition
    margin: float = 0.3

    @classmethod
    def fit(cls, random: np.ndarray, ordinary: np.ndarray, margin: float) -> MarkovPair:
        """From transition counts, smoothed towards the following character's own frequency and an even share.

        The labelled secrets of a corpus may come from few alphabets, so half of the random model is even.
        """
        if not random.sum() or not ordinary.sum():
            return cls(None, margin)

        def logs(counts: np.ndarray, even: float) -> np.ndarray:
            table = counts.reshape(WIDTH, WIDTH).astype(float)
            single = (table.sum(axis=0) + 0.05) / (table.sum() + 0.05 * WIDTH)
            learned = (table + 4 * single) / (table.sum(axis=1, keepdims=True) + 4)
            return np.log((1 - even) * learned + even / WIDTH).reshape(-1)

        return cls(logs(random, RANDOM_EVEN) - logs(ordinary, ORDINARY_EVEN), margin)

    def spans(self, texts: list[str], bases: list[list[Span]]) -> list[list[Span]]:
        found: list[list[Span]] = [[] for _ in texts]
        if self.ratio is None:
            return found
        runs = [(i, a, b) for i, (t, base) in enumerate(zip(texts, bases, strict=True)) for a, b in free_runs(t, base)]
        if not runs:
            return found
        codes, starts = pair_codes([texts[i][a:b] for i, a, b in runs])
        sums = np.add.reduceat(self.ratio[codes], starts)
        for (i, a, b), s in zip(runs, sums.tolist(), strict=True):
            if s >= self.margin * (b - a):
                found[i].append((a, 3, b))
        return found


def train(docs: DataFrame, *, sample: int = 10_000, margin: float = 0.3) -> MarkovPair:
    """Fit both models on about ``sample`` documents at most that name a kind of secret, and as many others."""

    def transitions(batches):
        counts = np.zeros((2, WIDTH * WIDTH), np.int64)
        for batch in batches:
            for _, texts in text_slices(batch):
                for t in texts:
                    base = pattern_spans(t)
                    for k, words in enumerate((secret_values(t, base), [t[a:b] for a, b in free_runs(t, base)])):
                        if words:
                            counts[k] += np.bincount(pair_codes(words)[0], minlength=WIDTH * WIDTH)
        at = np.nonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(at[0].astype(np.int32)), pa.array(at[1].astype(np.int32)), pa.array(counts[at])], names=["model", "pair", "n"])

    low = F.lower("text")
    names = reduce(or_, (F.contains(low, F.lit(w)) for w in ("password", "passwd", "secret", "token", "api_key", "apikey", "akia")))
    rows = docs.where("text is not null").select("text", names.alias("names"), *(["doc_id"] if "doc_id" in docs.columns else []))
    rows = sampled(rows, "names", sample).select("text")
    counts = np.zeros((2, WIDTH * WIDTH))
    for r in rows.mapInArrow(transitions, "model int, pair int, n bigint").groupBy("model", "pair").agg(F.sum("n").alias("n")).collect():
        counts[r["model"], r["pair"]] = r["n"]  # WIDTH squared for each model at most
    return MarkovPair.fit(counts[0], counts[1], margin)


def all_spans(texts: list[str], model: MarkovPair) -> tuple[list[list[Span]], list[list[Span]]]:
    bases = [pattern_spans(t) for t in texts]
    return bases, [sorted(a + b) if b else a for a, b in zip(bases, model.spans(texts, bases), strict=True)]


def written(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def scan(docs: DataFrame, model: MarkovPair) -> DataFrame:
    """Per row: doc_id, counts per kind, base_sha256 (of the base spans as written), spans (all of them)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def find(batches):
        for batch in batches:
            for first, texts in text_slices(batch):
                bases, spans = all_spans(texts, shared.value)
                counts = [[sum(k == kind for _, k, _ in s) for s in spans] for kind in range(4)]
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(first, len(texts)),
                        *(pa.array(c, pa.int64()) for c in counts),
                        pa.array([hashlib.sha256(written(s).encode()).hexdigest() for s in bases], pa.string()),
                        pa.array([written(s) for s in spans], pa.string()),
                    ],
                    names=["doc_id", "n_assign", "n_access", "n_hex", "n_markov", "base_sha256", "spans"],
                )

    fields = "doc_id bigint, n_assign bigint, n_access bigint, n_hex bigint, n_markov bigint, base_sha256 string, spans string"
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(find, fields)


def redact(docs: DataFrame, model: MarkovPair, mark: str = "[SECRET]") -> DataFrame:
    """``docs`` with every span of ``text`` replaced by ``mark`` (overlapping spans by one)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index("text")

    def hidden(text: str, spans: list[Span]) -> str:
        out, end = [], 0
        for a, _, b in spans:
            if a >= end:
                out += [text[end:a], mark]
            end = max(end, b)
        return "".join([*out, text[end:]])

    def replace(batches):
        for batch in batches:
            for first, texts in text_slices(batch):
                part = batch.slice(first, len(texts))
                _, spans = all_spans(texts, shared.value)
                if any(spans):
                    nulls = part.column(at).is_null().to_pylist()
                    new = pa.array([None if n else hidden(t, s) if s else t for t, s, n in zip(texts, spans, nulls, strict=True)], part.schema.field(at).type)
                    part = part.set_column(at, part.schema.field(at), new)
                yield part

    return docs.mapInArrow(replace, docs.schema)

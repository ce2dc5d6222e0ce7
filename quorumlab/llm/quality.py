"""Document quality from a linear-chain conditional random field over lines.

Every line is good or bad. Its state scores come from features of the line (length, symbol, upper-case,
digit and mark shares, word length, repeated words, repeated lines) and the same features of the line
before and after; neighbouring states interact by a 2 x 2 transition score. Weights are fitted by the
conditional likelihood of line labels, which are the labels of the lines' documents, on a sample of
bounded size. A document's score is the mean of its lines' forward-backward marginals of ``good``,
weighted by their lengths.

Null and empty texts are one empty line, scored like any other. Without training rows all scores are
0.5. Repeated rows get equal scores. Empty tables give no rows. Long documents are scored in full.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quorumlab.llm.shared import sampled, text_slices

OWN = 14
FEATURES = 3 * OWN + 2  # own, before, after, whether there is one before and after
SYMBOLS = b"#*$%&|<>{}[]\\^~=_@+"


def line_features(text: str) -> tuple[np.ndarray, np.ndarray]:
    """(own features of each line, weight of each line)."""
    lines = text.split("\n")
    rows, seen = np.zeros((len(lines), OWN), np.float32), set()
    for i, line in enumerate(lines):
        raw = line.encode()
        words = raw.split()
        n, w = len(raw), len(words)
        if not n:
            rows[i, 0] = 1
            continue
        upper = n - len(raw.translate(None, b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"))
        digits = n - len(raw.translate(None, b"0123456789"))
        symbols = n - len(raw.translate(None, SYMBOLS))
        marks = raw.count(b"!") + raw.count(b"?")
        letters = max(1, n - digits - symbols - marks - raw.count(b" "))
        unique = len(set(words))
        pairs = len(set(zip(words, words[1:], strict=False)))
        rows[i, 1:] = (
            min(1.0, np.log1p(n) / 8),
            min(1.0, 2 * upper / letters),
            upper > 0.5 * letters,
            min(1.0, 5 * digits / n),
            min(1.0, 5 * symbols / n),
            symbols * 20 > n,
            min(1.0, 5 * marks / n),
            marks * 30 > n,
            min(1.0, n / max(w, 1) / 12),
            1 - unique / max(w, 1),
            1 - pairs / max(w - 1, 1) if w > 1 else 0.0,
            line in seen,
            w < 4,
        )
        seen.add(line)
    return rows, np.array([max(1, len(x)) for x in lines], np.float64)


def with_neighbours(own: np.ndarray) -> np.ndarray:
    n = len(own)
    out = np.zeros((n, FEATURES), np.float32)
    out[:, :OWN] = own
    out[1:, OWN : 2 * OWN] = own[:-1]
    out[:-1, 2 * OWN : 3 * OWN] = own[1:]
    out[1:, -2] = 1
    out[:-1, -1] = 1
    return out


def forward_backward(state: np.ndarray, edge: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(marginals of each line, expected transitions, log normalizers); all documents move a line at a time.

    ``state``: (lines, 2) scores, documents one after another; ``sizes``: lines of each.
    """
    starts = np.cumsum(sizes) - sizes
    order = np.argsort(-sizes, kind="stable")
    sizes, starts = sizes[order], starts[order]
    alpha, beta = np.zeros_like(state), np.zeros_like(state)
    alpha[starts] = state[starts]
    top = int(sizes[0]) if len(sizes) else 0
    alive = np.searchsorted(-sizes, -np.arange(top), "left")  # documents with more than t lines
    for t in range(1, top):
        at = starts[: alive[t]] + t
        alpha[at] = state[at] + np.logaddexp(alpha[at - 1, :1] + edge[0], alpha[at - 1, 1:] + edge[1])
    for t in range(top - 2, -1, -1):
        at = starts[: alive[t + 1]] + t
        after = state[at + 1] + beta[at + 1]
        beta[at] = np.logaddexp(after[:, :1] + edge[:, 0], after[:, 1:] + edge[:, 1])
    total = alpha + beta
    norm = np.logaddexp(total[:, 0], total[:, 1])
    marginal = np.exp(total - norm[:, None])
    first = np.zeros(len(state), bool)
    first[starts] = True
    at = np.flatnonzero(~first)
    after = state[at] + beta[at] - norm[at, None]
    pairs = np.exp(alpha[at - 1][:, :, None] + edge[None] + after[:, None, :]).sum(axis=0)
    return marginal, pairs, norm[starts]


@dataclass
class LineField:
    weights: np.ndarray | None = None  # (FEATURES + 1, 2), the last row is the bias
    edge: np.ndarray | None = None  # (from, to)

    def state(self, x: np.ndarray) -> np.ndarray:
        return x @ self.weights[:-1] + self.weights[-1]

    @classmethod
    def fit(cls, x: np.ndarray, label: np.ndarray, sizes: np.ndarray, *, steps: int = 100, rate: float = 0.1, ridge: float = 1e-4) -> LineField:
        """Adam on the mean conditional log-likelihood of the line labels."""
        if not len(sizes):
            return cls()
        theta = np.zeros(2 * (FEATURES + 1) + 4)
        truth = np.eye(2)[label]
        first = np.zeros(len(label), bool)
        first[np.cumsum(sizes) - sizes] = True
        at = np.flatnonzero(~first)
        seen = np.zeros((2, 2))
        np.add.at(seen, (label[at - 1], label[at]), 1)
        m, v = np.zeros_like(theta), np.zeros_like(theta)
        for step in range(1, steps + 1):
            field = cls(theta[:-4].reshape(FEATURES + 1, 2), theta[-4:].reshape(2, 2))
            marginal, pairs, _ = forward_backward(field.state(x), field.edge, sizes)
            gap = marginal - truth
            grad = np.concatenate([(x.T @ gap).reshape(-1), gap.sum(axis=0), (pairs - seen).reshape(-1)]) / len(label) + ridge * theta
            m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad**2
            theta = theta - rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
        return cls(theta[:-4].reshape(FEATURES + 1, 2), theta[-4:].reshape(2, 2))

    def scores(self, texts: list[str]) -> np.ndarray:
        if self.weights is None:
            return np.full(len(texts), 0.5)
        parts = [line_features(t) for t in texts]
        sizes = np.array([len(p[1]) for p in parts])
        weight = np.concatenate([p[1] for p in parts])
        marginal, _, _ = forward_backward(self.state(np.concatenate([with_neighbours(p[0]) for p in parts])), self.edge, sizes)
        starts = np.cumsum(sizes) - sizes
        return np.clip(np.add.reduceat(marginal[:, 1] * weight, starts) / np.add.reduceat(weight, starts), 0, 1)


def window_of(text: str, max_lines: int) -> np.ndarray:
    """Own features of up to ``max_lines`` neighbouring lines of a whole text, from a place that its hash chooses."""
    own = line_features(text)[0]
    spare = len(own) - max_lines
    at = zlib.crc32(text.encode()) % (spare + 1) if spare > 0 else 0
    return own[at : at + max_lines]


def train(rows: DataFrame, *, sample: int = 2000, max_lines: int = 200) -> LineField:
    """Fit on (text, label) rows, label 1 good and 0 bad: about ``sample`` at most of each label.

    A longer document takes part with ``max_lines`` neighbouring lines; the bounds hold the driver's share, two
    labels of ``sample`` documents of ``max_lines`` lines, below 150 MB.
    """

    def features(batches):
        for batch in batches:
            label = batch.column(1).to_pylist()
            for first, texts in text_slices(batch):
                found = [window_of(t, max_lines).reshape(-1).tolist() for t in texts]
                yield pa.RecordBatch.from_arrays([pa.array(label[first : first + len(texts)], pa.int32()), pa.array(found, pa.list_(pa.float32()))], names=["label", "own"])

    rows = rows.where("label in (0, 1)").select("text", F.col("label").cast("int").alias("label"), *(["doc_id"] if "doc_id" in rows.columns else []))
    rows = sampled(rows, "label", sample).select("text", "label")
    found = rows.mapInArrow(features, "label int, own array<float>").toArrow()  # bounded by sample and max_lines
    own = [np.asarray(x, np.float32).reshape(-1, OWN) for x in found.column("own").to_numpy()]
    sizes = np.array([len(x) for x in own], np.int64)
    label = np.repeat(found.column("label").to_numpy().astype(np.int64), sizes)
    x = np.concatenate([with_neighbours(o) for o in own]) if own else np.zeros((0, FEATURES), np.float32)
    return LineField.fit(x, label, sizes)


def scored(docs: DataFrame, field: LineField) -> DataFrame:
    """(doc_id, score) of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(field)

    def score(batches):
        for batch in batches:
            for first, texts in text_slices(batch):
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, len(texts)), pa.array(shared.value.scores(texts))], names=["doc_id", "score"])

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(score, "doc_id bigint, score double")

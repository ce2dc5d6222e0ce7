"""Language identification with bit-sliced Bloom filters of character n-grams.

One filter serves all languages: each of its slots holds a bitmask of languages, and the bitwise AND
of an n-gram's slots gives every language whose n-gram set holds it (or seems to). A text's n-grams
are counted per language bit; a language's false-positive rate (its fill to the power of the number
of slots) is taken out of its count, and the largest corrected count decides.

A language's set holds the n-grams that stand in at least ``min_share`` of its training texts and
whose share is at least ``keep_ratio`` of the largest share that any language has.

Training takes a bounded number of texts of each language (all of a rare one), so that no language gets lost
as the table grows.

Null text, empty text and text without a letter give ``und`` and 0. Ties go to the language with
more training texts, then to the name. A text with letters of which no n-gram is known gets the most
frequent language and score 0. Without training rows all texts are ``und``.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quorumlab.llm.shared import mixed, sampled, spread, staged, text_slices

SIZES = (3, 4)
SLOTS = 3
#: Slots of the filter: 2**18, so a table of 2 MB for up to 64 languages, whatever the corpus.
SLOT_BITS = 18
#: Bits between the parts of an n-gram's hash that give its slots.
STEP_BITS = 20


@lru_cache(maxsize=1)
def letters() -> np.ndarray:
    """Whether a code point is a letter."""
    return np.fromiter((chr(i).isalpha() for i in range(0x110000)), np.bool_, 0x110000)


def ngrams(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hashes, text number of each, whether each text has a letter). Words are framed by one space."""
    lowered = [t.lower() for t in texts]
    joined = " " + " \n ".join(lowered) + " "
    points = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
    word = letters()[points]
    sizes = np.fromiter(map(len, lowered), np.int64, len(texts))
    starts = np.cumsum(sizes + 3) - (sizes + 3) + 1
    number = np.zeros(len(points), np.int32)
    number[starts[1:] - 2] = 1
    number = np.cumsum(number, dtype=np.int32)
    has = np.zeros(len(texts), bool)
    has[number[word]] = True
    keep = word.copy()
    keep[1:] |= word[:-1]  # one space after a word
    keep[:-1] |= word[1:]  # and one before it
    symbols = np.where(word, points, 32)[keep].astype(np.uint64)
    number, word = number[keep], word[keep]
    hashes, owners = [], []
    for size in SIZES:
        n = len(symbols) - size + 1
        if n <= 0:
            continue
        h = np.zeros(n, np.uint64)
        for k in range(size):
            h = h * np.uint64(0x100000001B3) + symbols[k : k + n]
        inside = np.ones(n, bool)
        for k in range(1, size - 1):
            inside &= word[k : k + n]  # spaces only at the ends: an n-gram stays within a word
        inside &= number[:n] == number[size - 1 :]
        hashes.append(mixed(h[inside] + np.uint64(size)))
        owners.append(number[:n][inside])
    if not hashes:
        return np.empty(0, np.uint64), np.empty(0, np.int32), has
    return np.concatenate(hashes), np.concatenate(owners), has


def slots(h: np.ndarray) -> list[np.ndarray]:
    low = np.uint64((1 << SLOT_BITS) - 1)
    return [((h >> np.uint64(i * STEP_BITS)) & low).astype(np.int64) for i in range(SLOTS)]


@dataclass
class LanguageModel:
    languages: list[str]  # most training texts first
    tables: np.ndarray  # (ceil(languages / 64), 2**SLOT_BITS) masks
    false_rate: np.ndarray

    def counts(self, h: np.ndarray, owner: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        """(n-grams of each text, corrected counts per text and language)."""
        total = np.bincount(owner, minlength=n).astype(float)
        hits = np.zeros((n, len(self.languages)))
        at = slots(h)
        for part, table in enumerate(self.tables):
            mask = table[at[0]] & table[at[1]] & table[at[2]]
            for i in range(part * 64, min(len(self.languages), part * 64 + 64)):
                hits[:, i] = np.bincount(owner[(mask >> np.uint64(i % 64)) & np.uint64(1) == 1], minlength=n)
        return total, np.maximum(0, hits - total[:, None] * self.false_rate) / (1 - self.false_rate)

    def predict(self, texts: list[str]) -> tuple[list[str], np.ndarray]:
        h, owner, has = ngrams(texts)
        if not self.languages:
            return ["und"] * len(texts), np.zeros(len(texts))
        _, counts = self.counts(h, owner, len(texts))
        best = counts.argmax(axis=1)
        score = counts[np.arange(len(texts)), best] / np.maximum(counts.sum(axis=1), 1e-12)
        return [self.languages[b] if ok else "und" for b, ok in zip(best.tolist(), has.tolist(), strict=True)], np.where(has, np.clip(score, 0, 1), 0.0)


def train(rows: DataFrame, *, sample: int = 2000, min_share: float = 0.004, keep_ratio: float = 0.3) -> LanguageModel:
    """Fit on (text, lang) rows with non-null lang, about ``sample`` of each language at most (a fixed bound).

    A column ``doc_id`` only spreads the sample, so that copies of a text are not all chosen together.
    """
    rows = rows.where("lang is not null").select("text", "lang", *(["doc_id"] if "doc_id" in rows.columns else []))
    rows = staged(sampled(rows, "lang", sample).select("text", "lang"), "language-sample")
    rows = spread(rows)
    sizes = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    languages = sorted(sizes, key=lambda x: (-sizes[x], x))
    width = (len(languages) + 63) // 64
    tables = np.zeros((max(1, width), 1 << SLOT_BITS), np.uint64)
    if languages:

        def presence(batches):
            for batch in batches:
                names = batch.column(1).to_pylist()
                for first, texts in text_slices(batch):
                    h, owner, _ = ngrams(texts)
                    code = {x: i for i, x in enumerate(languages)}
                    lang = np.array([code[x] for x in names[first : first + len(texts)]])
                    order = np.lexsort((owner, h))
                    h, owner = h[order], owner[order]
                    fresh = np.ones(len(h), bool)
                    fresh[1:] = (h[1:] != h[:-1]) | (owner[1:] != owner[:-1])
                    h, of = h[fresh], lang[owner[fresh]]  # each n-gram once for each text
                    for i in np.unique(lang):
                        gram, n = np.unique(h[of == i], return_counts=True)
                        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(gram), i, np.int32)), pa.array(gram.view(np.int64)), pa.array(n.astype(np.int64))], names=["lang", "gram", "n"])

        found = rows.mapInArrow(presence, "lang int, gram bigint, n bigint").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
        share = F.col("n") / F.element_at(F.array(*(F.lit(float(sizes[x])) for x in languages)), F.col("lang") + 1)
        # an n-gram of one text alone counts only where the language has no other text
        found = found.withColumn("share", share).where(((F.col("n") >= 2) | (F.col("share") == 1)) & (F.col("share") >= min_share))
        top = found.groupBy("gram").agg(F.max("share").alias("top"))
        kept = found.join(top, "gram").where(F.col("share") >= keep_ratio * F.col("top"))
        low = (1 << SLOT_BITS) - 1
        slot = F.explode(F.array(*(F.shiftrightunsigned("gram", i * STEP_BITS).bitwiseAND(F.lit(low)) for i in range(SLOTS))))
        masks = kept.select((F.col("lang") / 64).cast("int").alias("part"), F.expr("shiftleft(1L, lang % 64)").alias("bit"), slot.alias("slot"))
        # at most 2**SLOT_BITS rows for every 64 languages
        for r in masks.groupBy("part", "slot").agg(F.bit_or("bit").alias("mask")).collect():
            tables[r["part"], r["slot"]] = np.uint64(r["mask"] & 0xFFFFFFFFFFFFFFFF)
    fill = np.array([((tables[i // 64] >> np.uint64(i % 64)) & np.uint64(1)).mean() for i in range(len(languages))])
    return LanguageModel(languages, tables, fill**SLOTS)


def identify(docs: DataFrame, model: LanguageModel) -> DataFrame:
    """(doc_id, lang_pred, score) of every row of ``docs``."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def predict(batches):
        for batch in batches:
            for first, texts in text_slices(batch, limit=400_000):
                names, score = shared.value.predict(texts)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, len(texts)), pa.array(names, pa.string()), pa.array(score)], names=["doc_id", "lang_pred", "score"])

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(predict, "doc_id bigint, lang_pred string, score double")

"""Quality rules whose thresholds follow each language and source.

Word and line counts are exact and per document. Their ratios go into mergeable quantile sketches per
(language, source): counts of values by bins whose bounds grow by ``GROWTH``, so a quantile is within one
per cent of its value, sketches merge by adding counts, and two runs agree. Fences around the middle half of
a group's values replace fixed cutoffs. A group's quartiles are drawn towards those of its language, and a
language's towards those of all rows, with the weight of ``prior`` rows, so that small groups follow the
larger ones without a jump. The table of fences (a row per language and source) is then joined to the
documents.

A document is rejected if it fails a base rule (fewer than 50 words, or more than half of its words in
repeated three-word windows) or lies beyond a fence. Null and empty texts have no words and fail the
base rule. Null languages and sources are groups of their own. Empty tables give no rows.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quorumlab.llm.shared import ASCII_SPACE, staged, text_slices

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_lines", "n_repeat_words")
#: Prefix of the columns that this module adds, so that columns of the documents do not clash.
OWN = "__rules_"
SYMBOLS = "#*$%&|<>"
#: Ratio, the least width that its middle half counts as, and whether small values are rejected too.
RATIOS = (("word_length", 0.5, True), ("symbols", 0.02, False), ("dup_lines", 0.1, False), ("repeats", 0.1, False))
QUARTERS = (0.25, 0.75)
#: Ratio of a bin's bounds, and the bin of 0.
GROWTH, LOWEST = 1.02, -(1 << 20)


def repeated_words(words: list[bytes]) -> int:
    """Words in three-word windows that stand twice or more in the text."""
    windows = list(zip(words, words[1:], words[2:], strict=False))
    if len(set(windows)) == len(windows):
        return 0
    seen: dict[tuple, int] = {}
    twice = bytearray(len(words))
    for i, w in enumerate(windows):
        j = seen.setdefault(w, i)
        if j != i:
            twice[j : j + 3] = twice[i : i + 3] = b"\1\1\1"
    return twice.count(1)


def measure(text: str) -> tuple[int, ...]:
    words = text.encode().split()  # bytes split at ASCII white space only
    lines = [x for x in text.split("\n") if x.strip(ASCII_SPACE)]
    return (
        len(words),
        len(text) - sum(map(text.count, ASCII_SPACE)),
        sum(map(text.count, SYMBOLS)),
        len(lines) - len(set(lines)),
        len(lines),
        repeated_words(words),
    )


def measured(docs: DataFrame, columns: list[str]) -> DataFrame:
    """``columns`` of ``docs`` and the counts of each whole text."""

    def count(batches):
        for batch in batches:
            kept = [batch.schema.get_field_index(c) for c in columns]
            for first, texts in text_slices(batch):
                found = np.array([measure(t) for t in texts], np.int64).reshape(-1, len(COUNTS))
                yield pa.RecordBatch.from_arrays([*(batch.column(i).slice(first, len(texts)) for i in kept), *(pa.array(found[:, i]) for i in range(len(COUNTS)))], names=[*columns, *(f"{OWN}{c}" for c in COUNTS)])

    needed = docs.select(*columns, *(["text"] if "text" not in columns else []))
    fields = ", ".join([*(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in columns), *(f"{OWN}{c} bigint" for c in COUNTS)])
    return needed.mapInArrow(count, fields)


def ratios() -> dict[str, Column]:
    words = F.greatest(F.col(OWN + "n_words"), F.lit(1)).cast("double")
    return {
        "word_length": F.col(OWN + "word_chars") / words,
        "symbols": F.col(OWN + "n_symbols") / words,
        "dup_lines": F.col(OWN + "n_dup_lines") / F.greatest(F.col(OWN + "n_lines"), F.lit(1)),
        "repeats": F.col(OWN + "n_repeat_words") / words,
    }


def base_failed() -> Column:
    return (F.col(OWN + "n_words") < 50) | (100 * F.col(OWN + "n_repeat_words") > 50 * F.col(OWN + "n_words"))


def bin_of(value: Column) -> Column:
    """Bin of a value; 0 is a bin of its own below all others."""
    return F.when(value > 0, F.ceil(F.log(value) / F.lit(math.log(GROWTH)))).otherwise(F.lit(LOWEST)).cast("int")


def value_of(place: Column) -> Column:
    """The middle of a bin."""
    return F.when(place > LOWEST, F.lit(2 / (GROWTH + 1)) * F.pow(F.lit(GROWTH), place)).otherwise(0.0)


def sketched(counted: DataFrame) -> DataFrame:
    """(lang, source, ratio, bin, n): the sketches over the rows that pass the base rules.

    A group has one row for each of at most some thousand bins of a ratio, whatever its size.
    """
    each = F.array(*(F.struct(F.lit(k).alias("ratio"), bin_of(v).alias("bin")) for k, v in ratios().items()))
    rows = counted.where(~base_failed()).select("lang", "source", F.explode(each).alias("r")).select("lang", "source", "r.*")
    return rows.groupBy("lang", "source", "ratio", "bin").agg(F.count(F.lit(1)).alias("n"))


def quartiles(sketches: DataFrame, keys: list[str], suffix: str) -> DataFrame:
    """(keys, ratio, n, q1, q3) of the sketches merged by ``keys``: the first bins that hold a quarter and three quarters."""
    merged = sketches.groupBy(*keys, "ratio", "bin").agg(F.sum("n").alias("n"))
    whole = Window.partitionBy(*keys, "ratio")
    below, total = F.sum("n").over(whole.orderBy("bin")), F.sum("n").over(whole)
    placed = merged.select(*keys, "ratio", "bin", below.alias("below"), total.alias("total"))
    edges = [F.min(F.when(F.col("below") >= q * F.col("total"), F.col("bin"))) for q in QUARTERS]
    return placed.groupBy(*keys, "ratio").agg(F.max("total").alias(f"n{suffix}"), *(value_of(e).alias(f"q{i}{suffix}") for i, e in enumerate(edges)))


def fences(counted: DataFrame, *, prior: int = 20, reach: float = 4.0) -> DataFrame:
    """(lang, source, low and high of each ratio), a row for each language and source."""
    sketches = staged(sketched(counted), "rule-sketches")
    own, by_lang, overall = (quartiles(sketches, keys, x) for keys, x in ((["lang", "source"], ""), (["lang"], "_lang"), ([], "_all")))
    by_lang = by_lang.withColumnRenamed("lang", "of_lang").withColumnRenamed("ratio", "of_ratio")
    whole = own.join(by_lang, F.col("lang").eqNullSafe(F.col("of_lang")) & (F.col("ratio") == F.col("of_ratio"))).join(overall, "ratio")

    def drawn(own: Column, n: Column, towards: Column) -> Column:
        return (n * own + prior * towards) / (n + prior)

    edge = [drawn(F.col(f"q{i}"), F.col("n"), drawn(F.col(f"q{i}_lang"), F.col("n_lang"), F.col(f"q{i}_all"))) for i in range(2)]
    whole = whole.select("lang", "source", "ratio", edge[0].alias("q1"), edge[1].alias("q3"))
    out = []
    for k, width, both in RATIOS:
        spread = reach * F.greatest(F.col("q3") - F.col("q1"), F.lit(width))
        out.append(F.max(F.when(F.col("ratio") == k, F.col("q3") + spread)).alias(f"{OWN}high_{k}"))
        if both:
            out.append(F.max(F.when(F.col("ratio") == k, F.col("q1") - spread)).alias(f"{OWN}low_{k}"))
    return whole.groupBy("lang", "source").agg(*out)


def beyond() -> Column:
    """Whether a row with its group's fences lies outside one; without fences it does not."""
    outside = F.lit(False)
    for k, value in ratios().items():
        outside = outside | F.coalesce(value > F.col(f"{OWN}high_{k}"), F.lit(False))
        if dict((n, b) for n, _, b in RATIOS)[k]:
            outside = outside | F.coalesce(value < F.col(f"{OWN}low_{k}"), F.lit(False))
    return outside


def with_fences(counted: DataFrame, table: DataFrame) -> DataFrame:
    table = table.withColumnsRenamed({"lang": f"{OWN}lang", "source": f"{OWN}source"})
    same = F.col("lang").eqNullSafe(F.col(f"{OWN}lang")) & F.col("source").eqNullSafe(F.col(f"{OWN}source"))
    return counted.join(table, same, "left")


def verdicts(docs: DataFrame, *, prior: int = 20, reach: float = 4.0) -> DataFrame:
    """Per row: doc_id, the counts, base_failed and kept."""
    counted = staged(measured(docs, ["doc_id", "lang", "source"]), "rule-counts")
    table = staged(fences(counted, prior=prior, reach=reach), "rule-fences")
    return with_fences(counted, table).select(
        F.col("doc_id").cast("bigint").alias("doc_id"),
        *(F.col(f"{OWN}{c}").alias(c) for c in COUNTS if c != "n_lines"),
        base_failed().alias("base_failed"),
        (~base_failed() & ~beyond()).alias("kept"),
    )


def kept_documents(docs: DataFrame, *, prior: int = 20, reach: float = 4.0) -> DataFrame:
    """The rows of ``docs`` that the rules keep, with their columns."""
    counted = staged(measured(docs, docs.columns), "rule-counts")  # texts are measured once
    table = staged(fences(counted, prior=prior, reach=reach), "rule-fences")
    return with_fences(counted, table).where(~base_failed() & ~beyond()).select(*docs.columns)

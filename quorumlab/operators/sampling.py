"""Order-stable samples: quotas and predicates as given, the order inside a bucket by md5(seed, id).

A shuffled sample depends on one process and its random state; here the order is a hash, so the same
rows come out under any partitioning. The selections between cuts are bounded by the sample size.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quorumlab.sources.files import staged


def order_key(seed: int, key: str = "task_id") -> Column:
    return F.md5(F.concat(F.lit(f"{seed}:"), F.col(key)).cast("binary"))


def first_by_key(rows: DataFrame, n: int) -> DataFrame:
    """The n rows of the smallest keys, without sorting them all in one place."""
    return rows.orderBy("order_key").limit(max(0, n))


def balanced(rows: DataFrame, label: str, labels: tuple[str, ...], size: int, seed: int) -> DataFrame:
    """Equal quotas per label, the remainder to the first labels; what is short is filled from the rest."""
    rows = staged(rows.withColumn("order_key", order_key(seed)), "pool")  # every label reads it
    present = {r[label] for r in rows.select(label).where(F.col(label).isin(*labels)).distinct().collect()}  # the given labels at most
    names = [x for x in labels if x in present]
    base, extra = divmod(size, max(1, len(names)))
    # a top-n for each label: every task keeps its own n, and only these meet
    parts = [first_by_key(rows.where(F.col(label) == name), base + (i < extra)) for i, name in enumerate(names)]
    chosen = staged(reduce(DataFrame.unionByName, parts, rows.limit(0)).withColumn("reason", F.lit("quota")), "quota")
    short = size - chosen.count()
    fill = first_by_key(rows.join(chosen.select("task_id"), "task_id", "left_anti"), short).withColumn("reason", F.lit("fill"))
    return chosen.unionByName(fill)


def targeted(rows: DataFrame, buckets: list[tuple[str, float, Column]], size: int, seed: int) -> DataFrame:
    """Ordered buckets with shares of the sample; the last takes what is left, then the rest fills up."""
    rows = staged(rows.withColumn("order_key", order_key(seed)), "pool")  # every bucket reads it
    chosen, taken = None, 0
    for i, (reason, ratio, predicate) in enumerate(buckets):
        target = size - taken if i == len(buckets) - 1 else int(size * ratio)
        open_rows = rows if chosen is None else rows.join(chosen.select("task_id"), "task_id", "left_anti")
        part = first_by_key(open_rows.where(predicate), target).withColumn("reason", F.lit(reason))
        chosen = part if chosen is None else chosen.unionByName(part)
        chosen = staged(chosen, "targeted")  # at most ``size`` rows
        taken = chosen.count()
    fill = first_by_key(rows.join(chosen.select("task_id"), "task_id", "left_anti"), size - taken).withColumn("reason", F.lit("fill_remaining"))
    return chosen.unionByName(fill)


def negative(rows: DataFrame, score: str, size: int, seed: int, most: float = 0.16) -> DataFrame:
    """Of the 2n lowest-scoring unmatched rows, n by hash."""
    low = rows.where((F.col("survival_label") == "not_found") & (F.col(score) <= most)).orderBy(score, "task_id").limit(2 * size)
    return first_by_key(low.withColumn("order_key", order_key(seed)), size)


def stratified(rows: DataFrame, stratum: str, scarce: tuple[str, ...], unclear: str, by: str, size: int, seed: int) -> DataFrame:
    """All rows of scarce classes, two unclear ones, the rest round robin over ``by``."""
    rows = rows.withColumn("order_key", order_key(seed))
    tier = F.when(F.col(stratum).isin(*scarce), 0).when(F.col(stratum) == unclear, 1).otherwise(2)
    rows = rows.withColumn("tier", tier)
    few = first_by_key(rows.where("tier = 1"), 2).withColumn("turn", F.lit(0))
    all_scarce = rows.where("tier = 0").withColumn("turn", F.lit(0))
    # no class can give more than ``size`` rows: a rank below a literal is cut in every task before rows meet
    rank = F.row_number().over(Window.partitionBy(by).orderBy("order_key"))
    others = rows.where("tier = 2").withColumn("turn", rank).where(F.col("turn") <= size)
    return all_scarce.unionByName(few).unionByName(others).orderBy("tier", "turn", by, "order_key").limit(size)

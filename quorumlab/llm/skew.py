"""Joins whose hot keys are dealt to several tasks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A key is hot with over 1 / SHARE of all rows, so there are fewer than SHARE of them, and over LEAST rows.
SHARE, LEAST = 1024, 1000


def hot_keys(counts: DataFrame, keys: list[str], n: str = "n") -> DataFrame:
    """(keys, parts): the hot keys of ``counts`` (keys, n) and how many parts each is dealt to; fewer than SHARE rows,
    to be broadcast."""
    total = counts.agg(F.coalesce(F.sum(n), F.lit(0))).first()[0]
    most = max(total // SHARE, LEAST)
    return F.broadcast(counts.where(F.col(n) > most).select(*keys, F.ceil(F.col(n) / most).cast("int").alias("parts")))


def joined_salted(rows: DataFrame, named: DataFrame, keys: list[str], counts: DataFrame, n: str = "n") -> DataFrame:
    """``rows`` joined with ``named`` on ``keys`` (neither null nor many rows of ``named`` for a key).

    Rows of a hot key are dealt to its parts by a hash of the row, and each part gets its own copy of the key's rows of
    ``named``; ``counts`` says how many ``rows`` a key has."""
    hot = hot_keys(counts, keys, n)
    part = F.pmod(F.xxhash64(*rows.columns), F.coalesce("parts", F.lit(1))).cast("int")
    left = rows.join(hot, keys, "left").withColumn("part", part).drop("parts")
    right = named.join(hot, keys, "left").withColumn("part", F.explode(F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1))).drop("parts")
    return left.join(right, [*keys, "part"]).drop("part")


def joined_in_cells(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """``left`` joined with ``right`` on ``keys``, both sides possibly with many rows of a key.

    The rows that a hot key has on each side are cut into parts, and each pair of parts meets in its own task; so no
    task gets more than LEAST rows (or 1 / SHARE of all) of either side."""
    sides = []
    for name, df in (("l", left), ("r", right)):
        hot = hot_keys(df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")), keys)
        sides.append((df, hot.withColumnRenamed("parts", f"parts_{name}")))
    (left, of_left), (right, of_right) = sides
    one = F.lit(1)

    def cells(df: DataFrame, own: str, other: str) -> DataFrame:
        df = df.join(of_left, keys, "left").join(of_right, keys, "left")
        mine = F.pmod(F.xxhash64(*(c for c in df.columns if not c.startswith("parts_"))), F.coalesce(f"parts_{own}", one)).cast("int")
        every = F.explode(F.sequence(F.lit(0), F.coalesce(f"parts_{other}", one) - 1))
        return df.withColumn(f"part_{own}", mine).withColumn(f"part_{other}", every).drop("parts_l", "parts_r")

    return cells(left, "l", "r").join(cells(right, "r", "l"), [*keys, "part_l", "part_r"]).drop("part_l", "part_r")

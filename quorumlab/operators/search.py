"""Substring search over an index of trigrams, with pages that follow a key instead of an offset."""

from __future__ import annotations

import base64
import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quorumlab.sources.files import shared_folder

#: Fields that are searched, and the mark that fills up the grams of a field's end.
FIELDS, END = ("title", "paper_id", "forum_id"), "\x00"


def grams_of(text: Column) -> Column:
    """Distinct pieces of three characters of a lower-cased text, its end filled up: every character begins one."""
    low = F.concat(F.lower(F.coalesce(text, F.lit(""))), F.lit(END * 2))
    every = F.transform(F.sequence(F.lit(1), F.length(low) - 2), lambda i: F.substring(low, i, F.lit(3)))
    return F.array_distinct(F.when(F.length(low) > 2, every).otherwise(F.array().cast("array<string>")))


def trigram_index(papers: DataFrame, path: str | None = None) -> DataFrame:
    """(gram, paper_id) of every searched field, written in the order of grams, so that a reader skips to those it needs.

    ``papers``: paper_id, forum_id, title and further columns. A field's gram counts once for a paper."""
    path = path or shared_folder(papers.sparkSession, "trigrams")
    grams = F.array_distinct(F.concat(*(grams_of(F.col(f)) for f in FIELDS)))
    rows = papers.select("paper_id", F.explode(grams).alias("gram"))
    rows.repartitionByRange("gram", "paper_id").sortWithinPartitions("gram", "paper_id").write.option("compression", "zstd").parquet(path)
    return papers.sparkSession.read.schema("paper_id string, gram string").parquet(path)


def holding(index: DataFrame, needle: str) -> DataFrame:
    """The paper_ids that may hold ``needle``: those with all of its trigrams, or with one that begins with it."""
    low = needle.lower()
    if len(low) < 3:
        return index.where(F.col("gram").startswith(low)).select("paper_id").distinct()
    wanted = sorted({low[i : i + 3] for i in range(len(low) - 2)})
    found = index.where(F.col("gram").isin(wanted)).groupBy("paper_id").agg(F.count(F.lit(1)).alias("n"))
    return found.where(F.col("n") == len(wanted)).select("paper_id")


def cursor_of(year: int | None, title: str | None, paper_id: str) -> str:
    return base64.urlsafe_b64encode(json.dumps([year, title, paper_id]).encode()).decode()


def after(cursor: str) -> Column:
    """Rows behind a cursor in the order of year (newest first, none last), title (none first) and id."""
    year, title, paper_id = json.loads(base64.urlsafe_b64decode(cursor))
    y, t = F.col("year"), F.col("title")
    later_title = t.isNotNull() if title is None else t > F.lit(title)
    same_title = t.isNull() if title is None else t == F.lit(title)
    later = later_title | (same_title & (F.col("paper_id") > paper_id))
    return (y.isNull() & later) if year is None else (y < year) | y.isNull() | ((y == year) & later)


def search_papers(papers: DataFrame, index: DataFrame | None, *, needle: str = "", venue: str | None = None, year: int | None = None, limit: int = 20, cursor: str = "") -> tuple[DataFrame, str | None]:
    """A page of up to ``limit`` (1 to 50) papers whose title or ids hold ``needle`` in any case, and the next cursor.

    Newest years come first, then titles, then ids. A page begins behind its cursor's key, so no page reads or sorts
    those before it again as an offset would, and rows that come in meanwhile shift none. The cursor is None at the end.
    """
    rows = papers.where(F.col("venue") == venue) if venue else papers
    rows = rows.where(F.col("year") == year) if year is not None else rows
    needle, limit = needle.strip(), max(1, min(50, limit))
    if needle:
        rows = rows.join(holding(index, needle), "paper_id", "left_semi") if index is not None else rows
        low = F.lit(needle.lower())
        hit = F.lit(False)
        for f in FIELDS:
            hit = hit | F.contains(F.lower(F.coalesce(f, F.lit(""))), low)
        rows = rows.where(hit)  # trigrams may stand apart
    rows = rows.where(after(cursor)) if cursor else rows
    order = [F.desc_nulls_last("year"), F.asc_nulls_first("title"), F.asc("paper_id")]
    page = rows.orderBy(*order).limit(limit + 1).collect()  # 51 rows at most
    found = papers.sparkSession.createDataFrame([(i + 1, *r) for i, r in enumerate(page[:limit])], f"place int, {', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in rows.schema)}")
    last = page[limit - 1] if len(page) > limit else None
    return found, cursor_of(last["year"], last["title"], last["paper_id"]) if last else None

"""Files of notes, records and datasets, read with declared schemas and written by Spark."""

from __future__ import annotations

import functools
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quorumlab.functions import text as T

REPLY = "reply_id string, turn bigint, signer string, invitation string, created_ms bigint, modified_ms bigint, text string"
NOTE = f"id string, forum string, venue string, replies array<struct<{', '.join(f.strip().replace(' ', ': ', 1) for f in REPLY.split(','))}>>"
RECORD = "id string, text string, label string, score double"


def shared_folder(spark: SparkSession, label: str) -> str:
    """A new path in the folder that all machines share (``spark.checkpoint.dir``); a local one on one machine only."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        root = f"file://{tempfile.mkdtemp(prefix='spark-')}"
        spark.conf.set("spark.checkpoint.dir", root)
    return f"{root.rstrip('/')}/{label}-{uuid.uuid4().hex}"


def staged(df: DataFrame, label: str) -> DataFrame:
    """``df`` written as Parquet in the shared folder and read back: computed once, and no lost executor undoes it."""
    path = shared_folder(df.sparkSession, label)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def spread(df: DataFrame, task_bytes: int = 8 << 20) -> DataFrame:
    """``df``, dealt out to all cores if it is too small to fill them (such as a file of one row group)."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return df.repartition(cores) if size < cores * task_bytes else df


def write_records(df: DataFrame, path: str, partitions: tuple[str, ...] = ()) -> str:
    """JSON lines, one file set for each value of ``partitions``."""
    df.write.partitionBy(*partitions).json(path) if partitions else df.write.json(path)
    return path


def read_note_pages(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Notes of the pages that a manifest names, with the page each came from."""
    pages = spark.read.schema(f"notes array<struct<{_fields(NOTE)}>>").json(paths)
    return pages.select(F.inline("notes"), F.input_file_name().alias("page"))


def _fields(schema: str) -> str:
    """Struct fields (name: type) of a column list."""
    out, depth, part = [], 0, ""
    for ch in schema:
        depth += (ch == "<") - (ch == ">")
        if ch == "," and not depth:
            out.append(part)
            part = ""
        else:
            part += ch
    return ", ".join(p.strip().replace(" ", ": ", 1) for p in [*out, part])


def read_records(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """Records from JSON lines (``jsonl``), from JSON files (``json``) or from CSV with a header (``csv``).

    A JSON file is a list of records, or an object with one under ``records``, ``items``, ``data`` or ``examples`` (the
    first of these counts); it may span many lines, and is then one task, as a file without line ends for records has
    no place to be cut. A byte-order mark before JSON is skipped, blank lines too. An object without a list is an error.
    """
    if kind == "csv":
        return spark.read.schema(RECORD).csv(path, header=True, multiLine=True, escape='"')
    if kind == "jsonl":
        lines = spark.read.text(path).select(F.regexp_replace("value", "^\ufeff", "").alias("line")).where(F.trim("line") != "")
        return lines.select(F.inline(F.array(F.from_json("line", RECORD, {"mode": "FAILFAST"}))))
    keys, own = ("records", "items", "data", "examples"), [f.strip().split()[0] for f in RECORD.split(",")]
    lists = ", ".join(f"{k} array<struct<{_fields(RECORD)}>>" for k in keys)
    rows = spark.read.schema(f"{RECORD}, {lists}, _corrupt_record string").json(path, multiLine=True)  # the parser itself skips the mark
    single = F.array(F.struct(*own))
    some = functools.reduce(lambda a, b: a | b, (F.col(c).isNotNull() for c in own))
    none = F.raise_error(F.concat(F.lit(f"no record list in {path}: "), F.coalesce("_corrupt_record", F.lit("")))).cast(f"array<struct<{_fields(RECORD)}>>")
    return rows.select(F.inline(F.coalesce(*keys, F.when(some & F.col("_corrupt_record").isNull(), single), none)))


def flatten_dataset(nested: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(papers, reviews) of nested papers; reviewers are numbered by array position, the last row of an id wins.

    ``nested``: load_order, paper_id, venue, reviews array<struct<review_id, review_text>>.
    """
    papers = nested.groupBy("paper_id").agg(F.max(F.struct("load_order", "venue", F.size("reviews").alias("n_reviews")))["venue"].alias("venue"), F.max(F.struct("load_order", F.size("reviews").alias("n")))["n"].alias("n_reviews"))
    rows = nested.select("load_order", "paper_id", F.posexplode("reviews").alias("pos", "r"))
    rows = rows.select("load_order", "paper_id", (F.col("pos") + 1).alias("reviewer_index"), F.coalesce("r.review_id", F.concat_ws("-r", "paper_id", F.col("pos") + 1)).alias("review_id"), F.col("r.review_text").alias("review_text"))
    last = rows.groupBy("review_id").agg(F.max(F.struct("load_order", "paper_id", "reviewer_index", "review_text")).alias("l"))
    return papers, last.select("review_id", "l.paper_id", "l.reviewer_index", "l.review_text")


def nested_papers(reviews: DataFrame) -> DataFrame:
    """Papers with their reviews in the order of their index, and counts."""
    row = F.struct("reviewer_index", "review_id", "rating_normalized")
    return reviews.groupBy("paper_id").agg(F.sort_array(F.collect_list(row)).alias("reviews"), F.count(F.lit(1)).alias("review_count"))


def works_table(works: DataFrame) -> DataFrame:
    """Bibliographic works with abstracts rebuilt from inverted indexes; untitled or empty ones are dropped, first of an id stays.

    ``works``: ord, work_id, title, inverted map<string, array<int>>.
    """
    words = F.flatten(F.transform(F.map_entries("inverted"), lambda e: F.transform(e["value"], lambda p: F.struct(p.alias("pos"), e["key"].alias("token")))))
    abstract = F.array_join(F.transform(F.array_sort(words), lambda w: w["token"]), " ")
    rows = works.withColumn("abstract", F.coalesce(abstract, F.lit(""))).where((F.trim(F.coalesce("title", F.lit(""))) != "") & (F.col("abstract") != ""))
    first = rows.groupBy("work_id").agg(F.min(F.struct("ord", "title", "abstract")).alias("w"))
    return first.select("work_id", "w.title", "w.abstract", T.stable_id("work", F.col("work_id")).alias("record_id"))

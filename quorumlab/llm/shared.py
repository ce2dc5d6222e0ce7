"""Helpers that the training-data operators share: tables, staged results and text batches."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space, which separates words in every contract of this package.
ASCII_SPACE = " \t\n\x0b\x0c\r"


#: So many distinct values of a column are broadcast with their counts, and no more.
FEW_KINDS = 10_000
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(table(spark, sf_dir, "documents"))


def spread(df: DataFrame, task_bytes: int = 8 << 20) -> DataFrame:
    """``df``, dealt out to all cores if it is too small to fill them (such as a file of one row group)."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return df.repartition(cores) if size < cores * task_bytes else df


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Only a session on one machine that names none gets a temporary folder; elsewhere that is an error.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        folder = f"file://{tempfile.mkdtemp(prefix='spark-')}"
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def new_path(spark: SparkSession, label: str) -> str:
    return f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex}"


def staged(df: DataFrame, label: str, *, row_group: int | None = None) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back: cuts lineage, survives lost executors.

    ``row_group``: bytes of a row group, which bounds what a reader of large rows holds at once.
    """
    spark = df.sparkSession
    path = new_path(spark, label)
    kept = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")  # the shuffle files of this write are not read again
    try:
        writer = df.write.option("compression", "zstd")
        (writer.option("parquet.block.size", str(row_group)) if row_group else writer).parquet(path)
    finally:
        spark.conf.set(CLEANUP, kept)
    return spark.read.schema(df.schema).parquet(path)


def drop_staged(df: DataFrame) -> None:
    """Delete the files of a staged table that no later step reads."""
    jvm = df.sparkSession._jvm
    conf = df.sparkSession._jsparkSession.sessionState().newHadoopConf()
    for folder in {name.rsplit("/", 1)[0] for name in df.inputFiles()}:
        path = jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(conf).delete(path, True)


def unused(df: DataFrame, name: str) -> str:
    """``name``, lengthened until no column of ``df`` has it."""
    while name.lower() in (c.lower() for c in df.columns):
        name += "_"
    return name


def sampled(df: DataFrame, kind: str, rows: int) -> DataFrame:
    """About ``rows`` rows at most of each value of the column ``kind``, chosen by a hash of the whole row.

    All rows of a kind that has no more, so that rare kinds stay whole. One pass over all rows counts them.
    """
    total, of = unused(df, "__total"), unused(df, "__kind")
    sizes = staged(df.groupBy(F.col(kind).alias(of)).agg(F.count(F.lit(1)).alias(total)), "kind-sizes")
    if sizes.count() <= FEW_KINDS:
        sizes = F.broadcast(sizes)  # else the rows are shuffled
    whole = 1 << 40
    chosen = F.pmod(F.xxhash64(*df.columns, F.lit(7)), F.lit(whole)) * F.col(total) < rows * whole
    return df.join(sizes, F.col(kind).eqNullSafe(F.col(of))).where((F.col(total) <= rows) | chosen).select(*df.columns)


def joined_by_hot(rows: DataFrame, named: DataFrame, key: str, counts: DataFrame, share: int = 64) -> DataFrame:
    """``rows`` joined with ``named`` (one row for each ``key``), keys that hold over 1 / ``share`` of all rows apart.

    ``counts``: key, n (rows of it). There are fewer than ``share`` such hot keys, so their rows of ``named`` are
    broadcast and the rows of a hot key stay where they are.
    """
    total = counts.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    hot = F.broadcast(counts.where(F.col("n") * share > total).select(key))  # fewer than ``share`` rows
    few = F.broadcast(named.join(hot, key, "left_semi"))
    return rows.join(few, key).unionByName(rows.join(hot, key, "left_anti").join(named, key))


def crc_fold(column: str, modulus: int):
    """The remainder that decides which labelled rows are held out."""
    return F.crc32(F.col(column).cast("string")) % F.lit(modulus)


def text_slices(batch: pa.RecordBatch, name: str = "text", limit: int = 500_000) -> Iterator[tuple[int, list[str]]]:
    """(first row, texts) of pieces of a batch, each of about ``limit`` bytes at most or one text; null becomes ''."""
    column = batch.column(batch.schema.get_field_index(name))
    sizes = np.zeros(len(column), np.int64)
    if len(column):
        sizes = pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    start, held = 0, 0
    for i, size in enumerate(sizes.tolist()):
        if held and held + size > limit:
            yield start, [t or "" for t in column.slice(start, i - start).to_pylist()]
            start, held = i, 0
        held += size
    if start < len(column):
        yield start, [t or "" for t in column.slice(start).to_pylist()]
    pa.default_memory_pool().release_unused()  # a worker lives on through many tasks


def mixed(h: np.ndarray) -> np.ndarray:
    """Spread 64-bit hashes over all bits."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h ^= h >> np.uint64(29)
    h = h * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(32))


class SpanHash:
    """64-bit hashes of many spans of one array of small numbers, from prefix sums of a polynomial."""

    BASE = 0x9E3779B97F4A7C15
    INVERSE = pow(BASE, -1, 1 << 64)

    def __init__(self) -> None:
        self.up = self.down = np.ones(1, np.uint64)

    def _grow(self, n: int) -> None:
        if len(self.up) >= n:
            return
        size = max(1 << 16, n + n // 4)
        for name, factor in (("up", self.BASE), ("down", self.INVERSE)):
            powers = np.full(size, factor, np.uint64)
            powers[0] = 1
            setattr(self, name, np.multiply.accumulate(powers))

    def __call__(self, values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        self._grow(len(values) + 1)
        v = (values.astype(np.uint64) + np.uint64(1)) * np.uint64(0xD6E8FEB86659FD93)
        v ^= v >> np.uint64(32)
        v *= self.up[: len(values)]
        total = np.zeros(len(values) + 1, np.uint64)
        np.cumsum(v, out=total[1:])
        h = (total[ends] - total[starts]) * self.down[starts]
        return mixed(h + (ends - starts).astype(np.uint64))

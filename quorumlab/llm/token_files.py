"""Token ids as ORC files: integer run-length encoding, row indexes and Bloom filters on doc_id.

Files follow ascending doc_id: the table is range-partitioned and sorted, so file k holds smaller
ids than file k+1 and every stripe a narrow id range. Readers of an id range or of single ids prune
whole files and stripes by their statistics, row groups by the row index and the Bloom filter;
large files are read stripe by stripe in parallel.

Null text counts as empty (its ids are the end id alone). Null doc_ids sort first. Rows that share
a doc_id are kept, in the order of their length and checksum, in the files as in the report. An empty table gives empty files and rows.
"""

from __future__ import annotations

import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quorumlab.llm.encoding import PieceEncoder
from quorumlab.llm.shared import new_path, staged, text_slices

FILE_SCHEMA = "doc_id bigint, ids array<int>"


@lru_cache(maxsize=2)
def encoder(path: str, drops_space: bool) -> PieceEncoder:
    """One per Python worker, so that its pieces serve all tasks."""
    return PieceEncoder(path, drops_space)


def ended_ids(texts: list[str], path: str, drops_space: bool, end_id: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all texts, each followed by ``end_id``, and where each text's ids end."""
    ids, ends = encoder(path, drops_space)(texts)
    return np.insert(ids, ends, end_id).astype(np.int32), ends + np.arange(1, len(ends) + 1)


def sums(values: np.ndarray, offsets: np.ndarray) -> tuple[pa.Array, pa.Array]:
    """(number, CRC-32) of the ids of each list."""
    crc = [zlib.crc32(np.ascontiguousarray(values[a:b], "<u4")) for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
    return pa.array(np.diff(offsets).astype(np.int64)), pa.array(crc, pa.int64())


def encode_documents(docs: DataFrame, tokenizer: str, *, drops_space: bool = True, end_id: int = 2) -> DataFrame:
    """(doc_id, ids, n_tokens, ids_crc32) of every whole text, in the partitioning and order of ``docs``."""

    def encode(batches):
        for batch in batches:
            for first, texts in text_slices(batch):
                ids, ends = ended_ids(texts, tokenizer, drops_space, end_id)
                offsets = pa.array(np.concatenate([[0], ends]).astype(np.int32))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(first, len(texts)), pa.ListArray.from_arrays(offsets, pa.array(ids)), *sums(ids, offsets.to_numpy())],
                    names=["doc_id", "ids", "n_tokens", "ids_crc32"],
                )

    fields = FILE_SCHEMA + ", n_tokens bigint, ids_crc32 bigint"
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(encode, fields)


def write_token_files(docs: DataFrame, path: str, tokenizer: str, *, drops_space: bool = True, end_id: int = 2, stripe_bytes: int = 16 << 20, index_rows: int = 1000) -> str:
    """Encode and write all documents in ascending doc_id order; returns ``path``."""
    dealt = docs.select("doc_id", "text").repartitionByRange("doc_id")
    (
        encode_documents(dealt, tokenizer, drops_space=drops_space, end_id=end_id)
        .sortWithinPartitions("doc_id", "n_tokens", "ids_crc32")
        .select("doc_id", "ids")
        .write.option("orc.compress", "ZSTD")
        .option("orc.stripe.size", str(stripe_bytes))
        .option("orc.row.index.stride", str(index_rows))
        .option("orc.bloom.filter.columns", "doc_id")
        .option("orc.bloom.filter.fpp", "0.01")
        .orc(path)
    )
    return path


def read_token_files(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, ids); filters on doc_id reach the stripes and row groups."""
    return spark.read.schema(FILE_SCHEMA).orc(path)


def describe_token_files(spark: SparkSession, path: str) -> DataFrame:
    """Per document of the files: doc_id, start (ids of all documents before it), n_tokens, ids_crc32."""

    def digest(batches):
        for batch in batches:
            lists = batch.column(1)
            found = sums(lists.values.to_numpy(), lists.offsets.to_numpy())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), *found], names=["doc_id", "file", "n_tokens", "ids_crc32"])

    rows = read_token_files(spark, path).select("doc_id", "ids", F.col("_metadata.file_name").alias("file"))
    rows = staged(rows.mapInArrow(digest, "doc_id bigint, file string, n_tokens bigint, ids_crc32 bigint"), "token-digest")
    files = rows.groupBy("file").agg(F.sum("n_tokens").alias("n"), F.min(F.struct(F.col("doc_id").isNotNull(), "doc_id")).alias("lead"))
    files = files.select("file", F.coalesce(F.sum("n").over(Window.orderBy("lead", "file").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base"))
    within = Window.partitionBy("file").orderBy(F.col("doc_id").asc_nulls_first(), "n_tokens", "ids_crc32").rowsBetween(Window.unboundedPreceding, -1)
    placed = rows.withColumn("within", F.coalesce(F.sum("n_tokens").over(within), F.lit(0)))
    return placed.join(files, "file").select("doc_id", (F.col("base") + F.col("within")).alias("start"), "n_tokens", "ids_crc32")


def token_files_report(docs: DataFrame, tokenizer: str) -> DataFrame:
    spark = docs.sparkSession
    return describe_token_files(spark, write_token_files(docs, new_path(spark, "token-files"), tokenizer))

"""From raw documents to packed token sequences in five stages, each kept as Parquet before the next.

Every stage but the last returns the columns of its documents, whatever their names. Null texts count as empty;
an empty table gives no rows in any stage; rows with a null doc_id are kept or dropped by their text alone.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quorumlab.llm import decontaminate, packing, rules, secrets, simhash
from quorumlab.llm.queries import tokenizer_path
from quorumlab.llm.shared import documents, staged, table

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that the adaptive rules reject: short ones (null and empty texts too), repetitive ones and
    those beyond a fence. Repeated rows share one verdict; a value on a fence stays."""
    return rules.kept_documents(docs)


def simhash_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document, that of the smallest doc_id, of each group of near duplicates: links of the SimHash trie,
    then pairs that only MinHash finds, both checked by whole sets.

    Null, empty and blank texts are one group. Repeated rows stay once, of rows without a doc_id each text once."""
    return simhash.deduplicated(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that hold benchmark passages; without items none goes. Texts without words stay."""
    return decontaminate.clean_documents(docs, table(spark, sf_dir, "benchmark"))


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces every secret by a mark; null texts stay null, every row stays."""
    return secrets.redact(docs, secrets.train(docs))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of token sequences, with their ids; null and empty texts are an end id. The order of ties is free."""
    return packing.pack_documents(docs, tokenizer_path("byte_bpe_50k.json"))


STAGES: list[tuple[str, Stage]] = [
    ("quality_rules", quality_rules),
    ("simhash_dedup", simhash_dedup),
    ("decontamination", decontamination),
    ("secret_scan", secret_scan),
    ("packing", packed),
]

#: Quantile sketches, SimHash and byte-pair encoding have no SQL form.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), name)
    return staged(STAGES[-1][1](spark, docs, sf_dir), STAGES[-1][0])

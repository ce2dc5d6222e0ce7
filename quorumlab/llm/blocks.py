"""A stated set of queries against all rows, block by block, without a join of the two.

Rows are dealt to blocks; every query is sent to every block once. A task reads the rows of its blocks, then the queries
as a stream, so it holds one block and one batch of queries, whatever the size of either table. Nothing is broadcast.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def blocks_for(rows: DataFrame, per_block: int) -> int:
    """So many blocks that none has many more than ``per_block`` rows and all cores have one."""
    return max(-(-rows.count() // per_block), rows.sparkSession.sparkContext.defaultParallelism)


def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, int, pa.RecordBatch]]:
    """(block, kind, rows) of the stretches of one block and kind."""
    for batch in batches:
        keys = pc.add(pc.multiply(batch.column(0), 2), batch.column(1)).to_numpy(zero_copy_only=False)
        starts = [0, *(i for i in range(1, len(keys)) if keys[i] != keys[i - 1]), len(keys)] if len(keys) else []
        for a, z in zip(starts, starts[1:]):
            yield int(keys[a]) >> 1, int(keys[a]) & 1, batch.slice(a, z - a)


def against_blocks(rows: DataFrame, queries: DataFrame, blocks: int, built: Callable, answered: Callable, schema: str) -> DataFrame:
    """``answered(index, batch of queries)`` for every block and query, ``index = built(list of batches of its rows)``.

    ``rows`` has the column ``block`` (0 to ``blocks`` - 1). Blocks without rows answer nothing. Both tables arrive with
    the columns of both, those of the other as nulls."""
    copies = queries.withColumn("block", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(blocks - 1).cast("bigint"))))
    kinds = rows.withColumn("block", F.col("block").cast("bigint")).withColumn("kind", F.lit(0)), copies.withColumn("kind", F.lit(1))
    both = kinds[0].unionByName(kinds[1], allowMissingColumns=True)
    both = both.select("block", "kind", *(c for c in both.columns if c not in ("block", "kind")))

    def work(batches):
        current, held, index = None, [], None
        for block, kind, part in runs(batches):
            if block != current:
                current, held, index = block, [], None
            if kind == 0:
                held.append(part)
            elif held or index is not None:
                if index is None:
                    index, held = built(held), []
                yield from answered(index, part)

    return both.repartition("block").sortWithinPartitions("block", "kind").mapInArrow(work, schema)

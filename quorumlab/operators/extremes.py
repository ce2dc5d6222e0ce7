"""The rows at both ends of each group, kept as small mergeable sets instead of sorted groups."""

from __future__ import annotations

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows that a task holds before it hands them on.
HELD = 50_000


def two_ended(rows: DataFrame, groups: list[str], value: str, ties: list[str], *, lowest: int = 0, highest: int = 0) -> DataFrame:
    """``rows`` of each group with the ``lowest`` smallest and the ``highest`` largest values: columns end and place.

    Ties go by ``ties``, ascending at both ends; rows without a value have no place. Each task keeps what its own rows
    can contribute (so many rows at each end of a group), so groups of any size meet as a few rows of each task and no
    group is sorted whole. A row can be at both ends of a small group.
    """
    schema = rows.schema

    def reduced(held: pd.DataFrame) -> pd.DataFrame:
        low = held.sort_values([value, *ties]).groupby(groups, dropna=False).head(lowest)
        high = held.sort_values([value, *ties], ascending=[False] + [True] * len(ties)).groupby(groups, dropna=False).head(highest)
        return held.loc[low.index.union(high.index)]

    def kept(batches):
        held = None
        for batch in batches:
            part = pa.Table.from_batches([batch]).to_pandas(types_mapper=pd.ArrowDtype)
            part = part[part[value].notna()]
            held = reduced(part if held is None else pd.concat([held, part], ignore_index=True))
            if len(held) > HELD:
                yield from pa.Table.from_pandas(held, batch.schema, preserve_index=False).to_batches()
                held = None
        if held is not None:
            yield from pa.Table.from_pandas(held, batch.schema, preserve_index=False).to_batches()

    few = rows.mapInArrow(kept, schema)
    facts = [c for c in rows.columns if c not in (*groups, value, *ties)]

    def end(sign: int, size: int):
        row = F.struct((sign * F.col(value)).alias("__at"), *ties, F.col(value), *facts)
        return F.slice(F.array_sort(F.collect_list(row)), 1, size)

    ends = {name: end(sign, size) for name, sign, size in (("lowest", 1, lowest), ("highest", -1, highest)) if size}
    both = few.groupBy(*groups).agg(*(column.alias(name) for name, column in ends.items()))
    parts = [both.select(*groups, F.lit(name).alias("end"), F.posexplode(name).alias("place", "r")) for name in ends]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out.select(*groups, "end", (F.col("place") + 1).alias("place"), *(F.col("r")[c].alias(c) for c in (value, *ties, *facts)))

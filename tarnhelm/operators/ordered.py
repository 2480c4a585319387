"""Ordered features per key that survive one key holding most of the rows.

A plain window puts a whole key into one task. Here every key is cut into blocks of its
order column; windows run inside a block, one small row per block carries the block's
totals forward, and an equi-join on (key, block) combines the two.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

BLOCK_ROWS = 65_536


def with_history(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    block: Column,
    lags: dict[str, str] | None = None,
    counts: dict[str, Column] | None = None,
    lasts: dict[str, Column] | None = None,
) -> DataFrame:
    """Add, per row, values of the rows before it in ``order``.

    ``lags``: output -> column of the immediately preceding row.
    ``counts``: output -> condition counted over all preceding rows.
    ``lasts``: output -> last non-null value of an expression over preceding rows.
    ``block`` must be non-decreasing in ``order``.
    """
    lags, counts, lasts = lags or {}, counts or {}, lasts or {}
    keys, order = list(keys), list(order)
    base = df.withColumn("_block", block)
    for out, cond in counts.items():
        base = base.withColumn(f"_c_{out}", cond.cast("bigint"))
    for out, expr in lasts.items():
        base = base.withColumn(f"_v_{out}", expr)

    rank = F.struct(*order)
    parts = [F.count("*").alias("_rows")]
    parts += [F.max_by(src, rank).alias(f"_t_{out}") for out, src in lags.items()]
    parts += [F.sum(f"_c_{out}").alias(f"_t_{out}") for out in counts]
    parts += [
        F.max_by(f"_v_{out}", F.when(F.col(f"_v_{out}").isNotNull(), rank)).alias(f"_t_{out}")
        for out in lasts
    ]
    across = W.partitionBy(*keys).orderBy("_block")
    before = across.rowsBetween(W.unboundedPreceding, -1)
    carried = [F.lag(f"_t_{out}").over(across).alias(f"_p_{out}") for out in lags]
    carried += [
        F.coalesce(F.sum(f"_t_{out}").over(before), F.lit(0)).alias(f"_p_{out}")
        for out in counts
    ]
    carried += [
        F.last(f"_t_{out}", ignorenulls=True).over(before).alias(f"_p_{out}") for out in lasts
    ]
    blocks = base.groupBy(*keys, "_block").agg(*parts).select(*keys, "_block", *carried)

    inside = W.partitionBy(*keys, "_block").orderBy(*order)
    earlier = inside.rowsBetween(W.unboundedPreceding, -1)
    cols = {"_rn": F.row_number().over(inside)}
    for out, src in lags.items():
        cols[f"_w_{out}"] = F.lag(src).over(inside)
    for out in counts:
        cols[f"_w_{out}"] = F.coalesce(F.sum(f"_c_{out}").over(earlier), F.lit(0))
    for out in lasts:
        cols[f"_w_{out}"] = F.last(f"_v_{out}", ignorenulls=True).over(earlier)
    rows = base.withColumns(cols).join(blocks, [*keys, "_block"])
    result = [F.col(c) for c in df.columns]
    for out in lags:
        result.append(
            F.when(F.col("_rn") == 1, F.col(f"_p_{out}")).otherwise(F.col(f"_w_{out}")).alias(out)
        )
    for out in counts:
        result.append((F.col(f"_p_{out}") + F.col(f"_w_{out}")).alias(out))
    for out in lasts:
        result.append(F.coalesce(f"_w_{out}", f"_p_{out}").alias(out))
    return rows.select(*result)

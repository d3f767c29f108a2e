"""Row numbers of tables and large groups, without a task that holds all their rows.

Rows are cut into blocks that keep their order, numbered inside each block, and moved on
by the sizes of the blocks before.  The numbers equal ``row_number`` over the whole group,
so they depend neither on the blocks nor on partitions.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rows of a block, about; a table of fewer rows is one block.
ROWS = 1 << 20
#: Blocks at most: beyond, blocks grow and their sorts spill.
MOST = 4096


def blocks_for(df: DataFrame) -> int:
    return min(MOST, max(1, math.ceil(df.count() / ROWS)))


def digest_block(digest: Column, blocks: int) -> Column:
    """The block of a hexadecimal digest, which is evenly spread: equal ranges of its first 32 bits."""
    if blocks == 1:
        return F.lit(0)
    return F.shiftright(F.conv(F.substring(digest, 1, 8), 16, 10).cast("long") * blocks, 32).cast("int")


def value_block(df: DataFrame, column: str, blocks: int, rows: int | None = None) -> Column:
    """The block of a value of any sortable type, found by bisection between cuts of a sample.

    The sample has about 32 values a block of ``rows``.  It decides how even blocks are and nothing else.
    """
    if blocks == 1:
        return F.lit(0)
    share = min(1.0, 32.0 * blocks / max(df.count() if rows is None else rows, 1))
    seen = sorted(r[0] for r in df.select(column).where(F.col(column).isNotNull()).sample(share, seed=1).collect())
    cuts = sorted({seen[len(seen) * i // blocks] for i in range(1, blocks)}) if seen else []
    if not cuts:
        return F.lit(0)
    at = F.array(*map(F.lit, cuts))
    steps = F.array(*(F.lit(1 << s) for s in reversed(range(len(cuts).bit_length()))))
    return F.aggregate(steps, F.lit(0), lambda low, step: F.when(F.get(at, low + step - 1) <= F.col(column), low + step).otherwise(low))


def _starts(t: DataFrame, by: list[str], sums: dict[str, Column]) -> tuple[DataFrame, Column]:
    """What the blocks before each block add up to, and the condition that joins it to the block's rows."""
    totals = t.groupBy(*by, "_block").agg(*(F.sum(c).alias(f"_sum_{o}") for o, c in sums.items()))
    w = Window.partitionBy(*(by or [F.lit(1)])).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select(*(F.col(c).alias(f"_by{i}") for i, c in enumerate(by)), F.col("_block").alias("_at"), *(F.coalesce(F.sum(f"_sum_{o}").over(w), F.lit(0)).alias(f"_start_{o}") for o in sums))
    same = F.col("_block") == F.col("_at")
    for i, c in enumerate(by):
        same = same & F.col(c).eqNullSafe(F.col(f"_by{i}"))
    return starts, same


def number(df: DataFrame, by: list[str], order: list[str | Column], block: Column, blocks: int, out: str) -> DataFrame:
    """``df`` with ``out``: 1, 2, ... in each group of ``by``; ``block`` must not fall along ``order``."""
    if blocks == 1:
        return df.withColumn(out, F.row_number().over(Window.partitionBy(*(by or [F.lit(1)])).orderBy(*order)).cast("long"))
    t = df.withColumn("_block", block)
    starts, same = _starts(t, by, {"n": F.lit(1)})
    inside = t.withColumn(out, F.row_number().over(Window.partitionBy(*by, "_block").orderBy(*order)))
    return inside.join(starts, same).withColumn(out, F.col(out) + F.col("_start_n")).select(*df.columns, out)


def running(df: DataFrame, by: list[str], order: list[str | Column], sums: dict[str, Column], block: Column, blocks: int) -> DataFrame:
    """``df`` with running sums along ``order`` in each group of ``by``, the row itself included; rows that tie share them.

    ``block`` must not fall along ``order`` and must be the same for rows that tie.
    """
    if blocks == 1:
        w = Window.partitionBy(*(by or [F.lit(1)])).orderBy(*order)
        return df.withColumns({o: F.sum(c).over(w) for o, c in sums.items()})
    t = df.withColumn("_block", block)
    starts, same = _starts(t, by, sums)
    w = Window.partitionBy(*by, "_block").orderBy(*order)
    inside = t.withColumns({o: F.sum(c).over(w) for o, c in sums.items()})
    return inside.join(starts, same).withColumns({o: F.col(o) + F.col(f"_start_{o}") for o in sums}).select(*df.columns, *sums)


def following(df: DataFrame, by: list[str], column: str, block: Column, blocks: int, out: str) -> DataFrame:
    """``df`` with the next value of ``column`` in each group of ``by``, null at the last; ``block`` rises with the column."""
    w = Window.partitionBy(*(by or [F.lit(1)])).orderBy(column)
    if blocks == 1:
        return df.withColumn(out, F.lead(column).over(w))
    t = df.withColumn("_block", block)
    first = t.groupBy(*by, "_block").agg(F.min(column).alias("_first"))
    over = Window.partitionBy(*(by or [F.lit(1)])).orderBy("_block")
    nexts = first.select(*(F.col(c).alias(f"_by{i}") for i, c in enumerate(by)), F.col("_block").alias("_at"), F.lead("_first").over(over).alias("_next"))
    same = F.col("_block") == F.col("_at")
    for i, c in enumerate(by):
        same = same & F.col(c).eqNullSafe(F.col(f"_by{i}"))
    inside = t.withColumn(out, F.lead(column).over(Window.partitionBy(*by, "_block").orderBy(column)))
    return inside.join(nexts, same).withColumn(out, F.coalesce(out, "_next")).select(*df.columns, out)

"""Global order, rank and running totals without a one-task window.

Rows are range-partitioned over the whole sort key, so even a key that holds a
third of the rows is split by the columns behind it.  The part and the place
within it are written down once; ranks and totals then need only the sums of
the parts, of which there are as many as partitions.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from itertools import accumulate

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from capweave.operators.scratch import materialize

_PLACE_BITS = 33  # layout of monotonically_increasing_id: partition above, row below


def ordered(
    df: DataFrame,
    keys: Sequence[str],
    parts: int | None = None,
    then: Callable[[DataFrame], DataFrame] | None = None,
) -> DataFrame:
    """Sort globally; adds ``part`` and ``place`` (0-based within the part).

    The key must be unique, otherwise the place of equal rows is arbitrary.
    ``then`` may add columns that depend on walking each part in order; it runs
    in the task that sorted the part.
    """
    ranged = df.repartitionByRange(parts, *keys) if parts else df.repartitionByRange(*keys)
    marked = ranged.sortWithinPartitions(*keys).withColumn("_at", F.monotonically_increasing_id())
    placed = marked.select(
        *df.columns,
        F.shiftright("_at", _PLACE_BITS).cast("int").alias("part"),
        F.col("_at").bitwiseAND(F.lit((1 << _PLACE_BITS) - 1)).alias("place"),
    )
    return materialize(then(placed) if then else placed, "ordered")


def part_bases(df: DataFrame, amount: Column) -> Column:
    """Expression for the total of ``amount`` over all parts before the row's own.

    Brings one number per part to the driver, never rows.
    """
    totals = sorted((r[0], r[1]) for r in df.groupBy("part").agg(amount).collect())
    if not totals:
        return F.lit(0).cast("bigint")
    sums = [0, *accumulate(total for _, total in totals)]
    size = totals[-1][0] + 1
    by_part = [0] * size
    for (part, _), base in zip(totals, sums):
        by_part[part] = base
    # One string that the optimizer folds into an array literal.
    bases = F.split(F.lit(",".join(map(str, by_part))), ",").cast("array<bigint>")
    return F.element_at(bases, F.col("part") + 1)


def with_rank(placed: DataFrame, name: str = "rank") -> DataFrame:
    """Global 0-based rank of an :func:`ordered` table."""
    return placed.withColumn(name, part_bases(placed, F.count("*")) + F.col("place"))


def with_running_start(placed: DataFrame, size: str, name: str = "start") -> DataFrame:
    """Sum of ``size`` over all rows before each row, in global order."""
    within = Window.partitionBy("part").orderBy("place").rowsBetween(
        Window.unboundedPreceding, Window.currentRow
    )
    before = F.sum(size).over(within) - F.col(size)
    return placed.withColumn(name, part_bases(placed, F.sum(size)) + before)

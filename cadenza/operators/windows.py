"""Windows over long series: a key of any length is many tasks' work.

A window partitioned by the key alone sends all of a hot key to one task. Here a series is cut into cells of
its integer index, and a cell also gets the few rows before it that its first rows look back on, so windows of
a bounded reach see all they need. Running totals are carried on by one row a cell.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W
from pyspark.sql import WindowSpec

from cadenza.runtime import materialise

#: Index values that one cell of a series spans.
CELL = 1 << 16


def numbered_within(df: DataFrame, keys: list[str], order: list[str], name: str, start: int = 0) -> DataFrame:
    """df with consecutive numbers from ``start`` within keys by order: rows are numbered in ranges, whose counts are added up.

    The ranges are stored, since their bounds are sampled and would differ between two evaluations.
    """
    by = [*keys, *order]
    d = df.repartitionByRange(*by).sortWithinPartitions(*by).withColumn("__p", F.spark_partition_id()).withColumn("__m", F.monotonically_increasing_id())
    d = materialise(d, "ranges")
    # a range holds one stretch of a key; the table has a row for each of them
    per = d.groupBy(*keys, "__p").agg(F.count("*").alias("__n"), F.min("__m").alias("__first"))
    before = F.coalesce(F.sum("__n").over(W.partitionBy(*keys).orderBy("__p").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    shift = per.select(*(F.col(k).alias(f"__{k}") for k in keys), F.col("__p").alias("__q"), (before - F.col("__first") + start).alias("__shift"))
    same = F.col("__p") == F.col("__q")
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"__{k}"))
    return d.join(shift, same).withColumn(name, F.col("__m") + F.col("__shift")).drop("__p", "__m", "__q", "__shift", *(f"__{k}" for k in keys))


def over_cells(df: DataFrame, keys: list[str], index: str, before: int, columns: Callable[[WindowSpec], dict[str, Column]], size: int = CELL) -> DataFrame:
    """df with columns(w), for w a window of a series in the order of its index whose frames reach ``before`` rows back at most.

    The index counts the rows of a series without gaps (``numbered_within`` gives one). A row is copied to the next
    cell if that looks back on it, and one shuffle deals rows by key and cell.
    """
    if before >= size:
        raise ValueError("cells must be longer than the rows before them")
    own = F.floor(F.col(index) / size)
    last = F.pmod(F.col(index), F.lit(size)) >= size - before
    d = df.withColumn("__own", own).withColumn("__cell", F.explode(F.when(last, F.array(own, own + 1)).otherwise(F.array(own))))
    w = W.partitionBy(*keys, "__cell").orderBy(index)
    return d.withColumns(columns(w)).filter("__own = __cell").drop("__own", "__cell")

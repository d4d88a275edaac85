"""Exact ranks, quantiles and counts of many groups, by range partitions: no group passes one task or one buffer.

Values are dealt into range partitions by group, value and what tells equal values apart, so a partition holds a stretch of
the order of all groups and ties do not gather. A value's rank is its place in the partition's part of its group, plus what
earlier partitions hold of the group; those sizes are one row for each partition and each group.
"""

from __future__ import annotations

from math import floor

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import written


def ranked(values: DataFrame, keys, column: str, apart=(), counted: Column | None = None) -> DataFrame:
    """values (keys, column, apart) with n, the size of the group, and at: how many rows of the group come before.

    With counted, n and at are numbers of rows for which it is true. apart: columns that tell rows of a group with the same
    value apart and put them in order; of rows that nothing tells apart any may be first.
    """
    keys, order = list(keys), [column, *apart]
    one = F.lit(1) if counted is None else F.when(counted, 1).otherwise(0)
    dealt = written(values.repartitionByRange(*keys, *order).select("*", F.spark_partition_id().alias("_part"), one.alias("_one")), "dealt")
    sizes = dealt.groupBy("_part", *keys).agg(F.sum("_one").alias("_here"))
    by_group = Window.partitionBy(*keys)  # one row a partition
    before = sizes.select("_part", *keys, (F.sum("_here").over(by_group.orderBy("_part")) - F.col("_here")).alias("_before"), F.sum("_here").over(by_group).alias("n"))
    within = F.sum("_one").over(Window.partitionBy("_part", *keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    placed = dealt.withColumn("_at", within - F.col("_one")).join(before, ["_part", *keys])
    return placed.withColumn("at", F.col("_at") + F.col("_before")).drop("_part", "_one", "_here", "_before", "_at")


def at_positions(ranks: DataFrame, keys, column: str, positions: list[float]) -> DataFrame:
    """(keys, q): the type-7 quantile of each group of ranked values at each position; positions ascend from 0 to 1.

    A value serves the positions whose two neighbours in the order include it; few values of a group serve any. Which ones
    those may be is looked up by the value's own place, so a value costs the same however many positions there are.
    """
    keys, m = list(keys), len(positions) + 1
    if positions != sorted(positions):
        raise ValueError("positions must ascend")
    literal = lambda values, mark="": F.expr(f"array({', '.join(f'{v!r}{mark}' for v in values)})")
    # Bucket b holds the positions from b / m on; before it begin[b] positions.
    begin = [sum(floor(p * m) < b for p in positions) for b in range(m + 2)]
    last = (F.col("n") - 1).cast("double")
    bucket = lambda at, off, other: F.coalesce(F.floor(F.try_divide(at * F.lit(float(m)), last) + F.lit(off)), F.lit(other)).cast("int")
    first = F.get(literal(begin), F.greatest(F.lit(0), bucket(F.col("at") - 1, -1e-6, 0)))
    end = F.get(literal(begin), F.least(F.lit(m), bucket(F.col("at") + 1, 1e-6, m)) + 1)
    may = F.slice(literal(range(m - 1)), first + 1, end - first)
    h = lambda i: last * F.get(literal(positions, "D"), i)
    low = lambda i: F.floor(h(i)).cast("long")
    part = lambda i: h(i) - F.floor(h(i))
    near = F.filter(may, lambda i: F.col("at").between(low(i), low(i) + 1))
    weighed = F.transform(near, lambda i: F.struct(i.alias("i"), (F.when(low(i) == F.col("at"), 1.0 - part(i)).otherwise(part(i)) * F.col(column)).alias("v")))
    each = ranks.select(*keys, F.explode(weighed).alias("e")).groupBy(*keys, "e.i").agg(F.sum("e.v").alias("v"))
    return each.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "v"))), lambda x: x["v"]).alias("q"))

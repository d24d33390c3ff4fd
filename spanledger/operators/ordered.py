"""Ordered folds over groups of any size: a group is cut into ranges of its order, and what a range needs of those before it is carried.

A window over a group runs in one task. Here rows are range-partitioned by group and order, windows run within a group's slice of a
partition, and only groups that reach over a partition's end (one at each end) pass on a row of what they held so far.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from ..session import materialize, shuffle_partitions

SLICE = "_slice"


class Sliced:
    """rows in order within groups. keys may be null; order should be unique within a group, as ties have no defined order.

    rows: the frame to build on, with a column _slice; its windows are within() and so_far(). carry() brings what came before.
    """

    def __init__(self, rows: DataFrame, keys: list[str], order: list[str], parts: int | None = None):
        self.keys, self.order = keys, order
        laid = rows.repartitionByRange(parts or shuffle_partitions(rows.sparkSession), *keys, *order)
        self.rows = materialize(laid.withColumn(SLICE, F.spark_partition_id()), "sliced")

    def within(self) -> WindowSpec:
        return Window.partitionBy(*self.keys, SLICE).orderBy(*self.order)

    def so_far(self) -> WindowSpec:
        return self.within().rowsBetween(Window.unboundedPreceding, 0)

    def carry(self, rows: DataFrame, held: dict[str, tuple[Column, str]]) -> DataFrame:
        """rows, which descend from self.rows, with a column for each of held: what the group's earlier slices come to.

        held is name: (aggregate over a slice, how slices combine: sum, first or last; the latter two skip nulls). The value is null (0 for
        sum) where there is nothing before.
        """
        per = rows.groupBy(*self.keys, SLICE).agg(*(a.alias(n) for n, (a, _) in held.items()))
        cut = materialize(per.groupBy(*self.keys).agg(F.count(F.lit(1)).alias("_n"), F.collect_list(F.struct(SLICE, *held)).alias("_s")).where("_n > 1").select(*self.keys, F.explode("_s").alias("_s")).select(*self.keys, "_s.*"), "carried")
        before = Window.partitionBy(*self.keys).orderBy(SLICE).rowsBetween(Window.unboundedPreceding, -1)
        how = {"sum": lambda c: F.coalesce(F.sum(c).over(before), F.lit(0)), "first": lambda c: F.first(c, ignorenulls=True).over(before), "last": lambda c: F.last(c, ignorenulls=True).over(before)}
        named = cut.select(*(F.col(k).alias(f"_k_{k}") for k in self.keys), F.col(SLICE).alias("_k_slice"), *(how[kind](n).alias(n) for n, (_, kind) in held.items()))
        same = reduce(lambda a, b: a & b, (F.col(k).eqNullSafe(F.col(f"_k_{k}")) for k in self.keys), F.col(SLICE) == F.col("_k_slice"))
        # At most two groups a partition are cut, one at each end: a row for each of those slices.
        out = rows.join(F.broadcast(named), same, "left").drop("_k_slice", *(f"_k_{k}" for k in self.keys))
        return out.withColumns({n: F.coalesce(F.col(n), F.lit(0)) for n, (_, kind) in held.items() if kind == "sum"})


def numbered(rows: DataFrame, keys: list[str], order: list[str], name: str = "n") -> DataFrame:
    """rows with their place within the group, from 1."""
    s = Sliced(rows, keys, order)
    out = s.carry(s.rows, {"_before": (F.count(F.lit(1)), "sum")})
    return out.withColumn(name, F.row_number().over(s.within()) + F.col("_before")).drop("_before", SLICE)

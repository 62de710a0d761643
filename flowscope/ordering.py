"""Running sums in the order of a table that is as large as it likes, also where one group has most of the rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from .store import fresh, staged


def running_sums(rows: DataFrame, group: list[str], order: dict[str, bool], values: dict[str, str]) -> DataFrame:
    """``rows`` with the sum of each value (new column: value) over the rows of its group up to its own, by ``order`` (column: descending).

    Rows are range-partitioned by group and order; each part of a group is summed by itself, and the sums of the group's earlier parts (a row for each part) are
    added. So no task holds a group. Rows of equal place have any order among them. Null groups are one group.
    """
    part = fresh("part", [*rows.columns, *values])
    keys = [*[F.col(g) for g in group], *[F.desc(c) if down else F.asc(c) for c, down in order.items()]]
    cut = staged(rows.repartitionByRange(*keys).withColumn(part, F.spark_partition_id()), "running")
    within = Window.partitionBy(part, *group).orderBy(*keys[len(group) :]).rowsBetween(Window.unboundedPreceding, 0)
    earlier = Window.partitionBy(*group).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    sums = cut.groupBy(part, *group).agg(*[F.sum(v).alias(n) for n, v in values.items()])
    before = sums.select(F.col(part).alias("_at_part"), *[F.col(g).alias(f"_at_g{i}") for i, g in enumerate(group)], *[F.coalesce(F.sum(n).over(earlier), F.lit(0)).alias(f"_before_{n}") for n in values])
    same: Column = F.col(part) == F.col("_at_part")
    for i, g in enumerate(group):
        same = same & F.col(g).eqNullSafe(F.col(f"_at_g{i}"))
    placed = cut.withColumns({f"_own_{n}": F.sum(v).over(within) for n, v in values.items()}).join(before, same)
    return placed.select(*rows.columns, *[(F.col(f"_own_{n}") + F.col(f"_before_{n}")).alias(n) for n in values])

"""Exact row numbers within groups of any size."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from .store import fresh, staged


def numbered(df: DataFrame, group: list[str], order: list[str], name: str, size: str | None = None) -> DataFrame:
    """``df`` with ``name``: the place (from 0) of a row among those of its ``group``, by ``order``; and with ``size``, the group's number of rows.

    Rows are range-partitioned by group and order, so that a large group lies in many partitions; places in a part of a
    group are then moved on by the rows of the group's earlier parts. No task holds a whole group. Null groups count as
    one group; nulls come first in the order.
    """
    part = fresh("part", df.columns)
    keys = [*group, *order]
    cut = staged(df.repartitionByRange(*keys).withColumn(part, F.spark_partition_id()), "numbered")
    within = Window.partitionBy(part, *group).orderBy(*order)
    counts = cut.groupBy(part, *group).agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy(*group).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    base = counts.select(F.col(part).alias("_p"), *[F.col(c).alias(f"_g{i}") for i, c in enumerate(group)], before.alias("_base"), *([F.sum("n").over(Window.partitionBy(*group)).alias("_size")] if size else []))
    placed = cut.withColumn(name, (F.row_number().over(within) - 1).cast("long"))
    same = placed[part] == base["_p"]
    for i, c in enumerate(group):
        same &= placed[c].eqNullSafe(base[f"_g{i}"])
    return placed.join(base, same).select(*[placed[c] for c in df.columns], (placed[name] + base["_base"]).alias(name), *([base["_size"].alias(size)] if size else []))

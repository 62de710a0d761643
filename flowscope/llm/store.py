"""Intermediate tables in the folder that driver and executors share (one helper for the whole library)."""

from itertools import accumulate

from pyspark.sql import DataFrame, functions as F

from ..store import fresh, new_path, shared_dir, staged

__all__ = ["BROADCAST_PARTS", "after_parts", "fresh", "new_path", "shared_dir", "staged"]

#: Parts whose bases (two numbers each) are broadcast at most; more are joined.
BROADCAST_PARTS = 500_000


def after_parts(rows: DataFrame, part: str, counts: DataFrame, base: str) -> DataFrame:
    """``rows`` with ``base``: the sum of ``counts`` (part, number; a row for each part written) over the parts before a row's own."""
    sizes = sorted(counts.collect())
    before = accumulate((n for _, n in sizes), initial=0)
    bases = rows.sparkSession.createDataFrame([(p, b) for (p, _), b in zip(sizes, before)], f"`{part}` int, `{base}` long")
    return rows.join(F.broadcast(bases) if len(sizes) <= BROADCAST_PARTS else bases, part)

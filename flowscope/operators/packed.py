"""Training pools as a few large binary rows, so that a pass over a pool moves arrays and not values.

A pool row holds ``n`` known rows: ``x`` (n by features), ``y`` (1 malicious, else 0) and ``w``, the rows' weights.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from . import contracts

BAD, GOOD = "malicious", "benign"
#: Sums of more parts than this are added on executors before the driver gets them.
PARTS = 256
_KIND = "n int, x binary, y binary, w binary"
#: Numbers of a part of a pool at most; a fit passes over it many times.
PART_VALUES = 4_000_000


@dataclass
class Pool:
    """A packed pool that is kept, and its number of parts."""

    rows: DataFrame
    parts: int

    def __enter__(self) -> Pool:
        self.rows = self.rows.persist()
        return self

    def __exit__(self, *_) -> None:
        self.rows.unpersist()


@dataclass
class Summary:
    """Counts by class, and of each feature the mean, deviation, least and largest value of a pool's known rows."""

    good: int
    bad: int
    mean: np.ndarray
    scale: np.ndarray
    low: np.ndarray
    high: np.ndarray

    def weights(self, balanced: bool) -> tuple[float, float]:
        """The weight of a benign and of a malicious row."""
        n = self.good + self.bad
        return (n / (2 * self.good), n / (2 * self.bad)) if balanced else (1.0, 1.0)


def known(rows: DataFrame) -> DataFrame:
    return rows.where(F.col("ground_truth_label") != "unknown")


def summary(train: DataFrame, names: list[str]) -> Summary:
    """One pass; raises unless the pool holds known rows of both classes. Constant features get scale 1."""
    label = F.col("ground_truth_label")
    each = [f(F.col(c).cast("double")).alias(f"{k}{i}") for i, c in enumerate(names) for k, f in (("m", F.avg), ("s", F.stddev_pop), ("a", F.min), ("b", F.max))]
    r = known(train).agg(F.count_if(label == GOOD).alias("good"), F.count_if(label == BAD).alias("bad"), F.count_if(~label.isin(GOOD, BAD)).alias("odd"), *each).first()
    contracts.guard_classes(r["good"], r["bad"], r["odd"])
    of = lambda k: np.array([r[f"{k}{i}"] for i in range(len(names))], float)
    scale = of("s")
    return Summary(r["good"], r["bad"], of("m"), np.where(scale > 0, scale, 1.0), of("a"), of("b"))


def pack(train: DataFrame, names: list[str], made: Callable[[np.ndarray], np.ndarray], weights: tuple[float, float], parts: int, held: Column | None = None, batch: int = 50_000) -> Pool:
    """The known rows of ``train`` in ``parts`` parts, with ``made`` of their features; rows that ``held`` names have 2 added to ``y``."""
    held = F.lit(False) if held is None else held
    rows = known(train).select(*[F.col(c).cast("double").alias(f"f{i}") for i, c in enumerate(names)], ((F.col("ground_truth_label") == BAD).cast("int") + 2 * held.cast("int")).alias("y"))

    def run(batches):
        for b in batches:
            x = np.column_stack([b.column(i).to_numpy(zero_copy_only=False) for i in range(len(names))]).astype(float)
            y = b.column(len(names)).to_numpy(zero_copy_only=False).astype(np.uint8)
            for a in range(0, len(y), batch):
                part = y[a : a + batch]
                yield pa.RecordBatch.from_arrays([pa.array([len(part)], pa.int32()), pa.array([np.ascontiguousarray(made(x[a : a + batch])).tobytes()]), pa.array([part.tobytes()]), pa.array([np.where(part & 1, weights[1], weights[0]).tobytes()])], names=["n", "x", "y", "w"])

    return Pool(rows.repartition(parts).mapInArrow(run, _KIND), parts)


def parts_of(train: DataFrame, s: Summary) -> int:
    """A part for each core, and so many that none is large."""
    return max(train.sparkSession.sparkContext.defaultParallelism, -(-(s.good + s.bad) * len(s.mean) // PART_VALUES))


def spread(rows: DataFrame) -> DataFrame:
    """``rows`` dealt by their ids to all cores: scoring by many trees takes far longer than a shuffle, and a table of few splits would lie in few tasks."""
    return rows.repartition(4 * rows.sparkSession.sparkContext.defaultParallelism, "event_id")


def arrays(batches: Iterator[pa.RecordBatch], features: int, kind: type = np.float64) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """x, y, w of a task's pool rows."""
    for b in batches:
        for r in zip(*[c.to_pylist() for c in b.columns]):
            yield row(r, features, kind)


def row(r: tuple, features: int, kind: type = np.float64) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """x, y, w of a pool row."""
    n, x, y, w = r
    return np.frombuffer(x, kind).reshape(n, features), np.frombuffer(y, np.uint8), np.frombuffer(w)


def total(pool: Pool, part: Callable[[Iterator[pa.RecordBatch]], np.ndarray], size: int) -> np.ndarray:
    """The sum over the tasks of what ``part`` makes of a task's rows, an array of ``size`` numbers."""

    def run(batches):
        yield pa.RecordBatch.from_arrays([pa.array([part(batches).tobytes()])], names=["s"])

    sums = pool.rows.mapInArrow(run, "s binary")
    if pool.parts > PARTS:
        def add(batches):
            whole = np.zeros(size)
            for b in batches:
                for s in b.column(0).to_pylist():
                    whole += np.frombuffer(s)
            yield pa.RecordBatch.from_arrays([pa.array([whole.tobytes()])], names=["s"])

        sums = sums.repartition(PARTS).mapInArrow(add, "s binary")
    whole = np.zeros(size)
    for r in sums.collect():  # at most PARTS rows
        whole += np.frombuffer(r.s)
    return whole


def linear(names: list[str], weights: np.ndarray, constant: float) -> Column:
    """The weighted sum of features, in the JVM."""
    out = F.lit(float(constant))
    for c, w in zip(names, weights.tolist()):
        out = out + F.col(c).cast("double") * F.lit(w)
    return out

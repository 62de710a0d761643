"""Independent pieces of work whose Spark jobs run side by side."""

from __future__ import annotations

from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from typing import TypeVar

from pyspark import inheritable_thread_target
from pyspark.sql import SparkSession

T = TypeVar("T")
AT_ONCE = 4


def together(spark: SparkSession, tasks: list[Callable[[], T]], at_once: int = AT_ONCE) -> list[T | Exception]:
    """The result of each task, or what it raised; each submits its jobs to a pool of its own (fair shares where the scheduler is fair)."""

    def run(k: int) -> T:
        spark.sparkContext.setLocalProperty("spark.scheduler.pool", f"together-{k}")
        return tasks[k]()

    def kept(k: int) -> T | Exception:
        try:
            return inheritable_thread_target(spark)(run)(k)
        except Exception as e:  # the caller decides what a failure means
            return e

    if len(tasks) < 2:
        return [kept(k) for k in range(len(tasks))]
    with ThreadPoolExecutor(min(at_once, len(tasks))) as pool:
        return list(pool.map(kept, range(len(tasks))))


def all_together(spark: SparkSession, tasks: list[Callable[[], T]], at_once: int = AT_ONCE) -> list[T]:
    """As ``together``, but raises the first failure."""
    done = together(spark, tasks, at_once)
    for x in done:
        if isinstance(x, Exception):
            raise x
    return done

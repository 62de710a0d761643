"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

#: Rows of a measured table that is broadcast at most; rows of such tables are of a few hundred bytes.
BROADCAST_ROWS = 500_000


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; where that is unset, a new local one, but only if driver and executors are one machine."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        found = spark.sparkContext.getCheckpointDir()
        if found:
            return found
        if spark.sparkContext.master != "local" and not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = "file://" + tempfile.mkdtemp(prefix="flowscope-")
        spark.sparkContext.setCheckpointDir(base)
        return spark.sparkContext.getCheckpointDir()
    return base


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/flowscope/{name}-{uuid.uuid4().hex}"


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back: cuts the lineage and survives lost executors."""
    path = new_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def made_once(rows: DataFrame) -> DataFrame:
    """``rows`` whose columns are made once: what reads them further on reads them, and doesn't make them again."""
    return rows.select(F.explode(F.array(F.struct("*"))).alias("_row")).select("_row.*")


def measured(rows: DataFrame, name: str) -> DataFrame:
    """``rows`` as a stored table that joins broadcast, if it has ``BROADCAST_ROWS`` at most; a larger one is joined as Spark sees fit."""
    small = staged(rows, name)
    return F.broadcast(small) if small.count() <= BROADCAST_ROWS else small


def fresh(name: str, taken: list[str]) -> str:
    """A column name like ``name`` that is not among ``taken`` (whatever the case)."""
    low = {c.lower() for c in taken}
    while name.lower() in low:
        name = "_" + name
    return name

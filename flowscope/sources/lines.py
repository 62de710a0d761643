"""Text files as numbered physical lines, and digests of whole files."""

from __future__ import annotations

import hashlib

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from ..store import measured

#: Files up to this size are hashed in the JVM; larger ones are streamed.
WHOLE_FILE_BYTES = 64 << 20
_CHUNK = 1 << 20


def numbered_lines(spark: SparkSession, path: str | list[str], strict: bool = False) -> DataFrame:
    """file, line_no (from 1), value, decoded (whether the line is valid UTF-8; with ``strict`` one that is not fails the job).

    Rows of a split are read in order, so a line's number is its distance from the split's first row, plus the lines of the
    file's earlier splits. Only a row for each split is shuffled, once, and lines stay where they are read.
    """
    raw = spark.read.text(path, lineSep="\n").select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"),
        F.is_valid_utf8("value").alias("decoded"), F.regexp_replace("value", r"\r$", "").alias("value"),
    )
    if strict:
        raw = raw.where(F.assert_true("decoded", F.concat(F.col("file"), F.lit(" is not UTF-8"))).isNull())
    counts = raw.groupBy("file", "block").agg(F.count("*").alias("n"), F.min("at").alias("first"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    base = measured(counts.select("file", "block", (before - F.col("first") + 1).alias("base")), "splits")  # a row a split of a file
    return raw.join(base, ["file", "block"]).select("file", (F.col("base") + F.col("at")).cast("long").alias("line_no"), "value", "decoded")


def file_digests(spark: SparkSession, path: str | list[str], whole_bytes: int = WHOLE_FILE_BYTES) -> DataFrame:
    """file, size_bytes, sha256 of whole files; those above ``whole_bytes`` are read a megabyte at a time, on executors."""
    files = spark.read.format("binaryFile").load(path)
    small = files.where(F.col("length") <= whole_bytes).select(F.col("path").alias("file"), F.col("length").alias("size_bytes"), F.sha2("content", 256).alias("sha256"))

    def stream(batches):
        from pyarrow import fs

        for pdf in batches:
            digests = []
            for name in pdf["file"]:
                system, inner = fs.FileSystem.from_uri(name)
                digest = hashlib.sha256()
                with system.open_input_stream(inner) as f:
                    while chunk := f.read(_CHUNK):
                        digest.update(chunk)
                digests.append(digest.hexdigest())
            yield pd.DataFrame({"file": pdf["file"], "size_bytes": pdf["size_bytes"], "sha256": digests})

    large = files.where(F.col("length") > whole_bytes).select(F.col("path").alias("file"), F.col("length").alias("size_bytes"))
    return small.unionByName(large.mapInPandas(stream, "file string, size_bytes long, sha256 string"))


def source_url(base: str, scenario: str, filename: str, folder: str = "detailed-bidirectional-flow-labels") -> str:
    """Where a scenario's labelled flows are published, below the address of the collection."""
    return "/".join([base.rstrip("/"), scenario, folder, filename])


def require_accepted(issues: DataFrame) -> DataFrame:
    """``issues``; raises with their counts by kind if there are any."""
    counts = {r["issue_type"]: r["count"] for r in issues.groupBy("issue_type").count().collect()}  # a row a kind
    if counts:
        raise ValueError("rejected rows: " + ", ".join(f"{k}: {n}" for k, n in sorted(counts.items())))
    return issues

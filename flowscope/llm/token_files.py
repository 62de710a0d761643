"""Token-id files: Parquet with one list of subword ids a document, in ascending order of the documents' ids.

The files hold ``doc_id``, ``part`` and ``row`` (place of the document), ``offset`` (ids of the part before it),
``n_tokens`` and ``ids``. Ids are dictionary- or delta-encoded, row groups and pages have set sizes, and the writer adds
page indexes, so that a reader takes the columns and rows it asks for: counts and places without ids, or one document.

Cases: null text is empty, so that its document holds the end id alone. Documents of an equal id are kept and follow each
other in the order of a hash of their texts, then of the texts, and may lie in several files; a null id comes first. An empty table makes no documents.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from .store import after_parts, new_path
from .subwords import IDS, default_path, encoded

ENCODINGS = {
    "dictionary": {"parquet.enable.dictionary": "true"},
    "delta": {"parquet.enable.dictionary": "false", "parquet.writer.version": "PARQUET_2_0"},
}


def write_tokens(docs: DataFrame, path: str, end_id: int, doc_id: str = "doc_id", text: str = "text", tokenizer: str | None = None, encoding: str = "dictionary", row_group_bytes: int = 32 << 20, page_bytes: int = 1 << 20) -> None:
    """Encode ``docs`` and write the files at ``path`` (any file system that Spark writes)."""
    tokenizer = tokenizer or default_path()
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), F.xxhash64(text).alias("hash"))
    schema = T.StructType([T.StructField("part", T.IntegerType()), T.StructField("row", T.LongType()), T.StructField("offset", T.LongType()), T.StructField("n_tokens", T.LongType()), rows.schema["doc_id"], T.StructField("ids", T.ArrayType(T.IntegerType(), False))])

    def encode(batches):
        part, row, offset = TaskContext.get().partitionId(), 0, 0
        for batch in batches:
            for first, ids, sizes in encoded(batch.column(1), tokenizer, end_id):
                n, upto = len(sizes), np.cumsum(sizes)
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], upto)).astype(np.int32)), pa.array(ids.view(np.int32)))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(n, part, np.int32)), pa.array(np.arange(row, row + n)), pa.array(offset + upto - sizes), pa.array(sizes), batch.column(0).slice(first, n), lists], names=schema.names)
                row, offset = row + n, offset + int(upto[-1])

    ordered = rows.repartitionByRange("doc_id", "hash").sortWithinPartitions("doc_id", "hash", "text")
    options = {"compression": "zstd", "parquet.block.size": str(row_group_bytes), "parquet.page.size": str(page_bytes), **ENCODINGS[encoding]}
    ordered.mapInArrow(encode, schema).write.options(**options).parquet(path)


def read_places(spark: SparkSession, path: str, with_ids: bool = False) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens; ids only when asked for."""
    files = spark.read.parquet(path)
    rows = after_parts(files, "part", files.groupBy("part").agg(F.sum("n_tokens")), "base")
    return rows.select("doc_id", (F.col("base") + F.col("offset")).alias("start"), "n_tokens", *["ids"] * with_ids)


def digest(docs: DataFrame) -> DataFrame:
    """Per document, from the files: doc_id, start, n_tokens, ids_crc32."""
    spark = docs.sparkSession
    path = new_path(spark, "token-files")
    write_tokens(docs, path, end_id=2)
    rows = read_places(spark, path, with_ids=True)
    schema = T.StructType([*rows.drop("ids").schema.fields, T.StructField("ids_crc32", T.LongType())])

    def crcs(batches):
        for batch in batches:
            ids = batch.column(3)
            raw, offs = memoryview(np.ascontiguousarray(ids.values.to_numpy(zero_copy_only=False), IDS)).cast("B"), (ids.offsets.to_numpy() * IDS.itemsize).tolist()
            crc = [zlib.crc32(raw[a:b]) for a, b in zip(offs, offs[1:])]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(crc, pa.int64())], names=schema.names)

    return rows.mapInArrow(crcs, schema)

"""Shards of near equal size by sampled splitters, with DataFrame functions only.

Records have a sortable key: a hash of the text, then a hash of the id, so that equal texts are neighbours and a large
group of them can still be divided. A size-weighted sample of keys gives quantile boundaries, which range-partition the
records; ranges that turn out overfull are subdivided by their own quantiles. With the exact sizes of all ranges known,
each record's place in the total order of bytes gives its shard, so that shard sizes differ by one record at most.

Law ``bytes``. Cases: null text counts no bytes, so its record has size 1; repeated rows are placed each; one text alone
may exceed a shard's share, which then holds it whole; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from .store import staged

SHARDS = 16
#: Ranges that the splitters make: one for each so many bytes, within these bounds; and keys drawn for each range (expected number).
RANGE_BYTES = 256_000_000
RANGES = 512, 8192
DRAWS = 32
#: A range of more than so many times its share is subdivided into so many.
OVERFULL = 2
SUBRANGES = 16


def _below(key: Column, splitters: Column, count: int) -> Column:
    """How many of the sorted ``splitters`` are at most ``key``, by binary search."""
    def step(s: Column, _: Column) -> Column:
        mid = F.floor((s["lo"] + s["hi"]) / 2).cast("int")
        right = F.get(splitters, mid) <= key
        return F.when(s["lo"] >= s["hi"], s).otherwise(F.struct(F.when(right, mid + 1).otherwise(s["lo"]).alias("lo"), F.when(right, s["hi"]).otherwise(mid).alias("hi")))

    return F.aggregate(F.sequence(F.lit(1), F.lit(count.bit_length())), F.struct(F.lit(0).alias("lo"), F.lit(count).alias("hi")), step, lambda s: s["lo"])


def _uniform(*cols: str | Column) -> Column:
    """A reproducible number in [0, 1) for each row."""
    return F.pmod(F.xxhash64(F.lit("draw"), *cols), F.lit(1 << 30)) / float(1 << 30)


def shard(docs: DataFrame, shards: int = SHARDS, doc_id: str = "doc_id", text: str = "text", ranges: int | None = None, draws: int = DRAWS) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard."""
    body = F.coalesce(F.col(text), F.lit(""))
    records = staged(
        docs.select(
            F.col(doc_id).alias("doc_id"),
            (F.octet_length(body) + 1).cast("long").alias("size"),
            F.crc32(body).alias("text_crc32"),
            (F.pmod(F.xxhash64(body), F.lit(1 << 32)) * (1 << 20) + F.pmod(F.xxhash64(F.col(doc_id)), F.lit(1 << 20))).alias("key"),
        ),
        "sharding",
    )
    total = records.agg(F.coalesce(F.sum("size"), F.lit(0)).alias("bytes")).first()["bytes"]

    ranges = ranges or min(max(RANGES[0], total // RANGE_BYTES), RANGES[1])
    # keys drawn in proportion to size; a record above the drawing step is drawn several times
    drawn = records.withColumn("copies", F.floor(F.col("size") * (draws * ranges / max(total, 1)) + _uniform("doc_id", "text_crc32"))).where("copies > 0")
    fractions = [i / ranges for i in range(1, ranges)]
    quantiles = drawn.agg(F.percentile("key", fractions, F.col("copies")).alias("q")).first()["q"] or []
    splitters = sorted({int(q) for q in quantiles})
    if splitters:
        in_range = records.withColumn("range", _below(F.col("key"), F.array(*[F.lit(x).cast("long") for x in splitters]), len(splitters)))
    else:
        in_range = records.withColumn("range", F.lit(0))
    in_range = staged(in_range, "sharding-ranges")

    # overfull ranges are subdivided by quantiles of their own keys
    sizes = in_range.groupBy("range").agg(F.sum("size").alias("bytes"))
    full = sizes.where(F.col("bytes") > OVERFULL * total // (len(splitters) + 1)).select("range")
    cuts = in_range.join(F.broadcast(full), "range", "left_semi").groupBy("range").agg(F.percentile_approx("key", [i / SUBRANGES for i in range(1, SUBRANGES)], 2000).alias("cuts"))
    sub = F.coalesce(F.size(F.filter("cuts", lambda c: c <= F.col("key"))), F.lit(0))
    cells = in_range.join(F.broadcast(cuts), "range", "left").withColumn("sub", F.when(F.col("cuts").isNull(), 0).otherwise(sub)).drop("cuts")

    # at most ranges x SUBRANGES cells: exact sizes of all that stands before each
    before = Window.orderBy("range", "sub").rowsBetween(Window.unboundedPreceding, -1)
    totals = cells.groupBy("range", "sub").agg(F.sum("size").alias("b"), F.count("*").alias("n"))
    bases = totals.select("range", "sub", F.coalesce(F.sum("b").over(before), F.lit(0)).alias("bytes_before"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("rows_before"))
    within = Window.partitionBy("range", "sub").orderBy("key", "doc_id", "text_crc32", "size")
    middle = 2 * (F.col("bytes_before") + F.sum("size").over(within.rowsBetween(Window.unboundedPreceding, 0))) - F.col("size")
    placed = cells.join(F.broadcast(bases), ["range", "sub"]).select(
        "doc_id",
        "size",
        "text_crc32",
        F.least(F.lit(shards - 1), F.floor(middle * shards / (2 * max(total, 1)))).cast("int").alias("shard"),
        (F.col("rows_before") + F.row_number().over(within) - 1).alias("row"),
    )
    placed = staged(placed, "sharding-placed")
    first = placed.groupBy("shard").agg(F.min("row").alias("first"))
    return placed.join(F.broadcast(first), "shard").select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("row") - F.col("first")).alias("slot"), F.lit(None).cast("int").alias("grown_shard")
    )


def digest(docs: DataFrame) -> DataFrame:
    return shard(docs)

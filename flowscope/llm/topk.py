"""Exact search of the k vectors with the largest integer inner product, by a pivot-distance index.

With a further component that brings all vectors to one norm, the largest inner product is the smallest Euclidean distance. The
index keys each vector by its nearest pivot and its distance from it, and cuts each pivot's vectors, sorted by distance,
into annuli of bounded size. A query takes annuli in the order of the largest score that the triangle inequality leaves
possible: the first few give it a k-th score, and of all others only those are searched whose bound reaches it. Every
vector is indexed, so results are exact whatever the pivots.

Pivots are a bounded sample (``pivots`` rows, by a hash of the id); the number of annuli is at most ``annuli`` plus the
pivots, so that their bounds are a table of known size on the driver. An annulus is copied only where more than
``QUERY_CHUNK`` queries ask for it. A query's vector goes once to each annulus that it searches, which is little beside the
``annulus_rows`` products or more that it makes there; this holds too where the bounds prune nothing.

Scores are 64-bit: the sum of squares of a vector's integer components must stay below ``LIMIT``, and so does every score then; a longer vector raises with its vec_id.

Cases: vectors that are null, or hold null or non-finite components, and rows of a null vec_id take no part; shorter vectors
count as filled up with zeros; rows of an equal vec_id are queries and candidates each, and only a query's own row is no
candidate of it; ties go to the smaller vec_id; with fewer candidates than k all are returned; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from .ordering import numbered
from .store import staged

PIVOTS = 64
ANNULI = 8192
ANNULUS_ROWS = 1024
FIRST = 4
QUERY_CHUNK = 4096
#: Largest sum of squares of a vector: a little below 2^63, for it is summed in double precision.
LIMIT = float((1 << 63) - (1 << 30))
#: Queries whose bounds of all annuli are in memory at once.
BOUNDED = 256


def integer_vectors(embeddings: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", scale: int = 1024) -> DataFrame:
    """row (a number of the row; store the table before it is used), vec_id, v: floor(scale * x) of each component, where all are finite numbers."""
    finite = F.forall(embedding, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    rows = embeddings.where(F.col(vec_id).isNotNull() & F.col(embedding).isNotNull() & finite)
    return rows.select(F.monotonically_increasing_id().alias("row"), F.col(vec_id).cast("long").alias("vec_id"), F.transform(embedding, lambda x: _floor(x.cast("double") * scale, F.col(vec_id))).alias("v"))


def _floor(x: Column, vec_id: Column) -> Column:
    """The integer below; a component beyond 2^32 has a square beyond the limit."""
    long = F.raise_error(F.concat(F.lit("scores of vector "), vec_id.cast("string"), F.lit(" would not fit 64 bits"))).cast("long")
    return F.when(F.abs(x) < float(1 << 32), F.floor(x)).otherwise(long)


def _matrix(vectors: pd.Series, dims: int) -> np.ndarray:
    out = np.zeros((len(vectors), dims))
    for i, v in enumerate(vectors):
        out[i, : len(v)] = v
    return out


def _best(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    if len(scores) > 4 * k:
        least = np.partition(scores, len(scores) - k)[len(scores) - k]
        some = np.flatnonzero(scores >= least)
    else:
        some = np.arange(len(scores))
    return some[np.lexsort((ids[some], -scores[some]))][:k]


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 10, pivots: int = PIVOTS, annuli: int = ANNULI, annulus_rows: int = ANNULUS_ROWS) -> DataFrame:
    """query_id, rank, vec_id, score for each row of ``queries`` against all ``vectors`` (both row, vec_id, v; stored tables)."""
    spark = vectors.sparkSession
    norm = F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x)
    shape = vectors.select("vec_id", F.size("v").alias("d"), norm.alias("n"), F.array_max(F.transform("v", F.abs)).alias("m")).agg(F.count("*").alias("rows"), F.max("d").alias("dims"), F.max("n").alias("norm"), F.max_by("vec_id", "n").alias("longest"), F.max("m").alias("most")).first()
    empty = spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    if not shape["rows"]:
        return empty
    dims, top = max(shape["dims"], 1), float(shape["norm"])
    if top >= LIMIT:
        raise ValueError(f"scores of vector {shape['longest']} would not fit 64 bits")
    exact = dims * float(shape["most"] or 0) ** 2 < 2**52  # then sums of products are whole in double precision
    sample = vectors.orderBy(F.xxhash64("vec_id"), "vec_id").limit(pivots).collect()
    centre = np.unique(_matrix(pd.Series([r["v"] for r in sample]), dims), axis=0)
    lift = np.sqrt(np.maximum(0, top - np.square(centre).sum(1)))
    slack = 1e-9 * max(top, 1.0)

    def keyed(batches):
        for pdf in batches:
            x = _matrix(pdf["v"], dims)
            own = np.sqrt(np.maximum(0, top - np.square(x).sum(1)))
            far = np.sqrt(np.maximum(0, 2 * top - 2 * (x @ centre.T + np.outer(own, lift))))
            near = far.argmin(1)
            yield pdf.assign(pivot=near.astype(np.int32), distance=far[np.arange(len(x)), near])

    index = vectors.select("row", "vec_id", "v").mapInPandas(keyed, "row long, vec_id long, v array<long>, pivot int, distance double")
    rows = max(annulus_rows, -(-shape["rows"] // annuli))
    placed = numbered(index, ["pivot"], ["distance", "vec_id", "row"], "place")
    placed = staged(placed.withColumn("annulus", F.concat_ws("-", "pivot", F.floor(F.col("place") / rows))), "annuli")
    bounds = placed.groupBy("annulus", "pivot").agg(F.min("distance").alias("near"), F.max("distance").alias("far")).orderBy("annulus").toPandas()
    names, at = bounds["annulus"].to_numpy(), bounds["pivot"].to_numpy()
    near, far = bounds["near"].to_numpy(), bounds["far"].to_numpy()
    def pairs(first: bool):
        """The annuli that a query searches; ``least`` is the k-th score that it has so far."""
        def choose(batches):
            for whole in batches:
                for batch in (whole.slice(a, BOUNDED) for a in range(0, whole.num_rows, BOUNDED)):
                    q = _matrix(batch.column(1).to_pandas(), dims)
                    norms = np.square(q).sum(1)
                    d = np.sqrt(np.maximum(0, (norms + top)[:, None] - 2 * q @ centre.T))[:, at]
                    gap = np.maximum(0, np.maximum(d - far, near - d) - 1e-7 * (1 + d))
                    most = ((norms + top)[:, None] - np.square(gap)) / 2 + slack
                    early = np.zeros(most.shape, bool)
                    np.put_along_axis(early, np.argsort(-most, axis=1, kind="stable")[:, :FIRST], True, axis=1)
                    asked = early if first else ~early & (most >= batch.column(2).to_numpy()[:, None])
                    who, which = np.nonzero(asked)
                    who = pa.array(who)
                    yield pa.RecordBatch.from_arrays([pa.array(names[which].tolist(), pa.string()), batch.column(0).take(who), batch.column(1).take(who)], names=["annulus", "query", "q"])

        return choose

    def search(_, block: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        none = pd.DataFrame({"query": np.empty(0, np.int64), "vec_id": np.empty(0, np.int64), "score": np.empty(0, np.int64)})
        if block.empty or asked.empty:
            return none
        kind = np.float64 if exact else object
        whole = lambda v: _matrix(v, dims) if exact else np.array([[int(c) for c in x] + [0] * (dims - len(x)) for x in v], dtype=kind)
        x, ids, own = whole(block["v"]), block["vec_id"].to_numpy(), block["row"].to_numpy()
        out = [none]
        for a in range(0, len(asked), 256):
            part = asked.iloc[a : a + 256]
            scores = (whole(part["q"]) @ x.T).astype(np.int64)
            for i, query in enumerate(part["query"].to_numpy()):
                others = np.flatnonzero(own != query)
                best = others[_best(scores[i, others], ids[others], k)]
                out.append(pd.DataFrame({"query": query, "vec_id": ids[best], "score": scores[i, best]}))
        return pd.concat(out)

    def found(asking: DataFrame, first: bool) -> DataFrame:
        """query, vec_id, score: the best of each annulus that a query asks for."""
        asked = staged(asking.mapInArrow(pairs(first), "annulus string, query long, q array<long>"), "asked-annuli")
        chunks = asked.groupBy("annulus").agg(F.ceil(F.count("*") / QUERY_CHUNK).cast("int").alias("chunks"))  # a row an annulus
        dealt = asked.join(chunks, "annulus").withColumn("chunk", F.pmod(F.xxhash64("query"), F.col("chunks")).cast("int")).drop("chunks")
        copies = placed.join(chunks, "annulus").select("annulus", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("chunk"), "row", "vec_id", "v")
        return copies.groupBy("annulus", "chunk").cogroup(dealt.groupBy("annulus", "chunk")).applyInPandas(search, "query long, vec_id long, score long")

    def ranked(rows: DataFrame) -> DataFrame:
        best = Window.partitionBy("query").orderBy(F.desc("score"), "vec_id")
        return rows.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)

    nothing = F.lit(float("-inf"))
    asking = queries.select(F.col("row").alias("query"), "v", nothing.alias("least"))
    early = staged(ranked(found(asking, True)), "first-annuli")
    least = early.where(F.col("rank") == k).select("query", F.col("score").cast("double").alias("found"))
    late = found(asking.join(least, "query", "left").select("query", "v", F.coalesce("found", nothing).alias("least")), False)
    out = ranked(early.drop("rank").unionByName(late))
    named = queries.select(F.col("row").alias("query"), F.col("vec_id").alias("query_id"))
    return out.join(named, "query").select("query_id", "rank", "vec_id", "score")


def digest(embeddings: DataFrame) -> DataFrame:
    """Queries: the rows whose vec_id is divisible by 100."""
    vectors = staged(integer_vectors(embeddings), "vectors")
    return top_k(vectors, vectors.where(F.col("vec_id") % 100 == 0))


DIGEST_SQL = """
WITH v AS (
  SELECT row_number() OVER () AS row, vec_id, [floor(1024 * CAST(x AS DOUBLE)) FOR x IN embedding] AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
s AS (
  SELECT q.row, q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.v, c.v) AS BIGINT) AS score
  FROM v q JOIN v c ON q.row <> c.row WHERE q.vec_id % 100 = 0)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY row ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 10
"""

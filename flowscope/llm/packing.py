"""Packing documents into as few sequences as possible, by a grouping genetic algorithm on islands.

Pieces are dealt at random, row by row, into blocks of about ``block_items``, each of which is an instance of bin packing of
bounded size with the lengths of the whole corpus. On each block several islands breed packings apart. They begin with
random groupings (best fit of the pieces in random order). Crossover takes whole well-filled bins of one parent, removes the other
parent's bins that hold the same pieces, and best-fits the displaced ones; the elite of each island migrates to the next
one after every epoch. In the last epoch a packing by decreasing size joins the first island, so that the result is never
worse than that. An island rests once it has as few bins as the sum of sizes allows. Blocks are independent, so the work is in
proportion to the input and no task ever holds more than a block.

A document longer than a sequence is cut into pieces of full length, the first of which may be shorter; full pieces are
sequences of their own. Cases: null and empty texts hold the end id alone; repeated documents are packed each, whatever
their ids; ids may be null; an empty table makes no sequences.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from .store import fresh, staged
from .subwords import IDS, default_path, encoded

CAPACITY = 2048
BLOCK_ITEMS = 8192
ISLANDS = 3
EPOCHS = 3
#: Random groupings that an island begins with, and children that it breeds in an epoch.
POPULATION = 4
OFFSPRING = 16


def pieces(docs: DataFrame, capacity: int = CAPACITY, end_id: int = 0, doc_id: str = "doc_id", text: str = "text", tokenizer: str | None = None, with_ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 (and ids): the documents, cut where they are longer than ``capacity``."""
    tokenizer = tokenizer or default_path()
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    fields = [rows.schema["doc_id"], T.StructField("piece", T.IntegerType()), *[T.StructField(c, T.LongType()) for c in ("start", "length", "ids_crc32")]]
    schema = T.StructType(fields + [T.StructField("ids", T.ArrayType(T.IntegerType(), False))] * with_ids)

    def cut(batches):
        for batch in batches:
            for first, ids, each in encoded(batch.column(1), tokenizer, end_id):
                count = -(-each // capacity)
                row = np.repeat(np.arange(len(each)), count)
                piece = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
                lead = (each - 1) % capacity + 1  # of a document's first piece
                length = np.where(piece == 0, lead[row], capacity)
                start = np.where(piece == 0, 0, lead[row] + (piece - 1) * capacity)
                at = np.concatenate(([0], np.cumsum(length)))
                raw, cuts = memoryview(np.ascontiguousarray(ids, IDS)).cast("B"), (at * IDS.itemsize).tolist()
                crc = [zlib.crc32(raw[a:b]) for a, b in zip(cuts, cuts[1:])]
                arrays = [batch.column(0).take(pa.array(first + row)), pa.array(piece.astype(np.int32)), *[pa.array(x, pa.int64()) for x in (start, length, crc)]]
                if with_ids:
                    arrays.append(pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(ids.view(np.int32))))
                yield pa.RecordBatch.from_arrays(arrays, names=schema.names)

    return rows.mapInArrow(cut, schema)


def best_fit(sizes: np.ndarray, order: np.ndarray, room: list[int], capacity: int) -> list[int]:
    """Put the items of ``order`` one by one where the least room is left; ``room`` of the bins is brought up to date. Returns their bins."""
    open_bins = sorted((r, b) for b, r in enumerate(room) if r > 0)
    out = []
    for size in sizes[order].tolist():
        k = bisect_left(open_bins, (size, -1))
        if k == len(open_bins):
            b = len(room)
            room.append(capacity)
        else:
            b = open_bins.pop(k)[1]
        out.append(b)
        room[b] -= size
        if room[b] > 0:
            insort(open_bins, (room[b], b))
    return out


def random_packing(sizes: np.ndarray, capacity: int, rng: np.random.Generator) -> np.ndarray:
    """Best fit of the items in random order."""
    order = rng.permutation(len(sizes))
    out = np.empty(len(sizes), np.int32)
    out[order] = best_fit(sizes, order, [], capacity)
    return out


def decreasing_packing(sizes: np.ndarray, capacity: int) -> np.ndarray:
    """Best fit of the items by decreasing size."""
    order = np.argsort(-sizes, kind="stable")
    out = np.empty(len(sizes), np.int32)
    out[order] = best_fit(sizes, order, [], capacity)
    return out


def fitness(bins: np.ndarray, sizes: np.ndarray, capacity: int) -> tuple[int, float]:
    """Fewer bins first, then fuller ones."""
    fill = np.bincount(bins, weights=sizes) / capacity
    return -len(fill), float(np.square(fill).sum())


def crossover(a: np.ndarray, b: np.ndarray, sizes: np.ndarray, capacity: int, rng: np.random.Generator) -> np.ndarray:
    """Inject well-filled bins of ``a`` into ``b``; the documents that this displaces, and those of ``b``'s worse filled bins, are best-fitted."""
    fill = np.bincount(a, weights=sizes)
    good = fill >= np.quantile(fill, 0.5)
    good &= rng.random(len(good)) < 0.6
    injected = good[a]
    left = np.bincount(b, weights=sizes)
    broken = np.bincount(b[injected], minlength=len(left)) > 0
    broken |= (left < np.quantile(left, 0.5)) & (rng.random(len(left)) < rng.random()) | (left <= np.quantile(left, 0.02))
    free = ~injected & broken[b]
    child = np.where(injected, a, b + len(good))
    used, child = np.unique(np.where(free, -1, child), return_inverse=True)
    child = child.astype(np.int32) - int(used[0] == -1)
    placed = ~free
    room = (capacity - np.bincount(child[placed], weights=sizes[placed], minlength=int(child.max(initial=-1)) + 1)).astype(int).tolist()
    order = np.flatnonzero(free)
    order = order[np.argsort(-sizes[order], kind="stable")]
    child[order] = best_fit(sizes, order, room, capacity)
    return child


@dataclass
class Bred:
    packings: list[np.ndarray]
    children: int


def evolve(packings: list[np.ndarray], sizes: np.ndarray, capacity: int, rng: np.random.Generator, offspring: int = OFFSPRING, population: int = POPULATION) -> Bred:
    """The best ``population`` packings after up to ``offspring`` crossovers, best first; it ends at the least number of bins."""
    least = -(-int(sizes.sum()) // capacity)
    scored = sorted(((fitness(x, sizes, capacity), k, x) for k, x in enumerate(packings)), reverse=True)[:population]
    children = 0
    while children < offspring and len(scored) > 1 and -scored[0][0][0] > least:
        a, b = rng.permutation(len(scored))[:2]
        child = crossover(scored[a][2], scored[b][2], sizes, capacity, rng)
        children += 1
        scored.append((fitness(child, sizes, capacity), len(packings) + children, child))
        scored = sorted(scored, reverse=True)[:population]
    return Bred([x for _, _, x in scored], children)


_STATE = "block long, island int, sizes binary, bins binary, children int"


def pack(items: DataFrame, capacity: int = CAPACITY, block_items: int = BLOCK_ITEMS, islands: int = ISLANDS, epochs: int = EPOCHS) -> DataFrame:
    """``items`` (doc_id, piece, start, length, ids_crc32, ...) with sequence_id, offset and children (crossovers of its block, on the island that bred most)."""
    row, block = fresh("row", items.columns), fresh("block", items.columns)
    stored = staged(items.withColumn(row, F.monotonically_increasing_id()), "pieces")
    blocks = -(-stored.count() // block_items) or 1
    dealt = stored.withColumn(block, F.pmod(F.xxhash64(row), F.lit(blocks)))

    def found(key, pdf: pd.DataFrame) -> pd.DataFrame:
        sizes = np.sort(pdf["length"].to_numpy(np.int32))
        rows = []
        for i in range(islands):
            rng = np.random.default_rng([int(key[0]), i])
            rows += [(key[0], i, sizes.tobytes(), random_packing(sizes, capacity, rng).tobytes(), 0) for _ in range(POPULATION)]
        return pd.DataFrame(rows, columns=["block", "island", "sizes", "bins", "children"])

    def epoch(number: int):
        def breed(key, pdf: pd.DataFrame) -> pd.DataFrame:
            at, island = int(key[0]), int(key[1])
            sizes = np.frombuffer(pdf["sizes"].iloc[0], np.int32)
            start = [np.frombuffer(x, np.int32) for x in sorted(pdf["bins"])]
            if number == epochs - 1 and island == 0:
                start.append(decreasing_packing(sizes, capacity))
            bred = evolve(start, sizes, capacity, np.random.default_rng([at, island, number]))
            children = int(pdf["children"].max()) + bred.children
            rows = [(at, island, sizes.tobytes(), x.tobytes(), children) for x in bred.packings]
            if islands > 1:  # the elite goes to the next island too
                rows.append((at, (island + 1) % islands, sizes.tobytes(), bred.packings[0].tobytes(), children))
            return pd.DataFrame(rows, columns=["block", "island", "sizes", "bins", "children"])

        return breed

    short = dealt.where(F.col("length") < capacity)
    state = short.select(F.col(block).alias("block"), "length").groupBy("block").applyInPandas(found, _STATE)
    for k in range(epochs):
        state = state.groupBy("block", "island").applyInPandas(epoch(k), _STATE)
    schema = T.StructType([*items.schema.fields, *[T.StructField(c, T.LongType()) for c in ("sequence_id", "offset", "children")]])

    def place(key, rows: pa.Table, packings: pa.Table) -> pa.Table:
        rows = rows.sort_by([("length", "ascending"), (row, "ascending")])
        lengths = rows["length"].to_numpy().astype(np.int64)
        part = lengths < capacity
        bins = np.empty(len(lengths), np.int64)
        count = children = 0
        if part.any():
            sizes = lengths[part].astype(np.int32)
            every = sorted((np.frombuffer(x, np.int32) for x in packings["bins"].to_pylist()), key=lambda x: x.tobytes())
            best = max(every, key=lambda x: fitness(x, sizes, capacity))
            bins[part] = best
            count, children = int(best.max()) + 1, max(packings["children"].to_pylist())
        bins[~part] = count + np.arange(int((~part).sum()))
        order = np.argsort(bins, kind="stable")
        upto = np.cumsum(lengths[order])
        new = np.concatenate(([True], np.diff(bins[order]) > 0))
        base = np.maximum.accumulate(np.where(new, upto - lengths[order], 0))
        offset = np.empty(len(lengths), np.int64)
        offset[order] = upto - lengths[order] - base
        out = [rows[c] for c in schema.names[:-3]]
        return pa.Table.from_arrays([*out, pa.array(key[0].as_py() * (1 << 32) + bins), pa.array(offset), pa.array(np.full(len(bins), children))], names=schema.names)

    left = dealt.groupBy(F.col(block))
    return left.cogroup(state.groupBy("block")).applyInArrow(place, schema)


def digest(docs: DataFrame) -> DataFrame:
    """Per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    return pack(pieces(docs)).drop("children")

"""Benchmark decontamination: finds texts that repeat word windows of benchmark items.

The windows of the benchmark (n consecutive words; an item of fewer words is one window) are sent to the executors as a
broadcast hash set, each document is scanned once, and every hash hit is verified on the words themselves. The set's size
is measured first; a benchmark of more than ``block_bytes`` is dealt into blocks, each of which is one bounded broadcast
and one scan, and the hit words of the blocks are then united by document.

Cases: null and empty texts have no words and are clean. A null item_id counts as the empty string; rows with an equal
item_id are one item. Repeated documents are reported row by row. An empty benchmark leaves all documents clean.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from .store import fresh, staged
from .words import ALNUM, runs, word_tables

#: Text bytes of benchmark items in one broadcast, which takes about six times as many bytes (some 30 for each window).
BLOCK_BYTES = 8_000_000

REPORT = T.StructType(
    [
        T.StructField("n_words", T.LongType()),
        T.StructField("spans", T.ArrayType(T.LongType())),
        T.StructField("items", T.ArrayType(T.StringType())),
    ]
)
_ARROW = pa.struct([("n_words", pa.int64()), ("spans", pa.list_(pa.int64())), ("items", pa.list_(pa.string()))])


class WindowSet:
    """Windows of some items by length: sorted codes, the first word of each, and its item; and the words themselves, in one block."""

    def __init__(self, items: list[tuple[str, str | None]], n: int):
        self.items = [i for i, _ in items]
        text, starts, ends, found = [], [], [], defaultdict(list)
        size_before = words_before = 0
        for w in word_tables(pa.array([t for _, t in items], pa.string()), ALNUM):
            count = np.diff(w.bounds)
            for size in np.unique(np.minimum(count[count > 0], n)).tolist():
                codes = runs(w.codes, size)
                at = np.arange(len(codes))
                own = count[w.text[at]]
                at = at[(w.text[at] == w.text[at + size - 1]) & ((own >= n) if size == n else (own == size))]
                found[size].append((codes[at], (at + words_before).astype(np.int32), (w.first + w.text[at]).astype(np.int32)))
            text.append(w.lower.tobytes())
            starts.append(w.starts + size_before)
            ends.append(w.ends + size_before)
            size_before, words_before = size_before + len(w.lower), words_before + len(w.codes)
        self.text = b"".join(text)
        self.starts, self.ends = (np.concatenate(x or [np.empty(0, np.int64)]).astype(np.int32) for x in (starts, ends))
        self.sizes = {}
        for size, parts in sorted(found.items()):
            codes, at, item = (np.concatenate(x) for x in zip(*parts))
            order = np.lexsort((item, codes))
            codes, at, item = codes[order], at[order], item[order]
            again = np.flatnonzero(codes[1:] == codes[:-1])
            odd = {int(codes[i]) for i in again.tolist() if self.words(at[i], size) != self.words(at[i + 1], size)}
            self.sizes[size] = (codes, at, item, max(16, (len(codes) * 4).bit_length()), odd)
        self._seen: dict[int, np.ndarray] = {}

    def words(self, first: int, size: int) -> bytes:
        return b" ".join([self.text[s:e] for s, e in zip(self.starts[first : first + size].tolist(), self.ends[first : first + size].tolist(), strict=True)])

    def candidates(self, codes: np.ndarray, size: int) -> Iterator[tuple[int, int, int]]:
        """Places in ``codes`` of windows that may be known, and from where to where windows of the code stand."""
        known, _, _, bits, _ = self.sizes[size]
        if size not in self._seen:  # a small table in front of the sorted codes
            seen = np.zeros(1 << bits, bool)
            seen[(known >> np.uint64(64 - bits)).astype(np.int64)] = True
            self._seen[size] = seen
        at = np.flatnonzero(self._seen[size][(codes >> np.uint64(64 - bits)).astype(np.int64)])
        low, high = (np.searchsorted(known, codes[at], side=side) for side in ("left", "right"))
        hit = high > low
        yield from zip(at[hit].tolist(), low[hit].tolist(), high[hit].tolist(), strict=True)

    def verified(self, words: bytes, size: int, low: int, high: int) -> list[tuple[int, int, int]]:
        """Those windows among ``low`` .. ``high`` of one code that consist of ``words``: (size, from, to)."""
        codes, at, _, _, odd = self.sizes[size]
        if int(codes[low]) not in odd:  # all windows of the code have the same words
            return [(size, low, high)] if self.words(at[low], size) == words else []
        return [(size, k, k + 1) for k in range(low, high) if self.words(at[k], size) == words]

    def owners(self, held: set[tuple[int, int, int]]) -> list[str]:
        return sorted({self.items[i] for size, low, high in held for i in self.sizes[size][2][low:high].tolist()})

    def __getstate__(self):
        return self.__dict__ | {"_seen": {}}


def _scan(batch: pa.RecordBatch, text: str, windows: WindowSet) -> pa.Array:
    """For each row: number of words, hit words as flat [from, to) pairs, items."""
    counts: list[int] = []
    spans: list[list[int]] = []
    items: list[list[str]] = []
    for w in word_tables(batch.column(batch.schema.get_field_index(text)), ALNUM):
        n, low = len(w.codes), None
        change = np.zeros(n + 1, np.int32)
        held: dict[int, set[tuple[int, int, int]]] = defaultdict(set)
        for size in windows.sizes:
            codes = runs(w.codes, size)
            for i, a, b in windows.candidates(codes, size):
                if w.text[i] != w.text[i + size - 1]:
                    continue
                low = w.lower.tobytes() if low is None else low
                mine = b" ".join([low[s:e] for s, e in zip(w.starts[i : i + size].tolist(), w.ends[i : i + size].tolist(), strict=True)])
                if found := windows.verified(mine, size, a, b):
                    change[i] += 1
                    change[i + size] -= 1
                    held[int(w.text[i])].update(found)
        counts += np.diff(w.bounds).tolist()
        mine = [[] for _ in range(w.texts)]
        if held:
            hit = np.cumsum(change)[:n] > 0
            for k in held:
                a, b = int(w.bounds[k]), int(w.bounds[k + 1])
                edge = np.diff(np.concatenate(([0], hit[a:b].astype(np.int8), [0])))
                mine[k] = np.stack((np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)), 1).ravel().tolist()
        spans += mine
        items += [windows.owners(held[k]) if k in held else [] for k in range(w.texts)]
    return pa.StructArray.from_arrays([pa.array(counts, pa.int64()), pa.array(spans, pa.list_(pa.int64())), pa.array(items, pa.list_(pa.string()))], fields=list(_ARROW))


def _with_report(docs: DataFrame, report: str, text: str, windows) -> DataFrame:
    schema = T.StructType([*docs.schema.fields, T.StructField(report, REPORT)])

    def scan(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns, _scan(batch, text, windows.value)], names=[*batch.schema.names, report])

    return docs.mapInArrow(scan, schema)


def _join_spans(flat: list[int]) -> list[int]:
    out: list[int] = []
    for a, b in sorted(zip(flat[::2], flat[1::2], strict=True)):
        if out and a <= out[-1]:
            out[-1] = max(out[-1], b)
        else:
            out += [a, b]
    return out


def contamination(docs: DataFrame, benchmark: DataFrame, n: int = 10, text: str = "text", item_id: str = "item_id", item_text: str = "text", block_bytes: int = BLOCK_BYTES) -> tuple[DataFrame, str]:
    """``docs`` with one more column, and its name: struct(n_words, spans, items), spans as flat [from, to) word numbers."""
    spark = docs.sparkSession
    report = fresh("contamination", docs.columns)
    items = benchmark.select(F.coalesce(F.col(item_id).cast("string"), F.lit("")).alias("id"), F.col(item_text).alias("text"))
    total = items.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("b")).first()["b"]
    blocks = total // block_bytes + 1

    def block(k: int):
        rows = items.where(F.pmod(F.xxhash64("id", "text"), F.lit(blocks)) == k).collect()
        return spark.sparkContext.broadcast(WindowSet([(r.id, r.text) for r in rows], n))

    if blocks == 1:
        return _with_report(docs, report, text, block(0)), report
    key = fresh("row_key", docs.columns)
    numbered = staged(docs.withColumn(key, F.monotonically_increasing_id()), "decontaminate")
    parts = None
    for k in range(blocks):
        part = _with_report(numbered.select(key, text), report, text, block(k)).select(key, report)
        part = part.where(F.size(f"{report}.items") > 0) if k else part
        parts = part if parts is None else parts.unionByName(part)
    spans = F.udf(_join_spans, "array<long>")
    joined = parts.groupBy(key).agg(
        F.max(f"{report}.n_words").alias("n_words"),
        spans(F.flatten(F.collect_list(f"{report}.spans"))).alias("spans"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list(f"{report}.items")))).alias("items"),
    )
    joined = joined.select(F.col(key).alias("k"), F.struct("n_words", "spans", "items").alias("r"))
    return numbered.join(joined, numbered[key] == joined["k"]).select(*[numbered[c] for c in docs.columns], joined["r"].alias(report)), report


def hit_words(report: str):
    """Number of hit words in the column that ``contamination`` adds."""
    at = F.sequence(F.lit(0), F.size(f"{report}.spans") - 2, F.lit(2))
    sizes = F.transform(at, lambda i: F.col(f"{report}.spans")[i + 1] - F.col(f"{report}.spans")[i])
    return F.when(F.size(f"{report}.spans") > 0, F.aggregate(sizes, F.lit(0).cast("long"), lambda a, x: a + x)).otherwise(F.lit(0).cast("long"))


def decontaminate(docs: DataFrame, benchmark: DataFrame, action: str = "drop", n: int = 10, text: str = "text", **names) -> DataFrame:
    """``docs`` without contaminated documents (``drop``) or without their hit spans (``cut``); columns as in ``docs``."""
    if action not in ("drop", "cut"):
        raise ValueError(f"action must be drop or cut: {action}")
    found, report = contamination(docs, benchmark, n, text, **names)
    if action == "drop":
        return found.where(F.size(f"{report}.items") == 0).select(*[f"`{c}`" for c in docs.columns])
    schema = docs.schema

    def cut(batches):
        for batch in batches:
            spans = batch.column(batch.schema.get_field_index(report)).field("spans").to_pylist()
            at = batch.schema.get_field_index(text)
            new = batch.column(at).to_pylist()
            for w in word_tables(batch.column(at), ALNUM):
                for k in range(w.texts):
                    mine = spans[w.first + k]
                    if not mine:
                        continue
                    raw, base = w.data[w.offsets[k] : w.offsets[k + 1]].tobytes(), w.offsets[k]
                    s, e = w.starts[w.bounds[k] : w.bounds[k + 1]] - base, w.ends[w.bounds[k] : w.bounds[k + 1]] - base
                    left, kept = 0, []
                    for a, b in zip(mine[::2], mine[1::2], strict=True):
                        kept.append(raw[left : s[a]])
                        left = e[b - 1]
                    new[w.first + k] = b"".join([*kept, raw[left:]]).decode()
            columns = [pa.array(new, pa.string()) if f == text else batch.column(i) for i, f in enumerate(batch.schema.names) if f != report]
            yield pa.RecordBatch.from_arrays(columns, names=[f for f in batch.schema.names if f != report])

    return found.mapInArrow(cut, schema)


def digest(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Per document: doc_id, n_words, n_hit, n_items, items_sha256, contaminated."""
    found, report = contamination(docs.select("doc_id", "text"), benchmark)
    hits = hit_words(report)
    return found.select(
        "doc_id",
        F.col(f"{report}.n_words").alias("n_words"),
        hits.alias("n_hit"),
        F.size(f"{report}.items").cast("long").alias("n_items"),
        F.sha2(F.array_join(f"{report}.items", ","), 256).alias("items_sha256"),
        (hits > 0).alias("contaminated"),
    )


DIGEST_SQL = r"""
WITH low AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
items AS (
  SELECT coalesce(CAST(item_id AS VARCHAR), '') AS id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
sized AS (SELECT id, w, least(10, len(w)) AS n FROM items WHERE len(w) > 0),
known AS (SELECT DISTINCT id, n, array_to_string(w[i : i + n - 1], ' ') AS k FROM (SELECT id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM sized)),
windows AS (SELECT r, n, i, array_to_string(w[i : i + n - 1], ' ') AS k FROM (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM low, (SELECT DISTINCT n FROM known) WHERE len(w) >= n)),
hits AS (SELECT r, n, i, id FROM windows JOIN known USING (n, k)),
covered AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(i, i + n)) AS p FROM (SELECT DISTINCT r, n, i FROM hits)) GROUP BY r),
owned AS (SELECT r, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS ids FROM (SELECT DISTINCT r, id FROM hits) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM low LEFT JOIN covered USING (r) LEFT JOIN owned USING (r)
"""

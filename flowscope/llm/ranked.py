"""Exact ranked search of texts for the best documents of each query text, by range maxima over posting lists.

An index row is a document with its number of terms and, of the terms that queries hold, those that occur in it and how often. A task
takes index rows in blocks. In a block each term has a posting list in the order of the documents (by length), with the document's impact
for the term, and a sparse table over it that answers the largest impact of any stretch. The sum of these answers over a query's terms bounds every document of an
interval. Intervals are taken best first: the document with the largest single impact is scored in full and splits its interval in two, each with
bounds of its own, and what is bounded below the query's k-th score is left. All queries go on together, a few intervals of each at a time.

Scores are integers, see ``Weights``. Terms are told apart by 64-bit codes. A query block is the only thing that is broadcast, and it is
of bounded size; the documents are read once for each block. A task gives at most k documents a query, and these are merged in two steps.

Cases: null and empty texts have no terms, and documents without terms don't count; queries without terms or matches have no rows; a repeated query (also of one id) is
ranked apart, and so is a repeated document; a null document id comes after all others; empty tables give no rows; a document of any length is one index row.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from .store import staged
from .words import ALNUM, word_tables

K = 10
#: Bytes of queries (and 16 a query) that are searched together.
BLOCK_BYTES = 8_000_000
#: Postings of a block of documents: a dozen times 8 bytes each.
POSTINGS = 500_000
#: Intervals of a query that are split in the first round; it doubles up to the second number.
WIDTH = 4, 256
_DOC_BITS = 24
_SLICES = 64


@dataclass
class Weights:
    """Term weights floor(1000 ln((2N+2)/(2df+1))) and, of a document with n terms, m = 10 + 90nN div L, for N documents with L terms."""

    documents: int
    terms: int
    term: np.ndarray

    def impacts(self, term: np.ndarray, tf: np.ndarray, n: np.ndarray) -> np.ndarray:
        if len(n) and int(n.max()) * 90 * self.documents >= 1 << 63:
            n = n.astype(object)
        m = (10 + 90 * n * self.documents // max(self.terms, 1)).astype(np.int64)
        return self.term[term] * (1_000_000_000 * tf // (1000 * tf + 8 * m))


def weights(index: DataFrame, vocabulary: int) -> Weights:
    """Counts over all documents; the driver gets a number for each term of the query block."""
    whole = index.agg(F.count("*").alias("n"), F.coalesce(F.sum("n"), F.lit(0)).alias("l")).first()
    found = index.select(F.explode("terms").alias("t")).groupBy("t").count().toPandas()
    df = np.zeros(vocabulary, np.int64)
    df[found["t"].to_numpy(np.int64)] = found["count"].to_numpy(np.int64)
    return Weights(whole.n, whole.l, np.floor(1000 * np.log((2 * whole.n + 2) / (2 * df + 1))).astype(np.int64))


def index(docs: DataFrame, codes: np.ndarray, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n, and of the terms with the sorted ``codes`` the numbers and counts: a row for each document with terms."""
    held = docs.sparkSession.sparkContext.broadcast(codes)

    def run(batches):
        vocabulary = held.value
        for batch in batches:
            for w in word_tables(batch.column(1), ALNUM):
                place = np.searchsorted(vocabulary, w.codes)
                mine = vocabulary[np.minimum(place, len(vocabulary) - 1)] == w.codes if len(vocabulary) else np.zeros(len(place), bool)
                pairs, tf = np.unique(w.text[mine] * max(len(vocabulary), 1) + place[mine], return_counts=True)
                doc, term = np.divmod(pairs, max(len(vocabulary), 1))
                n = np.diff(w.bounds)
                kept = np.flatnonzero(n)
                offs = pa.array(np.append(np.searchsorted(doc, kept), len(doc)).astype(np.int32))
                lists = [pa.ListArray.from_arrays(offs, pa.array(x.astype(np.int32))) for x in (term, tf)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(w.first, w.texts).take(pa.array(kept)), pa.array(n[kept]), *lists], names=["doc_id", "n", "terms", "tfs"])

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), text).mapInArrow(run, "doc_id long, n long, terms array<int>, tfs array<int>")


class Best:
    """The best k documents of each query so far."""

    def __init__(self, queries: int, k: int):
        self.k, self.least = k, np.ones(queries, np.int64)
        self.rows = pd.DataFrame({"q": np.empty(0, np.int64), "score": np.empty(0, np.int64), "null": np.empty(0, bool), "id": np.empty(0, np.int64)})

    def add(self, q: np.ndarray, score: np.ndarray, null: np.ndarray, ids: np.ndarray) -> None:
        good = score >= self.least[q]
        if not good.any():
            return
        new = pd.DataFrame({"q": q[good], "score": score[good], "null": null[good], "id": ids[good]})
        rows = pd.concat([self.rows, new], ignore_index=True)
        rows = rows.iloc[np.lexsort((rows["id"], rows["null"], -rows["score"], rows["q"]))]
        at = rows["q"].to_numpy()
        place = np.arange(len(at)) - np.searchsorted(at, at)
        self.rows = rows[place < self.k].reset_index(drop=True)
        last = rows[place == self.k - 1]
        self.least[last["q"]] = np.maximum(last["score"], 1)


class Block:
    """Posting lists of some documents, one list after the other, with range maxima."""

    def __init__(self, ids: np.ndarray, null: np.ndarray, doc: np.ndarray, term: np.ndarray, impact: np.ndarray, vocabulary: int):
        self.ids, self.null, self.count = ids, null, len(ids)
        key = term.astype(np.int64) * self.count + doc
        order = np.argsort(key)
        self.key, self.impact = key[order], impact[order]
        self.lists = np.searchsorted(self.key, np.arange(vocabulary + 1, dtype=np.int64) * self.count)
        # the largest impact and its document, of 1, 2, 4 ... postings from each place
        self.maxima = [self.impact << _DOC_BITS | doc[order]]
        for j in range(1, int(np.diff(self.lists).max(initial=1)).bit_length()):
            half, last = 1 << (j - 1), self.maxima[-1]
            self.maxima.append(np.concatenate((np.maximum(last[:-half], last[half:]), last[-half:])))
        self.maxima = np.stack(self.maxima)

    def largest(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Of each stretch of postings [a, b)."""
        level = np.frexp((b - a).astype(float))[1] - 1
        return np.maximum(self.maxima[level, a], self.maxima[level, b - (1 << level)])

    def search(self, queries: list[np.ndarray], best: Best) -> int:
        """Adds this block's documents to ``best``; gives the number of scored documents."""
        q = np.repeat(np.arange(len(queries)), [len(t) for t in queries])
        term = np.concatenate([*queries, np.empty(0, np.int64)]).astype(np.int64)
        held = Intervals.of(self, q, self.lists[term], self.lists[term + 1])
        width, scored = WIDTH[0], 0
        while len((held := held.at_least(best.least)).q):
            chosen = held.best(width)
            width = min(2 * width, WIDTH[1])
            now, held = held.pick(chosen), held.pick(~chosen)
            iv = np.repeat(np.arange(len(now.q)), now.size)
            want = self.key[now.a] // self.count * self.count + now.doc[iv]
            p = np.searchsorted(self.key, want)
            hit = (p < now.b) & (self.key[np.minimum(p, len(self.key) - 1)] == want)
            score = np.bincount(iv[hit], self.impact[p[hit]], len(now.q)).astype(np.int64)  # below 2^53, so exact
            best.add(now.q, score, self.null[now.doc], self.ids[now.doc])
            scored += len(now.q)
            left, right = Intervals.of(self, iv, now.a, p), Intervals.of(self, iv, p + hit, now.b)
            left.q, right.q = now.q[left.q], now.q[right.q]
            held = held.with_(left.at_least(best.least)).with_(right.at_least(best.least))
        return scored


@dataclass
class Intervals:
    """Intervals of documents: query, bound, splitting document, and a stretch of postings [a, b) for each term that occurs there."""

    q: np.ndarray
    bound: np.ndarray
    doc: np.ndarray
    size: np.ndarray
    a: np.ndarray
    b: np.ndarray

    @staticmethod
    def of(block: Block, owner: np.ndarray, a: np.ndarray, b: np.ndarray) -> Intervals:
        """An interval for each owner (in order) with postings; its ``q`` is the owner."""
        some = b > a
        owner, a, b = owner[some], a[some], b[some]
        first = np.flatnonzero(np.diff(owner, prepend=-1))
        if not len(first):
            return Intervals(*[np.empty(0, np.int64)] * 6)
        top = block.largest(a, b)
        return Intervals(owner[first], np.add.reduceat(top >> _DOC_BITS, first), np.maximum.reduceat(top, first) & ((1 << _DOC_BITS) - 1), np.diff(first, append=len(a)), a, b)

    def pick(self, which: np.ndarray) -> Intervals:
        wide = np.repeat(which, self.size)
        return Intervals(self.q[which], self.bound[which], self.doc[which], self.size[which], self.a[wide], self.b[wide])

    def at_least(self, least: np.ndarray) -> Intervals:
        good = self.bound >= least[self.q]
        return self if good.all() else self.pick(good)

    def best(self, width: int) -> np.ndarray:
        """Marks the ``width`` best intervals of each query."""
        order = np.lexsort((-self.bound, self.q))
        at = self.q[order]
        out = np.zeros(len(at), bool)
        out[order[np.arange(len(at)) - np.searchsorted(at, at) < width]] = True
        return out

    def with_(self, more: Intervals) -> Intervals:
        return Intervals(*[np.concatenate((getattr(self, f), getattr(more, f))) for f in ("q", "bound", "doc", "size", "a", "b")])


def _blocks(batches, limit: int):
    """Index rows in blocks of about ``limit`` postings, in order of length: ids, nulls, n, postings a document, terms, counts."""
    held, size = [], 0

    def one():
        rows = pa.Table.from_batches(held).combine_chunks()
        rows = rows.take(pa.array(np.lexsort((rows["doc_id"].fill_null(0).to_numpy(), rows["n"].to_numpy())))).combine_chunks().to_batches()[0]
        each = np.diff(rows["terms"].offsets.to_numpy())
        return rows["doc_id"].fill_null(0).to_numpy(), rows["doc_id"].is_null().to_numpy(zero_copy_only=False), rows["n"].to_numpy(), each, rows["terms"].flatten().to_numpy().astype(np.int64), rows["tfs"].flatten().to_numpy().astype(np.int64)

    for batch in batches:
        upto = np.cumsum(batch["terms"].value_lengths().to_numpy())
        a = 0
        while a < len(upto):
            before = int(upto[a - 1]) if a else 0
            b = max(a + 1, int(np.searchsorted(upto, before + limit - size, side="right")))
            held.append(batch.slice(a, b - a))
            size += int(upto[b - 1]) - before
            a = b
            if size >= limit or a < len(upto):
                yield one()
                held, size = [], 0
    if held:
        yield one()


def _search_block(docs: DataFrame, items: list[tuple[int, str]], k: int, doc_id: str, text: str, postings: int) -> DataFrame:
    """item (its number), doc_id, score: the best k of each task for each item."""
    spark = docs.sparkSession
    tables = list(word_tables(pa.array([t for _, t in items], pa.large_string()), ALNUM))
    codes = np.unique(np.concatenate([*[w.codes for w in tables], np.empty(0, np.uint64)]))
    numbers = np.array([i for i, _ in items], np.int64)
    queries = [np.searchsorted(codes, np.unique(w.codes[a:b])) for w in tables for a, b in zip(w.bounds.tolist(), w.bounds[1:].tolist())]
    rows = staged(index(docs, codes, doc_id, text), "ranked-index")
    weight = weights(rows, len(codes))
    queries = [t[weight.term[t] > 0] for t in queries]  # other terms add nothing
    held = spark.sparkContext.broadcast((weight, queries, numbers))

    def run(batches):
        weight, queries, numbers = held.value
        best = Best(len(queries), k)
        for ids, null, n, each, term, tf in _blocks(batches, postings):
            doc = np.repeat(np.arange(len(ids)), each)
            Block(ids, null, doc, term, weight.impacts(term, tf, n[doc]), len(weight.term)).search(queries, best)
        yield pa.RecordBatch.from_arrays([pa.array(numbers[best.rows["q"]]), pa.array(best.rows["id"], mask=best.rows["null"].to_numpy()), pa.array(best.rows["score"])], names=["item", "doc_id", "score"])

    return rows.mapInArrow(run, "item long, doc_id long, score long")


def search(docs: DataFrame, queries: DataFrame, k: int = K, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", block_bytes: int = BLOCK_BYTES, postings: int = POSTINGS) -> DataFrame:
    """item_id, rank (from 1), doc_id, score: the k best documents of each query with a score above 0, equal scores by ascending id."""
    spark = docs.sparkSession
    numbered = staged(queries.select(F.monotonically_increasing_id().alias("item"), F.col(item_id).alias("item_id"), F.coalesce(F.col(item_text), F.lit("")).alias("t")), "ranked-queries")
    total = numbered.agg(F.coalesce(F.sum(F.octet_length("t") + 16), F.lit(0)).alias("b")).first()["b"]
    blocks = total // block_bytes + 1
    found = None
    for j in range(blocks):
        items = [(r.item, r.t) for r in numbered.where(F.pmod(F.xxhash64("item"), F.lit(blocks)) == j).select("item", "t").collect()]
        part = staged(_search_block(docs, items, k, doc_id, text, postings), "ranked-found")
        found = part if found is None else found.unionByName(part)
    order = F.desc("score"), F.asc_nulls_last("doc_id")
    some = found.withColumn("place", F.row_number().over(Window.partitionBy("item", F.pmod(F.xxhash64("doc_id", "score"), F.lit(_SLICES))).orderBy(*order))).where(F.col("place") <= k)
    whole = some.withColumn("rank", F.row_number().over(Window.partitionBy("item").orderBy(*order))).where(F.col("rank") <= k)
    return whole.join(numbered.select("item", "item_id"), "item").select("item_id", "rank", "doc_id", "score")


def digest(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    return search(docs.select("doc_id", "text"), benchmark.select("item_id", "text"))


DIGEST_SQL = r"""
WITH doc_terms AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
held AS MATERIALIZED (SELECT r, doc_id, w, CAST(len(w) AS BIGINT) AS n FROM doc_terms WHERE len(w) > 0),
whole AS (SELECT CAST(count(*) AS BIGINT) AS n_docs, CAST(sum(n) AS BIGINT) AS n_terms FROM held),
item_terms AS MATERIALIZED (
  SELECT DISTINCT item, item_id, unnest(w) AS t FROM (
    SELECT row_number() OVER () AS item, item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM benchmark)),
counts AS MATERIALIZED (SELECT r, t, CAST(count(*) AS BIGINT) AS tf FROM (SELECT r, unnest(w) AS t FROM held) WHERE t IN (SELECT t FROM item_terms) GROUP BY r, t),
weights AS (SELECT t, CAST(floor(1000 * ln(CAST(2 * n_docs + 2 AS DOUBLE) / CAST(2 * count(*) + 1 AS DOUBLE))) AS BIGINT) AS w FROM counts, whole GROUP BY t, n_docs),
impacts AS (
  SELECT r, t, doc_id, weights.w * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 90 + (90 * n * n_docs) // n_terms))) AS impact
  FROM counts JOIN weights USING (t) JOIN held USING (r), whole),
scores AS (SELECT item, item_id, r, doc_id, CAST(sum(impact) AS BIGINT) AS score FROM item_terms JOIN impacts USING (t) GROUP BY item, item_id, r, doc_id)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY item ORDER BY score DESC, doc_id NULLS LAST) AS rank FROM scores WHERE score > 0)
WHERE rank <= 10
"""

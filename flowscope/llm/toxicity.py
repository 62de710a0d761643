"""Toxicity by a chain of linear classifiers.

Categories are predicted one after the other; each model sees the words of the text, a few figures of its shape, and the
probabilities of the categories before it. While the chain is trained, those are out-of-fold predictions, so that a later
model learns how far to trust an earlier one. The thresholds are chosen on out-of-fold predictions too.

Features are hashed words and their 4-, 5- and 6-byte beginnings, as present or absent in the whole text. Their document
counts by category are summed over the training rows by Spark, and the ``SELECTED`` strongest signs of each category are
kept. Training rows are a bounded sample of the labelled documents (``LABELLED``, by a hash of the id); scoring covers
every document and needs no shuffle.

Cases: null and empty texts, and texts without a letter or digit, have probability 0 in every category; labels that are null, or of documents that are missing, are no examples;
several labels of one document count as toxic if any does; without examples of both kinds a category has one constant
probability (that of the examples, or 0), which rejects nothing unless it is at least one half.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from .store import fresh, staged
from .words import ALNUM, LOWER, buffers, chunks, word_tables

#: Training rows at most, and selected words of a category.
LABELLED = 20_000
SELECTED = 2048
BITS = 20
FOLDS = 3
#: Training steps at most, and the largest part of the gradient at which they end sooner.
STEPS = 600
GRADIENT = 1e-5
PREFIXES = (4, 5, 6)
#: In the order of the chain: what a label row says of a document.
CATEGORIES = {"low_quality": "CAST(quality = 0 AS INT)", "toxic": "CAST(toxic = 1 AS INT)"}


def _features(column: pa.Array):
    """For groups of texts: number of the first, number of texts, (text, feature) pairs."""
    for w in word_tables(column, ALNUM):
        text, code = [w.text], [w.codes]
        for size in PREFIXES:
            at, codes = w.prefix_codes(size)
            text.append(w.text[at])
            code.append(codes)
        yield w.first, w.texts, np.concatenate(text), (np.concatenate(code) >> np.uint64(64 - BITS)).astype(np.int64)


def _shape(column: pa.Array) -> np.ndarray:
    """Shares of capitals, digits, blanks and signs, and the logarithm of the length, of each text."""
    data, offs = buffers(column)
    data, offs = data[offs[0] : offs[-1]], offs - offs[0]
    size = np.diff(offs)
    out = [np.log1p(size)]
    for inside in ((65, 90), (48, 57), (0, 32), (33, 47), (91, 126)):
        hit = np.concatenate(([0], np.cumsum((data >= inside[0]) & (data <= inside[1]), dtype=np.int64)))
        if inside == (91, 126):
            hit -= np.concatenate(([0], np.cumsum((data >= 97) & (data <= 122), dtype=np.int64)))
        out.append(np.diff(hit[offs]) / np.maximum(size, 1))
    return np.stack(out, 1)


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _fit(rows: np.ndarray, cols: np.ndarray, dense: np.ndarray, width: int, y: np.ndarray, ridge: float = 0.5) -> tuple[np.ndarray, np.ndarray, float]:
    """Logistic regression on present features and dense columns, by accelerated gradient steps, until the gradient is small (``STEPS`` at most)."""
    n = len(y)
    base = float(np.log((y.sum() + 0.5) / (n - y.sum() + 0.5)))
    w, d, b = np.zeros(width), np.zeros(dense.shape[1]), base
    per_row = np.bincount(rows, minlength=n)
    step = 4.0 / (1 + np.quantile(per_row, 0.98) + dense.shape[1])
    now, last, t = (w, d, b), (w, d, b), 1.0
    for _ in range(STEPS):
        t, before = (1 + np.sqrt(1 + 4 * t * t)) / 2, t
        look = [x + (before - 1) / t * (x - p) for x, p in zip(now, last, strict=True)]
        z = look[2] + dense @ look[1] + np.bincount(rows, weights=look[0][cols], minlength=n)
        error = _sigmoid(z) - y
        grad = (np.bincount(cols, weights=error[rows], minlength=width) + ridge * look[0]) / n, (dense.T @ error + ridge * look[1]) / n, error.mean()
        rate = step * np.array([n / max(y.sum(), 1), 1, 1]).clip(1, 12)
        last, now = now, tuple(x - r * g for x, r, g in zip(look, rate, grad, strict=True))
        if max(np.abs(g).max(initial=0) for g in grad) < GRADIENT:
            break
    return now


def _scaled(shape: np.ndarray, mean: np.ndarray, scale: np.ndarray) -> np.ndarray:
    """Standardised, and held within five deviations so that odd texts aren't judged by their shape alone."""
    return np.clip((shape - mean) / scale, -5, 5)


def _wordless(column: pa.Array) -> np.ndarray:
    """Numbers of the texts without a letter or digit."""
    data, offs = buffers(column)
    data, offs = data[offs[0] : offs[-1]], offs - offs[0]
    inside = np.concatenate(([0], np.cumsum(ALNUM[LOWER[data]], dtype=np.int64)))
    return np.flatnonzero(inside[offs[1:]] == inside[offs[:-1]])


@dataclass
class Chain:
    """Fitted models in order; ``place`` maps a hashed word to its column, or to -1."""

    names: list[str]
    place: np.ndarray
    mean: np.ndarray
    scale: np.ndarray
    words: list[np.ndarray] = field(default_factory=list)
    dense: list[np.ndarray] = field(default_factory=list)
    bias: list[float] = field(default_factory=list)
    thresholds: list[float] = field(default_factory=list)

    def score(self, column: pa.Array) -> np.ndarray:
        """A column of probabilities for each category; texts are taken a few megabytes at a time."""
        parts = [self._score(column.slice(first, len(offs) - 1)) for first, _, offs in chunks(column)]
        return np.concatenate(parts) if parts else np.empty((0, len(self.names)))

    def _score(self, column: pa.Array) -> np.ndarray:
        seen = _scaled(_shape(column), self.mean, self.scale)
        rows, cols = self.present(column)
        wordless = _wordless(column)
        out = []
        for w, d, b in zip(self.words, self.dense, self.bias, strict=True):
            out.append(_sigmoid(b + seen @ d + np.bincount(rows, weights=w[cols], minlength=len(column))))
            out[-1][wordless] = 0.0
            seen = np.column_stack((seen, out[-1]))
        return np.stack(out, 1)

    def present(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(text, column) pairs of the selected words that a text holds."""
        width = max(int(self.place.max(initial=-1)) + 1, 1)
        pairs = [np.empty(0, np.int64)]
        for first, _, text, feature in _features(column):
            col = self.place[feature]
            hit = col >= 0
            pairs.append(np.unique((first + text[hit]) * width + col[hit]))
        pairs = np.concatenate(pairs)
        return pairs // width, pairs % width


def examples(docs: DataFrame, labels: DataFrame, categories: dict[str, str] = CATEGORIES, limit: int = LABELLED, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """text, y (0 or 1 for each category), fold: at most ``limit`` labelled documents, chosen by a hash of the id."""
    known = labels.groupBy(F.col(doc_id).alias("of")).agg(*[F.max(F.expr(c)).alias(f"y{i}") for i, c in enumerate(categories.values())]).dropna()
    chosen = known.orderBy(F.xxhash64("of"), "of").limit(limit)
    y = F.array(*[F.col(f"y{i}").cast("double") for i in range(len(categories))])
    return docs.select(F.col(doc_id).alias("id"), F.col(text).alias("text")).join(F.broadcast(chosen), F.col("id") == F.col("of")).select("text", y.alias("y"), F.pmod(F.xxhash64("id", F.lit("fold")), F.lit(FOLDS)).cast("int").alias("fold"))


def _select(rows: DataFrame, count: int, selected: int) -> np.ndarray:
    """Hashed words that are the strongest signs of each category: a table from feature to column, -1 elsewhere."""
    def counts(batches):
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            y = np.array(batch.column(1).to_pylist(), float).reshape(-1, count)
            for first, _, text, feature in _features(batch.column(0)):
                pairs = np.unique(text * (1 << BITS) + feature)
                t, f = pairs >> BITS, pairs & ((1 << BITS) - 1)
                names, at = np.unique(f, return_inverse=True)
                held = np.stack([np.bincount(at), *[np.bincount(at, weights=y[first + t, c]) for c in range(count)]], 1)
                for name, h in zip(names.tolist(), held, strict=True):
                    total[name] = total[name] + h if name in total else h
        if total:
            yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int64()), *[pa.array(np.array([h[c] for h in total.values()])) for c in range(count + 1)]], names=["feature", "n", *[f"n{c}" for c in range(count)]])

    columns = [f"n{c}" for c in range(count)]
    summed = staged(rows.select("text", "y").mapInArrow(counts, "feature long, n double, " + ", ".join(f"{c} double" for c in columns)).groupBy("feature").agg(*[F.sum(c).alias(c) for c in ["n", *columns]]), "word-counts")
    sizes = rows.agg(F.count("*").alias("n"), *[F.sum(F.col("y")[c]).alias(f"n{c}") for c in range(count)]).first()
    place = np.full(1 << BITS, -1, np.int32)
    chosen: dict[int, int] = {}
    for c, name in enumerate(columns):
        pos, neg = sizes[name] or 0, (sizes["n"] or 0) - (sizes[name] or 0)
        if not pos or not neg:
            continue
        p = F.col("n") / (pos + neg)
        z = (F.col(name) / pos - (F.col("n") - F.col(name)) / neg) / F.sqrt(p * (1 - p) * (1 / pos + 1 / neg) + 1e-12)
        for r in summed.where(F.col(name) >= 3).withColumn("z", z).where("z > 3").orderBy(F.desc("z"), "feature").limit(selected).collect():
            chosen.setdefault(r["feature"], len(chosen))
    for feature, column in chosen.items():
        place[feature] = column
    return place


def fit(docs: DataFrame, labels: DataFrame, categories: dict[str, str] = CATEGORIES, limit: int = LABELLED, selected: int = SELECTED, **names) -> Chain:
    count = len(categories)
    rows = staged(examples(docs, labels, categories, limit, **names), "examples")
    place = _select(rows, count, selected)
    chain = Chain(list(categories), place, np.zeros(6), np.ones(6))

    def present(batches):
        for batch in batches:
            r, c = chain.present(batch.column(0))
            held = np.split(c, np.searchsorted(r, np.arange(1, batch.num_rows)))
            shape = np.concatenate([_shape(batch.column(0).slice(first, len(offs) - 1)) for first, _, offs in chunks(batch.column(0))] or [np.empty((0, 6))])
            yield pa.RecordBatch.from_arrays([pa.array([x.tolist() for x in held[: batch.num_rows]], pa.list_(pa.int64())), pa.array(shape.tolist(), pa.list_(pa.float64())), batch.column(1), batch.column(2)], names=["cols", "shape", "y", "fold"])

    data = rows.mapInArrow(present, "cols array<long>, shape array<double>, y array<double>, fold int").toPandas()
    if data.empty:
        chain.words, chain.dense = [np.zeros(1)] * count, [np.zeros(6 + c) for c in range(count)]
        chain.bias, chain.thresholds = [-30.0] * count, [0.5] * count
        return chain
    width = max(int(place.max()) + 1, 1)
    lengths = data["cols"].map(len).to_numpy()
    r, c = np.repeat(np.arange(len(data)), lengths), np.concatenate(data["cols"].to_list()).astype(np.int64)
    shape, y, fold = np.stack(data["shape"].to_list()), np.stack(data["y"].to_list()), data["fold"].to_numpy()
    chain.mean, chain.scale = shape.mean(0), shape.std(0) + 1e-9
    seen = _scaled(shape, chain.mean, chain.scale)
    for k in range(count):
        target = y[:, k]
        if 0 < target.sum() < len(target):
            held_out = np.empty(len(target))
            for f in range(FOLDS):
                train, test = fold != f, fold == f
                if not test.any():
                    continue
                if not 0 < target[train].sum() < train.sum():
                    held_out[test] = target[train].mean() if train.any() else target.mean()
                    continue
                index = np.cumsum(train) - 1
                own = train[r]
                w, d, b = _fit(index[r[own]], c[own], seen[train], width, target[train])
                z = b + seen @ d + np.bincount(r, weights=w[c], minlength=len(data))
                held_out[test] = _sigmoid(z)[test]
            w, d, b = _fit(r, c, seen, width, target)
        else:
            share = float(target.mean())
            w, d, b = np.zeros(width), np.zeros(seen.shape[1]), 30.0 if share else -30.0
            held_out = np.full(len(target), share)
        chain.words.append(w)
        chain.dense.append(d)
        chain.bias.append(float(b))
        chain.thresholds.append(_threshold(held_out, target))
        seen = np.column_stack((seen, held_out))
    return chain


def _threshold(p: np.ndarray, y: np.ndarray) -> float:
    """The middle of the best cuts by F1, or one half without examples of both kinds."""
    if not 0 < y.sum() < len(y):
        return 0.5
    grid = np.linspace(0.05, 0.95, 91)
    f1 = [2 * ((p >= t) & (y > 0)).sum() / ((p >= t).sum() + y.sum()) for t in grid]
    best = grid[np.array(f1) >= max(f1) - 1e-12]
    return float(best[np.abs(best - 0.5).argmin()])


def score(docs: DataFrame, chain: Chain, text: str = "text") -> tuple[DataFrame, str]:
    """``docs`` with one more column, and its name: struct of a probability and a flag for each category."""
    name = fresh("categories", docs.columns)
    kind = T.StructType([f for c in chain.names for f in (T.StructField(f"p_{c}", T.DoubleType()), T.StructField(c, T.BooleanType()))])
    model = docs.sparkSession.sparkContext.broadcast(chain)

    def run(batches):
        for batch in batches:
            c = model.value
            p = c.score(batch.column(batch.schema.get_field_index(text)))
            arrays = [a for k, t in enumerate(c.thresholds) for a in (pa.array(p[:, k]), pa.array(p[:, k] >= t))]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.StructArray.from_arrays(arrays, kind.names)], names=[*batch.schema.names, name])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField(name, kind)])), name


def reject(docs: DataFrame, labels: DataFrame, category: str = "toxic", **options) -> DataFrame:
    """``docs`` without those of the category; columns as in ``docs``."""
    scored, name = score(docs, fit(docs, labels, **options))
    return scored.where(~F.col(name)[category]).select(*[f"`{c}`" for c in docs.columns])


def digest(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Per document: doc_id, p_low_quality, low_quality, p_toxic, toxic."""
    scored, name = score(docs.select("doc_id", "text"), fit(docs, labels))
    return scored.select("doc_id", *[F.col(f"{name}.{c}").alias(c) for k in CATEGORIES for c in (f"p_{k}", k)])

"""Scores of texts by a causal self-attention model on subword ids, and by a smoothed word-frequency base.

Words. Counts of all training tokens are made without a row for each token: every few megabytes of text (a piece) sends
its distinct words, packed by hash bucket; a bucket sums each word's counts over all pieces and sends them back to the
pieces that asked. A frequent word costs one entry a piece, so nothing grows with its frequency.

Model (``attention``). One layer of masked self-attention over the last ids. Every id of the training documents has a place and an
input row of its own. It is trained in numpy on all training documents, at every size: the first ``SHARD_TOKENS`` ids warm the
parameters up, so that all tasks go on in one basin; then each task learns from the pieces that it reads, one after the
other, and the parameters are averaged by the ids learnt, in ``ROUNDS`` passes, each over another part of every document's
windows, so that each id is learnt once (those of the warm-up twice). A task sends one set of parameters, in chunks.

Scoring. Each document is cut into windows that overlap by ``CONTEXT`` ids; a window scores its own ``STEP`` ids, each
once, with attention batched over windows. The text's end is scored too.

Cases: null and empty texts hold the end alone; a null doc_id counts as empty text when documents are held out; without
training documents the model is uniform and no token is known; repeated rows are scored each; an empty table gives no rows.
"""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from ..together import all_together
from .attention import CONTEXT, Model
from .store import new_path, staged
from .subwords import default_path, encoder
from .words import NOT_BLANK, word_tables

#: Ids of the default tokenizer; another tokenizer may have up to 65,535.
VOCABULARY = 50_257
#: Bounds of a model's classes and of their members; it takes as many as its ids need.
CLASSES, MEMBERS = 256, 257
#: Passes over the pieces; ids of the warm-up; rates of the warm-up, the first and the last pass.
ROUNDS = 2
SHARD_TOKENS = 2_000_000
WARM_RATE, FIRST_RATE, LAST_RATE = 0.02, 0.012, 0.003
CHUNK = 1024
PIECE = 2_000_000
BUCKET_BYTES = 32_000_000
_END_WORD = np.array([0x5EED_0F_7E_87_E4_D0], np.uint64)
_SCHEMA = "kind int, piece long, bucket int, a binary, b binary, c binary, docs array<long>"
_KINDS = [pa.int32(), pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.binary(), pa.list_(pa.int64())]


def held_out(doc_id: int | None) -> bool:
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % 5 == 1


def _pieces(docs: DataFrame, buckets: int, tokenizer: str) -> DataFrame:
    """Kind 0: a piece's words of a bucket and their training counts. 1: word, document and frequency. 2: subword ids."""
    def cut(batches):
        number = TaskContext.get().partitionId() << 32
        for batch in batches:
            ids = batch.column(0).to_pylist()
            out = np.array([held_out(i) for i in ids])
            for w in word_tables(batch.column(1), NOT_BLANK, PIECE):
                n, mine = w.texts, out[w.first : w.first + w.texts]
                codes = np.concatenate((w.codes, np.repeat(_END_WORD, n)))
                text = np.concatenate((w.text, np.arange(n)))
                at, words = pd.factorize(codes)
                order = np.argsort(words)
                words, at = words[order], np.argsort(order)[at]
                pairs, tf = np.unique(at * n + text, return_counts=True)
                word, text = pairs // n, pairs % n
                train = np.bincount(word, weights=tf * ~mine[text], minlength=len(words)).astype(np.uint32)
                edges = np.searchsorted(((words >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32), np.arange(buckets + 1))
                rows = [(0, number, k, words[a:b].tobytes(), train[a:b].tobytes(), None, None) for k, (a, b) in enumerate(zip(edges, edges[1:])) if b > a]
                rows.append((1, number, -1, word.astype(np.uint32).tobytes(), text.astype(np.uint32).tobytes(), tf.astype(np.uint32).tobytes(), None))
                sub, sizes = encoder(tokenizer)(batch.column(1).slice(w.first, n))
                rows.append((2, number, -1, sub.astype(np.uint16).tobytes(), sizes.astype(np.uint32).tobytes(), mine.astype(np.uint8).tobytes(), ids[w.first : w.first + n]))
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), _KINDS)], names=["kind", "piece", "bucket", "a", "b", "c", "docs"])
                number += 1

    return docs.mapInArrow(cut, _SCHEMA)


def _totals(key, pdf: pd.DataFrame) -> pd.DataFrame:
    """The training counts of a bucket's words over all pieces, for each piece; and the bucket's tokens and distinct words."""
    codes = [np.frombuffer(x, np.uint64) for x in pdf["a"]]
    words, at = np.unique(np.concatenate(codes), return_inverse=True)
    total = np.bincount(at, weights=np.concatenate([np.frombuffer(x, np.uint32) for x in pdf["b"]]), minlength=len(words)).astype(np.int64)
    cuts = np.cumsum([0, *map(len, codes)])
    rows = [(int(p), int(key[0]), total[at[a:b]].tobytes(), 0, 0) for p, a, b in zip(pdf["piece"], cuts, cuts[1:])]
    rows.append((-1, int(key[0]), None, int(total.sum()), int((total > 0).sum())))
    return pd.DataFrame(rows, columns=["piece", "bucket", "t", "tokens", "distinct"])


def _base(all_tokens: int, distinct: int):
    down = np.log10(all_tokens + 0.5 * (distinct + 1))

    def score(key, totals: pd.DataFrame, pairs: pd.DataFrame) -> pd.DataFrame:
        count = np.concatenate([np.frombuffer(x, np.int64) for x in totals.sort_values("bucket")["t"]])
        parts = []
        for a, b, c in zip(pairs["a"], pairs["b"], pairs["c"]):
            word, text, tf = (np.frombuffer(x, np.uint32) for x in (a, b, c))
            c = count[word]
            n = np.bincount(text, weights=tf)
            parts.append(pd.DataFrame({"piece": int(key[0]), "pos": np.arange(len(n)), "n_tokens": n.astype(np.int64), "n_known": np.bincount(text, weights=tf * (c > 0)).astype(np.int64), "base_score": np.bincount(text, weights=tf * np.log10(c + 0.5)) - n * down}))
        return pd.concat(parts)

    return score


def _streams(batch: pa.RecordBatch):
    """ids, sizes, held-out flags of each piece in a batch of kind 2."""
    for a, b, c in zip(*(batch.column(batch.schema.get_field_index(x)) for x in "abc"), strict=True):
        yield np.frombuffer(a.as_buffer(), np.uint16), np.frombuffer(b.as_buffer(), np.uint32), np.frombuffer(c.as_buffer(), np.uint8) > 0


def _chosen(ids: np.ndarray, sizes: np.ndarray, keep: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return ids[np.repeat(keep, sizes)], sizes[keep]


def _training(batches):
    """ids and sizes of the training documents of each piece."""
    for batch in batches:
        for ids, sizes, out in _streams(batch):
            kept = _chosen(ids, sizes, ~out)
            if len(kept[1]):
                yield kept


def _warm_up(pieces, limit: int):
    """Pieces until about ``limit`` ids are given."""
    n = 0
    for ids, sizes in pieces:
        last = int(np.searchsorted(np.cumsum(sizes), limit - n)) + 1
        yield ids[: int(sizes[:last].sum())], sizes[:last]
        n += int(sizes[:last].sum())
        if n >= limit:
            return


def _spelling(tokenizer: str) -> list[str]:
    """How each id is written, and the end, which has the id after them."""
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(tokenizer)
    size = library.get_vocab_size()
    if size > 65_535:
        raise ValueError(f"{tokenizer} has {size} ids; up to 65535 can be scored")
    return [*(library.id_to_token(i) or "" for i in range(size)), ""]


def _fit(subwords: DataFrame, tokenizer: str) -> Model:
    spark = subwords.sparkSession
    spelling = _spelling(tokenizer)
    end = len(spelling) - 1

    def count(batches):
        total = np.zeros(end + 1, np.int64)
        for ids, sizes in _training(batches):
            total += np.bincount(ids, minlength=end + 1)
            total[end] += len(sizes)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["id", "n"])

    counts = np.zeros(end + 1, np.int64)
    for r in subwords.mapInArrow(count, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).collect():  # a row an id at most
        counts[r["id"]] = r["n"]
    model = Model(counts, spelling, end)
    if not counts.any():
        return model
    warm_ids = SHARD_TOKENS

    def add(key, pdf: pd.DataFrame) -> pd.DataFrame:
        total = sum(np.frombuffer(x, np.float32) * float(n) for x, n in zip(pdf["x"], pdf["n"]))
        return pd.DataFrame({"chunk": [key[0]], "x": [(total / pdf["n"].sum()).astype(np.float32).tobytes()], "n": [pdf["n"].sum()], "ids": [pdf["ids"].sum()]})

    rates = np.geomspace(FIRST_RATE, LAST_RATE, ROUNDS).tolist()
    for k in range(-1, ROUNDS):
        now = spark.sparkContext.broadcast(model)

        def learn(batches, now=now, k=k):
            own, pieces = now.value, _training(batches)
            if k < 0:
                if TaskContext.get().partitionId():
                    return
                learnt = own.train(_warm_up(pieces, warm_ids), WARM_RATE)
            else:
                learnt = own.train(pieces, rates[k], seen=warm_ids, part=(k, ROUNDS))
            if learnt:
                vector = own.vector()
                parts = [vector[a : a + CHUNK].tobytes() for a in range(0, len(vector), CHUNK)]
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(parts))), pa.array(parts, pa.binary()), pa.array(np.full(len(parts), learnt)), pa.array(np.full(len(parts), learnt if k >= 0 else 0))], names=["chunk", "x", "n", "ids"])

        kind = "chunk long, x binary, n long, ids long"
        rows = subwords.mapInArrow(learn, kind).groupBy("chunk").applyInPandas(add, kind).toPandas().sort_values("chunk")  # the parameters once
        if len(rows):
            model.load(np.concatenate([np.frombuffer(x, np.float32) for x in rows["x"]]))
            model.trained += int(rows["ids"].iloc[0])
    return model


def score(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", tokenizer: str | None = None) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score."""
    spark = docs.sparkSession
    tokenizer = tokenizer or default_path()
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    size = rows.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("b")).first()["b"]
    path = new_path(spark, "lm-pieces")
    _pieces(rows, max(8, -(-size // BUCKET_BYTES)), tokenizer).write.partitionBy("kind").options(**{"compression": "zstd", "parquet.block.size": str(16 << 20), "parquet.enable.dictionary": "false"}).parquet(path)
    pieces = spark.read.schema(_SCHEMA.removeprefix("kind int, ") + ", kind int").parquet(path)
    words, pairs, subwords = (pieces.where(F.col("kind") == k) for k in range(3))

    totals = staged(words.select("piece", "bucket", "a", "b").groupBy("bucket").applyInPandas(_totals, "piece long, bucket int, t binary, tokens long, distinct long"), "lm-totals")
    whole = totals.where("piece = -1").agg(F.coalesce(F.sum("tokens"), F.lit(0)).alias("n"), F.coalesce(F.sum("distinct"), F.lit(0)).alias("v")).first()
    base = totals.where("piece >= 0").select("piece", "bucket", "t").groupBy("piece").cogroup(pairs.select("piece", "a", "b", "c").groupBy("piece")).applyInPandas(_base(whole["n"], whole["v"]), "piece long, pos long, n_tokens long, n_known long, base_score double")

    # Side by side, so that the base is summed on cores that the warm-up and the ends of the passes leave idle.
    base, model = all_together(spark, [lambda: staged(base, "lm-base"), lambda: _fit(subwords.select("piece", "a", "b", "c", "docs"), tokenizer)])
    fitted = spark.sparkContext.broadcast(model)

    def run(batches):
        for batch in batches:
            for (ids, sizes, out), docs_, piece in zip(_streams(batch), batch.column(4).to_pylist(), batch.column(0).to_pylist(), strict=True):
                n = len(sizes)
                yield pa.RecordBatch.from_arrays([pa.array([piece] * n, pa.int64()), pa.array(np.arange(n)), pa.array(docs_, pa.int64()), pa.array(out), pa.array(fitted.value.score(ids, sizes))], names=["p", "i", "doc_id", "held_out", "score"])

    scored = subwords.select("piece", "a", "b", "c", "docs").mapInArrow(run, "p long, i long, doc_id long, held_out boolean, score double")
    return scored.join(base.hint("merge"), (F.col("p") == F.col("piece")) & (F.col("i") == F.col("pos"))).select("doc_id", "held_out", "n_tokens", "n_known", F.lit(whole["n"]).cast("long").alias("train_tokens"), "base_score", "score")


def digest(docs: DataFrame) -> DataFrame:
    return score(docs)

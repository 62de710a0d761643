"""The corpus pipeline and its stages against brute force, and the toxicity model against a naive one."""

import math
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from flowscope.llm import toxicity
from flowscope.llm.words import ALNUM

LOWER = bytes(c + 32 if 65 <= c < 91 else c for c in range(256))
WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return (text or "").encode().translate(LOWER).split()


def shingles(text, n=5):
    w = words(text)
    return {tuple(w[k : k + n]) for k in range(max(1, len(w) - n + 1))} if w else set()


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    rng = random.Random(11)
    vocabulary = [f"w{k}x" for k in range(400)]
    say = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    docs, labels, toxic = [], [], set()
    for i in range(700):
        t = say(rng.randint(12, 90))
        if i % 7 == 0:
            t[rng.randrange(len(t))] = rng.choice(["idiot", "scum", "nasty"])
            toxic.add(i)
        docs.append((i, " ".join(t)))
        if i < 450:
            labels.append((i, 1, int(i in toxic)))
    passage = say(14)
    base = say(80)
    for k in range(12):  # near copies
        t = list(base)
        t[k * 3] = "changed"
        docs.append((1000 + k, " ".join(t)))
    docs += [(1100, docs[1][1].upper()), (1101, docs[1][1])]  # copies of a clean document
    docs += [(1200, " ".join(say(20) + passage + say(20))), (1201, " ".join(passage))]
    docs += [(1300, None), (1301, ""), (1302, "   "), (None, " ".join(say(30))), (None, " ".join(say(30))), (2, docs[3][1]), (1303, " ".join(say(9000)))]
    docs += [(5, docs[5][1])]  # a repeated row
    root = str(tmp_path_factory.mktemp("sf"))
    kind = "doc_id long, text string, source string, n_words string, kept boolean, block int"
    spark.createDataFrame([(i, t, "s", "x", None, 3) for i, t in docs], kind).write.parquet(f"{root}/documents.parquet")
    spark.createDataFrame([*labels, (None, None, None)], "doc_id long, quality int, toxic int").write.parquet(f"{root}/labels.parquet")
    spark.createDataFrame([("b1", " ".join(passage)), (None, None), ("b2", "")], "item_id string, text string").write.parquet(f"{root}/benchmark.parquet")
    return root, docs, toxic


def clusters(rows):
    """Of each group of near copies, by five-word shingles and 0.8, the row that stays: brute force."""
    sets = [shingles(t) for _, t in rows]
    label = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                a, b = label[i], label[j]
                label = [min(a, b) if x in (a, b) else x for x in label]
    out = {}
    for k, (i, t) in enumerate(rows):
        out.setdefault(label[k], []).append((i is None, i, t))
    return out.values()


def test_stages_one_by_one(spark, tables):
    root, docs, toxic = tables
    rows = [*corpus_pipeline.STAGES]
    assert [n for n, _ in rows] == ["toxicity", "near_dedup", "decontamination", "packing"]
    read = spark.read.parquet(f"{root}/documents.parquet")
    # toxicity: what the chain calls toxic goes, and nothing else
    left = rows[0][1](spark, read, root)
    assert left.columns == read.columns
    flagged = {(r.doc_id, r.toxic) for r in toxicity.digest(read, spark.read.parquet(f"{root}/labels.parquet")).collect()}
    left_ids = Counter(r.doc_id for r in left.collect())
    assert left_ids == Counter(i for i, _ in docs if (i, True) not in flagged)
    caught = {i for i, bad in flagged if bad}
    assert len(caught & toxic) >= 0.95 * len(toxic) and len(caught - toxic) <= 5
    # near copies: one row of each group
    left = rows[1][1](spark, read, root)
    assert left.columns == read.columns
    got = Counter((r.doc_id, r.text) for r in left.collect())
    for group in clusters([d for d in docs if shingles(d[1])]):
        kept = [x for x in group if (x[1], x[2]) in got]
        smallest = min((none, i if i is not None else 0) for none, i, _ in group)
        assert kept and {(n, i if i is not None else 0) for n, i, _ in kept} == {smallest}, group[:2]
        assert sum(got[k] for k in {(i, t) for _, i, t in kept}) == 1
    assert all(got[d] for d in docs if not shingles(d[1]))
    # benchmark passages
    left = rows[2][1](spark, read, root)
    assert left.columns == read.columns
    assert Counter(r.doc_id for r in left.collect()) == Counter(i for i, _ in docs if i not in (1200, 1201))
    # packing: every token once, in sequences of 2048
    packed = rows[3][1](spark, read, root).collect()
    assert Counter(r.doc_id for r in packed if r.piece == 0) == Counter(i for i, _ in docs)
    fill = Counter()
    for r in packed:
        fill[r.sequence_id] += r.length
    assert max(fill.values()) <= 2048 and len(fill) == -(-sum(fill.values()) // 2048)


def test_pipeline_end_to_end(spark, tables):
    root, docs, toxic = tables
    out = corpus_pipeline.run(spark, root).collect()
    ids = Counter(r.doc_id for r in out if r.piece == 0)
    assert not {1200, 1201} & set(ids) and ids[1000] == 1 and not ids.keys() & set(range(1001, 1012)) and ids[1] == 1 and not ids[1100] + ids[1101]
    assert len(toxic & set(ids)) <= 0.05 * len(toxic)
    clean = {i for i, _ in docs if i is not None and i < 700 and i not in toxic} - {3}
    assert len(clean - set(ids)) <= 5 and ids[None] == 2 and ids[1300] == ids[1301] == ids[1302] == ids[5] == 1 and ids[2] == 2 and not ids[3]


@pytest.mark.xfail(reason="many words of no meaning add up in a text far longer than those with labels; see README", strict=False)
def test_a_long_clean_document_is_not_toxic(spark, tables):
    root, _, _ = tables
    kept = corpus_pipeline.toxicity_stage(spark, spark.read.parquet(f"{root}/documents.parquet"), root)
    assert kept.where("doc_id = 1303").count() == 1


@pytest.mark.parametrize("stage", range(4))
def test_stages_of_empty_tables(spark, tables, tmp_path, stage):
    root, _, _ = tables
    for name in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{root}/{name}.parquet").limit(0).write.parquet(f"{tmp_path}/{name}.parquet")
    name, run = corpus_pipeline.STAGES[stage]
    assert run(spark, spark.read.parquet(f"{tmp_path}/documents.parquet"), str(tmp_path)).count() == 0


def code(word: bytes, extra: int) -> int:
    """Naively, the hash of a word: a polynomial of its bytes, scrambled."""
    p, m = 0x9E3779B97F4A7C15, (1 << 64) - 1
    h = (sum((b + 1) * pow(p, k, 1 << 64) for k, b in enumerate(word)) + extra) & m
    h ^= h >> 32
    h = h * 0xD6E8FEB86659FD93 & m
    h ^= h >> 29
    h = h * 0xBF58476D1CE4E5B9 & m
    return h ^ (h >> 32)


def test_toxicity_scores_as_a_naive_chain(spark, tables):
    root, docs, _ = tables
    chain = toxicity.fit(spark.read.parquet(f"{root}/documents.parquet"), spark.read.parquet(f"{root}/labels.parquet"))
    texts = [t for _, t in docs[:60]] + ["", None, "IDIOT!!", "!!! ---", "é scum 123", "idiotic NASTYnasty a"]
    got = chain.score(pa.array(texts, pa.string()))
    for text, row in zip(texts, got, strict=True):
        raw = (text or "").encode()
        lower = raw.translate(LOWER)
        assert all(bool(WORD.fullmatch(bytes([b]))) == bool(ALNUM[b]) for b in set(lower))
        found = WORD.findall(lower)
        features = {code(w, len(w)) >> 44 for w in found} | {code(w[:n], 1000 + n) >> 44 for w in found for n in (4, 5, 6) if len(w) > n}
        columns = {int(chain.place[f]) for f in features} - {-1}
        share = lambda test: sum(map(test, raw)) / max(len(raw), 1)
        shape = [math.log1p(len(raw)), share(lambda b: 65 <= b <= 90), share(lambda b: 48 <= b <= 57), share(lambda b: b <= 32), share(lambda b: 33 <= b <= 47), share(lambda b: 91 <= b <= 126 and not 97 <= b <= 122)]
        seen = np.clip((np.array(shape) - chain.mean) / chain.scale, -5, 5).tolist()
        for k in range(len(chain.names)):
            z = chain.bias[k] + sum(chain.words[k][c] for c in columns) + float(np.dot(chain.dense[k], seen))
            p = 1 / (1 + math.exp(-max(-30, min(30, z)))) if found else 0.0
            assert row[k] == pytest.approx(p, abs=1e-9)
            seen.append(p)

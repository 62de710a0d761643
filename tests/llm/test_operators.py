"""Operators of the llm subpackage against brute force, on small tables with nulls, empty and repeated rows."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from pyspark.sql import functions as F
from flowscope.llm import attention, chat, decontaminate, lm_scoring, near_dedup, packing, sharding, store, subwords, token_files, topk, toxicity, warc

LOWER = bytes(c + 32 if 65 <= c < 91 else c for c in range(256))
WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
TOKEN = re.compile(rb"[^\x20\x09-\x0D]+")


def words(text, pattern=TOKEN):
    return pattern.findall((text or "").encode().translate(LOWER))


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(5)
    vocabulary = ["".join(rng.choice("abcdeéßñ") for _ in range(rng.randint(2, 7))) for _ in range(300)]
    say = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    texts = [say(rng.randint(1, 80)) for _ in range(60)] + [None, "", "   ", "one", "Two words", say(4000), "\x00 \x1c odd space\n\n x", "<|endoftext|> a"]
    base = say(60).split()
    for k in range(25):
        t = list(base)
        for _ in range(k % 6):
            t[rng.randrange(len(t))] = rng.choice(vocabulary)
        texts.append(" ".join(t).upper() if k % 7 == 0 else " ".join(t))
    out = list(enumerate(texts))
    return out + [out[3], out[3]]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id long, text string, n_words string, contamination int")


def empty(spark):
    return spark.createDataFrame([], "doc_id long, text string")


def test_decontamination(spark, docs, rows):
    items = [(1, " ".join((rows[0][1] + " " + rows[1][1]).split()[:14])), (2, rows[5][1]), (3, "one"), (4, None), (5, ""), (2, rows[5][1]), (10, rows[65][1])]
    bench = spark.createDataFrame(items, "item_id long, text string")
    windows = defaultdict(set)
    for i, t in items:
        w = words(t, WORD)
        n = min(10, len(w))
        for k in range(len(w) - n + 1 if w else 0):
            windows[tuple(w[k : k + n])].add(str(i))
    got = Counter()
    for r in decontaminate.digest(docs, bench).collect():
        got[(r.doc_id, r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated)] += 1
    want = Counter()
    for i, t in rows:
        w, hit, held = words(t, WORD), set(), set()
        for n in {len(k) for k in windows}:
            for k in range(len(w) - n + 1):
                if o := windows.get(tuple(w[k : k + n])):
                    hit.update(range(k, k + n))
                    held |= o
        want[(i, len(w), len(hit), len(held), hashlib.sha256(",".join(sorted(held)).encode()).hexdigest(), bool(hit))] += 1
    assert got == want
    found, name = decontaminate.contamination(docs.distinct(), bench, block_bytes=200)
    blocks = {r.doc_id: r.h for r in found.select("doc_id", decontaminate.hit_words(name).alias("h")).collect()}
    assert blocks == {k[0]: k[2] for k in want}
    cut = decontaminate.decontaminate(docs, bench, "cut")
    assert cut.columns == docs.columns and cut.count() == len(rows)
    assert decontaminate.decontaminate(docs, bench).columns == docs.columns
    assert decontaminate.digest(empty(spark), bench).count() == 0
    assert decontaminate.digest(docs, bench.limit(0)).where("contaminated").count() == 0


def encoded(rows, end):
    import tokenizers

    t = tokenizers.Tokenizer.from_file(subwords.default_path())
    return [(i, t.encode(x or "", add_special_tokens=False).ids + [end]) for i, x in rows]


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


@pytest.mark.parametrize("encoding", ["dictionary", "delta"])
def test_token_files(spark, docs, rows, encoding):
    path = store.new_path(spark, "t")
    token_files.write_tokens(docs, path, 2, encoding=encoding)
    got = sorted((r.start, r.doc_id, r.n_tokens, r.ids) for r in token_files.read_places(spark, path, True).collect())
    start = 0
    for (s, i, n, ids), (j, want) in zip(got, sorted(encoded(rows, 2), key=lambda x: x[0]), strict=True):
        assert (s, i, n, ids) == (start, j, len(want), want)
        start += n
    assert token_files.read_places(spark, path).columns == ["doc_id", "start", "n_tokens"]


def test_token_digest(spark, docs, rows):
    got = Counter((r.doc_id, r.n_tokens, r.ids_crc32) for r in token_files.digest(docs).collect())
    assert got == Counter((i, len(x), crc(x)) for i, x in encoded(rows, 2))
    assert token_files.digest(empty(spark)).count() == 0


def test_packing(spark, docs, rows):
    out = packing.digest(docs).collect()
    ids = dict(encoded(rows, 0))
    by = defaultdict(list)
    for r in out:
        assert crc(ids[r.doc_id][r.start : r.start + r.length]) == r.ids_crc32
        assert r.length == 2048 or r.piece == 0
        by[r.sequence_id].append((r.offset, r.length))
    assert Counter(r.doc_id for r in out if r.piece == 0) == Counter(i for i, _ in rows)
    for parts in by.values():
        at = 0
        for o, n in sorted(parts):
            assert o == at
            at += n
        assert at <= 2048
    assert len(by) == -(-sum(r.length for r in out) // 2048)
    assert packing.digest(empty(spark)).count() == 0


def test_crossover_keeps_every_item():
    rng = np.random.default_rng(3)
    sizes = np.sort(rng.integers(1, 2048, 500)).astype(np.int32)
    a, b = packing.decreasing_packing(sizes, 2048), packing.random_packing(sizes, 2048, rng)
    for _ in range(20):
        c = packing.crossover(a, b, sizes, 2048, rng)
        assert np.bincount(c, weights=sizes).max() <= 2048 and len(np.unique(c)) == c.max() + 1
        a, b = b, c


def test_warc(spark):
    pages = [(1, "http://a.b/x", "p" * 200), (0, "https://u@a.b:80/y?q", "p" * 200), (2, None, None), (3, "http://c/", "é WARC/1.1\r\n\r\n" * 30), (4, "http://c/", "é WARC/1.1\r\n\r\n" * 30), (5, "q\r\nx", "short"), (6, "q", "short"), (5, "q\r\nx", "short")]
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    first = {}
    for i, _, h in sorted(pages):
        first.setdefault(h or "", i)
    got = Counter((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in warc.digest(df).collect())
    want = Counter()
    for i, _, h in pages:
        p = (h or "").encode()
        again = len(p) >= 100 and first[h or ""] != i
        want[(i, len(p), hashlib.sha256(p).hexdigest(), "revisit" if again else "response", first[h] if again else None)] += 1
    assert got == want
    h = sorted(warc.digest(df).collect(), key=lambda r: r.place)
    assert [r.place for r in h] == list(range(len(pages)))
    assert [(r.url_key, r.timestamp, r.page_id) for r in h] == sorted((r.url_key, r.timestamp, r.page_id) for r in h)
    assert warc.digest(df.limit(0)).count() == 0


def test_loser_tree():
    rng = random.Random(1)
    for n in range(8):
        runs = [sorted(rng.randrange(50) for _ in range(rng.randrange(9))) for _ in range(n)]
        assert list(warc.LoserTree(runs)) == sorted(sum(runs, []))


def test_chat(spark):
    turns = [(1, 0, "user", "hé"), (1, 1, "bot", None), (1, 1, None, "x"), (None, None, "user", ""), (2, 0, "a", "1"), (2, 0, "a", "1")] + [(3, k, "ab"[k % 2], str(k)) for k in range(150)]
    out = chat.perspectives(spark.createDataFrame(turns, "conv_id long, turn long, role string, text string")).collect()
    assert {(r.conv_id, r.perspective) for r in out} == {(1, "user"), (1, "bot"), (1, "unknown"), (None, "user"), (2, "a"), (3, "a"), (3, "b")}
    assert sorted(r.n_turns for r in out if r.conv_id == 3) == [22, 22, 64, 64, 64, 64]
    r = next(r for r in out if r.conv_id == 1 and r.perspective == "user")
    assert r.rendered == "<|im_start|>assistant\nhé<|im_end|>\n<|im_start|>user name=bot\n<|im_end|>\n<|im_start|>user name=unknown\nx<|im_end|>\n"
    assert [r.rendered[m.start : m.end] for m in r.mask] == ["hé<|im_end|>"]
    learnt = sorted(r.rendered[m.start : m.end] for r in out if r.conv_id == 3 for m in r.mask)
    assert learnt == sorted(f"{k}<|im_end|>" for k in range(150))


@pytest.mark.parametrize("scale", [1.0, 1e4])
def test_top_k(spark, scale):
    rng = np.random.default_rng(0)
    x = (rng.standard_normal((330, 6)) * scale).round(3)
    x[50:150] = x[7]
    data = [(i, v.tolist()) for i, v in enumerate(x)] + [(900, None), (901, [1.0, None]), (902, [float("nan")] * 6), (1000, [])]
    v = store.staged(topk.integer_vectors(spark.createDataFrame(data, "vec_id long, embedding array<double>")), "v")
    got = sorted(map(tuple, topk.top_k(v, v.where("vec_id % 100 = 0"), annulus_rows=20, pivots=5).collect()))
    ints = {i: [math.floor(1024 * c) for c in e] for i, e in data if e is not None and all(c is not None and math.isfinite(c) for c in e)}
    want = []
    for q in (i for i in ints if i % 100 == 0):
        scored = sorted((-sum(a * b for a, b in zip(ints[q], e)), i) for i, e in ints.items() if i != q)[:10]
        want += [(q, k + 1, i, -s) for k, (s, i) in enumerate(scored)]
    assert got == sorted(want)


def test_sharding(spark, docs, rows):
    out = sharding.digest(docs).collect()
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in out) == Counter((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in rows)
    by = defaultdict(list)
    for r in out:
        by[r.shard].append(r)
    for part in by.values():
        assert sorted(r.slot for r in part) == list(range(len(part)))
    total, most = sum(r.size for r in out), max(r.size for r in out)
    assert all(abs(sum(r.size for r in by[k]) - total / 16) <= most for k in range(16))
    assert sharding.digest(empty(spark)).count() == 0


@pytest.mark.parametrize(("n", "percent"), [(3, 85), (5, 80)])
def test_near_duplicates(spark, docs, rows, n, percent):
    sets = {}
    for i, t in rows:
        w = words(t)
        sets[i] = {tuple(w[k : k + n]) for k in range(max(1, len(w) - n + 1))} if w else set()
    label = {i: i for i in sets}
    for i in sorted(sets):
        for j in sorted(sets):
            if i < j and sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                a, b = label[i], label[j]
                label = {k: min(a, b) if v in (a, b) else v for k, v in label.items()}
    rule = near_dedup.Rule(n, percent)
    got = near_dedup.groups(docs, rule).collect()
    assert len(got) == len(rows)
    assert all((r.n_shingles, r.component_id, r.kept) == (len(sets[r.doc_id]), label[r.doc_id], label[r.doc_id] == r.doc_id) for r in got)
    kept = near_dedup.deduplicate(docs, rule)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == sorted(i for i in sets if label[i] == i)


def test_toxicity(spark):
    rng = random.Random(2)
    clean = [f"w{k}" for k in range(200)]
    data, labels = [], []
    for i in range(600):
        t = [rng.choice(clean) for _ in range(rng.randint(5, 60))]
        bad = i % 5 == 0
        if bad:
            t[rng.randrange(len(t))] = rng.choice(["idiot", "scum", "nasty"])
        data.append((i, " ".join(t).upper() + "!!" if i % 7 == 0 else " ".join(t)))
        if i < 400:
            labels.append((i, int(i % 7 != 0), int(bad)))
    docs = spark.createDataFrame([*data, (600, None), (601, "")], "doc_id long, text string")
    marks = spark.createDataFrame([*labels, labels[0], (9999, 1, None)], "doc_id long, quality int, toxic int")
    out = {r.doc_id: r for r in toxicity.digest(docs, marks).collect()}
    right = sum(out[i].toxic == (i % 5 == 0) for i in range(400, 600))
    assert right >= 190 and not out[600].toxic and not out[601].toxic
    assert sum(out[i].low_quality == (i % 7 == 0) for i in range(400, 600)) >= 190
    none = toxicity.digest(docs, marks.limit(0)).collect()
    assert len(none) == 602 and not any(r.toxic for r in none)
    assert toxicity.reject(docs, marks).columns == docs.columns


def test_language_model(spark, docs, rows):
    out = lm_scoring.digest(docs).collect()
    assert Counter(r.doc_id for r in out) == Counter(i for i, _ in rows)
    tokens = [(i, [*words(t), None]) for i, t in rows]
    c = Counter(w for i, v in tokens if not lm_scoring.held_out(i) for w in v)
    n, distinct = sum(c.values()), len(c)
    of = dict(tokens)
    for r in out:
        v = of[r.doc_id]
        base = sum(math.log10((c[w] + 0.5) / (n + 0.5 * (distinct + 1))) for w in v)
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (zlib.crc32(str(r.doc_id).encode()) % 5 == 1, len(v), sum(c[w] > 0 for w in v), n)
        assert abs(base - r.base_score) < 1e-6 and r.score < 0 and math.isfinite(r.score)
    assert lm_scoring.digest(empty(spark)).count() == 0


def small_model(ids=40, scale=1.0):
    """A model of random parameters, over ids of which the last never occur."""
    rng = np.random.default_rng(0)
    counts = np.concatenate((rng.integers(1, 100, ids), np.zeros(5, np.int64)))
    counts[7] = 500
    m = attention.Model(counts, [f"{i * 7 % 45:03}" for i in range(ids + 5)], end=7)
    return m.load((m.vector() + rng.standard_normal(len(m.vector())) * scale).astype(np.float32))


def next_id(m, before, at):
    """Naively, log probabilities of all ids at place ``at`` of a text, from the ids before it."""
    p, first = {k: v.astype(np.float64) for k, v in m.p.items()}, at // attention.STEP * attention.STEP
    given = [m.end, *before]  # the id at place i follows given[i]
    seen = range(max(0, first - attention.CONTEXT), at + 1)
    x = [p["E"][m.rank[given[i]]] for i in seen]
    z = np.array([(x[-1] @ p["q"]) @ (y @ p["k"]) / np.sqrt(attention.WIDTH) + p["r"][at - i] for i, y in zip(seen, x)])
    w = np.exp(z - z.max())
    h = x[-1] + sum(a * (y @ p["v"]) for a, y in zip(w / w.sum(), x))
    log = lambda v: v - v.max() - np.log(np.exp(v - v.max()).sum())
    klass = log(h @ p["U"] + p["b"])
    member = [log(h @ p["M"][c] + p["c"][c]) for c in range(m.classes)]
    return np.array([klass[c] + member[c][k] + s for c, k, s in zip(m.klass, m.member, m.share)])


@pytest.mark.parametrize("scale", [0.3, 8.0])
def test_model_scores_as_a_naive_model(scale):
    m, rng = small_model(scale=scale), np.random.default_rng(1)
    texts = [rng.integers(0, 45, n).tolist() for n in (0, 1, 5, 31, 32, 33, 70, 100)]
    got = m.score(np.array(sum(texts, []), np.uint16), np.array([len(t) for t in texts], np.uint32))
    want = [sum(next_id(m, t[:i], i)[c] for i, c in enumerate([*t, m.end])) / np.log(10) for t in texts]
    assert np.isfinite(got).all() and np.allclose(got, want, rtol=2e-3 if scale > 1 else 1e-4, atol=1e-3)


def test_model_probabilities_sum_to_one():
    m, rng = small_model(), np.random.default_rng(2)
    for n in (0, 3, 40):
        assert np.isclose(np.exp(next_id(m, rng.integers(0, 45, n).tolist(), n)).sum(), 1)


def test_model_learns_by_the_gradient():
    """A step against the gradient makes the text more likely; so does training."""
    m, rng = small_model(scale=0.1), np.random.default_rng(3)
    ids, sizes = np.tile(rng.integers(0, 40, 25), 200).astype(np.uint16), np.full(200, 25, np.uint32)
    before = m.score(ids, sizes).mean()
    assert m.train([(ids, sizes)], 0.02) == 5000 - int((ids == m.end).sum()) and m.score(ids, sizes).mean() > before + 5


def test_a_step_of_training_follows_the_loss(monkeypatch):
    """Gradients of every parameter against differences of the loss; windows of several parts, with and without a context before them."""
    monkeypatch.setattr(attention, "PART", 2)
    m, rng = small_model(scale=0.3), np.random.default_rng(4)
    sizes = np.array([0, 3, 31, 70, 100], np.uint32)
    ids, found = rng.integers(0, 40, int(sizes.sum())).astype(np.uint16), {}

    class Kept:
        def step(self, grads, rows, rate):
            found.update({k: (g.astype(np.float64), rows.get(k)) for k, g in grads.items()})

    source, target, begin, stop, first, _ = m.windows(ids, sizes)
    m._step(Kept(), np.arange(len(begin)), source, target, begin, stop, first, 0.0)
    whole = found["E"][0]
    found["E"] = (np.zeros(m.p["E"].shape), None)
    found["E"][0][np.unique(source)] = whole
    loss = lambda: -m.score(ids, sizes).sum() * np.log(10) / len(target)
    for name, (g, _) in found.items():
        way = (g + rng.standard_normal(g.shape) * np.abs(g).max() * 0.1 * (m.p[name] > -1e8)).astype(np.float32)
        way *= 0.02 / max(np.abs(way).max(), 1e-9)
        kept, ends = m.p[name], []
        for side in (1, -1):
            m.p[name] = kept + side * way
            ends.append(loss())
        m.p[name] = kept
        assert np.isclose((ends[0] - ends[1]) / 2, (g * way).sum(), rtol=0.02, atol=2e-5), name


def test_adam_moves_large_arrays_as_small_ones(monkeypatch):
    rng, ends = np.random.default_rng(5), []
    start, grads = rng.standard_normal((7, 11)).astype(np.float32), rng.standard_normal((4, 7, 11)).astype(np.float32)
    for block in (5, 1000):
        monkeypatch.setattr(attention, "BLOCK", block)
        p = {"a": start.copy(), "b": start.copy()}
        adam = attention.Adam(p)
        for g in grads:
            adam.step({"a": g.copy(), "b": g[[1, 4]]}, {"b": np.array([1, 4])}, 0.1)
        ends.append(p)
    for k in "ab":
        assert np.array_equal(ends[0][k], ends[1][k]) and not np.array_equal(ends[0][k], start)
    assert np.array_equal(ends[0]["b"][[0, 2, 3, 5, 6]], start[[0, 2, 3, 5, 6]])


def test_language_model_beats_the_base_on_held_out_text(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    sums = lm_scoring.digest(docs).where("held_out").agg(F.sum("score").alias("score"), F.sum("base_score").alias("base")).first()
    assert sums["score"] > sums["base"]


def test_language_model_learns_from_all_training_documents(spark, docs, rows, monkeypatch):
    monkeypatch.setattr(lm_scoring, "LEAST_TOKENS", 0, raising=False)  # formerly a corpus above this size was sampled
    monkeypatch.setattr(lm_scoring, "SHARD_TOKENS", 500)
    path = subwords.default_path()
    pieces = lm_scoring._pieces(docs.select("doc_id", "text"), 8, path).where("kind = 2").select("piece", "a", "b", "c", "docs")
    train = [t for i, t in rows if not lm_scoring.held_out(i)]
    sizes = subwords.encoder(path)(pa.array(train, pa.string()))[1].tolist()
    assert sum(sizes) > 4 * 500 and lm_scoring._fit(pieces, path).trained == sum(sizes)


def test_model_predicts_every_id_of_the_training_documents():
    counts = np.zeros(lm_scoring.VOCABULARY, np.int64)
    seen = np.random.default_rng(1).permutation(lm_scoring.VOCABULARY)[:20_000]
    counts[seen] = 1 + np.arange(20_000)
    m = lm_scoring.Model(counts, [f"{i:06}" for i in range(lm_scoring.VOCABULARY)])
    places = Counter(zip(m.klass.tolist(), m.member.tolist()))
    assert all(places[m.klass[i], m.member[i]] == 1 for i in seen.tolist()) and not m.share[seen].any()
    assert len(set(m.rank[seen].tolist())) == 20_000 and lm_scoring.CONTEXT >= 16
    full = lm_scoring.Model(np.ones(lm_scoring.VOCABULARY, np.int64), [f"{i:06}" for i in range(lm_scoring.VOCABULARY)])
    assert full.classes <= lm_scoring.CLASSES and full.members <= lm_scoring.MEMBERS


def test_near_duplicates_with_null_and_repeated_ids(spark):
    rng = random.Random(9)
    say = lambda tag: " ".join(f"{tag}{rng.randrange(10**6)}" for _ in range(60))
    a, b, c, d, e = (say(x) for x in "abcde")
    data = [(None, a), (None, a + " more"), (None, b), (7, c), (7, d), (8, d + " more"), (2, e), (7, e + " more"), (None, None), (None, ""), (5, ""), (5, ""), (9, "x y"), (9, "X  Y"), (1, b + " more")]
    docs = spark.createDataFrame(data, "doc_id long, text string")
    groups = near_dedup.groups(docs).collect()
    assert len(groups) == len(data) and {r.component_id for r in groups if r.doc_id == 8} == {7}
    got = Counter((r.doc_id, r.text) for r in near_dedup.deduplicate(docs).collect())
    first = [x for x in got if x in ((None, a), (None, a + " more"))]
    same = [x for x in got if x in ((9, "x y"), (9, "X  Y"))]
    assert len(first) == len(same) == 1
    assert got == Counter([first[0], same[0], (7, c), (7, d), (2, e), (1, b + " more"), (None, None), (None, ""), (5, "")])

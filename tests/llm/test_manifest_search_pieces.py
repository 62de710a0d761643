"""Merkle manifest, ranked search and piece ids against brute force, on small tables with nulls, ties, empty, long and repeated rows."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings, strategies as st

from flowscope.llm import manifest, pieces, ranked

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def run_tree(nodes, fan=16):
    """Root and, for each node, its path of (left, right)."""
    paths, place = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for i, p in enumerate(place):
            a = p // fan * fan
            paths[i].append(("".join(nodes[a:p]), "".join(nodes[p + 1 : a + fan])))
        nodes, place = [h(*nodes[a : a + fan]) for a in range(0, len(nodes), fan)], [p // fan for p in place]
    return (nodes[0] if nodes else None), paths


def naive_manifest(rows):
    shown = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    leaf_of = lambda r, t: h(*[shown(v) for v in (*r[:4], t)])
    groups = defaultdict(list)
    for r in rows:  # doc_id, source, lang, n_chars, text
        groups[r[1]].append((r, leaf_of(r, r[4])))
    names = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    made = {}
    for g in names:
        groups[g].sort(key=lambda x: (x[0][0] is not None, x[0][0] or 0, x[1]))
        made[g] = run_tree([leaf for _, leaf in groups[g]])
    root, tops = run_tree([made[g][0] for g in names])
    out = []
    for g, top in zip(names, tops):
        for (r, leaf), path in zip(groups[g], made[g][1]):
            path = path + top
            struck = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0 and r[4] is not None
            fold = leaf_of(r, r[4].translate(LOWER)) if struck else leaf
            for left, right in path:
                fold = h(left, fold, right)
            out.append((r[0], leaf, made[g][0], root, h(*[x for s in path for x in s]), fold, fold == root))
    return Counter(out)


def manifest_rows(sizes):
    rng = random.Random(4)
    rows, i = [], 0
    for g, n in sizes.items():
        for _ in range(n):
            i += 1
            rows.append((i * 7 % 10_007, g, rng.choice(["en", None, ""]), rng.choice([None, 5, -3]), rng.choice([None, "", "Aé:1", f"Text {i}", "low"])))
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("sizes", [{"a": 300, None: 17, "": 1, "é": 16, "Z": 2, "b": 33}, {"only": 40}, {"one": 1}, {f"s{i}": 1 for i in range(40)}])
def test_manifest_equals_a_naive_tree(spark, sizes):
    rows = manifest_rows(sizes)
    if len(sizes) > 3:
        rows += [rows[0]] * 3 + [(None, "a", None, None, None), (None, None, "x", 1, "A")] * 2
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, source string, lang string, n_chars long, text string, pos int, g string")
    got = Counter(tuple(r) for r in manifest.digest(df).select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified").collect())
    assert got == naive_manifest(rows)
    assert not all(v for *_, v in got) or len(rows) < 5


def test_manifest_of_an_empty_table_and_clashing_columns(spark):
    kind = "doc_id long, source string, lang string, n_chars long, text string"
    assert manifest.digest(spark.createDataFrame([], kind)).count() == 0
    rows = spark.createDataFrame([(i, "a", f"{i:064x}", i) for i in range(40)], "o int, g string, digest string, path int")
    out = manifest.prove(rows, "digest", "g", "o")
    assert out.columns == ["o", "g", "digest", "subroot", "root", "path"] and out.where(manifest.fold(out["digest"], out["path"]) != out["root"]).count() == 0


def naive_search(docs, items, k=10):
    words = lambda t: TERM.findall((t or "").translate(LOWER))
    held = [(i, w, Counter(w)) for i, t in docs if (w := words(t))]
    n, total, df = len(held), sum(len(w) for _, w, _ in held), Counter(t for _, _, c in held for t in c)
    out = Counter()
    for item, text in items:
        scores = []
        for i, w, c in held:
            m = 10 + 90 * len(w) * n // total
            s = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 8 * m)) for t in set(words(text)) if c[t])
            if s > 0:
                scores.append((-s, i is None, i))
        out.update((item, r, i, -s) for r, (s, _, i) in enumerate(sorted(scores, key=lambda x: (x[0], x[1], x[2] or 0))[:k], 1))
    return out


@pytest.fixture(scope="module")
def library():
    rng = random.Random(6)
    vocabulary = ["".join(rng.choice("abcdeéß1") for _ in range(rng.randint(1, 4))) for _ in range(80)]
    say = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    docs = [(i, say(rng.choice([1, 5, 30, 200]))) for i in range(400)]
    docs += [(400 + i, docs[3][1]) for i in range(30)] + [docs[3]] * 3 + [(None, docs[3][1]), (900, None), (901, ""), (902, " .,\x00"), (903, say(30_000)), (904, "ONLY@here")]
    items = [(i, say(rng.choice([1, 3, 40]))) for i in range(25)] + [(3, docs[3][1]), (3, docs[3][1]), (30, None), (31, ""), (None, "only"), (32, "nowhere else")]
    return docs, items


@pytest.mark.parametrize(("block_bytes", "postings"), [(8_000_000, 500_000), (300, 700)])
def test_search_equals_scoring_every_document(spark, library, block_bytes, postings):
    docs, items = library
    d = spark.createDataFrame([(i, t, 0) for i, t in docs], "doc_id long, text string, n int").repartition(5)
    q = spark.createDataFrame([(i, t, 0) for i, t in items], "item_id int, text string, item int")
    got = Counter(tuple(r) for r in ranked.search(d, q, block_bytes=block_bytes, postings=postings).collect())
    assert got == naive_search(docs, items)


def test_search_of_empty_tables(spark, library):
    docs, items = (spark.createDataFrame(x, s) for x, s in zip(library, ("doc_id long, text string", "item_id int, text string")))
    assert ranked.search(docs.limit(0), items).count() == ranked.search(docs, items.limit(0)).count() == 0


def test_best_first_search_leaves_most_documents():
    """Intervals that cannot reach the k-th score are never opened."""
    rng = np.random.default_rng(1)
    docs, terms = 4000, 200
    doc = np.repeat(np.arange(docs), 30)
    pairs = np.unique(doc * terms + rng.zipf(1.3, len(doc)) % terms)
    doc, term = np.divmod(pairs, terms)
    impact = rng.integers(1, 10**6, len(doc)) * (1 + term)
    queries = [rng.choice(terms, 6, replace=False) for _ in range(50)]
    best = ranked.Best(len(queries), 10)
    block = ranked.Block(np.arange(docs), np.zeros(docs, bool), doc, term, impact, terms)
    scored = block.search(queries, best)
    for q, query in enumerate(queries):
        mine = np.isin(term, query)
        total = np.bincount(doc[mine], impact[mine], docs).astype(np.int64)
        want = sorted(zip(-total, range(docs)))[:10]
        assert best.rows[best.rows["q"] == q][["score", "id"]].values.tolist() == [[-s, i] for s, i in want]
    assert scored < docs * len(queries) / 4


def test_impacts_of_extreme_lengths():
    w = ranked.Weights(10**12, 10**15, np.array([1000]))
    n = np.array([10**9, 1])
    assert w.impacts(np.zeros(2, int), np.array([7, 7]), n).tolist() == [1000 * (7 * 10**9 // (7000 + 8 * (10 + 90 * int(x) * 10**12 // 10**15))) for x in n]


@pytest.fixture(scope="module")
def library_model():
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=pieces.default_path())


TEXT = st.text(alphabet=st.one_of(st.sampled_from(" \n\t▁aetinhr.,1é中😀\x00"), st.characters(exclude_categories=["Cs"])), max_size=60)


@settings(max_examples=60, deadline=None)
@given(st.lists(TEXT, min_size=1, max_size=30))
def test_pieces_of_odd_texts(library_model, texts):
    ids, each = pieces.encoder(pieces.default_path())(pa.array(texts))
    at = np.concatenate(([0], np.cumsum(each)))
    assert [ids[a:b].tolist() for a, b in zip(at, at[1:])] == library_model.encode(texts)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.one_of(st.integers(0, 300), st.integers(0, 31_999)), max_size=20), min_size=1, max_size=20))
def test_texts_of_any_ids(library_model, lists):
    raw, offs = pieces.decoder(pieces.default_path())(np.array([i for x in lists for i in x], int), np.array([len(x) for x in lists]))
    assert [raw[a:b].decode() for a, b in zip(offs.tolist(), offs[1:].tolist())] == [library_model.decode(x) for x in lists]


def test_backtracking_equals_merging(library_model):
    """The backtracker against the merges themselves, on rows of pieces that seldom stand together; it does step back there."""
    tracker = pieces.encoder(pieces.default_path()).backtracker
    rng = random.Random(2)
    known = sorted(tracker.made)
    steps = 0
    for _ in range(2000):
        text = "".join(rng.choice(known) for _ in range(rng.randint(1, 6)))
        got = tracker.pieces(text)
        assert got == tracker.model.merged(text)
        greedy, at = [], 0
        while at < len(text):
            piece = next(text[at : at + n] for n in range(min(16, len(text) - at), 0, -1) if n == 1 or text[at : at + n] in tracker.made)
            greedy.append(piece)
            at += len(piece)
        steps += greedy != got
    assert steps > 100


def test_piece_digest_equals_the_library(spark, library_model, monkeypatch):
    monkeypatch.setattr(pieces, "CACHED", 50)  # the table is begun anew again and again
    rng = random.Random(3)
    texts = [None, "", " ", "  two  blanks ", "a▁b", "x" * 300, "<s></s><unk><0x41>", "\x00\r\n\t", "word " * 50_000, "中文没有空格" * 500] + ["".join(rng.choice("abcde é.\n") for _ in range(rng.randint(0, 300))) for _ in range(300)]
    rows = [(i, t) for i, t in enumerate(texts)] + [(0, "again"), (0, "again"), (None, "no id")]
    df = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, ids int")
    want = Counter()
    for i, t in rows:
        ids = library_model.encode(t or "")
        want[i, len(ids), h(",".join(map(str, ids))), h(library_model.decode(ids))] += 1
    assert Counter(tuple(r) for r in pieces.digest(df).collect()) == want
    assert pieces.digest(df.limit(0)).count() == 0
    coded = pieces.encode(df, name="tokens")
    assert coded.columns == ["doc_id", "text", "ids", "tokens"]
    back = pieces.decode(coded, "tokens").where("decoded <> replace(coalesce(text, ''), '▁', ' ')")
    assert back.count() == 0


def test_models_of_other_kinds_are_refused(tmp_path):
    raw = bytearray(open(pieces.default_path(), "rb").read())
    at = raw.rindex(b"\x12\x06tok_v0\x18\x02")
    raw[at + 9] = 1  # not of the merge type
    path = tmp_path / "m.model"
    path.write_bytes(raw)
    with pytest.raises(ValueError, match="merge-type"):
        pieces.Model(str(path))

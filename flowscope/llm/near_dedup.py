"""Near duplicates by one-permutation MinHash with optimal densification.

A document's set is its distinct word shingles. One hash of each shingle chooses both a bin and a value; a bin's least value is
its minimum, and empty bins borrow from bins that a fixed hash sequence names (optimal densification). Bands of bins are
buckets; in each bucket every member is joined to the bucket's smallest document only (a star), which bounds candidate
pairs by bucket entries. Candidates are confirmed on full sets: first each document with the smallest of its centres, then,
in buckets whose members are still in several components, those outside the largest with a member drawn from it, anew in each pass
while a pass joins many. A star could miss a link between two members that
its centre is too far from; so a last pass confirms pairs across the components that a bucket still holds, in blocks of ``BLOCK`` members,
so that a large bucket is spread over tasks. Links are kept as edges between components, so a group of texts that are all alike
leaves few. Equal sets are one vertex throughout, so copies are never paired.

A bitmap of ``BITS`` bits, each the parity of the shingles that fall on it, differs in at most as many places as two sets
differ in shingles; so pairs whose bitmaps differ too much are discarded without loss before sets are fetched. With the
default bands a pair at the threshold meets in no bucket with a probability below 1e-6.

Cases: null text, or text without words, has an empty set, is linked with nothing and kept; with fewer words than a shingle
the whole sequence is one shingle; an empty table gives no rows. Ids may be null or repeated: a row is known by its id and
two hashes of its text (``_KEY``), and of each group the row with the smallest id is kept (a null id comes last, and among texts of one id the hash decides).
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .store import fresh, staged
from .words import NOT_BLANK, mix, runs, word_tables

BINS = 192
BITS = 2048
#: Members of a bucket that meet as many others in one task.
BLOCK = 512
#: Rows (of two or three numbers) that are broadcast at most.
BROADCAST_ROWS = 500_000
#: Passes with a drawn centre at most, and the share of documents that a pass must join for another one. What passes leave, pairs across components find.
PASSES, SETTLED = 8, 0.005
_KEY = ["doc_id", "h1", "h2"]
_U = np.uint64


@dataclass(frozen=True)
class Rule:
    """Documents of ``words``-word shingles are linked from a similarity of ``percent`` / 100 on."""

    words: int = 5
    percent: int = 80

    @property
    def rows(self) -> int:
        """Bins of a band."""
        return 6 if self.percent >= 84 else 5 if self.percent >= 78 else 4


def shingle_sets(column: pa.Array, words: int):
    """For each text, in order, the sorted codes of its distinct shingles."""
    for w in word_tables(column, NOT_BLANK):
        codes = runs(w.codes, words)
        for k in range(w.texts):
            a, b = int(w.bounds[k]), int(w.bounds[k + 1])
            if a == b:
                yield np.empty(0, np.uint64)
            elif b - a < words:
                yield runs(w.codes[a:b], b - a)
            else:
                s = np.sort(codes[a : b - words + 1])
                yield s[np.concatenate(([True], s[1:] != s[:-1]))]


def _probe(attempt: int) -> np.ndarray:
    """For every bin, the bin that it borrows from at this attempt."""
    return (mix(np.arange(BINS, dtype=np.uint64) + _U(1_000_003) * _U(attempt + 1)) % _U(BINS)).astype(np.int64)


def minima(sets: list[np.ndarray]) -> np.ndarray:
    """Densified bin minima of non-empty sets: one row each."""
    out = np.full((len(sets), BINS), np.iinfo(np.uint64).max, np.uint64)
    sizes = np.fromiter(map(len, sets), np.int64, len(sets))
    codes = mix(np.concatenate(sets))
    place = np.repeat(np.arange(len(sets)), sizes) * BINS + ((codes >> _U(32)) * _U(BINS) >> _U(32)).astype(np.int64)
    np.minimum.at(out.reshape(-1), place, codes & _U(0xFFFFFFFF))
    filled = out != np.iinfo(np.uint64).max
    todo = np.flatnonzero(~filled.all(1))
    attempt = 0
    open_ = ~filled
    while len(todo):
        source = _probe(attempt)
        usable = open_[todo] & filled[todo][:, source]
        rows, bins = np.nonzero(usable)
        out[todo[rows], bins] = out[todo[rows], source[bins]]
        open_[todo[rows], bins] = False
        todo = todo[open_[todo].any(1)]
        attempt += 1
    return out


def _keyed(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """doc_id, text, and hashes of the text."""
    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"), F.xxhash64(text).alias("h1"), F.hash(text).alias("h2"))


def _same(x: dict, y: dict):
    """Whether two keys are equal; null ids are."""
    return x["doc_id"].eqNullSafe(y["doc_id"]) & (x["h1"] == y["h1"]) & (x["h2"] == y["h2"])


def _sketches(docs: DataFrame, rule: Rule, doc_id: str, text: str) -> DataFrame:
    """doc_id, h1, h2, n, d1, d2 (a digest of the set), bands, bits."""
    rows = _keyed(docs, doc_id, text)
    bands = BINS // rule.rows

    def sketch(batches):
        for batch in batches:
            sets = list(shingle_sets(batch.column(1), rule.words))
            n = np.fromiter(map(len, sets), np.int64, len(sets))
            d1, d2 = (np.array([mix(s + _U(c)).sum(dtype=np.uint64) for s in sets], np.uint64).view(np.int64) for c in (1, 2))
            full = np.flatnonzero(n > 0)
            keys, bits = np.zeros((len(sets), bands), np.int64), np.zeros((len(sets), BITS // 64), np.int64)
            for a in range(0, len(full), 1000):
                part = full[a : a + 1000]
                low = minima([sets[i] for i in part])
                value = np.zeros((len(part), bands), np.uint64)
                for k in range(rule.rows):
                    value = mix(value + low[:, k : bands * rule.rows : rule.rows] + _U(k))
                keys[part] = mix(value + np.arange(bands, dtype=np.uint64)).view(np.int64)
                place = np.concatenate([sets[i] for i in part])
                place = np.repeat(np.arange(len(part)) * BITS, n[part]) + (mix(place + _U(7)) % _U(BITS)).astype(np.int64)
                odd = np.bincount(place, minlength=len(part) * BITS) & 1
                bits[part] = np.packbits(odd.reshape(len(part), BITS).astype(bool), axis=1).view(np.int64)
            lists = lambda m: pa.ListArray.from_arrays(pa.array(np.arange(0, m.size + 1, m.shape[1], dtype=np.int32)), pa.array(m.reshape(-1)))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), batch.column(3), pa.array(n), pa.array(d1), pa.array(d2), lists(keys), lists(bits)], names=[*_KEY, "n", "d1", "d2", "bands", "bits"])

    return rows.mapInArrow(sketch, "doc_id long, h1 long, h2 int, n long, d1 long, d2 long, bands array<long>, bits array<long>")


def components(edges: DataFrame) -> DataFrame:
    """id, label (the smallest id that can be reached) of all ends of ``edges`` (a, b)."""
    both = staged(edges.select("a", "b").union(edges.select("b", "a")).distinct(), "links")
    labels = staged(both.groupBy(F.col("a").alias("id")).agg(F.least(F.min("b"), F.first("a")).alias("label")), "labels")
    while True:
        near = both.join(labels, both["b"] == labels["id"]).groupBy("a").agg(F.min("label").alias("near"))
        step = labels.join(near, labels["id"] == near["a"]).select("id", F.col("label").alias("old"), F.least("label", "near").alias("label"))
        jump = labels.select(F.col("id").alias("of"), F.col("label").alias("further"))
        moved = staged(step.join(jump, step["label"] == jump["of"], "left").select("id", "old", F.least("label", F.coalesce("further", "label")).alias("label")), "labels")
        labels = moved.select("id", "label")
        if moved.where("old != label").isEmpty():
            return labels


def _united(labels: DataFrame, links: DataFrame) -> tuple[DataFrame, int]:
    """``labels`` after ``links`` (a, b) were added, and how many components they join: all links between two components are one edge."""
    ends = {x: labels.select(F.col("id").alias(f"{x}_id"), F.col("label").alias(f"{x}_label")) for x in "ab"}
    rows = links.join(ends["a"], F.col("a") == F.col("a_id"), "left").join(ends["b"], F.col("b") == F.col("b_id"), "left")
    edges = staged(rows.select(F.coalesce("a_label", "a").alias("a"), F.coalesce("b_label", "b").alias("b")).where("a != b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "confirmed")
    if edges.isEmpty():
        return labels, 0
    merged = components(edges)
    known = labels.join(merged.select(F.col("id").alias("was"), F.col("label").alias("now")), F.col("label") == F.col("was"), "left").select("id", F.coalesce("now", "label").alias("label"))
    return staged(known.union(merged.join(labels.select("id"), "id", "left_anti").select("id", "label")), "labels"), merged.where("id != label").count()


def _far(rule: Rule, x: str, y: str):
    """Whether sizes or bitmaps prove that two documents are not linked."""
    differing = sum((F.bit_count(F.col(f"{x}bits")[i].bitwiseXOR(F.col(f"{y}bits")[i])) for i in range(BITS // 64)), F.lit(0))
    small, large = F.least(f"{x}n", f"{y}n"), F.greatest(f"{x}n", f"{y}n")
    return (small * 100 < large * rule.percent) | (differing * (100 + rule.percent) > (small + large) * (100 - rule.percent))


def _confirm(pairs: DataFrame, sets: DataFrame, rule: Rule) -> DataFrame:
    """Those of ``pairs`` (a, b) whose full sets are similar enough."""
    left, right = (sets.select(F.col("id").alias(f"{x}_id"), F.col("codes").alias(f"{x}_codes")) for x in "ab")
    rows = pairs.join(left, pairs["a"] == left["a_id"]).join(right, pairs["b"] == right["b_id"]).select("a", "b", "a_codes", "b_codes")

    def check(batches):
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(100 * both >= rule.percent * (len(x) + len(y) - both))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return rows.mapInArrow(check, "a long, b long")


def _counted(rows: DataFrame, name: str) -> DataFrame:
    """``rows``, stored, and broadcast while there are few, so that a large bucket that is joined with them stays where its rows are."""
    rows = staged(rows, name)
    return F.broadcast(rows) if rows.count() <= BROADCAST_ROWS else rows


def groups(docs: DataFrame, rule: Rule = Rule(), doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id (the group's smallest id), kept: one row for each row of ``docs``; equal rows are kept alike."""
    return _grouped(docs, rule, doc_id, text).drop("h1", "h2")


def _grouped(docs: DataFrame, rule: Rule, doc_id: str, text: str) -> DataFrame:
    sketches = staged(_sketches(docs, rule, doc_id, text), "sketches")
    classes = staged(sketches.where("n > 0").groupBy("d1", "d2", "n").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), *_KEY)).alias("row"), F.first("bands").alias("bands"), F.first("bits").alias("bits")).withColumn("id", F.monotonically_increasing_id()), "classes")
    entries = classes.select("id", F.posexplode("bands").alias("band", "bucket"))
    stars = entries.groupBy("bucket").agg(F.min("id").alias("centre"), F.count("*").alias("entries")).where("entries > 1").select(F.col("bucket").alias("of"), "centre")
    members = staged(entries.join(stars, entries["bucket"] == stars["of"]).select("band", "bucket", "id", "centre"), "buckets")

    side = lambda x: classes.select(F.col("id").alias(f"{x}_id"), F.col("n").alias(f"{x}_n"), F.col("bits").alias(f"{x}_bits"), F.col("bands").alias(f"{x}_bands"))
    def near(pairs: DataFrame) -> DataFrame:
        """Pairs (a, b) whose sizes and sketches allow a link."""
        return pairs.join(side("a"), F.col("a") == F.col("a_id")).join(side("b"), F.col("b") == F.col("b_id")).where(~_far(rule, "a_", "b_")).select("a", "b")

    def marked(labels: DataFrame) -> DataFrame:
        """Buckets whose members are in several components, with the members' components."""
        rows = members.join(labels.withColumnRenamed("id", "of"), F.col("id") == F.col("of"), "left").select("band", "bucket", "id", "centre", F.coalesce("label", "id").alias("label"))
        rows = staged(rows, "bucket-labels")
        several = _counted(rows.groupBy(F.col("bucket").alias("of")).agg(F.min("label").alias("low"), F.max("label").alias("high")).where("low < high").select("of"), "several")
        return staged(rows.join(several, F.col("bucket") == F.col("of")).drop("of"), "mixed-buckets")

    # sets of the documents that share a bucket with another
    suspects = members.select(F.col("id").alias("of")).distinct().join(classes.select("id", "d1", "row"), F.col("of") == F.col("id")).drop("of")
    texts = _keyed(docs, doc_id, text).join(suspects, _same({c: F.col(c) for c in _KEY}, {c: F.col("row")[c] for c in _KEY})).select("id", "d1", "text")

    def codes(batches):
        for batch in batches:
            sets = list(shingle_sets(batch.column(2), rule.words))
            same = [int(mix(s + _U(1)).sum(dtype=np.uint64).view(np.int64)) == d for s, d in zip(sets, batch.column(1).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([s.tobytes() for s in sets], pa.binary())], names=["id", "codes"]).filter(pa.array(same, pa.bool_()))

    sets = staged(texts.mapInArrow(codes, "id long, codes binary").dropDuplicates(["id"]), "sets")
    # first every member with the smallest of its centres only: as many pairs as documents at most
    tried = staged(near(members.where("id != centre").groupBy(F.col("id").alias("b")).agg(F.min("centre").alias("a")).select("a", "b")), "candidates")
    labels = components(staged(_confirm(tried, sets, rule), "confirmed"))

    # then, in buckets that are still in several components, the members outside the largest with one drawn from it
    least = SETTLED * sets.count()
    for k in range(PASSES):
        mixed = marked(labels)
        held = mixed.groupBy("bucket", "label").agg(F.count("*").alias("n"), F.min(F.struct(F.xxhash64("id", F.lit(k)), "id"))["id"].alias("drawn"))
        centres = held.groupBy(F.col("bucket").alias("of")).agg(F.max_by(F.struct("label", "drawn"), F.struct("n", -F.col("label"))).alias("top"))
        centres = _counted(centres.select("of", F.col("top.label").alias("centre_label"), F.col("top.drawn").alias("drawn")), "centres")
        star = mixed.join(centres, F.col("bucket") == F.col("of")).where("label != centre_label").select(F.least("drawn", "id").alias("a"), F.greatest("drawn", "id").alias("b")).distinct()
        more = staged(near(star.join(tried, ["a", "b"], "left_anti")), "candidates")
        tried = tried.union(more)
        labels, joined = _united(labels, _confirm(more, sets, rule))
        if joined <= least:
            break

    # then pairs across the components of a bucket, but for those already tried; members of a large bucket meet in blocks
    mixed = marked(labels)
    held = mixed.groupBy("bucket", "label").agg(F.count("*").alias("n"))
    most = _counted(held.groupBy(F.col("bucket").alias("of")).agg(F.max_by("label", F.struct("n", -F.col("label"))).alias("most"), F.ceil(F.sum("n") / BLOCK).cast("int").alias("blocks")), "largest")
    mixed = mixed.join(most, F.col("bucket") == F.col("of")).drop("of")

    def across(x: str, other: str) -> DataFrame:
        """Members with what tells far pairs, each in its own block and once for every block of the other side."""
        rows = mixed.select(*[F.col(c).alias(f"{x}_{c}") for c in ("band", "bucket", "label", "most")], F.col("id").alias(x), "blocks")
        rows = rows.withColumn(f"{x}_{x}", F.pmod(F.xxhash64(x), F.col("blocks")).cast("int")).withColumn(f"{x}_{other}", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        return rows.drop("blocks").join(side(x), F.col(x) == F.col(f"{x}_id"))

    meet = (F.col("p_bucket") == F.col("q_bucket")) & (F.col("p_p") == F.col("q_p")) & (F.col("p_q") == F.col("q_q"))
    # one of the two lies outside the bucket's largest component
    apart = (F.col("p_label") != F.col("q_label")) & ((F.col("q_label") == F.col("p_most")) | (F.col("p") < F.col("q")))
    first = F.array_position(F.zip_with("p_bands", "q_bands", lambda x, y: x == y), True) == F.col("p_band") + 1  # a pair counts in the first bucket that it shares
    pair = across("p", "q").where("p_label != p_most").join(across("q", "p"), meet & apart & ~_far(rule, "p_", "q_") & first)
    more = pair.select(F.least("p", "q").alias("a"), F.greatest("p", "q").alias("b")).distinct().join(tried, ["a", "b"], "left_anti")
    labels, _ = _united(labels, _confirm(more, sets, rule))

    vertex = classes.select(F.col("d1").alias("c1"), F.col("d2").alias("c2"), F.col("n").alias("cn"), "row", "id").join(labels.withColumnRenamed("id", "of"), F.col("id") == F.col("of"), "left")
    vertex = vertex.select("c1", "c2", "cn", "row", F.coalesce("label", "id").alias("label"))
    best = vertex.groupBy(F.col("label").alias("of")).agg(F.min("row").alias("best"))
    vertex = vertex.join(best, F.col("label") == F.col("of")).select("c1", "c2", "cn", "best")
    rows = sketches.select(*_KEY, "n", "d1", "d2")
    empty = F.col("n") == 0
    component = F.when(empty, F.col("doc_id")).otherwise(F.col("best.doc_id"))
    kept = empty | _same({c: F.col(c) for c in _KEY}, {c: F.col("best")[c] for c in _KEY})
    return rows.join(vertex, (F.col("d1") == F.col("c1")) & (F.col("d2") == F.col("c2")) & (F.col("n") == F.col("cn")), "left").select(
        *_KEY, F.col("n").alias("n_shingles"), component.alias("component_id"), kept.alias("kept")
    )


def deduplicate(docs: DataFrame, rule: Rule = Rule(), doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with one row of each group alone: the smallest id. Texts without words stay, but for repeats of an id and text."""
    marks = staged(_grouped(docs, rule, doc_id, text).groupBy(*_KEY).agg(F.first("kept").alias("kept"), F.max("n_shingles").alias("n"), F.count("*").alias("count")).where("NOT kept OR count > 1 AND (n > 0 OR doc_id IS NOT NULL)"), "dropped")
    own = [fresh(c, docs.columns) for c in ("key_id", "key_1", "key_2")]
    theirs = [fresh(c, [*docs.columns, *own]) for c in ("mark_id", "mark_1", "mark_2")]
    rows = docs.select(*[f"`{c}`" for c in docs.columns], *[c.alias(o) for c, o in zip((F.col(doc_id).cast("long"), F.xxhash64(text), F.hash(text)), own)])
    same = _same(*[{c: F.col(n) for c, n in zip(_KEY, names)} for names in (own, theirs)])
    named = lambda which: marks.where(which).select(*[F.col(c).alias(n) for c, n in zip(_KEY, theirs)])
    out = rows.join(named("true"), same, "left_anti")
    if not marks.where("kept").isEmpty():
        out = out.union(rows.join(named("kept"), same, "left_semi").dropDuplicates(own))
    return out.select(*[f"`{c}`" for c in docs.columns])


def digest(docs: DataFrame) -> DataFrame:
    """Three-word shingles, similarity 0.85."""
    return groups(docs, Rule(words=3, percent=85))


#: By an exact join of shingles; for tables of a few thousand documents.
DIGEST_SQL = r"""
WITH RECURSIVE low AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i : i + 2], ' ') AS k FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 2, 1) + 1)) AS i FROM low WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
shared AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b USING (k) WHERE a.doc_id < b.doc_id GROUP BY ALL),
links AS (SELECT a, b FROM shared JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 85 * (x.n + y.n - c)),
edges AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach AS (SELECT doc_id, doc_id AS other FROM low UNION SELECT reach.doc_id, edges.b FROM reach JOIN edges ON edges.a = reach.other),
least_ AS (SELECT doc_id, min(other) AS component_id FROM reach GROUP BY doc_id)
SELECT low.doc_id, coalesce(n.n, 0) AS n_shingles, component_id, low.doc_id = component_id AS kept FROM low LEFT JOIN n USING (doc_id) JOIN least_ USING (doc_id)
"""

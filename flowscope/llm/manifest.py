"""Merkle manifest of a table: a tree of hashes for each group, a tree over the groups' roots, and an inclusion proof for each row.

A node is the SHA-256 (hexadecimal text) of its children's digests in order, of up to ``FAN`` consecutive ones; levels follow until one node is left.
A level is numbered within each group without bringing a group to one task, and dealt by (group, run of children). There, lag and lead columns of
fixed offsets 1 to ``FAN`` - 1 are masked by a row's slot in its run and by the run's length; the first child hashes itself and its leads to the parent, and
lags and leads are a row's siblings. Proofs come down level by level: a node's path is its siblings before its parent's path.

Cases: a null field is ``-``; repeated rows are leaves each, rows of one place in the order follow by their digests, a null place comes first; a null group is a group and comes
first; a lone leaf is its group's root and a lone group's root the root, without hashing; an empty table gives no rows; texts are read once and never shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from .ordering import numbered
from .store import staged

FAN = 16
FIELDS = ["doc_id", "source", "lang", "n_chars", "text"]


def leaf(fields: list[Column]) -> Column:
    """The digest of a row: of each field ``-`` if null, else its bytes in UTF-8, a colon and the value."""
    shown = [f.cast("string") for f in fields]
    return F.sha2(F.concat(*[F.coalesce(F.concat(F.octet_length(s).cast("string"), F.lit(":"), s), F.lit("-")) for s in shown]), 256)


def fold(start: Column, path: Column) -> Column:
    """The root that a leaf and its path (siblings left and right, from the lowest level) make."""
    return F.aggregate(path, start, lambda digest, s: F.sha2(F.concat(s["left"], digest, s["right"]), 256))


def _siblings() -> tuple[Column, Column]:
    """Digests left and right of a row in its run, by lags and leads that the row's slot and the run's length mask."""
    within = Window.partitionBy("g", "run").orderBy("pos")
    slot, length = F.col("pos") % FAN, F.least(F.lit(FAN), F.col("n") - F.col("run") * FAN)
    lags = [F.when(slot >= d, F.lag("digest", d).over(within)) for d in range(FAN - 1, 0, -1)]
    leads = [F.when(slot + d < length, F.lead("digest", d).over(within)) for d in range(1, FAN)]
    return F.concat_ws("", *lags), F.concat_ws("", *leads)


def _runs(level: DataFrame) -> DataFrame:
    return level.withColumn("run", F.floor(F.col("pos") / FAN).cast("long"))


def _levels(leaves: DataFrame) -> list[DataFrame]:
    """Tables (g, pos, n, digest) from the leaves (which may have more columns) up to the level where each group has one node at most."""
    out = [leaves]
    most = leaves.agg(F.max("n").alias("n")).first()["n"] or 0
    while most > 1:
        rows = _runs(out[-1].where("n > 1").select("g", "pos", "n", "digest")).withColumn("right", _siblings()[1])
        parents = rows.where(F.col("pos") % FAN == 0).select("g", F.col("run").alias("pos"), F.ceil(F.col("n") / FAN).cast("long").alias("n"), F.sha2(F.concat("digest", "right"), 256).alias("digest"))
        out.append(staged(parents, "manifest-level"))
        most = -(-most // FAN)
    return out


def _down(levels: list[DataFrame], above: DataFrame | None) -> DataFrame:
    """The lowest level with ``path``, its nodes' siblings up to the root; ``above`` (g, subroot, top) goes on from each group's own root."""
    paths = None
    for k in range(len(levels) - 1, -1, -1):
        level = _runs(levels[k])
        lone = level.where("n = 1").drop("run")
        if above is None:
            done = lone.withColumns({"subroot": F.col("digest"), "path": F.array().cast("array<struct<left:string,right:string>>")})
        else:
            done = lone.join(above.withColumnRenamed("top", "path"), "g")
        if paths is not None:
            up = paths.select("g", F.col("pos").alias("run"), "subroot", F.col("path").alias("rest"))
            left, right = _siblings()
            inner = level.where("n > 1").join(up, ["g", "run"]).withColumns({"left": left, "right": right})
            inner = inner.withColumn("path", F.concat(F.array(F.struct("left", "right")), "rest")).drop("left", "right", "rest", "run")
            done = done.unionByName(inner)
        paths = staged(done, "manifest-paths") if k else done
    return paths


def prove(rows: DataFrame, digest: str, group: str, order: str) -> DataFrame:
    """``rows`` with subroot (of the row's group), root and path: array of (left, right) from the row's level to the root's."""
    kept = [c for c in rows.columns if c not in ("subroot", "root", "path")]
    g = F.coalesce(F.concat(F.lit("="), F.col(group).cast("string")), F.lit(""))  # null comes first, and never equals a text
    work = rows.select(F.struct(*kept).alias("row"), g.alias("g"), F.col(order).alias("o"), F.col(digest).alias("digest"))
    levels = _levels(staged(numbered(work, ["g"], ["o", "digest"], "pos", "n").drop("o"), "manifest-leaves"))
    roots = None
    for level in levels:
        lone = level.where("n = 1").select(F.lit("").alias("g"), F.col("g").alias("member"), "digest")
        roots = lone if roots is None else roots.unionByName(lone)
    tops = _levels(staged(numbered(roots, ["g"], ["member"], "pos", "n"), "manifest-groups"))
    root = tops[-1].where("n = 1").select("digest").limit(1).collect()  # one row, none in an empty table
    above = staged(_down(tops, None).select(F.col("member").alias("g"), F.col("digest").alias("subroot"), F.col("path").alias("top")), "manifest-tops")
    return _down(levels, above).select("row.*", "subroot", F.lit(root[0].digest if root else None).cast("string").alias("root"), "path")


def digest(docs: DataFrame) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root, verified; texts of every fifth code are lower-cased to see that the proof fails."""
    columns = {c: F.col(c) for c in FIELDS}
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    struck = F.crc32(F.col("doc_id").cast("string")) % 5 == 0
    changed = leaf(list((columns | {"text": F.translate("text", upper, upper.lower())}).values()))
    leaves = staged(docs.select("doc_id", "source", leaf(list(columns.values())).alias("leaf"), F.when(struck, changed).alias("changed")), "manifest-digests")
    proven = prove(leaves, "leaf", "source", "doc_id")
    proof = F.sha2(F.concat_ws("", F.transform("path", lambda s: F.concat(s["left"], s["right"]))), 256)
    out = proven.select("doc_id", "leaf", "subroot", "root", proof.alias("proof_sha256"), fold(F.coalesce("changed", "leaf"), F.col("path")).alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))


def _sql(levels: int = 6, tops: int = 4) -> str:
    """Groups of up to 16^levels leaves, up to 16^tops groups."""
    field = lambda c: f"coalesce(strlen(CAST({c} AS VARCHAR)) || ':' || CAST({c} AS VARCHAR), '-')"
    leaf_of = lambda text: f"sha256({' || '.join(field(c) for c in FIELDS[:-1])} || {field(text)})"
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    byte = "xor(c, CAST(ascii(substr(CAST(doc_id AS VARCHAR), i, 1)) AS BIGINT))"
    bits = "list_reduce(list_prepend({0}, CAST([1, 2, 3, 4, 5, 6, 7, 8] AS BIGINT[])), lambda b, j: CASE WHEN b % 2 = 1 THEN xor(b // 2, 3988292384) ELSE b // 2 END)".format(byte)
    crc = f"xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, CAST(range(1, length(CAST(doc_id AS VARCHAR)) + 1) AS BIGINT[])), lambda c, i: {bits}))"
    out = [f"""base AS MATERIALIZED (
  SELECT row_number() OVER () AS r, doc_id, coalesce('=' || source, '') AS g, {leaf_of('text')} AS leaf,
    CASE WHEN {crc} % 5 = 0 THEN {leaf_of(f"translate(text, '{upper}', '{upper.lower()}')")} END AS changed FROM documents),
s0 AS MATERIALIZED (SELECT g, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, leaf AS digest, r FROM base)"""]

    def up(name: str, k: int) -> str:
        return f"""{name}{k} AS MATERIALIZED (
  SELECT g, pos // 16 AS pos, CASE WHEN any_value(n) = 1 THEN any_value(digest) ELSE sha256(string_agg(digest, '' ORDER BY pos)) END AS digest
  FROM (SELECT *, count(*) OVER (PARTITION BY g) AS n FROM {name}{k - 1}) GROUP BY g, pos // 16)"""

    out += [up("s", k) for k in range(1, levels + 1)]
    out.append(f"t0 AS MATERIALIZED (SELECT '' AS g, row_number() OVER (ORDER BY g) - 1 AS pos, digest, g AS member FROM s{levels})")
    out += [up("t", k) for k in range(1, tops + 1)]
    for name, count, key in (("t", tops, "member"), ("s", levels, "r")):
        for k in range(count):
            out.append(f"""{name}x{k} AS MATERIALIZED (
  SELECT a.g, a.pos, coalesce(string_agg(b.digest, '' ORDER BY b.pos) FILTER (b.pos < a.pos), '') AS l, coalesce(string_agg(b.digest, '' ORDER BY b.pos) FILTER (b.pos > a.pos), '') AS u, (SELECT count(*) FROM {name}{k} c WHERE c.g = a.g) > 1 AS more
  FROM {name}{k} a JOIN {name}{k} b ON a.g = b.g AND a.pos // 16 = b.pos // 16 GROUP BY a.g, a.pos)""")
        walk, steps = f"SELECT {key}, g, pos, digest FROM {name}0", []
        joins = " ".join(f"JOIN {name}x{k} x{k} ON x{k}.g = z.g AND x{k}.pos = z.pos // {16 ** k}" for k in range(count))
        path = "list_concat(" * (count - 1) + "".join(f"{'' if not k else ', '}CASE WHEN x{k}.more THEN [struct_pack(l := x{k}.l, u := x{k}.u)] ELSE [] END{')' if k else ''}" for k in range(count))
        out.append(f"{name}p AS MATERIALIZED (SELECT z.{key}, z.g, {path} AS path FROM ({walk}) z {joins})")
    fold_sql = "list_reduce(list_prepend(struct_pack(l := coalesce(changed, leaf), u := ''), path), lambda a, s: struct_pack(l := sha256(s.l || a.l || s.u), u := '')).l"
    return f"""WITH {', '.join(out)},
whole AS (SELECT base.doc_id, base.leaf, base.changed, s{levels}.digest AS subroot, t{tops}.digest AS root, list_concat(sp.path, tp.path) AS path
  FROM base JOIN sp ON sp.r = base.r JOIN tp ON tp.member = sp.g JOIN s{levels} ON s{levels}.g = sp.g, t{tops})
SELECT doc_id, leaf, subroot, root, sha256(array_to_string(list_transform(path, lambda s: s.l || s.u), '')) AS proof_sha256, {fold_sql} AS folded_root, {fold_sql} = root AS verified FROM whole"""


DIGEST_SQL = _sql()

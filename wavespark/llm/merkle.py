"""Merkle manifest of a dataset: a hash tree for each group of rows and one over the groups, and a proof for every row."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import ascii_lower, stored, table

#: Children of a node.
FANOUT = 8
#: Rows of a group that share one key where positions are joined to rows.
CHUNK = 4096

COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")
PROOF = "array<struct<left:string,right:string>>"


def digest(columns: Sequence[Column]) -> Column:
    """SHA-256 (lowercase hex) of the columns, each `-` if null, else its length in bytes, `:` and itself: no two rows that
    differ give the same bytes."""
    values = [c.cast("string") for c in columns]
    return F.sha2(F.concat(*[F.coalesce(F.concat(F.octet_length(v).cast("string"), F.lit(":"), v), F.lit("-")) for v in values]), 256)


def ranked(rows: DataFrame, by: Sequence[str]) -> DataFrame:
    """Rows with pos, the place (from 0) of each within its key when sorted by `by`, and n, the rows of the key.

    One range partitioning and sort by (key, *by, input order); within a partition the place is counted as rows go by, and
    what earlier partitions hold of a key is added from counts, one for each partition and key. No key is gathered: the
    counts are joined by key, partition and stretch of CHUNK rows, so a key with most rows is spread like any other. Rows
    alike in all of `by` take any order among themselves.
    """
    rows = rows.withColumn("_order", F.monotonically_increasing_id())
    dealt = rows.repartitionByRange("key", *by, "_order").sortWithinPartitions("key", *by, "_order").drop("_order")
    at = F.monotonically_increasing_id()
    dealt = stored(dealt.withColumn("_part", F.shiftright(at, 33)).withColumn("_at", at.bitwiseAND((1 << 33) - 1)))
    runs = dealt.groupBy("key", "_part").agg(F.min("_at").alias("_first"), F.count("*").alias("_count"))
    of_key = W.partitionBy("key")
    before = F.sum("_count").over(of_key.orderBy("_part")) - F.col("_count")
    runs = runs.select("key", "_part", "_first", "_count", before.alias("_before"), F.sum("_count").over(of_key).alias("n"))
    stretch = lambda c: F.floor(c / CHUNK)
    ends = F.sequence(stretch(F.col("_first")), stretch(F.col("_first") + F.col("_count") - 1))
    runs = runs.select("key", "_part", (F.col("_before") - F.col("_first")).alias("_shift"), "n", F.explode(ends).alias("_stretch"))
    placed = dealt.withColumn("_stretch", stretch(F.col("_at"))).join(runs, ["key", "_part", "_stretch"])
    return placed.withColumn("pos", F.col("_at") + F.col("_shift")).drop("_part", "_at", "_shift", "_stretch")


def _parents(nodes: DataFrame, fanout: int) -> DataFrame:
    """One level up: key, pos, n (nodes of the key on this level), digest, kids (the children's digests in order)."""
    groups = nodes.where("n > 1").groupBy("key", F.floor(F.col("pos") / fanout).alias("pos")).agg(
        F.max("n").alias("n"), F.array_sort(F.collect_list(F.struct("pos", "digest"))).alias("kids")
    )
    kids = F.transform("kids", lambda k: k["digest"])
    found = groups.select("key", "pos", F.ceil(F.col("n") / fanout).alias("n"), kids.alias("kids"))
    return found.withColumn("digest", F.sha2(F.array_join("kids", ""), 256))


def levels(leaves: DataFrame, fanout: int) -> list[DataFrame]:
    """The tree of each key, bottom up: leaves (key, pos, n, digest) and every level above them, each written. A key is on
    the levels up to the one where it has a single node."""
    found, most = [leaves], leaves.agg(F.max("n")).first()[0] or 0
    while most > 1:
        found.append(stored(_parents(found[-1], fanout)))
        most = -(-most // fanout)
    return found


def _siblings(kids: Column, at: Column) -> Column:
    """The other children on the left and the right of child number at (from 0), each side's digests joined."""
    left = F.array_join(F.slice(kids, F.lit(1), at), "")
    right = F.array_join(F.slice(kids, at + 2, F.greatest(F.size(kids) - at - 1, F.lit(0))), "")
    return F.struct(left.alias("left"), right.alias("right"))


def push(tree: list[DataFrame], tops: DataFrame, fanout: int) -> DataFrame:
    """The leaves of the tree with what they inherit: proof, from the leaf's own run upwards, and the columns of tops.

    tops (key, proof, ...) holds what the single top node of each key starts with. From the top level down, the nodes of a
    level join their parents, which have one run of children at most, and prepend their siblings to the parents' proofs.
    """
    carried = [c for c in tops.columns if c not in ("key", "proof")]
    upper = None
    for k in range(len(tree) - 1, -1, -1):
        nodes = tree[k]
        known = nodes.where("n = 1").join(tops, "key").select(*nodes.columns, "proof", *carried)
        if upper is not None:
            parents = upper.select("key", F.col("pos").alias("_up"), F.col("kids").alias("_run"), F.col("proof").alias("_suffix"), *carried)
            rest = nodes.where("n > 1").withColumn("_up", F.floor(F.col("pos") / fanout)).join(parents, ["key", "_up"])
            own = _siblings(F.col("_run"), F.pmod("pos", F.lit(fanout)).cast("int"))
            known = known.unionAll(rest.select(*nodes.columns, F.concat(F.array(own), "_suffix").alias("proof"), *carried))
        upper = stored(known) if k else known
    return upper


@dataclass
class Manifest:
    """leaves (key, pos, n, digest and the rows' own columns), the levels over them, and the tree over the groups' roots."""

    tree: list[DataFrame]
    over: list[DataFrame]
    fanout: int
    root: str | None

    def proofs(self) -> DataFrame:
        """Every leaf with subroot, root and proof: an array, from the leaf's run up to the root, of the siblings' digests on
        the left and on the right. fold(digest, proof) is the root."""
        start = self.over[-1].select("key").distinct().select("key", F.array().cast(PROOF).alias("proof"))
        groups = push(self.over, start, self.fanout)
        tops = groups.select(F.col("group").alias("key"), "proof", F.col("digest").alias("subroot"))
        return push(self.tree, stored(tops), self.fanout).withColumn("root", F.lit(self.root).cast("string"))


def fold(leaf: Column, proof: Column) -> Column:
    """The root that a leaf and its proof lead to."""
    return F.aggregate(proof, leaf, lambda node, side: F.sha2(F.concat(side["left"], node, side["right"]), 256))


def proof_digest(proof: Column) -> Column:
    """SHA-256 of all siblings, level by level, left to right."""
    return F.sha2(F.array_join(F.transform(proof, lambda side: F.concat(side["left"], side["right"])), ""), 256)


def build(docs: DataFrame, leaf: Column, group_col: str, id_col: str, more: dict[str, Column] | None = None, fanout: int = FANOUT) -> Manifest:
    """The manifest of docs, bottom up: in each group leaves ascend by id, and while a level has several nodes each run of
    fanout consecutive ones (the last run may be shorter, of one even) becomes the SHA-256 of its digests' text. The groups'
    roots, ordered by group (null first, then bytewise), have a tree of the same kind, whose top is the root.

    leaf is hashed in the scan, so contents are never shuffled; more are further columns of the leaves, by name. Every level
    is written and read again: a lost executor costs a reread, and a level is an eighth of the one below. The levels are
    built one after another, as many as the logarithm of the largest group.

    Defined results: a null group is a group of its own, before the empty one. Null ids come first. Rows alike in group and
    id are ordered by their digests, so equal rows may change places without any effect. A group of one leaf has that leaf as
    its root, and a single group's root is the root. Very long contents are hashed where they are read. Columns of docs
    clash with nothing, as only what is named is taken. An empty table has no leaves and no root.
    """
    key = F.coalesce(F.concat(F.lit("="), F.col(group_col).cast("string")), F.lit(""))
    extra = {f"more_{k}": c for k, c in (more or {}).items()}
    rows = docs.select(key.alias("key"), F.col(id_col).alias("id"), leaf.alias("digest"), *[c.alias(k) for k, c in extra.items()])
    leaves = stored(ranked(rows, ["id", "digest"]))
    tree = levels(leaves, fanout)
    roots = [level.where("n = 1").select("key", "digest") for level in tree]
    subroots = roots[0]
    for more_roots in roots[1:]:
        subroots = subroots.unionAll(more_roots)
    over = ranked(subroots.select(F.lit(0).alias("key"), F.col("key").alias("group"), "digest"), ["group"])
    over = levels(stored(over), fanout)
    top = over[-1].select("digest").first()
    return Manifest(tree, over, fanout, top and top[0])


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's proof, folded again from a leaf that has been tampered with where 3 divides the CRC of doc_id."""
    docs = table(spark, sf_dir, "documents")
    leaf = digest([F.col(c) for c in COLUMNS])
    lowered = ascii_lower(F.col("text"))
    tampered = F.when(F.crc32(F.col("doc_id").cast("string")) % 3 == 0, digest([lowered if c == "text" else F.col(c) for c in COLUMNS]))
    manifest = build(docs, leaf, "lang", "doc_id", {"tampered": tampered})
    found = manifest.proofs()
    folded = fold(F.coalesce("more_tampered", "digest"), F.col("proof"))
    found = found.select(F.col("id").alias("doc_id"), F.col("digest").alias("leaf"), "subroot", "root", proof_digest(F.col("proof")).alias("proof_sha256"), folded.alias("folded_root"))
    return found.withColumn("verified", F.col("folded_root") == F.col("root"))


def _leaf_sql(text: str) -> str:
    parts = [text if c == "text" else f"{c}::VARCHAR" for c in COLUMNS]
    return "sha256(" + " || ".join(f"coalesce(octet_length(encode({p})) || ':' || {p}, '-')" for p in parts) + ")"


OP11_SQL = f"""
WITH RECURSIVE crcs AS (
  SELECT doc_id, xor(list_reduce(
    list_transform(range(0, 8 * length(s)), lambda i: CASE WHEN i % 8 = 0 THEN ascii(s[i // 8 + 1]) ELSE 0 END::BIGINT),
    lambda c, x: CASE WHEN xor(c, x) & 1 = 1 THEN xor(xor(c, x) >> 1, 3988292384) ELSE xor(c, x) >> 1 END, 4294967295::BIGINT), 4294967295::BIGINT) AS crc
  FROM (SELECT DISTINCT doc_id, doc_id::VARCHAR AS s FROM documents)
), d AS (
  SELECT doc_id, coalesce('=' || lang, '') AS key, {_leaf_sql('text')} AS leaf,
    CASE WHEN crc % 3 = 0 THEN {_leaf_sql("translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} END AS tampered
  FROM documents LEFT JOIN crcs USING (doc_id)
), leaves AS (
  SELECT *, row_number() OVER (PARTITION BY key ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY key) AS n FROM d
), tree AS (
  SELECT key, 0 AS level, pos, n, leaf AS node FROM leaves
  UNION ALL
  SELECT key, level + 1, pos // {FANOUT}, (n + {FANOUT - 1}) // {FANOUT}, sha256(string_agg(node, '' ORDER BY pos)) FROM tree
  WHERE n > 1 GROUP BY key, level, n, pos // {FANOUT}
), subroots AS (
  SELECT key, node, row_number() OVER (ORDER BY key) - 1 AS pos, count(*) OVER () AS n FROM tree WHERE n = 1
), top AS (
  SELECT 0 AS level, pos, n, node FROM subroots
  UNION ALL
  SELECT level + 1, pos // {FANOUT}, (n + {FANOUT - 1}) // {FANOUT}, sha256(string_agg(node, '' ORDER BY pos)) FROM top WHERE n > 1 GROUP BY level, n, pos // {FANOUT}
), sides AS (
  SELECT a.key, a.level, a.pos, coalesce(string_agg(b.node, '' ORDER BY b.pos) FILTER (WHERE b.pos < a.pos), '') AS l,
    coalesce(string_agg(b.node, '' ORDER BY b.pos) FILTER (WHERE b.pos > a.pos), '') AS r
  FROM tree a JOIN tree b ON b.key = a.key AND b.level = a.level AND b.pos // {FANOUT} = a.pos // {FANOUT} WHERE a.n > 1 GROUP BY 1, 2, 3
), top_sides AS (
  SELECT a.level, a.pos, coalesce(string_agg(b.node, '' ORDER BY b.pos) FILTER (WHERE b.pos < a.pos), '') AS l,
    coalesce(string_agg(b.node, '' ORDER BY b.pos) FILTER (WHERE b.pos > a.pos), '') AS r
  FROM top a JOIN top b ON b.level = a.level AND b.pos // {FANOUT} = a.pos // {FANOUT} WHERE a.n > 1 GROUP BY 1, 2
), climb AS (
  SELECT key, pos AS leaf_pos, 0 AS level, pos, coalesce(tampered, leaf) AS node, '' AS proof FROM leaves
  UNION ALL
  SELECT c.key, leaf_pos, c.level + 1, c.pos // {FANOUT}, sha256(l || node || r), proof || l || r FROM climb c JOIN sides s ON s.key = c.key AND s.level = c.level AND s.pos = c.pos
), climbed AS (
  SELECT c.key, leaf_pos, 0 AS level, s.pos, c.node, proof, s.node AS subroot FROM climb c JOIN tree t ON t.key = c.key AND t.level = c.level AND t.n = 1 JOIN subroots s ON s.key = c.key
  UNION ALL
  SELECT c.key, leaf_pos, c.level + 1, c.pos // {FANOUT}, sha256(l || c.node || r), proof || l || r, subroot FROM climbed c JOIN top_sides s ON s.level = c.level AND s.pos = c.pos
), root AS (SELECT node AS root, level FROM top WHERE n = 1)
SELECT doc_id, leaf, subroot, root, sha256(proof) AS proof_sha256, c.node AS folded_root, c.node = root AS verified
FROM climbed c JOIN root ON root.level = c.level JOIN leaves ON leaves.key = c.key AND leaves.pos = c.leaf_pos
"""

"""A Merkle manifest of a table: one tree a source, a tree over the sources' roots, a proof for every row.

Rows are numbered within their source by one range partitioning: ``monotonically_increasing_id`` after a sort inside the
partitions, less what came before, so a source of any share of the rows is spread like the rest. Every level is a
self-join by shifted slots: with ``arity`` nodes a run, each node computes the indices of the others of its run, sends
its digest there, and an equijoin on (tree, index) brings every node its siblings; the nodes of slot zero then emit the
parents, one for sixteen. A node meets at most ``arity`` - 1 others, whatever the sizes of trees. Proofs are put together
from the top: a node's path is its own siblings and the path of its parent, which sixteen nodes share.

Defined results: nulls are written as ``-`` (see ``leaf_digest``); the null source is a source of its own and comes first;
a null id comes before others. Rows that repeat an id are ordered by their leaves and are leaves of their own, also where
they are equal. A tree of one node has that node as its root and no siblings; a table of one row has the digest of an
empty text as its proof. An empty table gives an empty one. Texts may have any length; extra columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut, table
from .word_runs import CRC32

#: Nodes a run.
ARITY = 16
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def digest(text: Column) -> Column:
    """Lowercase hex sha256."""
    return F.sha2(text, 256)


def leaf_digest(*columns: Column) -> Column:
    """The digest of a row: each value as its bytes' count, a colon and itself, or a dash for null."""
    plain = [c.cast("string") for c in columns]
    return digest(F.concat(*(F.coalesce(F.concat(F.octet_length(c).cast("string"), F.lit(":"), c), F.lit("-")) for c in plain)))


def numbered(rows: DataFrame, key: str, *order: str) -> tuple[DataFrame, DataFrame]:
    """``rows`` with idx, from 0 by ``order`` within each key, and total, the key's rows; and (key, tree, total), a row a key.

    ``tree`` is a number of the key that ascends with it. No key's rows are brought together.
    """
    parts = max(2, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    dealt = rows.repartitionByRange(parts, key, *order).sortWithinPartitions(key, *order)
    placed = cut(dealt.withColumn("place", F.monotonically_increasing_id())).withColumn("part", F.shiftright("place", 33))
    runs = placed.groupBy(key, "part").agg(F.min("place").alias("begin"), F.count(F.lit(1)).alias("n"))  # a row for a key and a partition
    ahead = Window.partitionBy(key).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    runs = runs.withColumn("ahead", F.coalesce(F.sum("n").over(ahead), F.lit(0)) - F.col("begin"))
    keys = runs.groupBy(key).agg(F.min("begin").alias("tree"), F.sum("n").alias("total"))
    shift = cut(runs.join(keys, key).select(key, "part", "ahead", "tree", "total"))
    out = placed.join(shift, [key, "part"]).withColumn("idx", F.col("place") + F.col("ahead")).drop("place", "part", "ahead")
    return out, shift.select(key, "tree", "total").distinct()


def with_siblings(nodes: DataFrame, arity: int = ARITY) -> DataFrame:
    """``nodes`` (tree, idx, total, digest, ...) with ``siblings``: the digests of the run's other nodes, left to right, as bytes."""
    slot = F.col("idx") % arity
    sent = nodes.select("tree", "idx", "total", F.unhex("digest").alias("digest")).withColumn("shift", F.explode(F.sequence(F.lit(1), F.lit(arity - 1))))
    sent = sent.select("tree", (F.col("idx") - slot + (slot + F.col("shift")) % arity).alias("to"), "total", F.struct(slot.alias("slot"), "digest").alias("other")).where("to < total")
    near = sent.groupBy("tree", F.col("to").alias("idx")).agg(F.sort_array(F.collect_list("other")).alias("others"))  # at most arity - 1
    joined = F.aggregate("others", F.lit(b""), lambda a, x: F.concat(a, x["digest"]))
    return nodes.join(near, ["tree", "idx"], "left").withColumn("siblings", F.coalesce(joined, F.lit(b""))).drop("others")


def parents(level: DataFrame, arity: int = ARITY) -> DataFrame:
    """The next level's nodes, emitted by the nodes of slot zero."""
    first = level.where(F.col("idx") % arity == 0)
    return first.select("tree", F.floor(F.col("idx") / arity).alias("idx"), F.ceil(F.col("total") / arity).alias("total"), digest(F.concat("digest", F.lower(F.hex("siblings")))).alias("digest"))


def forest(leaves: DataFrame, arity: int = ARITY) -> tuple[list[DataFrame], DataFrame]:
    """(levels, roots): the levels' nodes with their siblings, leaves first, and (tree, height, digest) of every tree."""
    levels, roots, nodes = [], [], leaves
    while True:
        roots.append(nodes.where("total = 1").select("tree", F.lit(len(levels)).alias("height"), "digest"))
        levels.append(cut(with_siblings(nodes, arity)))
        if levels[-1].where("total > 1").isEmpty():
            break
        nodes = cut(parents(levels[-1].where("total > 1"), arity))
    out = roots[0]
    for r in roots[1:]:
        out = out.unionByName(r)
    return levels, out


def with_paths(levels: list[DataFrame], above: DataFrame, arity: int = ARITY) -> DataFrame:
    """The leaves with ``path``, an array of (slot, siblings) from their own level up, and the columns of their tree.

    ``above``: (tree, height, up, ...), what a tree's root has above itself.
    """
    rest = [c for c in above.columns if c not in ("tree", "height", "up")]
    upper = None
    for k in range(len(levels) - 1, -1, -1):
        # a node's parent is a node of the level above or its tree's root; a lone leaf is its own root
        ends = above.where(F.col("height") == k + 1) if k else above.where("height <= 1")
        ends = ends.select("tree", F.lit(0).cast("long").alias("run"), "up", *rest)
        upper = ends if upper is None else upper.select("tree", F.col("idx").alias("run"), F.col("path").alias("up"), *rest).unionByName(ends)
        own = F.when(F.col("total") > 1, F.array(F.struct((F.col("idx") % arity).cast("int").alias("slot"), "siblings"))).otherwise(F.expr("cast(array() as array<struct<slot: int, siblings: binary>>)"))
        nodes = levels[k].where("total > 1") if k else levels[k]
        x = nodes.withColumn("run", F.floor(F.col("idx") / arity)).join(upper, ["tree", "run"])
        upper = x.withColumn("path", F.concat(own, "up")).drop("run", "up", "siblings")
        if k:
            upper = upper.select("tree", "idx", "path", *rest)
    return upper


def manifest(docs: DataFrame, arity: int = ARITY) -> DataFrame:
    """(doc_id, leaf, other_leaf, subroot, root, path): a row a row of docs, of (doc_id, source, lang, n_chars, text, other_text).

    ``other_leaf`` is the leaf of the row with ``other_text`` in place of its text. ``path`` has the slot and the
    siblings, as hexadecimal text, of every level from the leaf to the root.
    """
    columns = [F.col(c) for c in ("doc_id", "source", "lang", "n_chars")]
    source = F.coalesce(F.concat(F.lit("="), "source"), F.lit("-"))  # "-" comes before "="
    other = F.when(F.col("other_text").eqNullSafe(F.col("text")), F.lit(None)).otherwise(leaf_digest(*columns, F.col("other_text")))
    leaves = cut(docs.select(source.alias("key"), "doc_id", leaf_digest(*columns, F.col("text")).alias("digest"), other.alias("other")))
    nodes, _ = numbered(leaves, "key", "doc_id", "digest")
    levels, roots = forest(nodes.drop("key"), arity)
    tops, _ = numbered(cut(roots.select(F.lit("").alias("key"), F.col("tree").alias("source"), "digest", F.col("digest").alias("subroot"), "height")), "key", "source")
    top_levels, top_root = forest(tops.drop("key"), arity)
    none = F.expr("cast(array() as array<struct<slot: int, siblings: binary>>)")
    top = with_paths(top_levels, top_root.select("tree", "height", none.alias("up"), F.col("digest").alias("root")), arity)
    above = cut(top.select(F.col("source").alias("tree"), "height", F.col("path").alias("up"), "subroot", "root"))
    found = with_paths(levels, above, arity)
    path = F.transform("path", lambda x: F.struct(x["slot"].alias("slot"), F.lower(F.hex(x["siblings"])).alias("siblings")))
    return found.select("doc_id", F.col("digest").alias("leaf"), F.coalesce("other", "digest").alias("other_leaf"), "subroot", "root", path.alias("path"))


def folded(leaf: Column, path: Column) -> Column:
    """The root that a leaf and its path lead to."""
    def step(done: Column, x: Column) -> Column:
        at = x["slot"] * 64
        return digest(F.concat(F.substring(x["siblings"], F.lit(1), at), done, F.substring(x["siblings"], at + 1, F.length(x["siblings"]))))

    return F.aggregate(path, leaf, step)


def report(found: DataFrame) -> DataFrame:
    """The contract's columns: the digest of the proof, the root folded from the other leaf, and whether it is the root."""
    x = found.withColumn("folded_root", folded(F.col("other_leaf"), F.col("path")))
    proof = digest(F.array_join(F.transform("path", lambda p: p["siblings"]), ""))
    return x.select("doc_id", "leaf", "subroot", "root", proof.alias("proof_sha256"), "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


def tampered(docs: DataFrame) -> DataFrame:
    """``docs`` with other_text: A-Z lower-cased where 5 divides the crc32 of the id."""
    chosen = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(False))
    return docs.withColumn("other_text", F.when(chosen, F.translate("text", UPPER, LOWER)).otherwise(F.col("text")))


def op12_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "lang", "n_chars", "text")
    return report(manifest(tampered(docs)))


def _encoded(*names: str) -> str:
    return " || ".join(f"coalesce(strlen({n}::VARCHAR) || ':' || {n}::VARCHAR, '-')" for n in names)


#: Trees by number: 0 is the sources' own, source k has number k.
_ORACLE = f"""
WITH RECURSIVE rows AS (
  SELECT doc_id, dense_rank() OVER (ORDER BY source NULLS FIRST) AS tree, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST) - 1 AS idx, count(*) OVER (PARTITION BY source) AS total,
         sha256({_encoded("doc_id", "source", "lang", "n_chars", "text")}) AS leaf,
         sha256({_encoded("doc_id", "source", "lang", "n_chars")} || CASE WHEN {CRC32} % 5 = 0 THEN coalesce(strlen(text) || ':' || translate(text, '{UPPER}', '{LOWER}'), '-') ELSE {_encoded("text")} END) AS other
  FROM documents
), lower_nodes AS (
  SELECT tree, 0 AS level, idx, total, leaf AS digest FROM rows
  UNION ALL SELECT tree, level + 1, idx // 16, (min(total) + 15) // 16, sha256(string_agg(digest, '' ORDER BY idx)) FROM lower_nodes WHERE total > 1 GROUP BY tree, level, idx // 16
), subroots AS (
  SELECT tree, digest FROM lower_nodes WHERE total = 1
), upper_nodes AS (
  SELECT 0 AS tree, 0 AS level, tree - 1 AS idx, count(*) OVER () AS total, digest FROM subroots
  UNION ALL SELECT tree, level + 1, idx // 16, (min(total) + 15) // 16, sha256(string_agg(digest, '' ORDER BY idx)) FROM upper_nodes WHERE total > 1 GROUP BY tree, level, idx // 16
), nodes AS (
  SELECT tree, level, idx, digest FROM lower_nodes WHERE total > 1 UNION ALL SELECT tree, level, idx, digest FROM upper_nodes WHERE total > 1
), around AS (
  SELECT a.tree, a.level, a.idx, coalesce(string_agg(b.digest, '' ORDER BY b.idx) FILTER (WHERE b.idx < a.idx), '') AS l, coalesce(string_agg(b.digest, '' ORDER BY b.idx) FILTER (WHERE b.idx > a.idx), '') AS r
  FROM nodes a JOIN nodes b ON a.tree = b.tree AND a.level = b.level AND a.idx // 16 = b.idx // 16 GROUP BY a.tree, a.level, a.idx
), heights AS (
  SELECT tree, max(level) AS height FROM lower_nodes GROUP BY tree
), steps AS (
  SELECT doc_id, leaf, tree AS home, 0 AS step, CASE WHEN height = 0 THEN 0 ELSE tree END AS tree, 0 AS level, CASE WHEN height = 0 THEN tree - 1 ELSE idx END AS idx, other AS now, '' AS proof FROM rows JOIN heights USING (tree)
  UNION ALL
  SELECT s.doc_id, s.leaf, s.home, s.step + 1, CASE WHEN s.level + 1 = height THEN 0 ELSE s.tree END, CASE WHEN s.tree > 0 AND s.level + 1 = height THEN 0 ELSE s.level + 1 END,
         CASE WHEN s.tree > 0 AND s.level + 1 = height THEN s.tree - 1 ELSE s.idx // 16 END, sha256(l || now || r), proof || l || r
  FROM steps s JOIN around a ON s.tree = a.tree AND s.level = a.level AND s.idx = a.idx LEFT JOIN heights h ON h.tree = s.tree
), ends AS (
  SELECT doc_id, leaf, home, arg_max(now, step) AS folded_root, arg_max(proof, step) AS proof FROM steps GROUP BY doc_id, leaf, home
), root AS (
  SELECT digest AS root FROM upper_nodes WHERE total = 1
)
SELECT doc_id, leaf, s.digest AS subroot, root, sha256(proof) AS proof_sha256, folded_root, folded_root = root AS verified FROM ends JOIN subroots s ON s.tree = home CROSS JOIN root
"""

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {"op12_manifest": op12_manifest}
ORACLE_SQL: dict[str, str] = {"op12_manifest": _ORACLE}

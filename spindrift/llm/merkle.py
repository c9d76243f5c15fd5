"""Merkle manifest of a dataset: blocks of ordered leaves, collapsed by higher-order functions.

The leaves of a group (a source) are cut into blocks of ``FAN_OUT ** LEVELS`` consecutive ones.  A block is an ordered
array in one row, which sequence, transform, slice and aggregate collapse to its root; block roots are the leaves of
the next round, and the roots of groups are the leaves of one more tree.  So a round divides the rows by the size of a
block, and no task ever holds more than blocks.  On the way back every block is told the path of its root, and a
leaf's proof is the siblings in its own block and then that path.

Positions come from range partitions: a row's place in its partition, plus the rows of earlier partitions of its
group.  A group of any size is therefore spread over as many partitions as it fills.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import in_fewer_files, materialize

FAN_OUT, LEVELS = 16, 2
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
COLUMNS = ("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value computed once, however often body uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def field(value: Column) -> Column:
    """``-`` for null, else UTF-8 byte count, colon, value."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_of(doc_id: Column, source: Column, lang: Column, n_chars: Column, text: Column) -> Column:
    return F.sha2(F.concat(*map(field, (doc_id, source, lang, n_chars, text))), 256)


# -- one block: an array of digests ----------------------------------------------------------------------------------------


def joined(digests: Column) -> Column:
    return F.array_join(digests, "")


def next_level(nodes: Column) -> Column:
    """The digests of runs of FAN_OUT consecutive nodes."""
    runs = F.sequence(F.lit(0), F.floor((F.size(nodes) - 1) / FAN_OUT).cast("int"))
    return F.transform(runs, lambda k: F.sha2(joined(F.slice(nodes, k * FAN_OUT + 1, F.lit(FAN_OUT))), 256))


def levels_of(nodes: Column, n_levels: Column) -> Column:
    """array of arrays: the nodes, and each of the n_levels levels above them."""
    steps = F.when(n_levels > 0, F.sequence(F.lit(1), n_levels)).otherwise(F.array().cast("array<int>"))
    return F.aggregate(steps, F.array(nodes), lambda levels, _: F.concat(levels, F.array(next_level(F.element_at(levels, -1)))))


def path_of(levels: Column, place: Column) -> Column:
    """array of struct(left, right): what stands beside the node at ``place`` (from 0) in its run, level by level."""

    def beside(level: Column, k: Column) -> Column:
        at = F.floor(place / F.pow(F.lit(float(FAN_OUT)), k)).cast("int")
        begin = F.floor(at / FAN_OUT).cast("int") * FAN_OUT
        return F.struct(joined(F.slice(level, begin + 1, at - begin)).alias("left"), joined(F.slice(level, at + 2, begin + FAN_OUT - 1 - at)).alias("right"))

    return F.transform(F.slice(levels, F.lit(1), F.size(levels) - 1), beside)


def siblings(path: Column) -> Column:
    return joined(F.transform(path, lambda x: F.concat(x["left"], x["right"])))


def folded(path: Column, digest: Column) -> Column:
    return F.aggregate(path, digest, lambda d, x: F.sha2(F.concat(x["left"], d, x["right"]), 256))


# -- trees of groups -------------------------------------------------------------------------------------------------------


def positions(df: DataFrame, order: list[str], label: str) -> DataFrame:
    """df (group, ...) with ``pos``: each row's place in its group by ``order``, from 0, and ``total``, the group's rows.

    Written, so that partition numbers hold.  The offsets have a row for each group in each partition.
    """
    dealt = df.repartitionByRange(F.col("group").asc_nulls_first(), *order).withColumn("__part", F.spark_partition_id())
    dealt = materialize(dealt, label)
    counts = dealt.groupBy("group", "__part").agg(F.count("*").alias("n"))
    mine = Window.partitionBy("group")
    offsets = counts.select(F.col("group").alias("__group"), F.col("__part").alias("__of"), (F.sum("n").over(mine.orderBy("__part")) - F.col("n")).alias("before"), F.sum("n").over(mine).alias("total"))
    place = F.row_number().over(Window.partitionBy("group", "__part").orderBy(*order))
    rows = dealt.withColumn("k", place - 1)
    same = rows["group"].eqNullSafe(offsets["__group"]) & (rows["__part"] == offsets["__of"])
    return rows.join(offsets, same).withColumn("pos", F.col("before") + F.col("k")).drop("__part", "__group", "__of", "before", "k")


def tree_levels(total: Column) -> Column:
    """Levels above ``total`` leaves: the least n with FAN_OUT ** n >= total."""
    powers = F.array(*[F.lit(FAN_OUT**n) for n in range(1, 16)])
    return F.size(F.filter(powers, lambda p: p < total)) + F.when(total > 1, 1).otherwise(0)


def blocks(nodes: DataFrame, value: Column) -> DataFrame:
    """(group, block, left, entries, digests, levels): rows of blocks of nodes (group, pos, left, ...).

    left: the levels of the group's tree that are still above its nodes; entries: ``value`` in order.
    """
    size = FAN_OUT**LEVELS
    packed = nodes.groupBy("group", F.floor(F.col("pos") / size).alias("block"), "left").agg(F.array_sort(F.collect_list(F.struct("pos", value.alias("v")))).alias("e"))
    entries = F.transform("e", lambda x: x["v"])
    return packed.select("group", "block", "left", entries.alias("entries"), F.least(F.lit(LEVELS), F.col("left")).alias("n"))


def roots_of(packed: DataFrame, digest: Callable[[Column], Column]) -> DataFrame:
    """The roots of blocks, as nodes (group, pos, left, digest) of the next round."""
    top = F.element_at(F.element_at(levels_of(F.transform("entries", digest), F.col("n")), -1), 1)
    return packed.select("group", F.col("block").alias("pos"), (F.col("left") - F.col("n")).alias("left"), top.alias("digest"))


def grow(packed: DataFrame, digest: Callable[[Column], Column], label: str) -> tuple[list[DataFrame], DataFrame]:
    """(rounds, tops): the blocks of block roots of every further round, lowest first, and (group, digest) of whole trees."""
    rounds, done = [], None
    nodes = materialize(in_fewer_files(roots_of(packed, digest)), label)
    while True:
        finished = nodes.where("left = 0").select("group", "digest")
        done = finished if done is None else done.unionByName(finished)
        if nodes.where("left > 0").isEmpty():
            return rounds, done
        rounds.append(blocks(nodes.where("left > 0"), F.col("digest")))
        nodes = materialize(in_fewer_files(roots_of(rounds[-1], lambda x: x)), label)


def handed_down(rounds: list[DataFrame], tops: DataFrame, label: str) -> DataFrame:
    """(group, block, path, subroot, root) of the lowest blocks; tops (group, path, subroot, root) are of whole trees.

    A tree's top block has number 0; blocks of a round are found under the blocks of the next.
    """
    named = tops.select("group", F.lit(0).cast("long").alias("block"), "path", "subroot", "root")
    waiting = named
    for packed in reversed(rounds):
        parent = packed.join(waiting.withColumnRenamed("group", "__group").withColumnRenamed("block", "__block"), F.col("group").eqNullSafe(F.col("__group")) & (F.col("block") == F.col("__block")))
        inside = let(levels_of(F.col("entries"), F.col("n")), lambda levels: F.transform(F.col("entries"), lambda _, i: F.concat(path_of(levels, i), F.col("path"))))
        told = parent.select("group", "block", "subroot", "root", F.posexplode(inside).alias("i", "path"))
        told = told.select("group", (F.col("block") * FAN_OUT**LEVELS + F.col("i")).alias("block"), "path", "subroot", "root")
        lower = named.join(packed.select(F.col("group").alias("__group")).distinct(), F.col("group").eqNullSafe(F.col("__group")), "left_anti")
        waiting = materialize(in_fewer_files(told.unionByName(lower)), label)
    return waiting


def manifest(df: DataFrame, tampered: Column | None = None) -> DataFrame:
    """One row per row of df, columns COLUMNS: leaf, its group's root, the root, its proof's digest, and a verification.

    df has doc_id, source, lang, n_chars and text; further columns are ignored, and what is null is hashed as ``-``.  A
    null source is a group of its own, the first.  Leaves of a group ascend by doc_id, null first, and those of equal
    doc_id by leaf: repeated rows are leaves of their own, which no order tells apart.  A very long text is read once, for its leaf.
    ``tampered`` is a text that stands for the row's in verification (by default the text itself).  An empty df gives no rows.
    """
    of = lambda name: F.col(f"`{name}`")
    leaf = lambda text: leaf_of(of("doc_id"), of("source"), of("lang"), of("n_chars"), text)
    shown = F.col("leaf") if tampered is None else F.when(tampered.eqNullSafe(of("text")), F.col("leaf")).otherwise(leaf(tampered))
    leaves = df.withColumn("leaf", leaf(of("text"))).select(of("source").alias("group"), of("doc_id").alias("doc_id"), "leaf", F.nullif(shown, F.col("leaf")).alias("shown"))
    placed = positions(leaves, ["doc_id", "leaf"], "leaves").withColumn("left", tree_levels(F.col("total")))
    packed = materialize(blocks(placed, F.struct("doc_id", "leaf", "shown")), "blocks")
    rounds, subroots = grow(packed, lambda x: x["leaf"], "nodes")

    # Subroots, ordered by source, are the leaves of one more tree, whose only group is null.
    tree = positions(subroots.select(F.lit(None).cast("string").alias("group"), F.col("group").alias("name"), "digest"), ["name"], "subroots").withColumn("left", tree_levels(F.col("total")))
    upper = materialize(blocks(tree, F.struct("name", "digest")), "blocks")
    more, root = grow(upper, lambda x: x["digest"], "nodes")
    no_path = F.array().cast("array<struct<left:string,right:string>>")
    down = handed_down(more, root.select("group", no_path.alias("path"), F.lit(None).cast("string").alias("subroot"), F.col("digest").alias("root")), "paths")
    named = upper.join(down.select("block", "path", "root"), "block")
    inside = let(levels_of(F.transform("entries", lambda x: x["digest"]), F.col("n")), lambda levels: F.transform("entries", lambda x, i: F.struct(x["name"].alias("group"), x["digest"].alias("subroot"), F.concat(path_of(levels, i), F.col("path")).alias("path"))))
    tops = materialize(in_fewer_files(named.select("root", F.explode(inside).alias("x")).select("x.group", "x.path", "x.subroot", "root")), "paths")

    down = handed_down(rounds, tops, "paths").withColumnRenamed("group", "__group").withColumnRenamed("block", "__block")
    leaves = packed.join(down, F.col("group").eqNullSafe(F.col("__group")) & (F.col("block") == F.col("__block")))

    def proved(levels: Column) -> Column:
        def entry(x: Column, i: Column) -> Column:
            return let(F.concat(path_of(levels, i), F.col("path")), lambda path: F.struct(x["doc_id"].alias("doc_id"), x["leaf"].alias("leaf"), F.sha2(siblings(path), 256).alias("proof_sha256"), folded(path, F.coalesce(x["shown"], x["leaf"])).alias("folded_root")))

        return F.transform("entries", entry)

    found = leaves.select("subroot", "root", F.explode(let(levels_of(F.transform("entries", lambda x: x["leaf"]), F.col("n")), proved)).alias("x")).select("x.*", "subroot", "root")
    return found.withColumn("verified", F.col("folded_root") == F.col("root")).select(*COLUMNS)


def tampered_text(doc_id: Column, text: Column, every: int = 5) -> Column:
    """text with A-Z lower-cased where ``every`` divides crc32 of doc_id in decimal, else text."""
    hit = F.crc32(doc_id.cast("string")) % every == 0
    return F.when(hit, F.translate(text, UPPER, LOWER)).otherwise(text)


#: Trees by recursion over levels, in every group at once; proofs by joining each leaf with the runs it is under.
ORACLE = r"""
WITH RECURSIVE
enc AS (SELECT doc_id, source, text, concat(
    coalesce(concat(strlen(CAST(doc_id AS VARCHAR)), ':', CAST(doc_id AS VARCHAR)), '-'), coalesce(concat(strlen(source), ':', source), '-'),
    coalesce(concat(strlen(lang), ':', lang), '-'), coalesce(concat(strlen(CAST(n_chars AS VARCHAR)), ':', CAST(n_chars AS VARCHAR)), '-')) AS head FROM documents),
seen AS (SELECT *, translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS low FROM enc),
leaves AS (SELECT doc_id, source, sha256(concat(head, coalesce(concat(strlen(text), ':', text), '-'))) AS leaf,
    sha256(concat(head, coalesce(concat(strlen(low), ':', low), '-'))) AS low_leaf, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS pos FROM seen),
t(level, source, pos, digest, n) AS (
  SELECT 0, source, pos, leaf, count(*) OVER (PARTITION BY source) FROM leaves
  UNION ALL
  SELECT level, source, pos, digest, count(*) OVER (PARTITION BY source) FROM (
    SELECT level + 1 AS level, source, pos // 16 AS pos, sha256(string_agg(digest, '' ORDER BY pos)) AS digest FROM t WHERE n > 1 GROUP BY level, source, pos // 16)),
subs AS (SELECT source, digest, level FROM t WHERE n = 1),
ranked AS (SELECT *, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS k FROM subs),
u(level, pos, digest, n) AS (
  SELECT 0, k, digest, count(*) OVER () FROM ranked
  UNION ALL
  SELECT level, pos, digest, count(*) OVER () FROM (SELECT level + 1 AS level, pos // 16 AS pos, sha256(string_agg(digest, '' ORDER BY pos)) AS digest FROM u WHERE n > 1 GROUP BY level, pos // 16)),
steps AS (
  SELECT l.doc_id, t.level AS step, coalesce(string_agg(t.digest, '' ORDER BY t.pos) FILTER (t.pos < l.pos // CAST(pow(16, t.level) AS BIGINT)), '') AS lhs,
    coalesce(string_agg(t.digest, '' ORDER BY t.pos) FILTER (t.pos > l.pos // CAST(pow(16, t.level) AS BIGINT)), '') AS rhs
  FROM leaves l JOIN t ON t.source IS NOT DISTINCT FROM l.source AND t.n > 1 AND t.pos // 16 = l.pos // CAST(pow(16, t.level + 1) AS BIGINT) GROUP BY l.doc_id, l.pos, t.level
  UNION ALL
  SELECT l.doc_id, r.level + u.level, coalesce(string_agg(u.digest, '' ORDER BY u.pos) FILTER (u.pos < r.k // CAST(pow(16, u.level) AS BIGINT)), ''),
    coalesce(string_agg(u.digest, '' ORDER BY u.pos) FILTER (u.pos > r.k // CAST(pow(16, u.level) AS BIGINT)), '')
  FROM leaves l JOIN ranked r ON r.source IS NOT DISTINCT FROM l.source JOIN u ON u.n > 1 AND u.pos // 16 = r.k // CAST(pow(16, u.level + 1) AS BIGINT) GROUP BY l.doc_id, r.level, r.k, u.level),
proofs AS (SELECT doc_id, sha256(string_agg(lhs || rhs, '' ORDER BY step)) AS proof FROM steps GROUP BY doc_id),
tab AS (SELECT list_transform(range(256), lambda n: list_reduce([n, 1, 1, 1, 1, 1, 1, 1, 1], lambda c, x: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS crc),
shown AS (SELECT doc_id, CASE WHEN xor(list_reduce(list_prepend(4294967295, list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda x: CAST(ascii(x) AS BIGINT))),
    lambda c, b: xor(crc[(xor(c, b) & 255) + 1], c >> 8)), 4294967295) % 5 = 0 THEN low_leaf ELSE leaf END AS digest FROM leaves, tab),
f(doc_id, step, digest) AS (
  SELECT doc_id, 0, digest FROM shown
  UNION ALL
  SELECT f.doc_id, f.step + 1, sha256(s.lhs || f.digest || s.rhs) FROM f JOIN steps s ON s.doc_id = f.doc_id AND s.step = f.step),
ends AS (SELECT doc_id, max_by(digest, step) AS folded FROM f GROUP BY doc_id)
SELECT l.doc_id, l.leaf, s.digest AS subroot, r.digest AS root, coalesce(p.proof, sha256('')) AS proof_sha256, e.folded AS folded_root, e.folded = r.digest AS verified
FROM leaves l JOIN subs s ON s.source IS NOT DISTINCT FROM l.source JOIN (SELECT digest FROM u WHERE n = 1) r ON true LEFT JOIN proofs p ON p.doc_id = l.doc_id JOIN ends e ON e.doc_id = l.doc_id
"""

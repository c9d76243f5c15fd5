"""Near-duplicate classes by a chosen-path set similarity join over word shingles.

Equal sets are one record.  In every tree a record chooses a path: at a node it takes the branches of one or two minwise
tokens, which tokens depending on the node alone, so similar records choose alike.  Nodes of at most ``NODE`` records are
compared exhaustively, by a wide fingerprint that measures the similarity; larger ones branch again, to a stated depth.
A node that is still large there (it must be dense: its records agree on many minwise tokens) is compared in chunks, and
each of its records with the node's pivots, the records closest to the others of their chunk; what is then outside the
node's largest class meets every record of the node, in cells of two chunks (``cells``).  Trees are repeated until
the stated similarity is found with the target recall (``trees_for``).

What is near by fingerprint is only a candidate.  The candidates' components are confirmed on full sets: small components
whole, in one task each; larger ones link by link, every record's best open candidate at a time, until each candidate is
a link, is refuted, or lies within a class.  What then still has near records of another class in a node is compared there
once more, on full sets, so a closer but refuted candidate hides no link.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import components, discard, doc_texts, in_fewer_files, materialize, settle, slices
from .simhash import WIDE, _mixed, _odd, _runs, cells, classes_of, confirmed_together, shingle_set, similar

#: Minwise tokens of a record; records of a node compared at once; levels; and the chance of a second branch below the first.
MINS, NODE, DEPTH, SECOND = 32, 1024, 4, 0.5
#: Pivots of a node that is large at the last level, and of them how many a chunk may name.
PIVOTS, NAMED = 64, 2
#: Shingles of a component that one task confirms whole.
WHOLE = 2_000_000
#: Standard deviations below the threshold at which a fingerprint still makes a candidate.
DEVIATIONS = 4.0
#: Sets of at most so many shingles are given so many bits more, for ties in a bit's majority widen their distances.
FEW, FEW_BITS = 16, 32
#: Links of one record that share a task.
LINKS_A_TASK = 2048


# -- records ---------------------------------------------------------------------------------------------------------------


def digest_of(hashes: np.ndarray) -> int:
    """A signed 64-bit name of a set of hashes; sets are taken as equal if their names are."""
    import xxhash

    return int(np.uint64(xxhash.xxh64_intdigest(hashes.tobytes(), 7)).astype(np.int64))


def record_of(hashes: np.ndarray) -> tuple[np.ndarray, bytes]:
    """(minwise tokens, wide fingerprint) of a set; of MINS hash functions each one's least value."""
    mins, wide = np.full(MINS, np.iinfo(np.uint64).max, np.uint64), np.zeros(64 * WIDE, np.int64)
    for at in range(0, len(hashes), 255):  # sums of so few bits fit a byte
        part = hashes[at : at + 255]
        np.minimum(mins, _mixed(part, _odd(MINS, 11)).min(axis=0), out=mins)
        bits = np.unpackbits(_mixed(part, _odd(WIDE, 12)).view(np.uint8), axis=1, bitorder="little")
        wide += np.add.reduce(bits, axis=0, dtype=np.uint8)
    return mins, np.packbits(2 * wide > len(hashes), bitorder="little").tobytes()


NAMES = "doc_id long, n long, fp long, mins array<long>, wide binary"


def records(docs: DataFrame, words: int) -> DataFrame:
    """(doc_id, n, fp, mins, wide) of docs (doc_id, data); an empty set has n 0."""
    heads = [f.split()[0] for f in NAMES.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1):
            n, fps, mins, wides = [], [], [], []
            for x in batch.column(1):
                hashes = shingle_set(x.as_py(), words)
                least, wide = record_of(hashes)
                n.append(len(hashes))
                fps.append(digest_of(hashes))
                mins.append(least.view(np.int64))
                wides.append(wide)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(fps, pa.int64()), pa.array(mins, pa.list_(pa.int64())), pa.array(wides, pa.binary())], heads)

    return docs.mapInArrow(run, NAMES)


# -- trees -----------------------------------------------------------------------------------------------------------------


def survival(similarity: float, depth: int = DEPTH, second: float = SECOND) -> float:
    """The chance that two records of this similarity share a node on every level of a tree down to ``depth``.

    A branch is shared with probability ``similarity``; below the first level, where both branches are taken, the second is
    taken with chance ``second``.
    """
    alive = 1.0
    for level in range(depth, 0, -1):
        shared = similarity * alive
        missed = (1 - shared) * (1 - shared * (1.0 if level == 1 else second))
        alive = 1 - missed
    return alive


def trees_for(similarity: float, recall: float) -> int:
    """Trees of which at least one brings a pair of this similarity together to the last level with chance ``recall``."""
    return max(1, math.ceil(math.log(1 - recall) / math.log(1 - survival(similarity))))


def branches(node: Column, mins: Column, both: bool) -> Column:
    """array of the child nodes that a record with these minwise tokens chooses at ``node``."""

    def child(k: int) -> Column:
        chosen = F.pmod(F.xxhash64(node, F.lit(k)), F.lit(MINS)).cast("int")
        return F.xxhash64(node, chosen, F.get(mins, chosen))

    second = F.lit(both) | (F.pmod(F.xxhash64(node, F.lit(2)), F.lit(1000)) < int(1000 * SECOND))
    return F.array_distinct(F.when(second, F.array(child(0), child(1))).otherwise(F.array(child(0))))


def leaves(nodes: DataFrame, trees: int, node_limit: int, depth: int) -> tuple[DataFrame, DataFrame | None, list[DataFrame]]:
    """((node, fp, n) of nodes to compare, the same of nodes too large at the last level or None, written tables); nodes
    has (fp, mins)."""
    roots = F.array(*[F.lit(t).cast("long") for t in range(trees)])
    rows = nodes.select("fp", F.explode(F.array_distinct(F.flatten(F.transform(roots, lambda t: branches(t, F.col("mins"), True))))).alias("node"))
    small, tables = None, []
    for level in range(1, depth + 1):
        sizes = materialize(in_fewer_files(rows.groupBy("node").agg(F.count("*").alias("n")).where("n > 1")), "nodes")
        ready = rows.join(sizes.where(F.col("n") <= node_limit), "node").select("node", "fp", "n")
        small = ready if small is None else small.unionByName(ready)
        large = rows.join(sizes.where(F.col("n") > node_limit), "node").select("node", "fp", "n")
        tables.append(sizes)
        if sizes.agg(F.max("n")).first()[0] is None or sizes.where(F.col("n") > node_limit).isEmpty():
            return small, None, tables
        if level == depth:
            return small, large, tables
        chosen = large.select("node", "fp").join(nodes, "fp").select("fp", F.explode(branches(F.col("node"), F.col("mins"), False)).alias("node"))
        rows = materialize(in_fewer_files(chosen), "branches")
        tables.append(rows)


# -- within a node ---------------------------------------------------------------------------------------------------------


def candidate_distance(similarity: float, deviations: float = DEVIATIONS) -> int:
    """Bits of the wide fingerprint in which sets of this similarity differ, plus so many standard deviations."""
    p = math.acos(2 * similarity / (1 + similarity)) / math.pi
    n = 64 * WIDE
    return max(0, round(n * p + deviations * math.sqrt(n * p * (1 - p))))


def distances(bits: np.ndarray, sizes: np.ndarray, others: np.ndarray, at: int, similarity: float) -> np.ndarray:
    """Bits between record ``at`` and others, with the allowance for few shingles; FAR where sizes rule the similarity out."""
    d = np.bitwise_count(bits[others] ^ bits[at]).sum(axis=1, dtype=np.int64)
    low, high = np.minimum(sizes[others], sizes[at]), np.maximum(sizes[others], sizes[at])
    d[low <= FEW] = np.maximum(d[low <= FEW] - FEW_BITS, 0)
    d[low < similarity * high - 1e-9] = FAR
    return d


FAR = 1 << 30


def nearest_forest(bits: np.ndarray, sizes: np.ndarray, similarity: float, distance: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(a, b, d): a minimum spanning forest of all pairs at most ``distance`` bits apart whose sizes allow the similarity.

    Prim's algorithm: every record joins by its closest pair, so each record's nearest is in it.
    """
    n = len(bits)
    best, by, rest = np.full(n, FAR), np.zeros(n, np.int64), np.ones(n, bool)
    a, b, d = [], [], []
    at = 0
    for _ in range(n):
        rest[at] = False
        left = np.flatnonzero(rest)
        if not len(left):
            break
        away = distances(bits, sizes, left, at, similarity)
        nearer = away < best[left]
        best[left[nearer]], by[left[nearer]] = away[nearer], at
        at = int(left[best[left].argmin()])
        if best[at] <= distance:
            a.append(at)
            b.append(int(by[at]))
            d.append(int(best[at]))
    return np.array(a, np.int64), np.array(b, np.int64), np.array(d, np.int64)


NEAR = "a long, b long, d long, node long, close long"
_LONG = pa.int64()


def _near(a, b, d, node=None, close=None) -> pa.RecordBatch:
    n = len(a)
    rest = [pa.nulls(n, _LONG) if x is None else pa.array(np.broadcast_to(x, n).astype(np.int64)) for x in (node, close)]
    return pa.RecordBatch.from_arrays([pa.array(a, _LONG), pa.nulls(n, _LONG) if b is None else pa.array(b, _LONG), pa.nulls(n, _LONG) if d is None else pa.array(d, _LONG), *rest], [f.split()[0] for f in NEAR.split(", ")])


def _compare(similarity: float, n_keys: int, name_pivots: bool):
    """Rows (node[, salt], fp, size, wide) sorted by key: candidates of each group; of chunks also their pivots, b null."""
    loose = candidate_distance(similarity)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, rows, _ in _runs(batches, n_keys, None):
            fps, sizes = rows.column(n_keys).to_numpy(), rows.column(n_keys + 1).to_numpy()
            bits = np.frombuffer(b"".join(rows.column(n_keys + 2).to_pylist()), np.uint64).reshape(-1, WIDE)
            a, b, d = nearest_forest(bits, sizes, similarity, loose)
            if len(a):
                yield _near(fps[a], fps[b], d)
            if name_pivots:
                close = np.array([np.maximum(loose - np.bitwise_count(bits ^ x).sum(axis=1, dtype=np.int64), 0).sum() for x in bits])
                top = np.argsort(-close, kind="stable")[:NAMED]
                yield _near(fps[top], None, None, key[0], close[top])

    return run


def _crossing(similarity: float):
    """Rows (key, fp, size, wide, class) sorted by key: (key, fp) of records with a near record of another class."""
    loose = candidate_distance(similarity)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, rows, _ in _runs(batches, 1, None):
            fps, sizes, classes = (rows.column(k).to_numpy() for k in (1, 2, 4))
            if (classes == classes[0]).all():
                continue
            bits, everyone = np.frombuffer(b"".join(rows.column(3).to_pylist()), np.uint64).reshape(-1, WIDE), np.arange(len(fps))
            hit = np.array([(distances(bits, sizes, everyone, k, similarity)[classes != classes[k]] <= loose).any() for k in everyone])
            if hit.any():
                yield pa.RecordBatch.from_arrays([pa.array(np.full(hit.sum(), key[0])), pa.array(fps[hit])], ["key", "fp"])

    return run


def _with_pivots(similarity: float):
    """Rows (node, salt, pivot 0 or 1, fp, size, wide) sorted so that pivots come last: every record's closest pivot."""
    loose = candidate_distance(similarity)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, rows, _ in _runs(batches, 2, None):
            pivot, fps, sizes = (rows.column(k).to_numpy() for k in (2, 3, 4))
            bits = np.frombuffer(b"".join(rows.column(5).to_pylist()), np.uint64).reshape(-1, WIDE)
            at, others = np.flatnonzero(pivot == 1), np.flatnonzero(pivot == 0)
            best, by = np.full(len(others), FAR), np.zeros(len(others), np.int64)
            for p in at:
                d = distances(bits, sizes, others, p, similarity)
                d[fps[others] == fps[p]] = FAR
                by[d < best], best = p, np.minimum(best, d)
            near = best <= loose
            if near.any():
                yield _near(fps[others[near]], fps[by[near]], best[near])

    return run


def candidates(recs: DataFrame, similarity: float, recall: float, node_limit: int, depth: int) -> tuple[DataFrame, DataFrame, list[DataFrame]]:
    """(near, meetings, written tables) of records (fp, n, mins, wide), themselves written.

    near (a, b, d): candidate links a > b, d bits apart; written.  Their components are those of all near pairs of a node.
    meetings (key, fp, node, salt): the records that are compared with each other, in nodes and in chunks with pivots; a
    record of a chunk has its node and salt.
    """
    small, large, tables = leaves(recs.select("fp", "mins"), trees_for(similarity, recall), node_limit, depth)
    shape = recs.select("fp", F.col("n").alias("size"), "wide")
    nothing = F.lit(None).cast("long")
    meetings = small.select(F.col("node").alias("key"), "fp", nothing.alias("node"), nothing.alias("salt"))

    def compared(met: DataFrame) -> DataFrame:
        dealt = met.join(shape, "fp").select("key", "fp", "size", "wide")
        return dealt.repartition("key").sortWithinPartitions("key").mapInArrow(_compare(similarity, 1, False), NEAR)

    paired = lambda df: settle(df.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"), "d").distinct(), "candidates")
    near = compared(meetings)
    if large is not None:
        salted = materialize(in_fewer_files(large.select("node", "fp", F.pmod(F.xxhash64("fp", "node"), F.ceil(F.col("n") / node_limit).cast("long")).alias("salt"))), "chunks")
        members = salted.select("node", "salt", "fp").join(shape, "fp").select("node", "salt", "fp", "size", "wide")
        chunks = materialize(members.repartition("node", "salt").sortWithinPartitions("node", "salt").mapInArrow(_compare(similarity, 2, True), NEAR), "chunks")
        tables += [salted, chunks]
        rank = F.row_number().over(Window.partitionBy("node").orderBy(F.desc("close"), "a"))
        pivots = chunks.where("b is null").withColumn("k", rank).where(F.col("k") <= PIVOTS).select("node", F.col("a").alias("fp"))
        held = pivots.join(salted.select("node", "salt").distinct(), "node").select("node", "salt", "fp")
        shaped = held.join(shape, "fp").select("node", "salt", F.lit(1).alias("pivot"), "fp", "size", "wide")
        both = members.withColumn("pivot", F.lit(0)).select(*shaped.columns).unionByName(shaped)
        met = both.repartition("node", "salt").sortWithinPartitions("node", "salt", "pivot").mapInArrow(_with_pivots(similarity), NEAR)
        near = near.unionByName(chunks.where("b is not null")).unionByName(met)
        key = F.xxhash64("node", "salt").alias("key")
        own = salted.select(key, "fp", "node", "salt")
        meetings = meetings.unionByName(own).unionByName(held.join(salted, ["node", "salt", "fp"], "left_anti").select(key, "fp", nothing.alias("node"), nothing.alias("salt")))
        first = paired(near)
        roots = components(first)
        rest = compared(cells(salted, roots.select(F.col("node").alias("fp"), F.col("root").alias("class")), node_limit))
        near = paired(first.unionByName(rest.select("a", "b", "d")))
        discard(first)
        discard(roots)
        return near, meetings, tables
    return paired(near), meetings, tables


# -- confirming ------------------------------------------------------------------------------------------------------------


def confirmed(pairs: DataFrame, texts: DataFrame, words: int, percent: int) -> DataFrame:
    """(a, b, linked): whether the full sets of each pair of records are similar.  texts has (fp, data).

    A record of many pairs is copied once for each LINKS_A_TASK of them, so that none gathers in one task.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 2):
            known: dict[bytes, np.ndarray] = {}
            rows = []
            for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                if x not in known:
                    known = {x: shingle_set(x, words)}
                one, two = known[x], shingle_set(y, words)
                rows.append(bool(similar(len(np.intersect1d(one, two, assume_unique=True)), len(one), len(two), percent)))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(rows, pa.bool_())], ["a", "b", "linked"])

    ends = pairs.select("a", "b", F.explode(F.array("a", "b")).alias("fp"))
    salts = ends.groupBy("fp").agg(F.ceil(F.count("*") / LINKS_A_TASK).cast("long").alias("salts"))
    held = texts.join(salts, "fp").select("fp", "data", F.explode(F.sequence(F.lit(0).cast("long"), F.col("salts") - 1)).alias("salt"))
    dealt = ends.join(salts, "fp").select("a", "b", "fp", F.pmod(F.xxhash64("a", "b"), F.col("salts")).alias("salt"))
    sides = dealt.join(held, ["fp", "salt"])
    side = lambda name: F.max(F.when(F.col("fp") == F.col(name), F.col("data"))).alias(f"data_{name}")
    return sides.groupBy("a", "b").agg(side("a"), side("b")).mapInArrow(run, "a long, b long, linked boolean")


def _labelled(pairs: DataFrame, roots: DataFrame) -> DataFrame:
    """pairs whose ends are not in one class of roots (node, root)."""
    of = lambda end: roots.select(F.col("node").alias(end), F.col("root").alias(f"root_{end}"))
    named = pairs.join(of("a"), "a", "left").join(of("b"), "b", "left")
    return named.where(F.coalesce("root_a", "a") != F.coalesce("root_b", "b")).select(*pairs.columns)


def links(near: DataFrame, meetings: DataFrame, recs: DataFrame, texts: DataFrame, words: int, percent: int, whole: int = WHOLE, node_limit: int = NODE) -> DataFrame:
    """(a, b): links with the classes of all candidates that full sets confirm; written."""
    members = components(near)
    sized = members.join(recs.select(F.col("fp").alias("node"), "n"), "node")
    weight = sized.groupBy("root").agg(F.sum("n").alias("weight"))
    dealt = materialize(in_fewer_files(members.join(weight, "root").select(F.col("root").alias("key"), F.col("node").alias("fp"), (F.col("weight") > whole).alias("large"))), "members")
    found = settle(confirmed_together(dealt.where("not large"), texts, words, percent), "links")
    large = dealt.where("large").select("fp")
    if large.isEmpty():
        return found
    waiting = settle(near.join(large, near["a"] == large["fp"], "left_semi"), "open")
    while not waiting.isEmpty():
        best = lambda end: waiting.groupBy(F.col(end).alias("end")).agg(F.min(F.struct("d", "a", "b")).alias("e")).select("e.a", "e.b")  # noqa: B023, E731
        chosen = best("a").unionByName(best("b")).distinct()
        told = settle(confirmed(chosen, texts, words, percent), "told")
        found = settle(found.unionByName(told.where("linked").select("a", "b")), "links")
        roots = components(found)
        rest = settle(_labelled(waiting.join(told, ["a", "b"], "left_anti"), roots), "open")
        for table in (waiting, told, roots):
            discard(table)
        waiting = rest
    roots = components(found)
    classes = large.join(roots, large["fp"] == roots["node"], "left").select("fp", F.coalesce("root", "fp").alias("class"))
    shape = recs.select("fp", F.col("n").alias("size"), "wide").join(classes, "fp")
    chunked = meetings.where("node is not null").select("node", "salt", "fp").join(classes.select("fp"), "fp")
    meetings = meetings.select("key", "fp").unionByName(cells(chunked, classes, node_limit))
    met = meetings.join(shape, "fp").select("key", "fp", "size", "wide", "class")
    crossing = met.repartition("key").sortWithinPartitions("key").mapInArrow(_crossing(percent / 100), "key long, fp long")
    return settle(found.unionByName(confirmed_together(crossing, texts, words, percent)), "links")


# -- documents -------------------------------------------------------------------------------------------------------------


def similar_documents(
    df: DataFrame, percent: int = 85, words: int = 3, recall: float = 0.9999, id_col: str = "doc_id", text_col: str = "text",
    node_limit: int = NODE, depth: int = DEPTH, whole: int = WHOLE,
) -> DataFrame:
    """One row per row of df: doc_id, n_shingles, component_id (smallest doc_id reachable by links), kept.

    Documents link if 100 * intersection >= percent * union of their sets of shingles.  Texts that are null, empty or
    without a word have an empty set, link with nothing and keep their own id.  Equal sets always link.  Repeated rows come
    back as often as they occur.  A row of null doc_id links and gets the smallest non-null id of its class (null if it has
    none); kept is then false.  Very long texts are one record; a task that confirms components holds ``whole`` shingles, or
    one pair.  Other columns of df are ignored; an empty df gives no rows.
    """
    texts = doc_texts(df, id_col, text_col)
    made = materialize(records(texts, words), "sets")
    recs = materialize(in_fewer_files(made.where("n > 0").dropDuplicates(["fp"]).select("fp", "n", "mins", "wide")), "records")
    docs = materialize(in_fewer_files(made.select("doc_id", "n", "fp")), "sets")
    discard(made)
    near, meetings, tables = candidates(recs, percent / 100, recall, node_limit, depth)
    # A record's text is that of its smallest document; of the texts under that id, the one whose set it is.
    wanted = near.select(F.explode(F.array("a", "b")).alias("fp")).distinct()
    first = docs.groupBy("fp").agg(F.min(F.struct(F.col("doc_id").isNull().alias("unnamed"), F.col("doc_id").alias("id"))).alias("p"))
    holders = first.join(wanted, "fp").select("fp", F.col("p.id").alias("id"))
    named = texts.join(holders, F.col("doc_id").eqNullSafe(F.col("id"))).select("fp", "data")
    held = materialize(_of_the_set(named, words), "texts")
    linked = links(near, meetings, recs, held, words, percent, whole, node_limit)
    roots = components(linked)
    lows = docs.groupBy("fp").agg(F.min("doc_id").alias("low"))
    owned = lows.join(roots, lows["fp"] == roots["node"], "left").select("fp", "low", F.coalesce("root", "fp").alias("root"))
    lowest = owned.groupBy("root").agg(F.min("low").alias("component_id"))
    classes = owned.join(lowest, "root").select("fp", "component_id")
    for table in (near, held, linked, recs, *tables):
        discard(table)
    found = docs.join(classes, "fp").withColumn("component_id", F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")))
    return found.select("doc_id", F.col("n").alias("n_shingles"), "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)).alias("kept"))


def _of_the_set(named: DataFrame, words: int) -> DataFrame:
    """Rows (fp, data) of named whose text has the set fp, one for each fp."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1):
            rows = zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)
            same = pa.array([digest_of(shingle_set(text, words)) == fp for fp, text in rows], pa.bool_())
            yield batch.filter(same)

    return named.mapInArrow(run, "fp long, data binary").dropDuplicates(["fp"])

"""SimHash near-duplicate classes by deletion-variant signatures.

Fingerprints within k bits, cut into k // 2 + 1 segments, have a segment that differs in one bit at most.  Every
fingerprint is indexed once per bit under the segment with that bit left out, and fingerprints that are equal on
such a signature are verified.  Only distinct fingerprints are indexed, so exact copies cost nothing, and a
signature's group yields a spanning forest of its verified links (at most a few rows per member), never its pairs.
Groups beyond ``group_limit`` are dealt out again by pieces of the rest of the fingerprint, which loses no link:
the rest differs in k bits at most, so of its k + 1 pieces one is equal.

Three of 64 bits are far stricter than a similarity of 0.8, whose pairs differ in ten bits on average.  For a stated
similarity (``distinct_documents``) a document therefore also has a wide fingerprint (1,024 bits, which measure the
similarity) and several fingerprints of parts of its shingles, the parts chosen by hash; documents with an equal part
meet, however many hold it, and are verified on the wide fingerprint, and on their shingles where it is too near the
threshold to tell.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ROWS_A_TASK, components, discard, doc_texts, hold, holding, in_small_batches, materialize, settle, slices

SEED = 42
#: Parts of a document's shingles, shingles in each, and 64-bit words of the wide fingerprint.
PARTS, PART_SIZE, WIDE = 8, 4, 16
#: Fingerprints that one group of a signature, or one chunk of the wide ones, may hold before it is dealt out again.
GROUP_LIMIT, CHUNK = 8192, 512
#: Chunks of a large part that meet as many others in one cell.
PIECES = 8
#: Shingles of full sets that one task compares (or those of one pair).
WHOLE = 1_000_000
MOST_TASKS = 100_000


def shingle_hashes(data: bytes | None, words: int, seed: int = SEED) -> np.ndarray:
    """XXH64 of the space-joined word shingles, repeats included; of the whole sequence if it has fewer words."""
    tokens = data.lower().split() if data else []  # bytes: A-Z only, ASCII white space only
    if not tokens:
        return np.zeros(0, np.uint64)
    joined, digest = b" ".join(tokens), xxhash.xxh64_intdigest
    if len(tokens) <= words:
        return np.array([digest(joined, seed)], np.uint64)
    ends = np.cumsum(np.fromiter(map(len, tokens), np.int64, len(tokens)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    n = len(tokens) - words + 1
    return np.fromiter((digest(joined[a:b], seed) for a, b in zip(starts[:n].tolist(), ends[words - 1 :].tolist(), strict=True)), np.uint64, n)


def shingle_set(data: bytes | None, words: int) -> np.ndarray:
    """Distinct 64-bit hashes of the word shingles, ascending."""
    return np.unique(shingle_hashes(data, words))


def majority(hashes: np.ndarray) -> np.ndarray:
    """Bits set in over half of the rows of hashes (n, w) of 64-bit words: w words."""
    n, counts = len(hashes), np.zeros(64 * hashes.shape[1], np.int64)
    for at in range(0, n, 255):  # sums of so few bits fit a byte
        block = np.ascontiguousarray(hashes[at : at + 255]).view(np.uint8).reshape(-1, 8 * hashes.shape[1])
        counts += np.add.reduce(np.unpackbits(block, axis=1, bitorder="little"), axis=0, dtype=np.uint8)
    return np.packbits(2 * counts > n, bitorder="little").view(np.uint64)


def fingerprint(data: bytes | None, words: int = 3, seed: int = SEED) -> int:
    """Unsigned 64-bit SimHash of the word shingles, repeats included; 0 without a word."""
    return int(majority(shingle_hashes(data, words, seed)[:, None])[0])


def _odd(n: int, seed: int) -> np.ndarray:
    return np.random.default_rng(seed).integers(0, 1 << 63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def _mixed(hashes: np.ndarray, factors: np.ndarray) -> np.ndarray:
    """(n, len(factors)): further 64-bit hashes of each hash."""
    x = (hashes[:, None] ^ (hashes[:, None] >> np.uint64(31))) * factors
    x ^= x >> np.uint64(29)
    x *= np.uint64(0x9E3779B97F4A7C15)
    return x ^ (x >> np.uint64(32))


def sketch(data: bytes | None, words: int) -> tuple[int, int, np.ndarray, bytes]:
    """(distinct shingles, 64-bit fingerprint, part fingerprints, wide fingerprint).

    Part p is the PART_SIZE shingles of least p-th hash, so texts of Jaccard similarity s share it with probability
    s ** PART_SIZE; its fingerprint is its own SimHash.
    """
    hashes = shingle_hashes(data, words)
    if not len(hashes):
        return 0, 0, np.zeros(PARTS, np.uint64), bytes(8 * WIDE)
    wide = np.zeros(64 * WIDE, np.int64)
    for at in range(0, len(hashes), 255):
        block = _mixed(hashes[at : at + 255], _odd(WIDE, 3)).view(np.uint8)
        wide += np.add.reduce(np.unpackbits(block, axis=1, bitorder="little"), axis=0, dtype=np.uint8)
    wide = np.packbits(2 * wide > len(hashes), bitorder="little")
    single = np.unique(hashes)
    order = _mixed(single, _odd(PARTS, 4))
    size = min(PART_SIZE, len(single))
    low = np.argpartition(order, size - 1, axis=0)[:size]  # (size, PARTS)
    keys = majority(single[low])
    return len(single), int(majority(hashes[:, None])[0]), keys, wide.tobytes()


def fingerprints(df: DataFrame, words: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp): fp the fingerprint's bits as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1):
            fps = np.fromiter((fingerprint(x.as_py(), words) for x in batch.column(1)), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps.view(np.int64))], ["doc_id", "fp"])

    return doc_texts(df, id_col, text_col).mapInArrow(run, "doc_id long, fp long")


def sketches(docs: DataFrame, words: int) -> DataFrame:
    """(doc_id, t, size, fp, keys, wide) of docs (doc_id, t, data)."""
    columns = "doc_id long, t long, size long, fp long, keys array<long>, wide binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 2):
            sizes, fps, keys, wides = zip(*[sketch(x.as_py(), words) for x in batch.column(2)], strict=True)
            made = [pa.array(sizes, pa.int64()), pa.array(np.array(fps, np.uint64).view(np.int64)), pa.array([k.view(np.int64) for k in keys], pa.list_(pa.int64())), pa.array(wides, pa.binary())]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *made], [f.split()[0] for f in columns.split(", ")])

    return docs.mapInArrow(run, columns)


# -- links within a group -------------------------------------------------------------------------------------------------


def spanning_links(bits: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(found, by, root): places of a spanning forest's links over fingerprints (n, w words) at most ``distance`` bits
    apart, every link a verified pair, and for each place the root of its tree."""
    rest, found, by, root = np.arange(len(bits)), [], [], np.arange(len(bits))
    while len(rest):
        first, rest = rest[0], rest[1:]
        frontier = [first]
        while frontier and len(rest):
            at = frontier.pop()
            near = np.bitwise_count(bits[rest] ^ bits[at]).sum(axis=1) <= distance
            if near.any():
                new = rest[near]
                rest = rest[~near]
                frontier.extend(new)
                found.append(new)
                by.append(np.full(len(new), at))
                root[new] = first
    empty = np.zeros(0, np.int64)
    return (np.concatenate(found), np.concatenate(by), root) if found else (empty, empty, root)


def bits_between(one: np.ndarray, other: np.ndarray) -> np.ndarray:
    """(len(one), len(other)): bits in which fingerprints of w words each differ."""
    d = np.zeros((len(one), len(other)), np.uint16)
    for k in range(one.shape[1]):
        d += np.bitwise_count(one[:, k, None] ^ other[None, :, k])
    return d


def class_links(bits: np.ndarray, label: np.ndarray, distance: int, stretch: int = 16) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(found, by, label): links at most ``distance`` bits long that join the classes of all such pairs, and the labels then."""
    label, found, by = label.copy(), [], []
    for at in range(0, len(bits), stretch):
        near = bits_between(bits[at : at + stretch], bits[at:]) <= distance
        for i in range(len(near)):
            others = at + np.flatnonzero(near[i] & (label[at:] != label[at + i]))
            if len(others):
                classes, first = np.unique(label[others], return_index=True)
                found.append(others[first])
                by.append(np.full(len(first), at + i))
                label[np.isin(label, classes)] = label[at + i]
    empty = np.zeros(0, np.int64)
    return (np.concatenate(found), np.concatenate(by), label) if found else (empty, empty, label)


def crossing(bits: np.ndarray, sizes: np.ndarray, label: np.ndarray, distance: int, similarity: float, stretch: int = 16) -> np.ndarray:
    """Which fingerprints have one of another label within ``distance`` bits, the set sizes of both allowing the similarity."""
    hit = np.zeros(len(bits), bool)
    if (label == label[0]).all():
        return hit
    order = np.argsort(sizes, kind="stable")
    bits, sizes, label = np.ascontiguousarray(bits[order]), sizes[order], label[order]
    for at in range(0, len(order), stretch):
        own = slice(at, min(at + stretch, len(order)))
        fit = slice(at, int(np.searchsorted(sizes, sizes[own.stop - 1] / similarity + 1e-6, side="right")))
        near = (bits_between(bits[own], bits[fit]) <= distance) & (label[own, None] != label[None, fit])
        hit[order[own]] |= near.any(axis=1)
        hit[order[fit]] |= near.any(axis=0)
    return hit


def exact_links(fps: np.ndarray, distance: int, most: int = 1024) -> tuple[np.ndarray, np.ndarray]:
    """(a, b): links with the components of all pairs of distinct fps within ``distance`` bits.

    Beyond ``most`` fps the bits in which any two of them differ are cut into distance + 1 pieces: linked ones agree on a
    piece, so each piece's groups are taken on their own, and further by the bits that still differ.
    """
    varying = int(np.bitwise_or.reduce(fps ^ fps[:1])) if len(fps) else 0
    bits = [b for b in range(64) if varying >> b & 1]
    if len(fps) <= most or len(bits) <= distance:
        found, by, _ = spanning_links(fps[:, None], distance)
        return fps[found], fps[by]
    a, b = [], []
    for k in range(distance + 1):
        piece = np.uint64(sum(1 << x for x in bits[len(bits) * k // (distance + 1) : len(bits) * (k + 1) // (distance + 1)]))
        value = fps & piece
        order = np.argsort(value, kind="stable")
        cuts = np.flatnonzero(np.diff(value[order])) + 1
        for group in np.split(order, cuts):
            if len(group) > 1:
                x, y = exact_links(fps[group], distance, most)
                a.append(x)
                b.append(y)
    empty = np.zeros(0, np.uint64)
    return (np.concatenate(a), np.concatenate(b)) if a else (empty, empty)


def _runs(batches: Iterator[pa.RecordBatch], n_keys: int, limit: int | None) -> Iterator[tuple[tuple, pa.Table, bool]]:
    """(key, rows, whole) of each group of two rows or more in batches sorted by their first n_keys columns of longs.

    A group beyond the limit comes in several stretches that are not whole.
    """
    held, held_key, size, cut = [], None, 0, False
    table = lambda: pa.Table.from_batches(held)
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = np.column_stack([batch.column(i).to_numpy().astype(np.int64) for i in range(n_keys)])
        bounds = np.concatenate([[0], np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1, [batch.num_rows]])
        sizes = np.diff(bounds)
        ends = np.isin(np.arange(len(sizes)), (0, len(sizes) - 1))
        for i in np.flatnonzero((sizes > 1) | ends).tolist():
            key, rows = tuple(keys[bounds[i]].tolist()), batch.slice(int(bounds[i]), int(sizes[i]))
            if key != held_key:
                if size > 1 or (cut and size):
                    yield held_key, table(), not cut
                held, held_key, size, cut = [], key, 0, False
            for at in range(0, rows.num_rows, limit or rows.num_rows):
                part = rows.slice(at, limit or rows.num_rows)
                if limit and size + part.num_rows > limit and size:
                    cut = True
                    yield held_key, table(), False
                    held, size = [], 0
                held.append(part)
                size += part.num_rows
    if size > 1 or (cut and size):
        yield held_key, table(), not cut


def _out(columns: list[tuple[np.ndarray, ...]], names: str) -> Iterator[pa.RecordBatch]:
    """Record batches of longs; a None column is null."""
    heads = [f.split()[0] for f in names.split(", ")]
    for part in columns:
        n = max(len(c) for c in part if c is not None)
        if n:
            yield pa.RecordBatch.from_arrays([pa.nulls(n, pa.int64()) if c is None else pa.array(c.astype(np.int64) if c.dtype != np.uint64 else c.view(np.int64), pa.int64()) for c in part], heads)


LINKS = "a long, b long, bit long"


def _signature_links(n_keys: int, distance: int, limit: int | None):
    """Links of each signature's group; the rows of a group beyond the limit come back with b null and their bit."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, rows, whole in _runs(batches, n_keys, limit):
            fps = np.unique(rows.column(n_keys).to_numpy()).view(np.uint64)
            if whole:
                a, b = exact_links(fps, distance)
                yield from _out([(a, b, None)], LINKS)
            else:
                yield from _out([(fps, None, np.full(len(fps), key[0]))], LINKS)

    return run


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _tasks(rows: int) -> int:
    return min(MOST_TASKS, 1 + rows // ROWS_A_TASK)


def links(fps: DataFrame, distance: int = 3, group_limit: int = GROUP_LIMIT, n_fps: int | None = None) -> DataFrame:
    """(a, b): links whose components are those of all pairs of distinct fps (column fp) within ``distance`` bits.

    They are written.  n_fps, at most so many fingerprints, sets the number of tasks: each becomes 64 rows.
    """
    segments = distance // 2 + 1
    edges = [64 * i // segments for i in range(segments + 1)]
    masks = [0] * 64  # by bit: its segment without it
    for lo, hi in zip(edges, edges[1:], strict=False):
        for bit in range(lo, hi):
            masks[bit] = _signed(((1 << hi) - (1 << lo)) & ~(1 << bit))
    signatures = F.explode(F.array(*[F.struct(F.lit(bit).alias("bit"), F.col("fp").bitwiseAND(F.lit(m).cast("long")).alias("sig")) for bit, m in enumerate(masks)])).alias("s")
    single = fps.select("fp").distinct()  # before it is dealt: copies are one row a task
    keyed = (single.repartition(_tasks(64 * n_fps), "fp") if n_fps else single).select(signatures, "fp").select("s.bit", "s.sig", "fp")
    first = keyed.repartition("bit", "sig").sortWithinPartitions("bit", "sig").mapInArrow(_signature_links(2, distance, group_limit), LINKS)
    first = settle(first, "near")
    over = first.where("b is null")
    if over.isEmpty():
        return first.drop("bit")
    # Large groups: the bits outside the wildcard segment, in distance + 1 pieces of which linked members share one.
    parts = []
    for lo, hi in zip(edges, edges[1:], strict=False):
        rest = [b for b in range(64) if not lo <= b < hi]
        for k in range(distance + 1):
            piece = sum(1 << b for b in rest[len(rest) * k // (distance + 1) : len(rest) * (k + 1) // (distance + 1)])
            in_segment = F.col("bit").between(lo, hi - 1)
            parts.append(F.when(in_segment, F.struct(F.lit(k).alias("k"), F.col("fp").bitwiseAND(F.lit(_signed(piece)).cast("long")).alias("val"))))
    mask = F.element_at(F.array(*[F.lit(m).cast("long") for m in masks]), F.col("bit").cast("int") + 1)
    over = over.select("bit", F.col("a").alias("fp")).distinct()
    again = over.select("bit", F.col("fp").bitwiseAND(mask).alias("sig"), "fp", F.explode(F.filter(F.array(*parts), lambda p: p.isNotNull())).alias("p"))
    again = again.select("bit", "sig", F.col("p.k").alias("k"), F.col("p.val").alias("val"), "fp")
    # Such a group agrees on 39 bits or more, so it has at most 2 ** 25 members of eight bytes.
    second = again.repartition("bit", "sig", "k", "val").sortWithinPartitions("bit", "sig", "k", "val").mapInArrow(_signature_links(4, distance, None), LINKS)
    out = settle(first.where("b is not null").select("a", "b").unionByName(second.select("a", "b")), "near")
    discard(first)
    return out


# -- similarity of whole documents ----------------------------------------------------------------------------------------


def wide_distance(similarity: float, deviations: float = 0.0) -> int:
    """Bits of the wide fingerprint in which texts of this Jaccard similarity differ, plus so many standard deviations."""
    p = math.acos(2 * similarity / (1 + similarity)) / math.pi
    n = 64 * WIDE
    return max(0, round(n * p + deviations * math.sqrt(n * p * (1 - p))))


#: Of fingerprints within so many bits of each other a net keeps one.
NET = 30


def net_of(bits: np.ndarray, root: np.ndarray, within: int = NET) -> np.ndarray:
    """Places, roots first, of which none is within so many bits of another, while every other place is of one of them."""
    own = root == np.arange(len(root))
    rest, kept = np.concatenate([np.flatnonzero(own), np.flatnonzero(~own)]), []
    while len(rest):
        kept.append(rest[0])
        rest = rest[1:][np.bitwise_count(bits[rest[1:]] ^ bits[rest[0]]).sum(axis=1) > within]
    return np.array(kept, np.int64)


WIDE_LINKS = "a long, b long, key long, size long"


def _wide_links(similarity: float, classed: bool):
    """Rows (key, fp, size, wide[, class]) sorted by key: (a, b) of sure links that join all such pairs of a group (of
    different classes), and (a, key, size) of what then still has a near fingerprint of another class there."""
    sure, loose = wide_distance(similarity, -3), wide_distance(similarity, 2.5)
    heads, long = [f.split()[0] for f in WIDE_LINKS.split(", ")], pa.int64()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, rows, _ in _runs(batches, 1, None):
            fps, sizes = rows.column(1).to_numpy(), rows.column(2).to_numpy()
            bits = np.frombuffer(b"".join(rows.column(3).to_pylist()), np.uint64).reshape(-1, WIDE)
            found, by, label = class_links(bits, rows.column(4).to_numpy(), sure) if classed else spanning_links(bits, sure)
            other = fps[found] != fps[by]
            if other.any():
                a, b, none = fps[found][other], fps[by][other], pa.nulls(int(other.sum()), long)
                yield pa.RecordBatch.from_arrays([pa.array(a, long), pa.array(b, long), none, none], heads)
            hit = crossing(bits, sizes, label, loose, similarity)
            if hit.any():
                n = int(hit.sum())
                yield pa.RecordBatch.from_arrays([pa.array(fps[hit], long), pa.nulls(n, long), pa.array(np.full(n, key[0]), long), pa.array(sizes[hit], long)], heads)

    return run


def cells(chunked: DataFrame, classes: DataFrame, node_limit: int) -> DataFrame:
    """(key, fp): of the nodes in chunked (node, salt, fp), cells in which every two records of different classes meet.

    One of two such records is outside the largest class of the node: these are dealt in chunks of their own, and each of
    them meets each chunk of the node, so a cell holds about two chunks.  A node of one class has no cell.  classes has
    (fp, class); a record without one is its own.
    """
    named = chunked.select("node", "salt", "fp").join(classes, "fp", "left").withColumn("class", F.coalesce("class", "fp"))
    sized = named.groupBy("node", "class").agg(F.count("*").alias("n"))
    largest = sized.groupBy("node").agg(F.max(F.struct("n", "class")).alias("m"), F.sum("n").alias("n"))
    parts = largest.select("node", F.col("m.class").alias("main"), F.ceil((F.col("n") - F.col("m.n")) / node_limit).cast("long").alias("parts")).where("parts > 0")
    salts = chunked.groupBy("node").agg(F.max("salt").alias("last"))
    met = named.join(parts, "node").join(salts, "node")
    key = F.xxhash64("node", "salt", "part").alias("key")
    every = met.select("node", "salt", "fp", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part"))
    own = F.pmod(F.xxhash64("fp", "node", F.lit(1)), F.col("parts"))
    minor = met.where("class <> main").select("node", F.explode(F.sequence(F.lit(0).cast("long"), F.col("last"))).alias("salt"), "fp", own.alias("part"))
    return every.unionByName(minor).select(key, "fp").distinct()


def part_links(docs: DataFrame, similarity: float, chunk: int = CHUNK, hold: Callable = hold) -> DataFrame:
    """(a, b, key, size) of docs (fp, size, keys, wide): links, and what full sets must tell; written.

    Fingerprints that share a part meet, all of them.  Links (a, b) are within three standard deviations of the
    similarity by the wide bits, and their classes are those of all such pairs.  Pairs too near to the threshold to tell
    are between fingerprints a of one key, b null.  Parts are counted before any group meets: one that many hold meets in
    chunks of about ``chunk`` first, and then all its fingerprints of different classes meet in cells.
    """
    nodes = hold(docs.select("fp", "size", "keys", "wide").distinct())
    parted = nodes.select("fp", F.posexplode("keys").alias("part", "one")).select(F.xxhash64("part", "one").alias("node"), "fp").distinct()
    counts = parted.groupBy("node").agg(F.count("*").alias("n")).where("n > 1")
    groups = parted.join(counts, "node")
    shape = nodes.select("fp", "size", "wide")

    def salted(most: int) -> DataFrame:
        return groups.select("node", F.pmod(F.xxhash64("fp", "node"), F.ceil(F.col("n") / most).cast("long")).alias("salt"), "fp", "n")

    def met(rows: DataFrame, *classes: str) -> DataFrame:
        dealt = rows.join(shape, "fp").select("key", "fp", "size", "wide", *classes)
        return dealt.repartition("key").sortWithinPartitions("key").mapInArrow(_wide_links(similarity, bool(classes)), WIDE_LINKS)

    first = settle(met(salted(chunk).select(F.xxhash64("node", "salt").alias("key"), "fp")), "near")
    if counts.where(F.col("n") > chunk).isEmpty():
        return first
    roots = components(first.where("b is not null").select("a", "b"))
    classes = hold(nodes.select("fp").distinct().join(roots, F.col("fp") == F.col("node"), "left").select("fp", F.coalesce("root", "fp").alias("class")))
    large = salted(PIECES * chunk).where(F.col("n") > chunk).select("node", "salt", "fp")
    second = met(cells(large, classes, PIECES * chunk).join(classes, "fp"), "class")
    out = settle(first.unionByName(second), "near")
    discard(first)
    discard(roots)
    return out


# -- full sets ----------------------------------------------------------------------------------------------------------------


def similar(common: np.ndarray | int, a: np.ndarray | int, b: np.ndarray | int, percent: float) -> np.ndarray | bool:
    """Whether 100 * intersection >= percent * union, in whole numbers."""
    return 100 * common >= percent * (a + b - common)


def classes_of(sets: list[np.ndarray], percent: float) -> np.ndarray:
    """For each set the first place of its class: components of all pairs that are similar.

    A set that is reached is compared with those that are not yet; in a class where most are near this is few.
    """
    sizes = np.array([len(s) for s in sets], np.int64)
    values, ids = np.unique(np.concatenate(sets), return_inverse=True)
    ends = np.cumsum(sizes)
    own = [ids[e - n : e] for e, n in zip(ends.tolist(), sizes.tolist(), strict=True)]
    root, rest, mark = np.arange(len(sets)), np.arange(len(sets)), np.zeros(len(values), np.int32)
    while len(rest):
        first, rest = rest[0], rest[1:]
        frontier = [first]
        while frontier and len(rest):
            at = frontier.pop()
            fit = rest[100 * np.minimum(sizes[rest], sizes[at]) >= percent * np.maximum(sizes[rest], sizes[at])]
            if not len(fit):
                continue
            mark[own[at]] = 1
            common = np.add.reduceat(mark[np.concatenate([own[i] for i in fit])], np.concatenate([[0], np.cumsum(sizes[fit])[:-1]]))
            mark[own[at]] = 0
            new = fit[similar(common.astype(np.int64), sizes[fit], sizes[at], percent)]
            if len(new):
                root[new] = first
                frontier.extend(new.tolist())
                rest = rest[~np.isin(rest, new)]
    return root


def _confirm_whole(words: int, percent: float):
    """Rows (key, fp, data) sorted by key: (a, b) links of the classes in every group, as stars."""

    def stars(fps: list[int], texts: list[bytes]) -> pa.RecordBatch:
        sets = [shingle_set(t, words) for t in texts]
        root = classes_of(sets, percent)
        names = np.array(fps, np.int64)
        low = {r: names[root == r].min() for r in np.unique(root)}
        b = np.array([low[r] for r in root], np.int64)
        return pa.RecordBatch.from_arrays([pa.array(names[names != b]), pa.array(b[names != b])], ["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, fps, texts = None, [], []
        for batch in batches:
            for key, fp, text in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                if key != held:
                    if len(fps) > 1:
                        yield stars(fps, texts)
                    held, fps, texts = key, [], []
                fps.append(fp)
                texts.append(text)
        if len(fps) > 1:
            yield stars(fps, texts)

    return run


def confirmed_together(groups: DataFrame, texts: DataFrame, words: int, percent: float) -> DataFrame:
    """(a, b): links with the classes of full sets within every group of groups (key, fp)."""
    dealt = groups.join(texts, "fp").select("key", "fp", "data")
    return dealt.repartition("key").sortWithinPartitions("key", "fp").mapInArrow(_confirm_whole(words, percent), "a long, b long")


def full_set_cells(members: DataFrame, whole: int = WHOLE) -> DataFrame:
    """(key, fp) of members (key, fp, size): in each group all meet, in cells of about ``whole`` shingles.

    Groups of the same members count once.  Of a larger group every two of its parts are a cell.
    """
    single = members.groupBy("key", "fp").agg(F.max("size").alias("size"))
    content = F.struct(F.count("*"), F.bit_xor(F.xxhash64("fp")), F.bit_xor(F.xxhash64("fp", F.lit(1))))
    groups = single.groupBy("key").agg(content.alias("content"), F.sum("size").alias("weight")).where("content.col1 > 1")
    groups = groups.groupBy("content").agg(F.min(F.struct("key", "weight")).alias("g")).select("g.key", "g.weight")
    parts = F.when(F.col("weight") <= whole, F.lit(1)).otherwise(F.ceil(2 * F.col("weight") / whole)).cast("long").alias("parts")
    sized = single.join(groups.select("key", parts), "key").withColumn("own", F.pmod(F.xxhash64("fp", "key"), F.col("parts")))
    sized = sized.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1))).where("parts = 1 or own <> other")
    return sized.select(F.xxhash64("key", F.least("own", "other"), F.greatest("own", "other")).alias("key"), "fp")


def verified(near: DataFrame, met: DataFrame, sketched: DataFrame, texts: DataFrame, similarity: float, words: int) -> DataFrame:
    """(a, b): the links of met, as ``part_links`` writes it, and all that full sets tell of its other fingerprints and of
    the pairs of near (a, b); written.

    sketched has (doc_id, t, size, fp, wide), texts (doc_id, t, data).  A fingerprint has a text for each wide fingerprint
    that goes with it, that of its smallest document.
    """
    sizes = sketched.groupBy("fp").agg(F.max("size").alias("size"))
    pairs = near.select(F.xxhash64(F.least("a", "b"), F.greatest("a", "b")).alias("key"), F.explode(F.array("a", "b")).alias("fp")).join(sizes, "fp").select("key", "fp", "size")
    doubtful = settle(full_set_cells(met.where("b is null").select("key", F.col("a").alias("fp"), "size").unionByName(pairs)), "doubtful")
    place = F.struct(F.col("doc_id").isNull().alias("unnamed"), F.col("doc_id").alias("id"), F.col("t").alias("t"))
    holders = sketched.join(doubtful.select("fp").distinct(), "fp").groupBy("fp", "wide").agg(F.min(place).alias("p")).select("fp", "wide", F.col("p.id").alias("id"), F.col("p.t").alias("pt"))
    held = texts.join(holders, F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("t") == F.col("pt"))).groupBy("fp", "wide").agg(F.first("data").alias("data"))
    told = confirmed_together(doubtful, held.select("fp", "data"), words, round(100 * similarity, 6))
    out = settle(met.where("b is not null").select("a", "b").unionByName(told), "near")
    discard(doubtful)
    return out


# -- documents --------------------------------------------------------------------------------------------------------------


def near_duplicates(df: DataFrame, distance: int = 3, words: int = 3, id_col: str = "doc_id", text_col: str = "text", group_limit: int = GROUP_LIMIT) -> DataFrame:
    """One row per row of df: doc_id, fingerprint (16 hex digits), component_id (smallest doc_id reachable by links).

    Texts that are null, empty or without a word have fingerprint zero and link as any other.  Repeated rows come back
    as often as they occur.  Rows of null doc_id link and get the smallest non-null doc_id of their component (null if
    it has none).  Other columns of df are ignored; an empty df gives no rows.
    """
    docs = materialize(fingerprints(df, words, id_col, text_col), "fingerprints")
    near = links(docs.select("fp"), distance, group_limit, docs.count())
    roots = components(near)
    discard(near)
    nodes = docs.groupBy("fp").agg(F.min("doc_id").alias("low"))
    owned = nodes.join(roots, nodes.fp == roots.node, "left").select("fp", "low", F.coalesce("root", "fp").alias("root"))
    lowest = owned.groupBy("root").agg(F.min("low").alias("component_id"))
    named = owned.join(lowest, "root").select("fp", "component_id")
    return docs.join(named, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def _verdicts(docs: DataFrame, similarity: float, words: int, distance: int) -> DataFrame:
    """(__id, __t, first, n): per id and text digest of docs (doc_id, t, data) that is repeated or not the first of its class."""
    with holding() as hold:
        texts, docs = docs, hold(sketches(docs, words))
        n = docs.count()
        near = [links(docs.select("fp"), distance, n_fps=n), part_links(docs, similarity, CHUNK, hold)]
        near.append(verified(*near, docs, texts, similarity, words))
        roots = components(near[2])
        place = F.struct(F.col("doc_id").isNull().alias("unnamed"), F.col("doc_id").alias("id"), F.col("t").alias("t"))
        nodes = docs.groupBy("fp").agg(F.min(place).alias("low"))
        owned = nodes.join(roots, nodes.fp == roots.node, "left").select("fp", "low", F.coalesce("root", "fp").alias("root"))
        lowest = owned.groupBy("root").agg(F.min("low").alias("low"))
        named = owned.select("fp", "root").join(lowest, "root").select("fp", "low")
        rows = docs.groupBy("doc_id", "t", "fp").agg(F.count("*").alias("n")).join(named, "fp")
        found = rows.select(F.col("doc_id").alias("__id"), F.col("t").alias("__t"), (place == F.col("low")).alias("first"), "n").where("n > 1 or not first")
        found = materialize(found.coalesce(_tasks(n)), "verdicts")
    for table in (roots, *near):
        discard(table)
    return found


def distinct_documents(df: DataFrame, similarity: float = 0.8, words: int = 5, distance: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of df without near duplicates: of each class the row of smallest id (of smallest text digest among equals).

    Documents meet if their 64-bit fingerprints differ in ``distance`` bits at most or if a part of their shingles is equal,
    and link if the Jaccard similarity of their shingles of ``words`` words is ``similarity`` or more; classes are the
    components of all links found.  Of texts of just that similarity, 1 - (1 - similarity ** PART_SIZE) ** PARTS meet by
    parts (98.5 % at 0.8).  Equal fingerprints always link.  Texts that are null, empty or without a word are one class.  Rows that share an id but not
    their text are documents of their own.  A row without an id stays only where its class has none with one.  Of rows
    with equal id and text one stays, the least by its other columns.  Other columns are kept, whatever their names; an
    empty df gives no rows.
    """
    text = df[f"`{text_col}`"].cast("string")
    ids, t = df[f"`{id_col}`"].cast("long"), F.xxhash64(F.coalesce(text, F.lit("")))
    in_small_batches(df.sparkSession)
    verdicts = _verdicts(df.select(ids.alias("doc_id"), t.alias("t"), text.cast("binary").alias("data")), similarity, words, distance)
    same = lambda v: ids.eqNullSafe(v["__id"]) & (t == v["__t"])
    single = df.join(verdicts, same(verdicts), "left_anti")
    repeated = verdicts.where("first")
    rows = df.join(repeated, same(repeated), "left_semi").select(ids.alias("__id"), t.alias("__t"), F.struct(*[df[f"`{c}`"] for c in df.columns]).alias("__row"))
    once = rows.groupBy("__id", "__t").agg(F.min("__row").alias("__row")).select("__row.*")
    return single.unionByName(once)

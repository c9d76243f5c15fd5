"""What lies in nodes too large to be compared at once is compared all the same."""

import random
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F
from spindrift.llm import pathjoin, simhash
from spindrift.llm.common import components, materialize

from .test_documents import brute_classes


def test_all_near_pairs_of_a_large_node_are_candidates(spark):
    """Many pairs in one node, of which chunks and pivots bring few together."""
    rng = random.Random(5)
    common, rows = [f"c{i}" for i in range(60)], []
    for k in range(150):
        words = common + [f"u{k}_{i}" for i in range(40)]
        rows += [(2 * k, " ".join(words)), (2 * k + 1, " ".join(words[:-2] + [f"x{rng.random()}"]))]
    docs = spark.createDataFrame(rows, "doc_id long, text string").select("doc_id", F.col("text").cast("binary").alias("data"))
    recs = materialize(pathjoin.records(docs, 3).select("fp", "n", "mins", "wide"), "records")
    near, meetings, _ = pathjoin.candidates(recs, 0.85, 0.5, 16, 1)
    shape = {r["fp"]: (np.frombuffer(r["wide"], np.uint64), r["n"]) for r in recs.collect()}
    nodes: dict = {}
    for r in meetings.where("node is not null").collect():
        nodes.setdefault(r["node"], set()).add(r["fp"])
    assert max(map(len, nodes.values())) > 64
    root = {r["node"]: r["root"] for r in components(near).collect()}
    loose, n = pathjoin.candidate_distance(0.85), 0
    for fps in nodes.values():
        for a, b in combinations(sorted(fps), 2):
            if pathjoin.distances(np.array([shape[a][0], shape[b][0]]), np.array([shape[a][1], shape[b][1]]), np.array([1]), 0, 0.85)[0] <= loose:
                n += 1
                assert root.get(a, a) == root.get(b, b)
    assert n > 100


def test_all_pairs_of_a_large_part_meet(docs_of, monkeypatch):
    """Pairs of just the similarity around a passage of all texts: those that share one part meet, though very many hold it."""
    monkeypatch.setattr(simhash, "CHUNK", 8)
    rng, rows, want = np.random.default_rng(6), [], []
    passage = [f"p{i}" for i in range(76)]
    for k in range(120):
        own = [f"u{k}_{i}" for i in range(24)]
        other = list(own)
        for at in rng.choice(np.arange(5, 19), 2, replace=False):
            other[at] = f"x{k}_{at}"
        rows += [(2 * k + 1, " ".join(passage + own)), (2 * k + 2, " ".join(passage + other))]
    made = {i: (set(simhash.shingle_hashes(t.encode(), 5).tolist()), *simhash.sketch(t.encode(), 5)[2:]) for i, t in rows}
    loose = simhash.wide_distance(0.8, 2.5)
    for i in range(1, len(rows), 2):
        (a, keys_a, wide_a), (b, keys_b, wide_b) = made[i], made[i + 1]
        apart = sum((x ^ y).bit_count() for x, y in zip(wide_a, wide_b, strict=True))
        if len(a & b) >= 0.8 * len(a | b) and (keys_a == keys_b).any() and apart <= loose:
            want.append(i + 1)
    stay = {r["doc_id"] for r in simhash.distinct_documents(docs_of(rows)).collect()}
    assert len(want) > 50 and not stay & set(want)
    assert {i for i, _ in rows if i % 2} <= stay


def test_a_refuted_nearest_pair_hides_no_link(docs_of, monkeypatch):
    """Two classes in one part: the pair closest by the wide fingerprint is not similar, another one is."""
    texts = {1: "a b c d e f g h i j", 2: "m n o p e f g h i j", 3: "k b c d e f g h i j"}
    wide = {1: (0, 0), 2: (85, 245), 3: (0, 170)}  # bits from, to: 3 is 160 from 2 and 170 from 1

    def sketch(data, words):
        i = next(k for k, t in texts.items() if t.encode() == data)
        bits = np.zeros(64 * simhash.WIDE, np.uint8)
        bits[slice(*wide[i])] = 1
        return 10, (1 << 20 * i) - 1, np.full(simhash.PARTS, 5, np.uint64), np.packbits(bits).tobytes()

    monkeypatch.setattr(simhash, "sketch", sketch)
    found = simhash.distinct_documents(docs_of(list(texts.items())), words=1).collect()
    assert sorted(r["doc_id"] for r in found) == [1, 2]


def test_full_set_cells_hold_all_pairs(spark):
    rows = [(k, fp, 10) for k in (1, 2) for fp in range(40)] + [(3, fp, 1) for fp in range(3)] + [(4, 7, 1)]
    cells: dict = {}
    for r in simhash.full_set_cells(spark.createDataFrame(rows, "key long, fp long, size long"), 100).collect():
        cells.setdefault(r["key"], set()).add(r["fp"])
    assert {p for c in cells.values() for p in combinations(sorted(c), 2)} == set(combinations(range(40), 2))
    assert max(map(len, cells.values())) < 30
    single = simhash.full_set_cells(spark.createDataFrame(rows, "key long, fp long, size long"), 10_000).collect()
    assert len(single) == 43  # of two groups of the same members one is left


@pytest.mark.parametrize("classed", [False, True])
def test_links_and_crossing_of_a_group(classed):
    rng = np.random.default_rng(2)
    for _ in range(30):
        n, sure, loose = int(rng.integers(2, 60)), 60, 120
        bits = rng.integers(0, 1 << 62, (4, simhash.WIDE), dtype=np.uint64)[rng.integers(0, 4, n)]
        bits ^= rng.integers(0, 1 << 62, bits.shape, dtype=np.uint64) & rng.integers(0, 1 << 62, bits.shape, dtype=np.uint64) & rng.integers(0, 1 << 62, bits.shape, dtype=np.uint64) & rng.integers(0, 1 << 62, bits.shape, dtype=np.uint64)
        sizes, start = rng.integers(10, 20, n), rng.integers(0, 8, n) if classed else np.arange(n)
        d = np.bitwise_count(bits[:, None] ^ bits[None]).sum(axis=2)
        assert (d == simhash.bits_between(bits, bits)).all()
        found, by, label = simhash.class_links(bits, start, sure)
        assert (d[found, by] <= sure).all()
        label_of = lambda links: {frozenset(np.flatnonzero(np.isin(np.arange(n), list(c))).tolist()) for c in brute_classes(range(n), links)}
        given = [(i, j) for i in range(n) for j in range(i) if start[i] == start[j]]
        near = [(i, j) for i in range(n) for j in range(i) if d[i, j] <= sure]
        assert label_of(given + near) == label_of(given + list(zip(found.tolist(), by.tolist(), strict=True))) == {frozenset(np.flatnonzero(label == x).tolist()) for x in label}
        fit = np.minimum(sizes[:, None], sizes) >= 0.8 * np.maximum(sizes[:, None], sizes)
        hit = simhash.crossing(bits, sizes, label, loose, 0.8)
        exact = ((d <= loose) & fit & (label[:, None] != label)).any(axis=1)
        assert hit[exact].all() and (hit <= ((d <= loose) & (label[:, None] != label)).any(axis=1)).all()

"""Approximate nearest neighbours by a hash-prefix forest.

Each tree gives every vector a string of 64 hyperplane signs.  Rows are dealt into blocks; a block keeps, per tree, a
sorted array of its strings.  A query descends to its longest prefix match in every tree, then all trees ascend
together, one bit at a time, until the strings that share the current prefix hold enough different vectors; these
candidates are scored exactly.  Vectors are lifted by one coordinate to one length, so that hyperplane signs order
inner products.  How many candidates a recall takes depends on the data: clustered vectors need a few hundredths of a
block, uniformly random directions (the test tables) leave nothing to hash and need over half.  So the share is measured
first, against brute force on a bounded sample.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

BITS = 64
FOUND = "query_id long, vec_id long, score double"


def hyperplanes(dim: int, trees: int, seed: int = 5) -> np.ndarray:
    return np.random.default_rng([seed, dim]).normal(size=(dim + 1, trees * BITS))


def strings(vectors: np.ndarray, lift: np.ndarray, planes: np.ndarray) -> np.ndarray:
    """(rows, trees) 64-bit strings, the first hyperplane in the highest bit."""
    signs = (vectors @ planes[:-1] + lift[:, None] * planes[-1]) > 0
    return np.packbits(signs, axis=1).view(">u8").astype(np.uint64)


class Block:
    """Sorted strings per tree over some vectors."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, codes: np.ndarray):
        self.ids, self.vectors = ids, vectors
        self.order = np.argsort(codes, axis=0, kind="stable").T.copy()
        self.sorted = np.take_along_axis(codes.T, self.order, axis=1)

    def ranges(self, codes: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
        """Per (query, tree) the stretch of the sorted array that shares the first ``length`` bits."""
        shift = np.uint64(BITS - length)
        if length == 0:
            return np.zeros(codes.shape, np.int64), np.full(codes.shape, len(self.ids), np.int64)
        low = codes >> shift << shift
        high = low | (np.uint64((1 << (BITS - length)) - 1) if length < BITS else np.uint64(0))
        lo = np.stack([np.searchsorted(s, c, "left") for s, c in zip(self.sorted, low.T, strict=True)], axis=1)
        hi = np.stack([np.searchsorted(s, c, "right") for s, c in zip(self.sorted, high.T, strict=True)], axis=1)
        return lo, hi

    def longest(self, codes: np.ndarray) -> np.ndarray:
        """Per query, the longest prefix that any tree shares with it: neighbours of its place in each sorted array."""
        best = np.zeros(len(codes), np.int64)
        for s, c in zip(self.sorted, codes.T, strict=True):
            at = np.searchsorted(s, c)
            for near in (np.maximum(at - 1, 0), np.minimum(at, len(s) - 1)):
                x = s[near] ^ c
                best = np.maximum(best, BITS - np.ceil(np.log2(x.astype(np.float64) + 1)).astype(np.int64))
        return np.clip(best, 0, BITS)

    def search(self, ids: np.ndarray, vectors: np.ndarray, codes: np.ndarray, k: int, wanted: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(query, ids, scores) of the k best candidates of each query, none of its own id; ties to the smaller id."""
        wanted = min(wanted, len(self.ids))
        top = int(self.longest(codes).max(initial=0))
        level, lo, hi = np.full(len(ids), -1), np.empty(codes.shape, np.int64), np.empty(codes.shape, np.int64)
        for length in range(top, -1, -1):  # all trees ascend together
            rest = np.flatnonzero(level < 0)
            if not len(rest):
                break
            a, b = self.ranges(codes[rest], length)
            enough = (b - a).sum(axis=1) >= wanted
            level[rest[enough]], lo[rest[enough]], hi[rest[enough]] = length, a[enough], b[enough]
        for q in range(len(ids)):
            own, length, a, b = codes[q : q + 1], int(level[q]), lo[q], hi[q]
            while True:
                mark = np.zeros(len(self.ids), bool)
                for order, i, j in zip(self.order, a.tolist(), b.tolist(), strict=True):
                    mark[order[i:j]] = True
                found = np.flatnonzero(mark)
                if len(found) >= wanted or length == 0:
                    break
                length -= 1
                (a,), (b,) = self.ranges(own, length)
            found = found[self.ids[found] != ids[q]]
            scores = self.vectors[found] @ vectors[q]
            if len(found) > k:
                edge = -np.partition(-scores, k - 1)[k - 1]
                near = scores >= edge
                found, scores = found[near], scores[near]
            best = np.lexsort((self.ids[found], -scores))[:k]
            yield int(ids[q]), self.ids[found[best]], scores[best]


def usable(embeddings: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(vec_id, v array<double>, dim): vectors that are not null or zero and have finite components only, one per id."""
    v = F.col(f"`{vec_col}`").cast("array<double>")
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    rows = embeddings.select(F.col(f"`{id_col}`").cast("long").alias("vec_id"), v.alias("v")).where(F.col("vec_id").isNotNull() & F.forall("v", finite) & F.exists("v", lambda x: x != 0))
    return rows.groupBy("vec_id").agg(F.min("v").alias("v")).withColumn("dim", F.size("v"))


SHARES = (0.02, 0.05, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1.0)


def measured_share(vectors: np.ndarray, k: int, trees: int, recall: float, queries: int = 128) -> float:
    """The smallest of SHARES at which a block of these vectors finds the k nearest with this mean recall."""
    n = len(vectors)
    if n <= k + 1:
        return 1.0
    planes, norms = hyperplanes(vectors.shape[1], trees), (vectors * vectors).sum(axis=1)
    asked = np.arange(n)[:: max(1, n // queries)][:queries]
    block = Block(np.arange(n), vectors, strings(vectors, np.sqrt(np.maximum(norms.max() - norms, 0)), planes))
    scores = vectors[asked] @ vectors.T
    scores[np.arange(len(asked)), asked] = -np.inf
    true = np.argpartition(-scores, k - 1, axis=1)[:, :k]
    codes = strings(vectors[asked], np.zeros(len(asked)), planes)
    for share in SHARES:
        found = {q: ids for q, ids, _ in block.search(asked, vectors[asked], codes, k, int(np.ceil(share * n)))}
        if np.mean([len(np.intersect1d(found[q], t)) / k for q, t in zip(asked.tolist(), true, strict=True)]) >= recall:
            return share
    return 1.0


def nearest(
    embeddings: DataFrame, every: int = 20, k: int = 20, trees: int = 32, share: float | None = None, recall: float = 0.95, sample: int = 4096,
    block_rows: int = 8192, query_rows: int = 2048, id_col: str = "vec_id", vec_col: str = "embedding",
) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest found of every row whose id is divisible by ``every``.

    Nearness is the inner product in double precision; only vectors of one length are compared.  A query gets at least
    ``share`` of every block as candidates.  Without a share it is the smallest that reaches ``recall`` among about
    ``sample`` vectors, chosen by a hash of their ids; all rows are indexed and searched.  Vectors that are null, zero, or
    hold null or non-finite components, and rows without an id, take no part; rows that share an id are one row (the
    smallest of their vectors).  Other columns are ignored; an empty table gives no rows.

    Queries meet all rows in blocks: a task holds at most about block_rows rows and query_rows queries.
    """
    rows = usable(embeddings, id_col, vec_col)
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x))
    sizes = {r["dim"]: (r["n"], r["norm"]) for r in rows.groupBy("dim").agg(F.count("*").alias("n"), F.max(norm).alias("norm")).collect()}
    norms = {dim: x for dim, (_, x) in sizes.items()}
    shares = dict.fromkeys(sizes, share)
    for dim, (n, _) in sizes.items() if share is None else ():
        chosen = F.pmod(F.xxhash64("vec_id"), F.lit(n)) < sample
        drawn = [r["v"] for r in rows.where((F.col("dim") == dim) & chosen).select("v").orderBy(F.xxhash64("vec_id")).limit(sample).collect()]
        shares[dim] = measured_share(np.array(drawn, np.float64).reshape(len(drawn), dim), k, trees, recall) if drawn else 1.0

    def encode(lifted: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            planes: dict[int, np.ndarray] = {}
            for batch in batches:
                vectors = [x.values.to_numpy() for x in batch.column(1)]
                codes = [b""] * len(vectors)
                dims = batch.column(2).to_numpy()
                for dim in np.unique(dims).tolist():
                    if dim not in planes:
                        planes[dim] = hyperplanes(dim, trees)
                    at = np.flatnonzero(dims == dim)
                    for part in np.array_split(at, -(-len(at) // 1024)):
                        x = np.stack([vectors[i] for i in part])
                        lift = np.sqrt(np.maximum(norms[dim] ** 2 - (x * x).sum(axis=1), 0)) if lifted else np.zeros(len(x))
                        for i, c in zip(part, strings(x, lift, planes[dim]), strict=True):
                            codes[i] = c.tobytes()
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array([v.tobytes() for v in vectors], pa.binary()), pa.array(codes, pa.binary())], ["vec_id", "dim", "v", "codes"])

        return run

    schema = "vec_id long, dim int, v binary, codes binary"
    points = rows.mapInArrow(encode(True), schema)
    queries = rows.where(F.col("vec_id") % every == 0).mapInArrow(encode(False), schema)

    def blocks(value: dict) -> F.Column:
        return F.coalesce(F.create_map(*[F.lit(x) for item in value.items() for x in item])[F.col("dim")], F.lit(1)) if value else F.lit(1)

    n_points = blocks({d: -(-n // block_rows) for d, (n, _) in sizes.items()})
    n_queries = blocks({d: -(-n // (every * query_rows)) for d, (n, _) in sizes.items()})
    deal = lambda n, salt: F.pmod(F.xxhash64("vec_id", F.lit(salt)), n).cast("int")
    all_of = lambda n: F.explode(F.sequence(F.lit(0), (n - 1).cast("int")))
    left = points.withColumns({"p": deal(n_points, 1), "q": all_of(n_queries)})
    right = queries.withColumns({"q": deal(n_queries, 2), "p": all_of(n_points)})

    def search(own: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        out: list = []
        if len(own) and len(asked):
            dim, stack = int(own.dim.iloc[0]), lambda c, kind: np.frombuffer(b"".join(c), kind)
            unpack = lambda x: (x.vec_id.to_numpy(), stack(x.v, np.float64).reshape(-1, dim), stack(x.codes, np.uint64).reshape(-1, trees))
            block = Block(*unpack(own))
            wanted = max(k + 1, int(np.ceil(shares[dim] * len(own))))
            out = [(np.full(len(i), q), i, s) for q, i, s in block.search(*unpack(asked), k, wanted)]
        cols = [np.concatenate(c) for c in zip(*out, strict=True)] if out else [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)]
        return pd.DataFrame(dict(zip(("query_id", "vec_id", "score"), cols, strict=True)))

    found = left.groupBy("dim", "p", "q").cogroup(right.groupBy("dim", "p", "q")).applyInPandas(search, FOUND)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")

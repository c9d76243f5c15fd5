"""Best-fit-decreasing packing of tokenised documents into fixed-length sequences.

Pieces of one length are interchangeable, so best-fit decreasing runs over the length histogram (at most
``capacity`` entries, whatever the corpus) on the driver: a segment tree over remaining capacities finds the
tightest open bin in logarithmic time, and a run of equal pieces falls into a run of equal bins at once,
exactly as placing them one by one would.  The executors then turn each piece's rank within its length into
(sequence, offset) by binary search in the runs.  Nothing that grows with the corpus reaches the driver.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import doc_texts, materialize, slices
from .wordbpe import WordBpe

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, part int, nth long"
PACKED = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"


class CapacityTree:
    """Counts of open bins by remaining capacity; finds the smallest capacity >= x that has one."""

    def __init__(self, capacity: int):
        self.leaves = 1 << max(1, capacity.bit_length())
        self.count = [0] * (2 * self.leaves)

    def add(self, capacity: int, bins: int) -> None:
        i = capacity + self.leaves
        while i:
            self.count[i] += bins
            i >>= 1

    def tightest(self, least: int) -> int | None:
        i = least + self.leaves
        if self.count[i]:
            return least
        while i > 1:  # up to the first right sibling that holds a bin, then down its leftmost path
            if not i & 1 and self.count[i + 1]:
                i += 1
                while i < self.leaves:
                    i = 2 * i if self.count[2 * i] else 2 * i + 1
                return i - self.leaves
            i >>= 1
        return None


def best_fit_runs(histogram: dict[int, int], capacity: int) -> np.ndarray:
    """Runs (length, first rank, pieces, first sequence, pieces a sequence, first offset), ordered by length, rank."""
    tree, bins, runs, opened = CapacityTree(capacity), defaultdict(list), [], 0

    def put(room: int, first: int, n: int) -> None:
        if room and n:
            bins[room].append((first, n))
            tree.add(room, n)

    for length in sorted(histogram, reverse=True):
        left, rank = histogram[length], 0
        while left:
            room = tree.tightest(length)
            if room is None:
                room, first = capacity, opened
                n = -(-left // (capacity // length))
                opened += n
            else:
                first, n = bins[room].pop()
                tree.add(room, -n)
            each = room // length
            full = min(n, left // each)
            if full:
                runs.append((length, rank, full * each, first, each, capacity - room))
                put(room - each * length, first, full)
            else:  # fewer pieces left than one bin could take
                runs.append((length, rank, left, first, left, capacity - room))
                put(room - left * length, first, 1)
                put(room, first + 1, n - 1)
                break
            rank, left = rank + full * each, left - full * each
            if full < n:
                if room == capacity:  # new bins: one more for the rest, which the next turn fills
                    put_back = n - full
                    bins_room = (first + full, put_back)
                    bins[room].append(bins_room)
                    tree.add(room, put_back)
                else:
                    put(room, first + full, n - full)
    runs.sort()
    return np.array(runs, np.int64).reshape(-1, 6)


def pieces_of(docs: DataFrame, path: str, capacity: int, end_id: int) -> DataFrame:
    """Token pieces of every document, with part (the scan partition) and nth (rank among its pieces of that length)."""
    names = [f.split()[0] for f in PIECES.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe, part, seen = WordBpe.load(path), TaskContext.get().partitionId(), defaultdict(int)
        end = np.asarray([end_id], "<u4").tobytes()
        for batch in slices(batches, 1):
            rows = []
            for doc_id, ids in zip(batch.column(0).to_pylist(), bpe.encode_many(batch.column(1).to_pylist()), strict=True):
                ids += end
                for piece, at in enumerate(range(0, len(ids), 4 * capacity)):
                    cut = ids[at : at + 4 * capacity]
                    n = len(cut) // 4
                    rows.append((doc_id, piece, at // 4, n, zlib.crc32(cut), part, seen[n]))
                    seen[n] += 1
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    return docs.mapInArrow(run, PIECES)


def pack(df: DataFrame, tokenizer: str, capacity: int = 4096, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pack every document of df; one row per piece (columns PACKED).

    Null and empty texts are one piece holding the end id alone.  Repeated rows and repeated or null ids are packed
    as separate documents.  Other columns of df are ignored.  An empty df gives no rows.
    """
    pieces = materialize(pieces_of(doc_texts(df, id_col, text_col), tokenizer, capacity, end_id), "pieces")
    counts = pieces.groupBy("part", "length").agg(F.count("*").alias("n"))
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    bases = counts.select("part", "length", (F.sum("n").over(before) - F.col("n")).alias("base"))
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # <= capacity rows
    runs = best_fit_runs(histogram, capacity)
    firsts = np.searchsorted(runs[:, 0], np.arange(capacity + 2)) if len(runs) else np.zeros(capacity + 2, np.int64)
    names = [f.split()[0] for f in PACKED.split(", ")]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            length, rank = batch.column(3).to_numpy(), batch.column(5).to_numpy()
            at = np.empty(len(rank), np.int64)
            order = np.argsort(length, kind="stable")
            cuts = np.flatnonzero(np.diff(length[order])) + 1
            for rows in np.split(order, cuts):
                n = int(length[rows[0]])
                at[rows] = firsts[n] + np.searchsorted(runs[firsts[n] : firsts[n + 1], 1], rank[rows], side="right") - 1
            run = runs[at]
            k = rank - run[:, 1]
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(run[:, 3] + k // run[:, 4]), pa.array(run[:, 5] + k % run[:, 4] * length)], names)

    ranked = pieces.join(bases, ["part", "length"]).select(*names[:5], (F.col("base") + F.col("nth")).alias("rank"))
    return ranked.mapInArrow(place, PACKED)

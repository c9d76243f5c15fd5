"""Byte-level BPE: a minimal perfect hash for whole pre-tokens, a heap over linked bytes for the rest."""

from __future__ import annotations

import base64
import hashlib
import heapq
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame

from .common import doc_texts, slices

COLUMNS = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


class PerfectHash:
    """Minimal perfect hash of n byte strings by hash and displace: n slots, no two keys in one.

    Keys fall into buckets; from the fullest bucket on, the smallest displacement is kept that puts all of a
    bucket's keys into free slots.  Buckets of one key name their slot directly (as -1 - slot).
    """

    def __init__(self, keys: list[bytes]):
        self.n = n = len(keys)
        self.buckets = max(1, n // 2)
        self.displace = np.zeros(self.buckets, np.int64)
        slots = np.full(n, -1, np.int64)
        h = np.array([xxhash.xxh3_64_intdigest(k) for k in keys], np.uint64)
        if len(np.unique(h)) != n:
            raise ValueError("keys must be distinct and free of 64-bit collisions")
        where = (h % np.uint64(self.buckets)).astype(np.int64)
        order = np.argsort(where, kind="stable")
        groups = np.split(order, np.flatnonzero(np.diff(where[order])) + 1)
        groups.sort(key=len, reverse=True)
        free = iter(())
        for members in groups:
            bucket = where[members[0]]
            if len(members) == 1:
                if not isinstance(free, list):
                    free = np.flatnonzero(slots < 0).tolist()
                slot = free.pop()
                self.displace[bucket] = -1 - slot
                slots[slot] = members[0]
                continue
            tries, d = np.arange(64), None
            while d is None:  # a stretch of displacements at a time
                at = self._slot(h[members][:, None], tries[None, :])
                fits = (slots[at] < 0).all(axis=0)
                for k in np.flatnonzero(fits).tolist():
                    if len(set(at[:, k].tolist())) == len(members):
                        d, at = int(tries[k]), at[:, k]
                        break
                tries = tries + 64
            self.displace[bucket] = d
            slots[at] = members
        self.order = slots  # key index by slot

    def _slot(self, h: np.ndarray, d: np.ndarray) -> np.ndarray:
        x = (h ^ (d.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))) * np.uint64(0xD6E8FEB86659FD93)
        return ((x >> np.uint64(32)) % np.uint64(self.n)).astype(np.int64)

    def slots(self, keys: list[bytes]) -> np.ndarray:
        """The slot of each key; any slot for a string that is no key."""
        h = np.array([xxhash.xxh3_64_intdigest(k) for k in keys], np.uint64)
        d = self.displace[(h % np.uint64(self.buckets)).astype(np.int64)]
        return np.where(d < 0, -1 - d, self._slot(h, np.maximum(d, 0)))


#: Longer pre-tokens are not remembered, so that the memo's limit also bounds its bytes.
MEMO_CHARS = 64


class ByteBpe:
    """Ranks of byte strings as ids; encode gives what greedy lowest-rank merging of each pre-token gives."""

    def __init__(self, ranks: dict[bytes, int], pattern: str, memo_limit: int = 400_000):
        self.pattern, self.limit = pattern, memo_limit
        keys = list(ranks)
        ids = np.fromiter(ranks.values(), np.int64, len(keys))
        self.hash = PerfectHash(keys)
        self.slot_key = [keys[i] for i in self.hash.order.tolist()]
        self.slot_id = ids[self.hash.order]
        self._prepare()

    @classmethod
    def from_file(cls, path: str, pattern: str, **options) -> ByteBpe:
        with open(path, "rb") as lines:
            return cls({base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}, pattern, **options)

    def _prepare(self) -> None:
        self.memo: dict[str, tuple[int, ...]] = {}
        self.rank_of = dict(zip(self.slot_key, self.slot_id.tolist(), strict=True))
        self.bytes_of = [b""] * (max(self.rank_of.values()) + 1)
        for key, i in self.rank_of.items():
            self.bytes_of[i] = key
        self.find = regex.compile(self.pattern).findall

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k not in ("memo", "find", "rank_of", "bytes_of")}

    def __setstate__(self, state: dict) -> None:
        self.__dict__.update(state)
        self._prepare()

    def ranks(self, keys: list[bytes]) -> list[int]:
        """The rank of each key by one perfect-hash probe and one comparison; -1 for a string outside the vocabulary."""
        if not keys:
            return []
        slots = self.hash.slots(keys).tolist()
        return [int(self.slot_id[s]) if self.slot_key[s] == k else -1 for s, k in zip(slots, keys, strict=True)]

    def merge(self, word: bytes) -> tuple[int, ...]:
        """Lowest-rank merging, leftmost among equals: a heap of candidate pairs over doubly linked parts of the word.

        A part begins at i and ends where the next begins; pair[i] is the rank of the pair that begins at i, -1 without
        one.  A heap entry is rank * n + i, and is stale unless it agrees with pair[i].
        """
        n, rank = len(word), self.rank_of.get
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        pair = [rank(word[i : i + 2], -1) for i in range(n - 1)]
        pair.append(-1)
        heap = [r * n + i for i, r in enumerate(pair) if r >= 0]
        heapq.heapify(heap)
        while heap:
            r, i = divmod(heapq.heappop(heap), n)
            if pair[i] != r:
                continue
            j = after[i]
            k = after[i] = after[j]
            pair[j] = pair[i] = -1
            if k < n:
                before[k] = i
                if (r := rank(word[i : after[k]], -1)) >= 0:
                    pair[i] = r
                    heapq.heappush(heap, r * n + i)
            p = before[i]
            if p >= 0:
                r = pair[p] = rank(word[p:k], -1)
                if r >= 0:
                    heapq.heappush(heap, r * n + p)
        parts, i = [], 0
        while i < n:
            parts.append(self.rank_of[word[i : after[i]]])
            i = after[i]
        return tuple(parts)

    def _learn(self, words: list[str]) -> None:
        data = [w.encode("utf-8", "replace") for w in words]
        for w, raw, rank in zip(words, data, self.ranks(data), strict=True):
            self.memo[w] = (rank,) if rank >= 0 else self.merge(raw)

    def encode(self, text: str) -> list[int]:
        words = self.find(text)
        distinct, memo = set(words), self.memo
        if missing := [w for w in distinct if w not in memo]:
            if len(memo) + len(missing) > self.limit:
                memo.clear()
                missing = list(distinct)
            self._learn(missing)
        ids = list(chain.from_iterable(map(memo.__getitem__, words)))
        for w in missing:
            if len(w) > MEMO_CHARS:
                del memo[w]
        return ids

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))


def round_trip(df: DataFrame, model: ByteBpe, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode every whole text, decode its ids, and digest both (columns COLUMNS), one row per row of df.

    A null text counts as empty: no ids, and the digests of nothing.  Texts and pre-tokens of any length are encoded whole.
    Repeated rows come back as often as they occur, and rows without an id too; other columns of df are ignored; an empty
    df gives no rows.  The model (the vocabulary's size, whatever the corpus) is broadcast.
    """
    shared = df.sparkSession.sparkContext.broadcast(model)
    names = [f.split()[0] for f in COLUMNS.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = shared.value
        text_of = list(map(str, range(len(bpe.bytes_of))))
        for batch in slices(batches, 1):
            n, ids_hash, text_hash = [], [], []
            for data in batch.column(1).to_pylist():
                ids = bpe.encode((data or b"").decode("utf-8", "replace"))
                n.append(len(ids))
                ids_hash.append(hashlib.sha256(",".join(map(text_of.__getitem__, ids)).encode()).hexdigest())
                text_hash.append(hashlib.sha256(bpe.decode(ids)).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(ids_hash), pa.array(text_hash)], names)

    return doc_texts(df, id_col, text_col).mapInArrow(run, COLUMNS)

"""Alignment of two tokenizers' tokens over the bytes of the same text, by byte-owner arrays.

Repeating each token's index over its bytes gives every byte its owner among A's tokens and among B's.  Where the pair
of owners changes, a new overlap begins; where both change at once, the text is cut.  So the distinct consecutive
owner pairs are the links, and the cuts the groups, without a search.

How many documents hold a pair of linked ids is counted over the corpus.  Documents are taken in chunks: a chunk asks
for each of its distinct id pairs once, whatever its documents, so a pair that every document holds is one row a chunk.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import doc_texts, in_fewer_files, materialize, slices
from .wordbpe import _byte_alphabet

#: Bytes of texts, and rows, after which a task begins a new chunk.
CHUNK_BYTES, CHUNK_ROWS = 16 << 20, 8000
#: Longer pre-tokens are not remembered.
MEMO_CHARS, MEMO_LIMIT = 64, 300_000
#: An id pair a * |B| + b; the product of the vocabularies must fit.
PAIR = np.uint32
FOUND = "chunk long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pairs binary, times binary"
COLUMNS = ("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


#: Texts of other characters than these are cut by the pattern itself, all others by its equivalent in the re module.
_OTHER = re.compile("[^\t-\r -~¡-įı-ɏ]")
_PLAIN = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?[^\W\d_²³¹¼½¾]+| ?[\d²³¹¼½¾]+| ?(?:[^\s\w]|_)+|\s+(?!\S)|\s+")


class _Memo(dict):
    """Pieces of text to their ids as int32 bytes.  ``learn`` encodes many at once: (ids of all, in order; pieces' ends).

    Long pieces are not kept, so that entries bound bytes.
    """

    def __init__(self, learn):
        super().__init__()
        self.learn = learn

    def all(self, pieces: list[str]) -> np.ndarray:
        if missing := [p for p in set(pieces) if p not in self]:
            if len(self) + len(missing) > MEMO_LIMIT:
                self.clear()
                missing = list(set(pieces))
            ids, ends = self.learn(missing)
            raw, at = np.asarray(ids, np.int32).tobytes(), 0
            for piece, end in zip(missing, ends, strict=True):
                self[piece], at = raw[4 * at : 4 * end], end
        found = np.frombuffer(b"".join(map(self.__getitem__, pieces)), np.int32)
        for piece in missing:
            if len(piece) > MEMO_CHARS:
                del self[piece]
        return found


class ByteTokens:
    """A: byte-level BPE of a tokenizers file; special strings in a text are plain text.

    The library merges each pre-token by itself, so one that was met before needs no merging.  Tokens spell the text, as
    the vocabulary has every byte and nothing is normalised.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from public_tokenizers import PATTERN
        from tokenizers import Tokenizer

        library = Tokenizer.from_file(path)
        with open(path) as lines:
            declared = json.load(lines)["pre_tokenizer"]
        if declared["type"] != "ByteLevel" or declared.get("add_prefix_space") or library.normalizer is not None:
            raise ValueError("a byte-level vocabulary without normaliser and added space is needed")
        self.alphabet, self.tokenize, self.memo = _byte_alphabet(), library.model.tokenize, _Memo(self._learn)
        self.find = regex.compile(PATTERN).findall
        of_char = {c: b for b, c in self.alphabet.items()}
        vocab = library.get_vocab(with_added_tokens=False)
        self.bytes_of = [b""] * (1 + max(vocab.values()))
        for spelled, i in vocab.items():
            self.bytes_of[i] = bytes(map(of_char.__getitem__, spelled))
        self.lengths = np.fromiter(map(len, self.bytes_of), np.int64)

    def _learn(self, pieces: list[str]) -> tuple[list[int], list[int]]:
        ids, ends = [], []
        for piece in pieces:
            ids += [t.id for t in self.tokenize(piece.encode("utf-8", "replace").decode("latin-1").translate(self.alphabet))]
            ends.append(len(ids))
        return ids, ends

    def encode(self, text: str) -> np.ndarray:
        return self.memo.all(self.find(text) if _OTHER.search(text) else _PLAIN.findall(text))


class PieceTokens:
    """B: a sentencepiece model, which adds the space itself.

    If no piece holds a space after another character, and none a line feed, then nothing is merged across the beginning of
    a run of spaces or a line feed, and what stands between is encoded by itself, once.  Other models, and texts in which
    the space's own sign stands, are encoded whole.
    """

    def __init__(self, path: str):
        import sentencepiece

        self.library = library = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = [library.id_to_piece(i) for i in range(library.get_piece_size())]
        self.bytes_of = [bytes([int(p[3:5], 16)]) if library.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        self.lengths = np.fromiter(map(len, self.bytes_of), np.int64)
        plain = [p for i, p in enumerate(pieces) if not library.is_byte(i)]
        alone, space = library.encode("\n"), library.piece_to_id("▁")
        self.by_parts = not any(re.search("[^▁]▁|\n", p) for p in plain) and alone[:1] == [space] and library.encode("  a\n  b") == [*library.encode("  a"), *library.encode("\n")[1:], *library.encode(" b")]
        self.memo = _Memo(self._learn)
        self.find = re.compile(" +[^ \n]*|\n[^ \n]*").findall

    def _learn(self, parts: list[str]) -> tuple[list[int], list[int]]:
        """All in one text, after the part `` a`` (the library adds its space); mere spaces stand before a line feed, which goes."""
        joined = [p + "\n" if p.isspace() and p[0] == " " else p for p in parts]
        ids = self.library.encode("a" + "".join(joined))
        ends = np.cumsum(self.lengths[ids]).tolist()
        sizes = np.cumsum([2, *(len(p.encode("utf-8", "replace")) for p in joined)])
        cuts, out, stops = (np.searchsorted(ends, sizes) + 1).tolist(), [], []
        for part, spelled, lo, hi in zip(parts, joined, cuts, cuts[1:], strict=False):
            out += ids[lo : hi - (part is not spelled)]
            stops.append(len(out))
        return out, stops

    def encode(self, text: str) -> np.ndarray:
        if not self.by_parts or "▁" in text:
            return np.array(self.library.encode(text), np.int32)
        return self.memo.all(self.find(" " + text)) if text else np.zeros(0, np.int32)


def overlaps(a_lengths: np.ndarray, b_lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(a, b, cut): for each link its A and B token, in order, and whether a group begins there.

    Lengths are the bytes of each token; both sum to the same.
    """
    a, b = np.repeat(np.arange(len(a_lengths)), a_lengths), np.repeat(np.arange(len(b_lengths)), b_lengths)
    new_a, new_b = np.diff(a, prepend=-1) > 0, np.diff(b, prepend=-1) > 0
    at = np.flatnonzero(new_a | new_b)
    return a[at], b[at], (new_a & new_b)[at]


class Speller:
    """The text ``a1,a2|b1;a3|b2,b3`` of groups, by one table of ids with the sign that follows them."""

    def __init__(self, n_a: int, n_b: int):
        numbers = list(map(str, range(max(n_a, n_b))))
        self.table = [numbers[i] + sign for n, sign in ((n_a, ","), (n_a, "|"), (n_b, ","), (n_b, ";")) for i in range(n)]
        self.n_a, self.n_b = n_a, n_b

    def spell(self, a_ids: np.ndarray, b_ids: np.ndarray, a: np.ndarray, b: np.ndarray, cut: np.ndarray) -> str:
        first = np.flatnonzero(cut)
        a_from, b_from = np.append(a[first], len(a_ids)), np.append(b[first], len(b_ids))
        code = np.empty(len(a_ids) + len(b_ids), np.int64)
        a_size, b_size = np.diff(a_from), np.diff(b_from)
        last_a, last_b = np.zeros(len(a_ids), np.int64), np.zeros(len(b_ids), np.int64)
        last_a[a_from[1:] - 1] = last_b[b_from[1:] - 1] = 1
        code[np.arange(len(a_ids)) + np.repeat(b_from[:-1], a_size)] = a_ids + last_a * self.n_a
        code[np.arange(len(b_ids)) + np.repeat(a_from[1:], b_size)] = b_ids + last_b * self.n_b + 2 * self.n_a
        return "".join(map(self.table.__getitem__, code.tolist()))[:-1]


def align(text: str | None, one: ByteTokens, two: PieceTokens, speller: Speller) -> tuple[int, int, int, int, str, np.ndarray, np.ndarray]:
    """(n_a, n_b, n_groups, n_links, groups_sha256, pairs, times): pairs are distinct a * |B| + b, ascending.

    All zero for a text that is null, empty, or not spelled byte for byte by both.
    """
    none = 0, 0, 0, 0, "", np.zeros(0, PAIR), np.zeros(0, np.uint32)
    if not text:
        return none
    a_ids, b_ids, want = one.encode(" " + text), two.encode(text), (" " + text).encode("utf-8", "replace")
    a_lengths, b_lengths = one.lengths[a_ids], two.lengths[b_ids]
    if a_lengths.sum() != len(want) or b_lengths.sum() != len(want) or b"".join(map(two.bytes_of.__getitem__, b_ids.tolist())) != want:
        return none
    a, b, cut = overlaps(a_lengths, b_lengths)
    pairs, times = np.unique(a_ids[a].astype(PAIR) * len(two.bytes_of) + b_ids[b], return_counts=True)
    digest = hashlib.sha256(speller.spell(a_ids, b_ids, a, b, cut).encode()).hexdigest()
    return len(a_ids), len(b_ids), int(cut.sum()), len(a), digest, pairs.astype(PAIR), times.astype(np.uint32)


_LOADED: dict[tuple[str, str], tuple[ByteTokens, PieceTokens, Speller]] = {}


def _models(a_path: str, b_path: str) -> tuple[ByteTokens, PieceTokens, Speller]:
    """One of each per Python worker."""
    if (a_path, b_path) not in _LOADED:
        one, two = ByteTokens(a_path), PieceTokens(b_path)
        _LOADED[a_path, b_path] = one, two, Speller(len(one.bytes_of), len(two.bytes_of))
    return _LOADED[a_path, b_path]


def _aligner(a_path: str, b_path: str):
    heads = [f.split()[0] for f in FOUND.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        models = _models(a_path, b_path)
        chunk, size, rows = TaskContext.get().partitionId() << 32, 0, 0
        for batch in slices(batches, 1):
            if rows and (size + batch.column(1).nbytes > CHUNK_BYTES or rows + batch.num_rows > CHUNK_ROWS):
                chunk, size, rows = chunk + 1, 0, 0
            size, rows = size + batch.column(1).nbytes, rows + batch.num_rows
            found = [align(None if x is None else x.decode("utf-8", "replace"), *models) for x in batch.column(1).to_pylist()]
            longs = [pa.array([f[k] for f in found], pa.int64()) for k in range(4)]
            bits = [pa.array([f[k].tobytes() for f in found], pa.binary()) for k in (5, 6)]
            yield pa.RecordBatch.from_arrays([pa.array(np.full(batch.num_rows, chunk)), batch.column(0), *longs, pa.array([f[4] for f in found], pa.string()), *bits], heads)

    return run


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows (chunk, pairs): a row (chunk, pair, n documents) for each pair of a batch's rows of one chunk."""
    for batch in batches:
        chunks = batch.column(0).to_numpy()
        for chunk in np.unique(chunks):
            held = batch.column(1).filter(pa.array(chunks == chunk)).to_pylist()
            pairs, n = np.unique(np.frombuffer(b"".join(held), PAIR), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(pairs), chunk)), pa.array(pairs.astype(np.int64)), pa.array(n.astype(np.int64))], ["chunk", "pair", "n"])


def _scored(docs: pa.Table, counts: pa.Table) -> pa.Table:
    """Documents of one chunk with the corpus-wide counts of the chunk's pairs."""
    order = np.argsort(counts["pair"].to_numpy())
    pair, n, best = (counts[c].to_numpy()[order] for c in ("pair", "n", "best"))
    n_best, total = [], []
    for pairs, times in zip(docs["pairs"].to_pylist(), docs["times"].to_pylist(), strict=True):
        at, times = np.searchsorted(pair, np.frombuffer(pairs, PAIR)), np.frombuffer(times, np.uint32).astype(np.int64)
        n_best.append(int(times[best[at]].sum()))
        total.append(int((times * n[at]).sum()))
    out = docs.select(["doc_id", "n_a", "n_b", "n_groups", "n_links"])
    return out.append_column("n_best", pa.array(n_best, pa.int64())).append_column("count_sum", pa.array(total, pa.int64())).append_column("groups_sha256", docs["groups_sha256"])


def alignments(df: DataFrame, a_path: str, b_path: str, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """(found, counts): columns FOUND a row of df, written, and the corpus-wide links (pair, a_id, b_id, n, best).

    n: the documents (rows) that hold the pair linked; best: no pair of the A id has more.  There are no more pairs than
    the vocabularies have, whatever the corpus.
    """
    one, two, _ = _models(a_path, b_path)
    size = len(two.bytes_of)
    if len(one.bytes_of) * size > np.iinfo(PAIR).max:
        raise ValueError("the vocabularies have too many pairs")
    found = materialize(doc_texts(df, id_col, text_col).mapInArrow(_aligner(a_path, b_path), FOUND), "alignments")
    each = found.where("n_links > 0").select("chunk", "pairs").mapInArrow(_counted, "chunk long, pair long, n long")
    totals = each.groupBy("pair").agg(F.sum("n").alias("n")).withColumn("a_id", F.floor(F.col("pair") / size)).withColumn("b_id", F.col("pair") % size)
    counts = totals.withColumn("best", F.col("n") == F.max("n").over(Window.partitionBy("a_id")))
    return found, materialize(in_fewer_files(counts), "counts")


def align_tokens(df: DataFrame, a_path: str, b_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of df, columns COLUMNS.

    Texts that are null, empty, or that a tokenizer does not spell byte for byte (after the added space) have no tokens:
    zeros, and an empty groups_sha256.  Repeated rows are documents of their own, in the counts too; a null id stays null.
    Very long texts are one row of one chunk.  Other columns of df are ignored; an empty df gives no rows.
    """
    found, counts = alignments(df, a_path, b_path, id_col, text_col)
    with_links, without = found.where("n_links > 0"), found.where("n_links = 0")
    asked = with_links.select("chunk", "pairs").mapInArrow(_counted, "chunk long, pair long, n long").select("chunk", "pair").distinct()
    told = asked.join(counts.select("pair", "n", "best"), "pair")
    kinds = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"
    scored = with_links.groupBy("chunk").cogroup(told.groupBy("chunk")).applyInArrow(_scored, kinds)
    zero = F.lit(0).cast("long")
    return scored.unionByName(without.withColumns({"n_best": zero, "count_sum": zero}).select(*COLUMNS))

"""Exact substring deduplication on a compacted De Bruijn graph of word windows.

A window of k words is an edge between its first and its last k - 1 words; the pair of their 64-bit hashes names it.
Windows that two texts share have the same minimizer, so first only minimizers are compared (a fifth of the windows),
and only windows under a minimizer that two texts share become edges.  Every repeated edge is owned by the smallest
document that holds it and has a source coordinate there.  Edges chain into a path where the node between them has one
way in and one way out and their source coordinates are consecutive; windows of later documents then compact into spans
along such paths.  A span is removed after its words equal the words at its source coordinates.

Copies of a text are one text in the graph; a copy of a smaller document's text is a span of the whole text.  What many
documents share is combined before every shuffle on a minimizer or an edge, so that it is a row a slice or a task there.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import compress

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, doc_texts, in_fewer_files, materialize, slices

MINIMIZER_WORDS = 5
_SPACE = np.isin(np.arange(256), np.frombuffer(b" \t\n\r\x0b\x0c", np.uint8))
_BYTE = np.random.default_rng(13).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0x9E3779B97F4A7C15
_STRETCH = 1 << 19
_POWERS: list[np.ndarray] = []


def _mix(x: np.ndarray) -> np.ndarray:
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(29)
    return x


def _powers(n: int) -> list[np.ndarray]:
    """Powers of the base and of its inverse modulo 2^64."""
    if not _POWERS or len(_POWERS[0]) < n:
        runs = []
        for base in (_BASE, pow(_BASE, -1, 1 << 64)):
            steps = np.full(max(n, _STRETCH + 4096), base, np.uint64)
            steps[0] = 1
            runs.append(np.multiply.accumulate(steps))
        _POWERS[:] = runs
    return _POWERS


def word_hashes(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, starts): a 64-bit hash and the first byte of every word; no Python object per word.

    A word's hash is its stretch of a running polynomial over all bytes, shifted back to the word's own start.
    """
    buf, at, hashes, starts = np.frombuffer(data, np.uint8), 0, [], []
    while at < len(buf):
        end = min(len(buf), at + _STRETCH)
        while end < len(buf) and not _SPACE[buf[end]]:
            end += 1
        part = buf[at:end]
        power, inverse = _powers(len(part))
        step = np.diff(~_SPACE[part], prepend=False, append=False).nonzero()[0]
        first, last = step[::2], step[1::2]
        sums = np.zeros(len(part) + 1, np.uint64)
        np.cumsum(_BYTE[part] * power[: len(part)], out=sums[1:])
        hashes.append(_mix((sums[last] - sums[first]) * inverse[first]))
        starts.append(first + at)
        at = end
    empty = np.zeros(0, np.uint64)
    return (np.concatenate(hashes), np.concatenate(starts)) if hashes else (empty, empty.astype(np.int64))


def gram_hashes(hashes: np.ndarray, n: int, seed: int) -> np.ndarray:
    """64-bit hashes of all runs of n words: multilinear in the word hashes, then mixed."""
    size = max(0, len(hashes) - n + 1)
    out = np.zeros(size, np.uint64)
    for j, a in enumerate(_factors(n, seed)):
        out += a * hashes[j : j + size]
    return _mix(out)


def _factors(n: int, seed: int) -> np.ndarray:
    return np.random.default_rng(seed).integers(0, 1 << 63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


class _Rows:
    """The words of several texts in one array: hashes, their row, and where each row's windows begin."""

    def __init__(self, texts: list[bytes | None], window: int):
        sizes = np.array([len(t or b"") + 1 for t in texts], np.int64)
        self.hashes, starts = word_hashes(b"\n".join(t or b"" for t in texts))
        self.row = np.searchsorted(np.cumsum(sizes), starts, side="right")
        self.first = np.searchsorted(self.row, np.arange(len(texts)))  # first word of each row
        n = max(0, len(self.hashes) - window + 1)
        self.whole = self.row[:n] == self.row[window - 1 :] if n else np.zeros(0, bool)  # windows inside one row

    def runs(self, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(start, length, minimizer) of runs of whole windows that share a minimizer: the smallest hash among a window's
        runs of MINIMIZER_WORDS words."""
        m = min(MINIMIZER_WORDS, window)
        grams, n = gram_hashes(self.hashes, m, 1), len(self.whole)
        low = grams[:n].copy()
        for j in range(1, window - m + 1):
            np.minimum(low, grams[j : j + n], out=low)
        at = np.flatnonzero(self.whole)
        if not len(at):
            return at, at, np.zeros(0, np.uint64)
        new = np.ones(len(at), bool)
        new[1:] = (low[at[1:]] != low[at[:-1]]) | (at[1:] != at[:-1] + 1) | (self.row[at[1:]] != self.row[at[:-1]])
        heads = np.flatnonzero(new)
        return at[heads], np.diff(np.append(heads, len(at))), low[at[heads]]


def _coordinates(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, tag, t, t2, data): tag (30 bits, so that places differ by a long) tells rows of one id apart, t and t2 name the text."""
    docs = doc_texts(df, id_col, text_col).where("doc_id is not null and data is not null")
    t = F.xxhash64("data")
    return docs.select("doc_id", F.shiftright(t, 34).cast("int").alias("tag"), t.alias("t"), F.xxhash64(F.lit(7), "data").alias("t2"), "data")


def _shared_minimizers(docs: DataFrame, window: int) -> DataFrame:
    """(t, minis): minimizers of each text that another text has too.

    A slice of rows knows at once which of its minimizers several of its texts have, and sends one row for each
    minimizer; so one that very many documents share arrives once a slice.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1, 1 << 20):
            rows = _Rows(batch.column(1).to_pylist(), window)
            start, _, mini = rows.runs(window)
            t = batch.column(0).to_numpy()[rows.row[start]]
            order = np.lexsort((t, mini))
            mini, t = mini[order].view(np.int64), t[order]
            single = np.ones(len(mini), bool)
            single[1:] = (mini[1:] != mini[:-1]) | (t[1:] != t[:-1])
            mini, t = mini[single], t[single]
            heads = np.flatnonzero(np.append(True, mini[1:] != mini[:-1])) if len(mini) else np.zeros(0, np.int64)
            size = np.diff(np.append(heads, len(mini)))
            known = np.repeat(size > 1, size)
            other = pa.concat_arrays([pa.array(t[heads + size - 1], mask=size == 1), pa.nulls(int(known.sum()), pa.int64())])
            columns = [pa.array(np.concatenate(c)) for c in ((mini[heads], mini[known] ^ t[known]), (t[heads], t[known]))]
            yield pa.RecordBatch.from_arrays([*columns, other, pa.array(np.repeat([False, True], [len(heads), int(known.sum())]))], ["key", "t", "other", "known"])

    # A minimizer that is known to be shared travels under a key of its own text, so that nothing meets there.
    held = docs.select("t", "data").mapInArrow(run, "key long, t long, other long, known boolean")
    met = Window.partitionBy("key", "known")
    found = held.select("key", "t", "known", F.min("t").over(met).alias("low"), F.max(F.greatest("t", "other")).over(met).alias("high")).where("known or low < high")
    found = found.select(F.when(F.col("known"), F.col("key").bitwiseXOR(F.col("t"))).otherwise(F.col("key")).alias("mini"), "t")
    return found.groupBy("t").agg(F.collect_set("mini").alias("minis"))


#: The bits of a node that count; all of them, but in tests of what collisions do.
NODE_MASK = np.uint64(0xFFFFFFFFFFFFFFFF)
EDGES = "edge long, src long, dst long, doc_id long, at long, members array<struct<doc_id: long, at: long>>"


def _edges(docs: DataFrame, shared: DataFrame, window: int) -> DataFrame:
    """EDGES: windows under shared minimizers, one row for each edge of a slice of rows.

    doc_id and at (the tag and the place of the first word) are the least, members the others of the slice.  src and dst
    are the nodes' hashes: two nodes of one hash only part a path in two.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 2, 1 << 20):
            rows = _Rows(batch.column(2).to_pylist(), window)
            start, length, mini = rows.runs(window)
            lists = batch.column(3)
            owner = np.repeat(np.arange(batch.num_rows), np.diff(lists.offsets.to_numpy()))
            known = lists.flatten().to_numpy().view(np.uint64)
            tag = lambda row: _mix(row.astype(np.uint64) + np.uint64(1))  # noqa: E731  one stray match only costs an edge
            hit = np.isin(mini ^ tag(rows.row[start]), known ^ tag(owner))
            start, size = start[hit], length[hit]
            first = np.repeat(start - np.cumsum(size) + size, size) + np.arange(size.sum())  # every window's first word
            grams = gram_hashes(rows.hashes, window - 1, 2)
            src, dst = grams[first], grams[first + 1]
            edge = _mix(src * np.uint64(_BASE) ^ (dst + (src >> np.uint64(32)))).view(np.int64)
            src, dst = (src & NODE_MASK).view(np.int64), (dst & NODE_MASK).view(np.int64)
            row = rows.row[first]
            doc_id, at = batch.column(0).to_numpy()[row], (batch.column(1).to_numpy()[row].astype(np.int64) << 32) + first - rows.first[row]
            order = np.lexsort((at, doc_id, edge))
            edge, src, dst, doc_id, at = edge[order], src[order], dst[order], doc_id[order], at[order]
            new = np.append(True, edge[1:] != edge[:-1])[: len(edge)]
            others = np.append(0, np.cumsum(np.diff(np.append(np.flatnonzero(new), len(edge))) - 1)).astype(np.int32)
            rest = pa.StructArray.from_arrays([pa.array(doc_id[~new]), pa.array(at[~new])], ["doc_id", "at"])
            members = pa.ListArray.from_arrays(pa.array(others), rest)
            yield pa.RecordBatch.from_arrays([pa.array(c[new]) for c in (edge, src, dst, doc_id, at)] + [members], ["edge", "src", "dst", "doc_id", "at", "members"])

    return docs.join(shared, ["doc_id", "t"]).select("doc_id", "tag", "data", "minis").mapInArrow(run, EDGES)


def _sources(docs: DataFrame, wanted: DataFrame, window: int) -> DataFrame:
    """(odoc, oat, n, digest): digests of the n words at the source coordinates wanted (odoc, oat, n)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1):
            out: list = []
            for doc_id, data, places in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                words = data.split()
                out.extend((doc_id, p["oat"], p["n"], run_digest(words, p["oat"] & 0xFFFFFFFF, p["n"])) for p in places)
            columns = list(zip(*out, strict=True)) or [[]] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(columns, (pa.int64(), pa.int64(), pa.int32(), pa.int64()), strict=True)], ["odoc", "oat", "n", "digest"])

    places = wanted.groupBy("odoc", F.shiftright("oat", 32).cast("int").alias("otag")).agg(F.collect_set(F.struct("oat", "n")).alias("places"))
    own = docs.join(places, (F.col("doc_id") == F.col("odoc")) & (F.col("tag") == F.col("otag"))).select("doc_id", "data", "places")
    return own.mapInArrow(run, "odoc long, oat long, n int, digest long").distinct()


def run_digest(words: list[bytes], start: int, n: int) -> int:
    """A signed 64-bit hash of n words by single spaces, from their bytes alone."""
    return xxhash.xxh3_64_intdigest(b" ".join(words[start : start + n])) - (1 << 63)


def repeated_spans(docs: DataFrame, window: int = 13) -> DataFrame:
    """(doc_id, tag, spans array<struct<start, n, digest>>, copy) of documents that repeat a smaller one.

    docs as _coordinates gives them.  The n words from start are those at a smaller document's source coordinates, which
    have this digest; copy says that the whole text is a smaller document's.
    """
    texts = docs.groupBy("t", "t2").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high"))
    copied = texts.where("low < high").select("t", "t2", "low")
    copies = docs.select("doc_id", "tag", "t", "t2").join(copied, ["t", "t2"]).where("doc_id > low").select("doc_id", "tag").distinct()
    shared = materialize(in_fewer_files(_shared_minimizers(docs, window).join(texts.select("t", F.col("low").alias("doc_id")), "t")), "minimizers")
    # Edges meet in one shuffle; the smallest document that holds an edge owns it.
    met = Window.partitionBy("edge")
    own, high = F.min(F.struct("doc_id", "at")).over(met), F.max(F.greatest("doc_id", F.array_max("members")["doc_id"])).over(met)
    kept = _edges(docs, shared, window).withColumns({"own": own, "high": high}).where("own.doc_id < high")
    kept = materialize(in_fewer_files(kept.select("src", "dst", "doc_id", "at", "members", F.col("own.doc_id").alias("odoc"), F.col("own.at").alias("oat"))), "edges")
    discard(shared)
    # Nonbranching nodes: one way in, one way out, and consecutive source coordinates.
    graph = kept.where("doc_id = odoc and at = oat").select("src", "dst", "odoc", "oat").distinct()
    ways_out = graph.groupBy(F.col("src").alias("node")).agg(F.count("*").alias("n"), F.min("odoc").alias("odoc"), F.min("oat").alias("oat")).where("n = 1")
    ways_in = graph.groupBy(F.col("dst").alias("node")).agg(F.count("*").alias("n"), F.min("odoc").alias("idoc"), F.min("oat").alias("iat")).where("n = 1")
    inner = ways_out.join(ways_in.drop("n"), "node").where("odoc = idoc and oat = iat + 1").select("odoc", "oat", F.lit(0).alias("head"))
    # Paths: an edge continues the one before it if the node between them is nonbranching; islands in the owner's text.
    marks = graph.select("odoc", "oat", F.lit(1).alias("head")).unionByName(inner)
    along = Window.partitionBy("odoc").orderBy("oat", "head")
    continues = F.coalesce((F.lag("oat").over(along) == F.col("oat")) & (F.lag("head").over(along) == 0), F.lit(False))
    marks = marks.withColumn("starts", F.when((F.col("head") == 1) & ~continues, F.col("oat")))
    paths = marks.select("odoc", "oat", "head", F.last("starts", ignorenulls=True).over(along).alias("path")).where("head = 1").drop("head")
    paths = materialize(in_fewer_files(paths), "paths")
    # Windows of later documents compact into runs along one path at one distance from the source coordinates.
    every = F.concat(F.array(F.struct("doc_id", "at")), "members")
    later = kept.join(paths, ["odoc", "oat"]).select("odoc", "oat", "path", F.explode(every).alias("m")).select("odoc", "oat", "path", "m.doc_id", "m.at").where("doc_id > odoc")
    runs = later.groupBy("doc_id", "odoc", "path", (F.col("at") - F.col("oat")).alias("shift")).agg(F.array_sort(F.collect_set("at")).alias("at"))
    before, after = (lambda k: F.get(F.col("at"), k - 1)), (lambda k: F.get(F.col("at"), k + 1))
    starts = F.filter("at", lambda x, k: (k == 0) | (before(k) < x - 1))
    lasts = F.filter("at", lambda x, k: (k == F.size("at") - 1) | (after(k) > x + 1))
    spans = runs.select("doc_id", "odoc", "shift", F.explode(F.arrays_zip(starts.alias("a"), lasts.alias("b"))).alias("s"))
    spans = spans.select("doc_id", F.col("s.a").alias("at"), (F.col("s.b") - F.col("s.a") + window).cast("int").alias("n"), "odoc", (F.col("s.a") - F.col("shift")).alias("oat"))
    spans = materialize(in_fewer_files(spans), "spans")
    discard(kept)
    discard(paths)
    # The words at the source coordinates, read once for every distinct span there, confirm the spans.
    digests = _sources(docs, spans.select("odoc", "oat", "n").distinct(), window)
    confirmed = spans.join(digests, ["odoc", "oat", "n"]).select("doc_id", F.shiftright("at", 32).cast("int").alias("tag"), F.struct(F.col("at").bitwiseAND(F.lit(0xFFFFFFFF)).cast("int").alias("start"), "n", "digest").alias("s"))
    marked = confirmed.select("doc_id", "tag", "s", F.lit(False).alias("copy")).unionByName(copies.select("doc_id", "tag", F.lit(None).cast("struct<start:int,n:int,digest:bigint>").alias("s"), F.lit(True).alias("copy")))
    out = materialize(in_fewer_files(marked.groupBy("doc_id", "tag").agg(F.collect_set("s").alias("spans"), F.max("copy").alias("copy"))), "spans")
    discard(spans)
    return out


def _kept(data: bytes | None, keep: np.ndarray | None, layout: bool) -> str:
    """The words that stay: by single spaces, or with the white space before them (layout)."""
    data = data or b""
    if layout:
        if keep is None:
            return data.decode("utf-8", "replace")
        out, at = [], 0
        for word, stays in zip(data.split(), keep.tolist(), strict=True):
            end = data.index(word, at) + len(word)
            if stays:
                out.append(data[at:end])
            at = end
        return b"".join(out).strip().decode("utf-8", "replace")
    words = data.split()
    return b" ".join(words if keep is None else compress(words, keep.tolist())).decode("utf-8", "replace")


def _trim(window: int, layout: bool):
    @F.pandas_udf("n_words long, n_removed long, kept string")
    def run(texts: pd.Series, spans: pd.Series, copies: pd.Series) -> pd.DataFrame:
        out = []
        for data, own, copy in zip(texts, spans, copies, strict=True):
            words = data.split() if data else []
            keep = np.ones(len(words), bool)
            if copy and len(words) >= window:
                keep[:] = False
            elif own is not None:
                for s in own:  # the source's words confirm the span
                    if run_digest(words, s["start"], s["n"]) == s["digest"] and s["start"] + s["n"] <= len(words):
                        keep[s["start"] : s["start"] + s["n"]] = False
            removed = len(keep) - int(keep.sum())
            out.append((len(keep), removed, _kept(data, keep if removed else None, layout)))
        return pd.DataFrame(out, columns=["n_words", "n_removed", "kept"])

    return run.asNondeterministic()  # once a row, whatever reads the result


def deduplicate(df: DataFrame, window: int = 13, layout: bool = False, id_col: str = "doc_id", text_col: str = "text", result: str = "substrings") -> DataFrame:
    """df with one more column, named result: struct(n_words, n_removed, kept).

    Every word covered by a window whose words also start in a document of smaller id is removed; windows are judged on
    the input.  Null and empty texts have no words; texts of fewer words than the window keep all, and texts of any length
    are read whole.  A row without an id owns nothing and loses nothing.  Rows that share an id are one document: none
    removes the other's words.  An empty df gives no rows.  A column of df that has the result's name is replaced; other
    columns keep their values, whatever their names.
    """
    spans = repeated_spans(_coordinates(df, id_col, text_col), window).select(F.col("doc_id").alias("__id"), F.col("tag").alias("__tag"), F.col("spans").alias("__spans"), F.col("copy").alias("__copy"))
    text = df[f"`{text_col}`"].cast("string").cast("binary")
    same = (df[f"`{id_col}`"].cast("long") == spans["__id"]) & (F.shiftright(F.xxhash64(text), 34).cast("int") == spans["__tag"])
    joined = df.join(spans, same, "left")
    value: Column = _trim(window, layout)(text, spans["__spans"], F.coalesce(spans["__copy"], F.lit(False)))
    return joined.select(*[df[f"`{c}`"] for c in df.columns if c.lower() != result.lower()], value.alias(result))


def substring_dedup(df: DataFrame, window: int = 13, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, n_removed and kept (the words that stay, by single spaces) of every row (see deduplicate)."""
    need = df.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    return deduplicate(need, window).select("doc_id", "substrings.n_words", "substrings.n_removed", "substrings.kept")

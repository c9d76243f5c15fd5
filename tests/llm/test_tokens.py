"""Byte BPE, records and packing against the tokenizer libraries."""

import base64
import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from spindrift.llm import bytebpe, packing, records
from spindrift.llm.wordbpe import WordBpe
from tokenizers import Tokenizer

WORDS = public_tokenizers.path("word_bpe_49k.json")
BYTES = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


@pytest.fixture(scope="module")
def library():
    t = Tokenizer.from_file(WORDS)
    t.encode_special_tokens = True
    return lambda text: t.encode(text or "", add_special_tokens=False).ids


@pytest.fixture(scope="module")
def byte_model():
    return bytebpe.ByteBpe.from_file(BYTES, public_tokenizers.PATTERN)


@pytest.fixture(scope="module")
def reference():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(BYTES, "rb"))}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


TEXT = st.text(alphabet=st.one_of(st.characters(max_codepoint=0x250, exclude_categories=["Cs"]), st.sampled_from(list(" \n\t'sretdlmv.,!1²½İΣσςﬁ日😀́‍　"))), max_size=30)


@settings(max_examples=300, deadline=None)
@given(text=TEXT)
def test_word_bpe_is_the_library(library, text):
    assert np.frombuffer(WordBpe.load(WORDS).encode(text.encode()), "<u4").tolist() == library(text)


@settings(max_examples=300, deadline=None)
@given(text=TEXT)
def test_byte_bpe_is_the_library(byte_model, reference, text):
    ids = byte_model.encode(text)
    assert ids == reference.encode_ordinary(text) and byte_model.decode(ids) == text.encode()


def test_perfect_hash():
    keys = [random.Random(i).randbytes(1 + i % 9) + str(i).encode() for i in range(5000)]
    table = bytebpe.PerfectHash(keys)
    assert sorted(table.slots(keys).tolist()) == list(range(5000))
    assert table.slots([b"no key"])[0] < 5000


def test_merge_of_long_words(byte_model, reference):
    for word in ("a" * 500, "abcab" * 200, "ññ" * 300):
        assert list(byte_model.merge(word.encode())) == reference.encode_ordinary(word)


def test_memo_limit_changes_nothing(reference):
    small = bytebpe.ByteBpe.from_file(BYTES, public_tokenizers.PATTERN, memo_limit=3)
    for text in ("one two three four five", "six one two", "five " * 10):
        assert small.encode(text) == reference.encode_ordinary(text)


@pytest.mark.parametrize("source", ["documents", "odd"])
def test_round_trip(request, byte_model, reference, source):
    df = request.getfixturevalue(source)
    found = sorted(map(tuple, bytebpe.round_trip(df, byte_model).collect()), key=repr)
    want = []
    for r in df.collect():
        ids = reference.encode_ordinary(r["text"] or "")
        want.append((r["doc_id"], len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((r["text"] or "").encode()).hexdigest()))
    assert found == sorted(want, key=repr)


def checked_packing(rows):
    """The number of sequences, each gapless from 0 and at most full."""
    bins = {}
    for r in rows:
        bins.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in bins.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 4096
    return len(bins)


@pytest.mark.parametrize("source", ["documents", "odd"])
def test_packing(request, library, source):
    df = request.getfixturevalue(source)
    rows = packing.pack(df, WORDS).collect()
    want = []
    for r in df.collect():
        ids = np.array([*library(r["text"]), 1], "<u4")
        want += [(r["doc_id"], k, k * 4096, len(c := ids[k * 4096 : (k + 1) * 4096]), zlib.crc32(c.tobytes())) for k in range(-(-len(ids) // 4096))]
    assert sorted((tuple(r)[:5] for r in rows), key=repr) == sorted(want, key=repr)
    assert checked_packing(rows) == len(greedy([r["length"] for r in rows], 4096))


def greedy(lengths, capacity):
    """Best-fit decreasing, one piece at a time."""
    rooms = []
    for n in sorted(lengths, reverse=True):
        fits = [k for k, room in enumerate(rooms) if room >= n]
        if fits:
            rooms[min(fits, key=lambda k: rooms[k])] -= n
        else:
            rooms.append(capacity - n)
    return sorted(rooms)


@settings(max_examples=200, deadline=None)
@given(st.dictionaries(st.integers(1, 24), st.integers(1, 40), max_size=10), st.sampled_from([24, 31, 50]))
def test_runs_are_best_fit_decreasing(histogram, capacity):
    fill = {}
    for length, _, pieces, first, each, offset in packing.best_fit_runs(histogram, capacity).tolist():
        for k in range(pieces):
            fill.setdefault(first + k // each, []).append((offset + k % each * length, length))
    for parts in fill.values():
        assert [o for o, _ in sorted(parts)] == np.cumsum([0, *(n for _, n in sorted(parts))])[:-1].tolist()
    assert sorted(capacity - sum(n for _, n in parts) for parts in fill.values()) == greedy([n for n, c in histogram.items() for _ in range(c)], capacity)


def test_capacity_tree():
    tree = packing.CapacityTree(100)
    tree.add(40, 2)
    tree.add(7, 1)
    assert (tree.tightest(1), tree.tightest(7), tree.tightest(8), tree.tightest(41)) == (7, 7, 40, None)


@pytest.mark.parametrize("source", ["documents", "odd"])
def test_records_read_back(request, spark, library, tmp_path, source):
    df = request.getfixturevalue(source)
    folder = f"file://{tmp_path}/{source}"
    manifest = records.write_records(df, folder, WORDS, 2)
    rows = records.read_records(spark, folder, manifest).orderBy("start").collect()
    start, order = 0, [r["doc_id"] for r in rows]
    assert order == sorted(order, key=lambda x: (x is not None, x))
    by_text = {}
    for r in df.collect():
        by_text.setdefault(r["doc_id"], []).append([*library(r["text"]), 2])
    for r in rows:
        mine = [ids for ids in by_text[r["doc_id"]] if (len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())) == (r["n_tokens"], r["ids_crc32"])]
        assert mine and r["start"] == start
        start += r["n_tokens"]
    assert len(rows) == df.count()
    epoch = list(records.shuffled(folder, manifest, 5))
    assert sorted((i, x.tolist()) for i, x in epoch if i is not None) == sorted((i, ids) for i, lists in by_text.items() if i is not None for ids in lists)
    assert [i for i, _ in epoch] == [i for i, _ in records.shuffled(folder, manifest, 5)]


def test_shards_roll_over_by_bytes(odd, spark, tmp_path):
    """Small shards read back as one large shard does, and only a text's last bytes may exceed the limit."""
    whole = records.encode_to_records(odd, WORDS, folder=f"file://{tmp_path}/one").orderBy("start").collect()
    folder = f"file://{tmp_path}/many"
    manifest = records.write_records(odd, folder, WORDS, 2, shard_bytes=64)
    assert records.read_records(spark, folder, manifest).orderBy("start").collect() == whole
    assert len(manifest) > len({m["part"] for m in manifest}) and len({m["shard"] for m in manifest}) == len(manifest)
    assert sum(m["records"] for m in manifest) == len(whole) and sum(m["ids"] for m in manifest) == sum(r["n_tokens"] for r in whole)
    last = {m["part"]: m["roll"] for m in manifest}
    for m in manifest:
        offsets = records.ShardReader(folder, m["shard"]).index[:, 0].tolist()
        size = (tmp_path / "many" / f"{m['shard']}.rec").stat().st_size
        assert offsets[-1] < 64 and (size >= 64 or m["roll"] == last[m["part"]])


@given(st.binary(max_size=40), st.integers(0, 60))
def test_damage_is_noticed(payload, at):
    data = bytearray(records.frame(payload))
    assert records.unframe(bytes(data)) == (payload, len(data))
    data[at % len(data)] ^= 1
    with pytest.raises(ValueError):
        records.unframe(bytes(data))


def test_serialized_forms():
    for doc_id, ids in [(5, [1, 2]), (None, []), (-3, [70_000, 1])]:
        back = records.deserialize(records.serialize(doc_id, np.array(ids, np.int64)))
        assert (back[0], back[1].tolist()) == (doc_id, ids)


def test_empty_tables(docs_of, spark, byte_model, tmp_path):
    empty = docs_of([])
    assert bytebpe.round_trip(empty, byte_model).count() == 0
    assert packing.pack(empty, WORDS).count() == 0
    assert records.encode_to_records(empty, WORDS, folder=f"file://{tmp_path}/e").count() == 0


def test_clashing_columns(spark, byte_model, library):
    df = spark.createDataFrame([(1, "a b", 5, "x", 7)], "doc_id long, text string, length long, data string, part int")
    assert packing.pack(df, WORDS).first()["length"] == len(library("a b")) + 1
    assert bytebpe.round_trip(df, byte_model).count() == 1


def test_records_and_long_pre_tokens_with_clashing_columns(spark, byte_model, tmp_path):
    df = spark.createDataFrame([(2, "a b"), (1, "x" * 5000)], "doc_id long, text string").selectExpr("*", "'s' AS shard", "1 AS start", "2 AS ids", "3 AS data")
    found = records.encode_to_records(df, WORDS, folder=f"file://{tmp_path}/r").orderBy("start").collect()
    assert [r["doc_id"] for r in found] == [1, 2] and found[1]["start"] == found[0]["n_tokens"]
    before = len(byte_model.memo)
    assert byte_model.decode(byte_model.encode("y" * 5000)) == b"y" * 5000
    assert all(len(w) <= bytebpe.MEMO_CHARS for w in byte_model.memo) and len(byte_model.memo) >= before

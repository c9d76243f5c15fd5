"""Set similarity join against all pairs, manifests against hashing one by one, alignment against byte offsets."""

import hashlib
import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from spindrift.llm import alignment, merkle, pathjoin
from spindrift.llm.wordbpe import _byte_alphabet
from tokenizers import Tokenizer

A_PATH, B_PATH = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")

# -- set similarity join ----------------------------------------------------------------------------------------------------


def words_of(text):
    return (text or "").encode().lower().split()


def shingles(text, k=3):
    w = words_of(text)
    return {tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()


def expected_classes(rows, percent=85, k=3):
    """Per row: (doc_id, set size, smallest id of its class), by comparing all pairs."""
    sets = [shingles(t, k) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                root[find(i)] = find(j)
    low = {}
    for i, (doc_id, _) in enumerate(rows):
        if doc_id is not None:
            low[find(i)] = min(low.get(find(i), doc_id), doc_id)
    return sorted(((d, len(s), low.get(find(i)) if s else d) for i, ((d, _), s) in enumerate(zip(rows, sets, strict=True))), key=repr)


def found_classes(df, **options):
    got = pathjoin.similar_documents(df, **options).collect()
    assert all(r["kept"] == (r["doc_id"] is not None and r["doc_id"] == r["component_id"]) for r in got)
    return sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got), key=repr)


def text_of(rng, n):
    return [f"w{rng.randrange(3000)}" for _ in range(n)]


def hard_rows():
    """A star of copies near its hub only, a drifting series, tight groups, copies, a shared passage, and pairs about the threshold."""
    rng, texts = random.Random(5), []
    edit = lambda w, places: [f"e{rng.randrange(10**6)}" if i in places else x for i, x in enumerate(w)]
    hub = text_of(rng, 203)
    texts += [hub] + [edit(hub, {3 * i + 1, 3 * i + 101}) for i in range(30)]
    step = text_of(rng, 150)
    for _ in range(25):
        texts.append(step)
        step = edit(step, {rng.randrange(150), rng.randrange(150)})
    for _ in range(10):
        base = text_of(rng, rng.choice([4, 8, 20, 60]))
        texts += [base, base, edit(base, {0})]
    passage = text_of(rng, 60)
    texts += [text_of(rng, 40) + passage + text_of(rng, 40) for _ in range(40)]
    for n in range(1, 16):
        base = text_of(rng, 120)
        texts += [base, edit(base, {5 * i for i in range(n)})]
    rng.shuffle(texts)
    return [(i + 1, " ".join(w)) for i, w in enumerate(texts)]


@pytest.mark.parametrize("options", [{}, {"node_limit": 8, "depth": 2, "whole": 300}])
def test_classes_are_those_of_all_pairs(docs_of, options):
    rows = hard_rows()
    assert found_classes(docs_of(rows), **options) == expected_classes(rows)


def test_classes_of_documents(documents):
    rows = [(r["doc_id"], r["text"]) for r in documents.collect()]
    assert found_classes(documents) == expected_classes(rows)


def test_classes_of_odd_rows(odd):
    from .conftest import ODD

    assert found_classes(odd) == expected_classes(ODD)
    extra = odd.withColumns({"fp": F.lit(1), "node": F.lit("x"), "a": F.lit(2), "component_id": F.lit(3), "n": F.lit(None).cast("int")})
    assert found_classes(extra) == expected_classes(ODD)
    assert found_classes(odd.limit(0)) == []


def test_other_thresholds_and_names(docs_of):
    rows = hard_rows()[:120]
    df = docs_of(rows).withColumnsRenamed({"doc_id": "my id", "text": "my.text"})
    assert found_classes(df, percent=60, words=2, id_col="my id", text_col="my.text") == expected_classes(rows, 60, 2)


def test_a_node_that_stays_large_meets_by_pivots(docs_of):
    """Copies near their hub only, in chunks of which one holds the hub: no level splits them, the pivots link them."""
    rng = random.Random(1)
    hub = [f"h{i}" for i in range(400)]
    rows = [(0, " ".join(hub))] + [(i, " ".join(f"x{i}_{j}" if j in {p := rng.randrange(400), (p + 133) % 400, (p + 266) % 400, (p + 50) % 400, (p + 200) % 400} else w for j, w in enumerate(hub))) for i in range(1, 150)]
    assert found_classes(docs_of(rows), node_limit=10, depth=1, whole=1000) == expected_classes(rows)


def test_trees_bring_pairs_together():
    assert pathjoin.survival(1.0) == 1 and pathjoin.survival(0.85, 1) == pytest.approx(1 - 0.15**2)
    missed = (1 - pathjoin.survival(0.85)) ** pathjoin.trees_for(0.85, 0.999)
    assert missed <= 0.001


@settings(max_examples=60, deadline=None)
@given(st.lists(st.sets(st.integers(0, 12), min_size=1, max_size=10), min_size=1, max_size=12), st.integers(50, 100))
def test_classes_of_sets(sets, percent):
    arrays = [np.array(sorted(s), np.uint64) for s in sets]
    root = pathjoin.classes_of(arrays, percent)
    same = list(range(len(sets)))
    for _ in sets:
        for i, a in enumerate(sets):
            for j, b in enumerate(sets):
                if 100 * len(a & b) >= percent * len(a | b):
                    same[i] = min(same[i], same[j])
    assert root.tolist() == same


# -- manifest ---------------------------------------------------------------------------------------------------------------


def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def expected_manifest(rows):
    """rows (doc_id, text, lang, source, n_chars): tuples of merkle.COLUMNS, by folding every leaf alone."""
    field = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    leaf = lambda r, text: sha(field(r[0]), field(r[3]), field(r[2]), field(r[4]), field(text))

    def tree(leaves):
        levels = [leaves]
        while len(levels[-1]) > 1:
            levels.append([sha(*levels[-1][i : i + 16]) for i in range(0, len(levels[-1]), 16)])
        return levels

    def path(levels, k):
        out = []
        for level in levels[:-1]:
            lo = k // 16 * 16
            out.append(("".join(level[lo:k]), "".join(level[k + 1 : lo + 16])))
            k //= 16
        return out

    hosts = sorted({r[3] for r in rows}, key=lambda s: (s is not None, (s or "").encode()))
    of = {h: sorted((r for r in rows if r[3] == h), key=lambda r: (r[0] is not None, r[0] or 0, leaf(r, r[1]))) for h in hosts}
    trees = {h: tree([leaf(r, r[1]) for r in of[h]]) for h in hosts}
    top = tree([trees[h][-1][0] for h in hosts])
    out = []
    for k, h in enumerate(hosts):
        for i, r in enumerate(of[h]):
            steps = path(trees[h], i) + path(top, k)
            hit = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0 and r[1] is not None
            shown = leaf(r, "".join(c.lower() if "A" <= c <= "Z" else c for c in r[1]) if hit else r[1])
            for left, right in steps:
                shown = sha(left, shown, right)
            out.append((r[0], leaf(r, r[1]), trees[h][-1][0], top[-1][0], sha(*(a + b for a, b in steps)), shown, shown == top[-1][0]))
    return sorted(out, key=repr)


def found_manifest(df):
    return sorted(map(tuple, merkle.manifest(df, merkle.tampered_text(F.col("doc_id"), F.col("text"))).collect()), key=repr)


def manifest_rows(sizes):
    return [(1000 * h + 7 * i % 997, f"Text {h} {i}" if i % 9 else None, None if i % 4 == 0 else "de", f"host{h:03d}" if h else None, i if i % 3 else None) for h, n in enumerate(sizes) for i in range(n)]


@pytest.mark.parametrize("sizes", [[0, 1], [17], [1, 2, 300, 256, 15, 16], [1] * 300])
def test_manifest(spark, sizes):
    rows = manifest_rows(sizes)
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    assert found_manifest(df) == expected_manifest(rows)


def test_manifest_of_a_deep_tree(spark):
    """More than 16 ** 4 leaves would take long; blocks of 16 leaves make as many rounds of 16 ** 3."""
    rows = manifest_rows([5, 4200])
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(7)
    old, merkle.LEVELS = merkle.LEVELS, 1
    try:
        assert found_manifest(df) == expected_manifest(rows)
    finally:
        merkle.LEVELS = old


def test_manifest_of_odd_rows(odd):
    rows = [tuple(r) for r in odd.collect()]
    assert found_manifest(odd) == expected_manifest(rows)
    extra = odd.withColumns({"leaf": F.lit(1), "group": F.lit("x"), "pos": F.lit(0), "root": F.lit("r"), "shown": F.lit(None).cast("string")})
    assert found_manifest(extra) == expected_manifest(rows)
    assert found_manifest(odd.limit(0)) == []


def test_only_changed_rows_fail(documents):
    got = merkle.manifest(documents, F.when(F.col("doc_id") == 3, "other").otherwise(F.col("text"))).where("not verified").collect()
    assert [r["doc_id"] for r in got] == [3]


# -- alignment --------------------------------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def libraries():
    one = Tokenizer.from_file(A_PATH)
    one.encode_special_tokens = True
    return one, sentencepiece.SentencePieceProcessor(model_file=B_PATH)


def expected_alignment(rows, libraries):
    one, two = libraries
    byte_of = {c: b for b, c in _byte_alphabet().items()}
    found = []
    for doc_id, text in rows:
        a_ids = one.encode(" " + text, add_special_tokens=False).ids if text else []
        b_ids = two.encode(text) if text else []
        spell_b = lambda i: bytes([int(two.id_to_piece(i)[3:5], 16)]) if two.is_byte(i) else two.id_to_piece(i).replace("▁", " ").encode()
        a, b = [bytes(byte_of[c] for c in one.id_to_token(i)) for i in a_ids], [spell_b(i) for i in b_ids]
        if not text or b"".join(a) != (want := (" " + text).encode()) or b"".join(b) != want:
            found.append((doc_id, 0, 0, [], set(), None))
            continue
        a_ends, b_ends = np.cumsum([len(x) for x in a]).tolist(), np.cumsum([len(x) for x in b]).tolist()
        links, j = [], 0
        for i, end in enumerate(a_ends):
            while True:
                links.append((a_ids[i], b_ids[j]))
                if b_ends[j] >= end:
                    j += b_ends[j] == end
                    break
                j += 1
        groups, i, j = [], 0, 0
        for cut in sorted(set(a_ends) & set(b_ends)):
            p, q = a_ends.index(cut) + 1, b_ends.index(cut) + 1
            groups.append(",".join(map(str, a_ids[i:p])) + "|" + ",".join(map(str, b_ids[j:q])))
            i, j = p, q
        found.append((doc_id, len(a_ids), len(b_ids), groups, set(links), links))
    counts = Counter(x for *_, held, _ in found for x in held)
    best = Counter()
    for (a, _), n in counts.items():
        best[a] = max(best[a], n)
    return sorted(
        (
            (d, n_a, n_b, len(g), len(links or []), sum(counts[x] == best[x[0]] for x in links or []), sum(counts[x] for x in links or []), hashlib.sha256(";".join(g).encode()).hexdigest() if links else "")
            for d, n_a, n_b, g, _, links in found
        ),
        key=repr,
    )


def found_alignment(df):
    return sorted(map(tuple, alignment.align_tokens(df, A_PATH, B_PATH).select(*alignment.COLUMNS).collect()), key=repr)


def test_alignment_of_documents(documents, libraries):
    assert found_alignment(documents) == expected_alignment([(r["doc_id"], r["text"]) for r in documents.collect()], libraries)


def test_alignment_of_odd_rows(odd, docs_of, libraries):
    from .conftest import ODD

    assert found_alignment(odd) == expected_alignment(ODD, libraries)
    more = [(1, "▁ piece sign"), (2, "<s> </s> <unk> <0x41> <|endoftext|>"), (3, "  two  spaces \n\n\t"), (4, "naïve Ωmega 日本語 🙂‍🙂 ﬁ ½"), (5, " "), (6, "  x"), (7, "a" * 3000), (8, "\x00\x01")]
    assert found_alignment(docs_of(more)) == expected_alignment(more, libraries)
    extra = odd.withColumns({"chunk": F.lit(1), "pairs": F.lit("x"), "n": F.lit(None).cast("int"), "n_links": F.lit(5)})
    assert found_alignment(extra) == expected_alignment(ODD, libraries)
    assert found_alignment(odd.limit(0)) == []


TEXT = st.text(alphabet=st.one_of(st.characters(max_codepoint=0x2FF, exclude_categories=["Cs"]), st.sampled_from(list(" \n\t'sretdlmv.,!1²½İΣςﬁ日😀‍　▁"))), max_size=40)


@settings(max_examples=300, deadline=None)
@given(text=TEXT)
def test_encoders_are_the_libraries(libraries, text):
    one, two, _ = alignment._models(A_PATH, B_PATH)
    assert one.encode(" " + text).tolist() == libraries[0].encode(" " + text, add_special_tokens=False).ids
    assert two.by_parts and two.encode(text).tolist() == libraries[1].encode(text)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(1, 4), min_size=1, max_size=12), st.randoms())
def test_overlaps(a, rng):
    ends = sorted(rng.sample(range(1, sum(a) + 1), rng.randint(1, sum(a))) + [sum(a)])
    b = np.diff([0, *sorted(set(ends))]).tolist()
    x, y, cut = alignment.overlaps(np.array(a), np.array(b))
    spans = lambda lengths: [(sum(lengths[:k]), sum(lengths[: k + 1])) for k in range(len(lengths))]
    want = [(i, j) for i, (p, q) in enumerate(spans(a)) for j, (r, s) in enumerate(spans(b)) if p < s and r < q]
    assert list(zip(x.tolist(), y.tolist(), strict=True)) == want
    assert int(cut.sum()) == len({q for _, q in spans(a)} & {q for _, q in spans(b)})


def test_chunks_change_nothing(documents, libraries):
    old, alignment.CHUNK_ROWS = alignment.CHUNK_ROWS, 1
    try:
        found, counts = alignment.alignments(documents.repartition(3), A_PATH, B_PATH)
        assert counts.where("n > 200").count() == 0 and counts.groupBy("a_id").agg(F.max("best").alias("b")).where("not b").count() == 0
    finally:
        alignment.CHUNK_ROWS = old

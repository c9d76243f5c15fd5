"""Language ID, quality rules, SimHash, substring dedup and the pipeline against brute force."""

import hashlib
import re

import duckdb
import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from spindrift.llm import langid, queries, quality, simhash, substrings

from .conftest import DATA, ODD

SPACE = re.compile(r"[^\x20\x09-\x0D]+")


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


# -- language ID


@pytest.fixture(scope="module")
def tagger(documents):
    return langid.train(documents.where("crc32(cast(doc_id as string)) % 4 <> 2"), steps=250)


def test_held_out_accuracy(documents, tagger):
    found = documents.where("crc32(cast(doc_id as string)) % 4 = 2").select("lang", langid.predict(F.col("text"), tagger).alias("p")).collect()
    assert np.mean([r["lang"] == r["p"]["lang"] for r in found]) >= 0.95
    assert all(0 <= r["p"]["score"] <= 1 for r in found)


def test_gradients():
    model = langid.ByteTagger(["a", "b"], hidden=3, span=5)
    x, lengths, y = np.array([[1, 2, 3, 4, 5], [5, 4, 3, 0, 0]], np.uint8), np.array([5, 3]), np.array([0, 1])
    model.p = {k: v.astype(np.float64) for k, v in model.p.items()}
    _, grads = model._grads(x, lengths, y)
    for name, at in [("Ef", (2, 4)), ("Ub", (1, 7)), ("cf", (1,)), ("Vb", (2, 1)), ("o", (0,)), ("Eb", (5, 1)), ("Uf", (0, 2))]:
        value = model.p[name][at]
        model.p[name][at] = value + 1e-3
        up = model._grads(x, lengths, y)[0]
        model.p[name][at] = value - 1e-3
        down = model._grads(x, lengths, y)[0]
        model.p[name][at] = value
        assert abs((up - down) / 2e-3 - grads[name][at]) < 2e-3 * max(1, abs(grads[name][at]))


def test_every_position_counts(tagger):
    text = "the of and that with thing\n".encode() * 40
    labels = tagger.position_labels(text)
    assert len(labels) == len(text)
    together, alone = tagger.probabilities([text, b"", b"x", text * 3]), tagger.probabilities([text * 3])
    assert np.allclose(together[3], alone[0], atol=1e-5) and together[1].sum() == 0


def test_language_of_odd_rows(odd, tagger):
    found = odd.select("doc_id", langid.predict(F.col("text"), tagger).alias("p")).collect()
    assert len(found) == len(ODD)
    for r in found:
        if r["doc_id"] in (1, 2, 3, 8):
            assert r["p"]["lang"] == "und" and r["p"]["score"] == 0
        else:
            assert r["p"]["lang"] in tagger.langs


def test_nothing_to_learn_from(docs_of):
    assert [r["lang_pred"] for r in langid.identify(docs_of([(1, "some text"), (2, None)])).collect()] == ["und", "und"]
    assert langid.identify(docs_of([])).count() == 0


# -- quality rules


def test_quality_is_its_sql(spark, documents):
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{DATA}/documents.parquet'")
    mine = quality.quality_rules(documents)
    theirs = con.execute(quality.ORACLE).fetchall()
    assert rows_of(mine) == sorted(theirs, key=repr)


def brute_repeats(words):
    grams, cover = {}, set()
    for k in range(len(words) - 7):
        grams.setdefault(tuple(words[k : k + 8]), []).append(k)
    for starts in grams.values():
        if len(starts) > 1:
            cover.update(k + j for k in starts for j in range(8))
    return len(cover)


@settings(max_examples=15, deadline=None)
@given(st.lists(st.lists(st.sampled_from("ab"), max_size=40), min_size=1, max_size=20))
def test_repeated_words(spark, lists):
    df = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(lists)], "i int, t string")
    found = {r["i"]: r["m"]["w"]["r"] for r in df.select("i", quality.base_measures(F.col("t")).alias("m")).collect()}
    assert found == {i: brute_repeats(w) for i, w in enumerate(lists)}


def test_frequent_lines_of_a_host(spark):
    own = lambda i: " ".join(f"w{i}x{k}" for k in range(30))
    rows = [(i, f"Read page {i + 10} now\n{own(i)}", "h") for i in range(30)]
    rows += [(100, "read PAGE 77  now\n" * 9 + own(100)[:40], "h"), (101, own(101), None), (102, own(102) + "\nread page 11 now", None)]
    rows += [(200 + i, own(777) + "\n" + own(778), "h") for i in range(60)]  # one text sixty times counts once
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    found = {r["doc_id"]: r for r in quality.quality_rules(df).collect()}
    assert found[3]["n_kept_words"] == 30 and found[3]["kept"]
    assert not found[100]["kept"] and found[101]["kept"] and found[102]["n_kept_words"] == 34
    assert found[210]["kept"] and found[210]["n_kept_words"] == 60


def test_near_copies_in_a_third_of_a_host_keep_one(spark, documents):
    import corpus_pipeline

    letters = str.maketrans("0123456789", "abcdefghij")
    own = lambda i, n=12: " ".join(f"w{i}x{k}" for k in range(n)).translate(letters)
    shared = [" ".join(f"s{chr(97 + j)}{chr(97 + k)}" for k in range(12)) for j in range(9)]
    rows = [(i, "\n".join([own(i), *shared]), "h") for i in range(5000, 5300)]
    rows += [(i, own(i, 60), "h") for i in range(600)]
    rows += [(7000 + i, f"menu home news sport\n{own(i + 7000, 40)}", "m") for i in range(60)]  # template lines of kept documents
    rows += [(8000 + i, "menu home news sport\n" + "menu about the site and its makers today with all of their many names and deeds\n" + own(i, 1), "m") for i in range(40)]
    rows += [(None, "\n".join([own(i), *shared]), None) for i in range(30)]
    docs = spark.createDataFrame([(i, t, None, h, len(t)) for i, t, h in rows], documents.schema)
    verdict = quality.quality_rules(docs.where("source = 'h'")).where("doc_id >= 5000").collect()
    assert len(verdict) == 300 and not any(r["kept"] for r in verdict)
    found = corpus_pipeline.quality_stage(spark, docs, DATA).collect()
    assert sorted(r["doc_id"] for r in found if r["source"] == "h") == [*range(600), 5000]
    assert sorted(r["doc_id"] for r in found if r["source"] == "m") == [*range(7000, 7060), 8000]
    assert [r["doc_id"] for r in found if r["source"] is None] == [None]


def test_quality_of_odd_rows(odd, docs_of):
    found = quality.quality_rules(odd).collect()
    assert len(found) == len(ODD) and all(r["base_failed"] for r in found)
    assert next(r for r in found if r["doc_id"] == 7)["n_repeat_words"] == 60_000
    assert quality.quality_rules(docs_of([])).count() == 0
    clash = odd.withColumn("n_words", F.lit("x")).withColumn("host", F.lit(1)).withColumn("lines", F.lit(2))
    assert quality.quality_rules(clash).count() == len(ODD) and quality.judge(clash).columns == [*clash.columns, "quality"]


# -- SimHash


def brute_fingerprint(text):
    words = SPACE.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(prints):
    """(id, fingerprint) pairs to the smallest id that is reachable by links of 3 bits or fewer."""
    root = list(range(len(prints)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, (_, a) in enumerate(prints):
        for j in range(i):
            if (a ^ prints[j][1]).bit_count() <= 3:
                root[max(find(i), find(j))] = min(find(i), find(j))
    groups = {}
    for i, (doc_id, _) in enumerate(prints):
        groups.setdefault(find(i), []).append(doc_id)
    low = {k: min((x for x in v if x is not None), default=None) for k, v in groups.items()}
    return [low[find(i)] for i in range(len(prints))]


@pytest.mark.parametrize("source", ["documents", "odd"])
def test_simhash(request, source):
    df = request.getfixturevalue(source)
    listed = [(r["doc_id"], brute_fingerprint(r["text"])) for r in df.collect()]
    want = [(i, f"{fp:016x}", c) for (i, fp), c in zip(listed, brute_components(listed), strict=True)]
    assert rows_of(simhash.near_duplicates(df)) == sorted(want, key=repr)


@pytest.mark.parametrize("limit", [8192, 5])
def test_links_keep_components(spark, limit):
    """Limit 5 sends most groups to the second level."""
    rng = np.random.default_rng(4)
    prints = rng.integers(0, 1 << 63, 60, dtype=np.uint64).tolist()
    for center in prints[:6]:  # chains and clouds of flipped bits
        for _ in range(25):
            center ^= sum(1 << int(b) for b in rng.choice(64, rng.integers(1, 5), replace=False))
            prints.append(center)
    prints = sorted(set(prints))
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    links = simhash.links(spark.createDataFrame([(p,) for p in signed], "fp long"), group_limit=limit).collect()
    for a, b in links:
        assert a in signed and b in signed
    from spindrift.llm.common import components

    roots = {r["node"]: r["root"] for r in components(spark.createDataFrame([tuple(x) for x in links], "a long, b long")).collect()}
    mine = {p: roots.get(p, p) for p in signed}
    brute = dict(zip(signed, brute_components(list(zip(signed, prints, strict=True))), strict=True))
    same = lambda m: {frozenset(k for k in m if m[k] == v) for v in m.values()}
    assert same(mine) == same(brute)


@settings(max_examples=40, deadline=None)
@given(st.integers(0, 1 << 30), st.integers(2, 200), st.integers(1, 40))
def test_exact_links_of_large_groups(seed, n, spread):
    rng = np.random.default_rng(seed)
    bits = rng.choice(64, spread, replace=False)
    fps = np.unique(np.array([int(rng.integers(1 << 62)) & 0 | sum(1 << int(b) for b in bits[rng.random(spread) < 0.3]) for _ in range(n)], np.uint64))
    a, b = simhash.exact_links(fps, 3, most=4)
    assert all(x != y and (int(x) ^ int(y)).bit_count() <= 3 for x, y in zip(a, b, strict=True))
    found, by, _ = simhash.spanning_links(fps[:, None], 3)
    same = lambda links: brute_classes(fps.tolist(), links)
    assert same(zip(a.tolist(), b.tolist(), strict=True)) == same(zip(fps[found].tolist(), fps[by].tolist(), strict=True))


def brute_classes(nodes, links):
    root = {n: n for n in nodes}

    def find(n):
        while root[n] != n:
            n = root[n]
        return n

    for a, b in links:
        root[find(a)] = find(b)
    return {frozenset(n for n in nodes if find(n) == r) for r in {find(n) for n in nodes}}


def shingle_set(text, n=5):
    words = SPACE.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(words[i : i + n]) for i in range(len(words) - n + 1)} or {tuple(words)}


def jaccard(a, b):
    return len(a & b) / len(a | b)


def check_distinct(before, after, least=0.8, missed=0.0):
    """One document stays of each class of exact links, but for a share of missed ones; what went was like another."""
    sets = {r["doc_id"]: shingle_set(r["text"]) for r in before}
    holders = {}
    for i, s in sets.items():
        for x in s:
            holders.setdefault(x, []).append(i)
    like = [(i, j) for i, s in sets.items() for j in {j for x in s for j in holders[x]} if j < i and jaccard(s, sets[j]) >= least]
    classes, stay = brute_classes(list(sets), like), {r["doc_id"] for r in after}
    assert len(stay) == len(after) and stay <= set(sets)
    assert all(min(c) in stay for c in classes)
    assert sum(len(stay & c) - 1 for c in classes) <= missed * len(sets)


@pytest.mark.parametrize("chunk", [512, 3])
def test_similar_documents(spark, docs_of, monkeypatch, chunk):
    monkeypatch.setattr(simhash, "CHUNK", chunk)
    rng = np.random.default_rng(8)
    word = lambda: f"w{rng.integers(100_000)}"
    passage = [word() for _ in range(60)]
    rows, groups = [], 25
    for g in range(groups):  # copies with a few changed words, all with a passage that every document shares
        text = [word() for _ in range(120)]
        text[20:80] = passage
        for _ in range(6):
            copy = list(text)
            for at in rng.choice(120, rng.integers(1, 3), replace=False):
                copy[at] = word()
            rows.append((len(rows) + 1, " ".join(copy)))
    docs = docs_of(rows)
    after = simhash.distinct_documents(docs).collect()
    before = docs.collect()
    check_distinct(before, after, missed=0.02)


def test_distinct_documents_of_odd_rows(spark, odd, docs_of):
    found = sorted(((r["doc_id"], r["text"]) for r in simhash.distinct_documents(odd).collect()), key=repr)
    want = [(1, None), (4, "same text here"), (6, ODD[7][1]), (7, ODD[8][1]), (None, "no id at all")]
    assert found == sorted(want, key=repr)
    assert simhash.distinct_documents(docs_of([])).count() == 0
    long = lambda k: " ".join(f"{k}x{j}" for j in range(40))
    clash = docs_of([(1, long("a")), (1, long("b")), (2, long("a")), (None, long("b")), (3, long("c")), (3, long("c"))])
    for name in ("t", "fp", "first", "n", "__id", "root", "keys"):
        clash = clash.withColumn(name, F.lit(name))
    found = simhash.distinct_documents(clash)
    assert found.columns == clash.columns
    assert sorted((r["doc_id"], r["text"]) for r in found.collect()) == [(1, long("a")), (1, long("b")), (3, long("c"))]


# -- substrings


def brute_removed(docs, window=13):
    words = [(i, SPACE.findall(t or "")) for i, t in docs]
    owner = {}
    for i, w in words:
        if i is not None:
            for k in range(len(w) - window + 1):
                key = tuple(w[k : k + window])
                owner[key] = min(owner.get(key, i), i)
    out = []
    for i, w in words:
        gone = set()
        if i is not None:
            for k in range(len(w) - window + 1):
                if owner[tuple(w[k : k + window])] < i:
                    gone.update(range(k, k + window))
        out.append((i, len(w), len(gone), hashlib.sha256(" ".join(x for k, x in enumerate(w) if k not in gone).encode()).hexdigest()))
    return sorted(out, key=repr)


def digest(df):
    return rows_of(df.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256)))


@pytest.mark.parametrize("source", ["documents", "odd"])
def test_substrings(request, source):
    df = request.getfixturevalue(source)
    assert digest(substrings.substring_dedup(df)) == brute_removed([(r["doc_id"], r["text"]) for r in df.collect()])


def test_branching_and_repeats(docs_of):
    rng = np.random.default_rng(1)
    shared = [" ".join(f"s{k}w{j}" for j in range(40)) for k in range(4)]
    rows = [(i, " ".join([f"own{i}", shared[rng.integers(4)], f"mid{i} x y", shared[rng.integers(4)], shared[rng.integers(4)][:60], "ing " * int(rng.integers(30))])) for i in range(30)]
    rows += [(30, rows[3][1]), (31, rows[3][1]), (31, rows[3][1]), (32, shared[0] + "\n\n" + shared[1]), (32, "other text of one id " + shared[2])]
    assert digest(substrings.substring_dedup(docs_of(rows))) == brute_removed(rows)


def test_passage_in_every_document(docs_of):
    rng = np.random.default_rng(2)
    passage = " ".join(f"p{k}" for k in range(50))
    rows = [(int(i), f"own{i} a{i} {passage} b{i} " + " ".join(f"t{rng.integers(30)}" for _ in range(30))) for i in rng.permutation(150)]
    rows += [(200 + i, rows[0][1]) for i in range(40)] + [(300, passage), (5, "row of an id " + passage), (5, rows[1][1])]
    df = docs_of(rows)
    assert digest(substrings.substring_dedup(df)) == brute_removed(rows)
    # A minimizer that all documents share arrives once a slice, not once a document.
    minis = substrings._shared_minimizers(substrings._coordinates(df, "doc_id", "text"), 13)
    assert minis.count() >= 150


def test_sources_confirm_spans(docs_of):
    docs = substrings._coordinates(docs_of([(1, " ".join(f"w{k}" for k in range(40)))]), "doc_id", "text")
    tag = docs.first()["tag"]
    wanted = docs.sparkSession.createDataFrame([(1, (tag << 32) + 3, 15), (1, (tag << 32) + 4, 15), (2, 3, 15)], "odoc long, oat long, n int")
    found = {r["oat"] & 0xFFFFFFFF: r["digest"] for r in substrings._sources(docs, wanted, 13).collect()}
    words = [f"w{k}".encode() for k in range(40)]
    assert found == {k: substrings.run_digest(words, k, 15) for k in (3, 4)}


def test_layout_and_columns(docs_of):
    text = " ".join(f"a{k}" for k in range(20))
    df = docs_of([(1, text), (2, f"Mine,\n\n  own   words.\n{text}\nand the end"), (3, "  kept   as it is \n")]).withColumn("spans", F.lit("x"))
    found = {r["doc_id"]: r for r in substrings.deduplicate(df, layout=True).collect()}
    assert found[2]["substrings"]["kept"] == "Mine,\n\n  own   words.\nand the end" and found[2]["spans"] == "x"
    assert found[3]["substrings"]["kept"] == "  kept   as it is \n" and found[1]["substrings"]["n_removed"] == 0


def test_names_of_its_own_columns_may_clash(docs_of):
    text = " ".join(f"a{k}" for k in range(20))
    df = docs_of([(1, text), (2, f"{text} more"), (3, None)]).withColumns({c: F.lit(c) for c in ("__id", "__tag", "__spans", "__copy", "substrings", "spans")})
    found = substrings.deduplicate(df)
    assert found.columns == [*[c for c in df.columns if c != "substrings"], "substrings"]
    rows = {r["doc_id"]: r for r in found.collect()}
    assert {i: r["substrings"]["n_removed"] for i, r in rows.items()} == {1: 0, 2: 20, 3: 0}
    assert all(r[c] == c for r in rows.values() for c in ("__id", "__tag", "__spans", "__copy", "spans"))


def test_word_hashes():
    data = b"  alpha beta\talpha\n\nbeta\x0bgamma  " + b"x" * 10 + b" alpha"
    h, start = substrings.word_hashes(data)
    assert [data[s : s + 2] for s in start] == [b"al", b"be", b"al", b"be", b"ga", b"xx", b"al"]
    assert h[0] == h[2] == h[6] and h[1] == h[3] and len(set(h.tolist())) == 4
    assert len(substrings.word_hashes(b"")[0]) == 0


def test_queries_have_the_contract_columns(spark):
    want = {
        "op1_language_id": {"doc_id": "bigint", "held_out": "boolean", "lang_pred": "string", "score": "double"},
        "op2_quality_rules": dict.fromkeys(["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"], "bigint") | {"base_failed": "boolean", "kept": "boolean"},
        "op3_byte_bpe": {"doc_id": "bigint", "n_tokens": "bigint", "ids_sha256": "string", "decoded_sha256": "string"},
        "op5_best_fit_packing": {"piece": "int"} | dict.fromkeys(["doc_id", "start", "length", "ids_crc32", "sequence_id", "offset"], "bigint"),
        "op6_substring_dedup": {"doc_id": "bigint", "n_words": "bigint", "n_removed": "bigint", "kept_sha256": "string"},
        "op7_token_records": dict.fromkeys(["doc_id", "start", "n_tokens", "ids_crc32"], "bigint"),
        "op8_simhash": {"doc_id": "bigint", "fingerprint": "string", "component_id": "bigint"},
        "op9_main_text": {"page_id": "bigint", "url": "string", "text": "string", "n_chars": "bigint"},
        "op10_nearest": {"query_id": "bigint", "rank": "int", "vec_id": "bigint", "score": "double"},
    }
    for name, columns in want.items():
        assert columns.items() <= dict(queries.QUERIES[name](spark, DATA).dtypes).items(), name


def test_language_query(spark, documents):
    found = queries.op1_language_id(spark, DATA).collect()
    truth = {r["doc_id"]: (r["lang"], r["fold"] == 2) for r in documents.selectExpr("doc_id", "lang", "crc32(cast(doc_id as string)) % 4 as fold").collect()}
    assert len(found) == len(truth) and all(r["held_out"] == truth[r["doc_id"]][1] and 0 <= r["score"] <= 1 for r in found)
    judged = [r["lang_pred"] == truth[r["doc_id"]][0] for r in found if r["held_out"] and truth[r["doc_id"]][0]]
    assert np.mean(judged) >= 0.95


def test_clashing_and_repeated_rows(spark, docs_of):
    text = "the thing and the whole of that with words in it " * 4
    df = docs_of([(1, text), (1, text), (2, text), (3, None)]).withColumn("lang", F.lit("en"))
    for name in ("score", "held_out", "p", "lang_pred", "fp", "root", "node", "fingerprint", "component_id", "data"):
        df = df.withColumn(name, F.lit(name))
    found = rows_of(langid.identify(df).select("doc_id", "lang_pred"))
    assert found == sorted([(1, "en"), (1, "en"), (2, "en"), (3, "und")], key=repr)
    near = rows_of(simhash.near_duplicates(df).select("doc_id", "component_id"))
    assert near == [(1, 1), (1, 1), (2, 1), (3, 3)]


def test_pipeline(spark, documents, docs_of):
    import corpus_pipeline

    docs, kept = documents, {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before, docs = docs, stage(spark, docs, DATA)
        assert tuple(docs.columns) == ("doc_id", "text", "lang", "source", "n_chars")
        rows = docs.collect()
        kept[name] = (before.collect(), rows)
        docs = spark.createDataFrame(rows, documents.schema)
    verdict = {r["doc_id"]: r["kept"] for r in quality.quality_rules(documents).collect()}
    assert {r["doc_id"] for r in kept["quality rules"][1]} == {i for i, k in verdict.items() if k}
    check_distinct(*kept["simhash near-dedup"])
    before, after = kept["substring dedup"]
    want = {i: n - gone for i, n, gone, _ in brute_removed([(r["doc_id"], r["text"]) for r in before])}
    assert {r["doc_id"]: len(SPACE.findall(r["text"])) for r in after} == want
    assert all(r["n_chars"] == len(r["text"]) for r in after)
    whole = corpus_pipeline.run(spark, DATA)
    assert {r["doc_id"] for r in whole.select("doc_id").distinct().collect()} == {r["doc_id"] for r in after}


def test_pipeline_stages_on_odd_rows(spark, odd, docs_of, tagger):
    import corpus_pipeline

    found = {}
    for name, stage in corpus_pipeline.STAGES:
        found[name] = stage(spark, odd.withColumn("extra", F.lit(1)).withColumn("data", F.lit("x")), DATA).collect()
        assert stage(spark, docs_of([]), DATA).count() == 0
    assert found["quality rules"] == []  # null, short, or one word 60,000 times
    assert found["language id"] == []  # no row has a label to learn from
    ids = lambda name: sorted((r["doc_id"] for r in found[name]), key=repr)
    assert len(ids("substring dedup")) == len(ODD)
    texts = {(r["doc_id"], r["text"]) for r in found["substring dedup"]}
    assert texts == {(i, t) for i, t in ODD}  # nothing repeats a smaller id's window
    assert all(r["n_chars"] == len(r["text"] or "") for r in found["substring dedup"])
    assert set(ids("best-fit packing")) == {i for i, _ in ODD}
    pieces = [r for r in found["best-fit packing"] if r["doc_id"] == 7]
    assert len(pieces) > 1 and all(r["length"] == 4096 for r in pieces if r["piece"] < len(pieces) - 1)


@pytest.mark.parametrize("chunk", [512, 16])
def test_a_drifting_series_in_a_hot_part_is_one_class(docs_of, monkeypatch, chunk):
    """Versions of one document, each a small edit of the one before, around a passage that other texts hold too."""
    monkeypatch.setattr(simhash, "CHUNK", chunk)
    rng = np.random.default_rng(3)
    words = lambda n: [f"w{x}" for x in rng.integers(0, 5000, n)]
    passage, step, rows = words(200), words(150), []
    for i in range(300):
        rows.append((i, " ".join(step[:75] + passage + step[75:])))
        step = list(step)
        for at in rng.integers(0, 150, 2):
            step[at] = f"e{rng.integers(10**7)}"
    rows += [(1000 + i, " ".join(words(300) + passage)) for i in range(100)]
    assert sorted(r["doc_id"] for r in simhash.distinct_documents(docs_of(rows)).collect()) == [0, *range(1000, 1100)]


def test_a_net_is_near_to_all():
    rng = np.random.default_rng(1)
    bits = rng.integers(0, 1 << 62, (200, simhash.WIDE), dtype=np.uint64)
    bits[100:] = bits[:100]
    bits[100:, 0] ^= np.uint64(7)
    net = simhash.net_of(bits, np.arange(200) % 100)
    assert sorted(net.tolist()) == list(range(100))


def test_nodes_that_collide_change_no_result(documents):
    """With nodes of eight bits almost every node seems to branch: paths part, and what is removed stays the same."""
    key = lambda df: sorted((r["doc_id"], r["n_words"], r["n_removed"], r["kept"]) for r in df.collect())
    whole = key(substrings.substring_dedup(documents))
    old, substrings.NODE_MASK = substrings.NODE_MASK, np.uint64(0xFF)
    try:
        assert key(substrings.substring_dedup(documents)) == whole
    finally:
        substrings.NODE_MASK = old

"""Repeated bytes, SimHash, nearest neighbours, components, and the pipeline,
against brute force."""

import hashlib
import os
import random
from collections import defaultdict

import numpy as np
import pytest
import xxhash

from factflow.llm import ann, decontaminate, langid, pii, repeats, simhash
from factflow.llm.common import scratch, settle, shared_dir
from factflow.llm.components import connected_components
from factflow.llm.suffixes import suffix_array
from tests.llm.helpers import ODD, docs, folder


# -- suffixes and repeats ------------------------------------------------------
def test_suffix_array():
    random.seed(1)
    for _ in range(3000):
        s = [random.randint(0, random.randint(0, 4)) for _ in range(random.randint(0, 30))]
        assert suffix_array(s) == sorted(range(len(s)), key=lambda i: s[i:])
    assert suffix_array([7] * 5000) == list(range(4999, -1, -1))


def brute_repeats(texts, length):
    places = defaultdict(list)
    for k, t in enumerate(texts):
        for p in range(len(t) - length + 1):
            places[hashlib.blake2b(t[p : p + length], digest_size=16).digest()].append((k, p))
    gone = [bytearray(len(t)) for t in texts]
    for own in places.values():
        if len(own) > 1:
            for k, p in own:
                gone[k][p : p + length] = b"\1" * length
    return [(len(t), sum(g), bytes(b for b, x in zip(t, g, strict=True) if not x)) for t, g in zip(texts, gone, strict=True)]


@pytest.mark.parametrize("seed, group, letters", [(0, 256, "ab"), (1, 4, "abcdefgh é"), (2, 256, "abcdefgh é"), (3, 4, "ab")])
def test_repeats(spark, monkeypatch, seed, group, letters):
    monkeypatch.setattr(repeats, "GROUP", group)
    random.seed(seed)
    base = ["".join(random.choice(letters) for _ in range(random.randint(300, 900))) for _ in range(5)]
    texts = []
    for _ in range(70):
        t = ""
        for _ in range(random.randint(0, 4)):
            b = random.choice(base)
            s = random.randrange(len(b))
            t += b[s : random.randint(s, len(b))] + "".join(random.choice(letters) for _ in range(random.choice((0, 0, 5, 60))))
        texts.append(random.choice(texts) if texts and random.random() < 0.2 else "a" * random.randint(0, 900) if random.random() < 0.1 else t)
    rows = [*ODD, *((100 + k, t) for k, t in enumerate(texts))]
    want = defaultdict(list)
    for (i, _), r in zip(rows, brute_repeats([(t or "").encode() for _, t in rows], 400), strict=True):
        want[i].append(r)
    got = defaultdict(list)
    for r in repeats.remove_repeats(docs(spark, rows)).collect():
        x = r["repeats"]
        got[r["doc_id"]].append((x["n_bytes"], x["n_removed"], bytes(x["kept"])))
        assert r["hits"] == "z" and sum(e - s for s, e in x["spans"]) == x["n_removed"]
        assert all(a[1] < b[0] for a, b in zip(x["spans"], x["spans"][1:], strict=False))
    assert got == want


def brute_shares(texts, n):
    places = defaultdict(set)
    for k, t in enumerate(texts):
        w = t.lower().split()
        for p in range(len(w) - n + 1):
            places[b" ".join(w[p : p + n])].add(k)
    return [any(len(places[b" ".join(w[p : p + n])]) > 1 for p in range(len(w) - n + 1)) for w in (t.lower().split() for t in texts)]


@pytest.mark.parametrize("seed, group", [(0, 256), (1, 3), (2, 256), (3, 2)])
def test_shared_passages(spark, monkeypatch, seed, group):
    monkeypatch.setattr(repeats, "GROUP", group)
    random.seed(seed)
    words = [f"w{k}" for k in range(50 if seed % 2 else 3)]
    say = lambda n: [random.choice(words) for _ in range(n)]
    passages = [say(n) for n in (49, 50, 51, 52, 60, 120, 300)]
    texts = []
    for _ in range(80):
        w = say(random.choice((0, 20, 80)))
        for _ in range(random.choice((0, 1, 2))):
            w += random.choice(passages) * random.choice((1, 1, 2)) + say(random.choice((0, 30)))
        texts.append(random.choice((" ", "\n\t")).join(x.upper() if random.random() < 0.3 else x for x in w))
    texts += [texts[0], "é".join(["x"] * 60), "b " * 60, "b " * 50, " ".join(say(40)) * 2]
    rows = [*ODD, *((100 + k, t) for k, t in enumerate(texts))]
    want = brute_shares([(t or "").encode() for _, t in rows], 51)
    got = defaultdict(list)
    for r in repeats.remove_repeats(docs(spark, rows)).collect():
        got[r["doc_id"]].append(r["repeats"]["shares"])
    assert got == {i: [x for (j, _), x in zip(rows, want, strict=True) if j == i] for i, _ in rows}
    assert 0 < sum(want) < len(want)


def test_suffixes_decide_what_is_repeated(spark, monkeypatch):
    text = " ".join(f"word{k}" for k in range(200))
    df = docs(spark, [(1, text), (2, "x" + text[40:900]), (3, text)])
    removed = lambda: {r["doc_id"]: r["repeats"]["n_removed"] for r in repeats.remove_repeats(df, passage_words=None).collect()}
    assert min(removed().values()) > 0
    # with every suffix in an interval of its own and no weights, nothing is
    rng = np.random.default_rng(0)
    group, e = np.array([0, 0, 1]), 63
    sides = [bytes(rng.integers(0, 255, 63, dtype=np.uint8)) for _ in range(2)]
    starts = lambda: repeats.repeated_starts(group, [sides[0]] * 3, [sides[1]] * 3, np.zeros(3), np.full(3, e), np.ones(3), np.zeros(3), np.zeros(3), e)
    assert starts()[:2].all() and not starts()[2].any()
    monkeypatch.setattr(repeats, "_intervals", lambda g, left, right: np.arange(left[:, :, 0].size).reshape(left.shape[:2]))
    assert not starts().any()


def test_repeats_over_segments(monkeypatch, spark):
    monkeypatch.setattr(repeats, "_SEGMENT", 1000)
    random.seed(9)
    long = "".join(random.choice("abcdef") for _ in range(5000))
    texts = [long, "x" + long[1500:3300] + "y", long[900:1400]]
    df = docs(spark, list(enumerate(texts)))
    got = {r["doc_id"]: (r["repeats"]["n_bytes"], r["repeats"]["n_removed"], bytes(r["repeats"]["kept"])) for r in repeats.remove_repeats(df).collect()}
    assert [got[k] for k in range(3)] == brute_repeats([t.encode() for t in texts], 400)


def test_no_rows_to_repeat(spark):
    assert repeats.remove_repeats(docs(spark, ODD).limit(0)).count() == 0


# -- components ----------------------------------------------------------------
def roots_of(edges):
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {x: find(x) for x in parent}


@pytest.mark.parametrize("edges", [
    [], [(1, 1)], [(k, k + 1) for k in range(40)], [(0, k) for k in range(1, 200)], [(5, 3), (3, 5), (3, 9), (7, 8)],
    [(random.Random(1).randrange(60) + 0 * k, k) for k in range(60)],
])
def test_components(spark, edges):
    df = spark.createDataFrame([*edges, (None, 3)], "u long, v long")
    got = {r["node"]: r["root"] for r in connected_components(df).collect()}
    assert got == roots_of([e for e in edges if e[0] != e[1]])


# -- SimHash -------------------------------------------------------------------
def brute_fingerprint(text):
    words = (text or "").encode().lower().split()
    own = [b" ".join(words[k : k + 3]) for k in range(max(1, len(words) - 2))] if words else []
    h = [xxhash.xxh64_intdigest(s, 42) for s in own]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_fingerprints():
    random.seed(1)
    for n in (0, 1, 2, 3, 4, 300, 1000):
        t = " \t".join(random.choice(["A", "bé", "c", "dd"]) for _ in range(n))
        assert simhash.fingerprint(t.encode()) == brute_fingerprint(t)


def test_native_hash_agrees(spark):
    from pyspark.sql import functions as F

    row = spark.createDataFrame([("bé c dd",)], "s string").select(F.xxhash64("s").alias("h")).first()
    assert row["h"] & (1 << 64) - 1 == xxhash.xxh64_intdigest("bé c dd".encode(), 42)


def near_components(rows):
    fp = [brute_fingerprint(t) for _, t in rows]
    edges = [(a, b) for a in range(len(rows)) for b in range(a) if (fp[a] ^ fp[b]).bit_count() <= 3]
    roots = roots_of([*edges, *((k, k) for k in range(len(rows)))])
    least = {}
    for k, (i, _) in enumerate(rows):
        if i is not None:
            least[roots[k]] = min(i, least.get(roots[k], i))
    return [(i, fp[k], least.get(roots[k])) for k, (i, _) in enumerate(rows)], roots


def corpus(n=120, seed=3):
    random.seed(seed)
    vocabulary = [f"w{k}" for k in range(300)]
    texts = [" ".join(random.choice(vocabulary) for _ in range(200)) for _ in range(n // 3)]
    out = []
    for k in range(n):
        words = random.choice(texts).split()
        for _ in range(random.choice((0, 0, 1, 2, 8))):
            words[random.randrange(len(words))] = random.choice(vocabulary)
        out.append((50 + k, " ".join(words)))
    return out


@pytest.mark.parametrize("chunk", [1024, 3])
def test_near_duplicates(spark, monkeypatch, chunk):
    rows = [*ODD, *corpus()]
    links = simhash.hamming_links
    monkeypatch.setattr(simhash, "hamming_links", lambda f, b: links(f, b, chunk))
    want, roots = near_components(rows)
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    got = simhash.near_duplicate_components(docs(spark, rows)).collect()
    key = lambda r: tuple((x is None, x or 0) for x in r)
    assert sorted(map(tuple, got), key=key) == sorted(((i, signed(f), c) for i, f, c in want), key=key)
    kept = simhash.drop_near_duplicates(docs(spark, rows)).collect()
    stay = {roots[k]: c for k, (_, _, c) in enumerate(want)}
    assert sorted(str(r["doc_id"]) for r in kept) == sorted(str(c) for c in stay.values())
    assert all(r["FP"] == "y" for r in kept) and kept[0].asDict().keys() == set(docs(spark, rows).columns)


def test_trie_finds_every_pair(spark):
    rng = np.random.default_rng(0)
    base = rng.integers(0, 1 << 63, 40, dtype=np.uint64)
    near = np.array([b ^ sum(np.uint64(1) << np.uint64(x) for x in rng.choice(64, rng.integers(0, 6), False)) for b in np.repeat(base, 8)], np.uint64)
    values = np.unique(np.concatenate([base, near]))
    found = set()
    simhash.trie_self_join(values, np.array([[0, len(values), 0, len(values)]]), 3, lambda a, b: found.update(zip(map(int, np.minimum(a, b)), map(int, np.maximum(a, b)))))
    want = {(i, j) for j in range(len(values)) for i in range(j) if int(values[i] ^ values[j]).bit_count() <= 3}
    assert found == want
    assert [simhash.block_count(n, 3) for n in (10, 1 << 28, 1 << 34, 1 << 50)] == [4, 4, 5, 8]


def test_a_crowded_block_is_dealt_again(spark):
    rng = np.random.default_rng(2)
    base = rng.integers(0, 1 << 48, 60, dtype=np.uint64)  # the upper 16 bits of all agree
    near = [int(b) ^ sum(1 << int(x) for x in rng.choice(64, rng.integers(0, 5), False)) for b in np.repeat(base, 6)]
    values = sorted({*map(int, base), *near})
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    df = spark.createDataFrame([(signed(x),) for x in values], "fp long")
    links = [(r["u"], r["v"]) for r in simhash.hamming_links(df, 3, 16).collect()]
    want = [(signed(a), signed(b)) for k, a in enumerate(values) for b in values[:k] if (a ^ b).bit_count() <= 3]
    groups = lambda edges: {frozenset(x for x, r in roots.items() if r == root) for roots in [roots_of(edges)] for root in set(roots.values())}
    assert groups(links) == groups(want)


def test_links_with_more_blocks(spark, monkeypatch):
    monkeypatch.setattr(simhash, "GROUP", 0)
    rows = corpus(60, 5)
    want, _ = near_components(rows)
    assert {(r["doc_id"], r["component"]) for r in simhash.near_duplicate_components(docs(spark, rows)).collect()} == {(i, c) for i, _, c in want}


def test_no_near_duplicates(spark):
    none = docs(spark, ODD).limit(0)
    assert simhash.near_duplicate_components(none).count() == 0 and simhash.drop_near_duplicates(none).count() == 0


# -- nearest neighbours --------------------------------------------------------
def test_hadamard():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(5, 16))
    h = np.array([[1.0]])
    while len(h) < 16:
        h = np.block([[h, h], [h, -h]])
    assert np.allclose(ann.hadamard(x), x @ h / 4)


def test_hashes_follow_the_number_of_vectors():
    assert [ann.hash_count(n, 64) for n in (0, 1000, 1 << 23, (1 << 23) + 1, 10**9, 10**12)] == [1, 1, 1, 2, 2, 3]


def test_recall_on_the_embeddings(spark):
    import os

    from pyspark.sql import functions as F

    path = "/root/testdata/sf0.1/embeddings.parquet"
    if not os.path.exists(path):
        pytest.skip("no tables")
    df = spark.read.parquet(path).where("embedding IS NOT NULL")
    x = {r["vec_id"]: np.array(r["embedding"], float) for r in df.collect()}
    x = {i: v for i, v in x.items() if np.isfinite(v).all() and v.any()}
    ids = np.array(sorted(x))
    data = np.stack([x[i] for i in ids])
    got = defaultdict(list)
    for r in ann.nearest_neighbours(df.select("vec_id", "embedding"), F.col("id") % 20 == 0).collect():
        got[r["query_id"]].append(r["vec_id"])
    found = 0
    for i in (i for i in ids.tolist() if i % 20 == 0):
        d = ((data - x[i]) ** 2).sum(axis=1)
        d[ids == i] = np.inf
        found += len(set(ids[np.argsort(d, kind="stable")[:10]].tolist()) & set(got[i]))
    recall = found / (10 * len(got))
    print(f"recall {recall:.3f}")
    assert len(got) == sum(i % 20 == 0 for i in ids.tolist()) and recall >= 0.9


@pytest.mark.parametrize("chunk, hashes, probes", [(512, None, None), (512, 1, 40), (7, 1, 40), (512, 2, 700)])
def test_neighbours(spark, chunk, hashes, probes):
    from pyspark.sql import functions as F

    rng = np.random.default_rng(1)
    x = rng.normal(size=(600, 24))
    x[300:450] = x[7]  # a third are equal
    rows = [(k, [float(c) for c in v]) for k, v in enumerate(x)]
    odd = [(1000, None), (1001, []), (1002, [0.0] * 24), (1003, [float("nan")] * 24), (1004, [1.0, None]), (1005, [float("inf")] * 24), (None, [1.0] * 24), (1006, [3.0, 4.0])]
    df = spark.createDataFrame([*rows, *odd], "vec_id long, embedding array<double>")
    got = defaultdict(list)
    for r in ann.nearest_neighbours(df, F.col("id") % 50 == 0, chunk=chunk, hashes=hashes, probes=probes).orderBy("query_id", "rank").collect():
        got[r["query_id"]].append((r["rank"], r["vec_id"], r["score"]))
    hit = 0
    assert sorted(got) == list(range(0, 600, 50))
    for query, found in got.items():
        d = np.sqrt(((x - x[query]) ** 2).sum(axis=1))
        d[query] = np.inf
        want = np.lexsort((np.arange(600), d))[:10].tolist()
        hit += len(set(want) & {v for _, v, _ in found})
        assert [r for r, _, _ in found] == list(range(1, 11))
        assert all(s == np.sqrt(((x[v] - x[query]) ** 2).sum()) for _, v, s in found)
        assert [(s, v) for _, v, s in found] == sorted((s, v) for _, v, s in found)
    assert hit >= 0.9 * 10 * len(got)
    assert [v for _, v, _ in got[350]][:3] == [7, 300, 301]  # ties by id
    assert ann.nearest_neighbours(df.limit(0), F.col("id") % 50 == 0).count() == 0


def test_few_candidates(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.0, 1.0]), (0, [1.0, 0.5])], "vec_id long, embedding array<float>")
    rows = ann.nearest_neighbours(df, F.col("id") == 1).orderBy("rank").collect()
    assert [(r["rank"], r["vec_id"]) for r in rows] == [(1, 0), (2, 0)] and rows[0]["score"] < rows[1]["score"]


def test_every_query_gets_as_many_as_there_are(spark):
    from pyspark.sql import functions as F

    rng = np.random.default_rng(3)
    far = rng.normal(size=64)
    x = [*(far + 0.01 * rng.normal(size=(3, 64))), *(-far + 0.01 * rng.normal(size=(100, 64))), *rng.normal(size=(6, 128))]  # few here, many opposite; few of another length
    df = spark.createDataFrame([(k, [float(c) for c in v]) for k, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = defaultdict(list)
    for r in ann.nearest_neighbours(df, F.col("id").isin(0, 2, 50, 103, 107), chunk=32).orderBy("query_id", "rank").collect():
        got[r["query_id"]].append((r["rank"], r["vec_id"]))
    for query in (0, 2, 103, 107):
        d = sorted((np.sqrt(((x[v] - x[query]) ** 2).sum()), v) for v in range(len(x)) if v != query and len(x[v]) == len(x[query]))
        assert got[query] == [(n, v) for n, (_, v) in enumerate(d[:10], 1)]
    assert len(got[50]) == 10


# -- pipeline ------------------------------------------------------------------
def test_pipeline(spark, tmp_path):
    import corpus_pipeline

    rng = random.Random(4)
    english = "the and with house under green walking about things over again never tomorrow city water".split()
    german = "der und mit haus unter grün gehen über dinge wieder niemals morgen stadt wasser immer".split()
    say = lambda words, n: " ".join(rng.choice(words) + rng.choice("abcdefgh") for _ in range(n))
    rows = [(k, say(german if k % 4 == 0 else english, 60), "de" if k % 4 == 0 else "en") for k in range(80)]
    rows += [(100, rows[3][1], "en"), (101, rows[3][1], "en"), (102, "12345 !!!", "en"), (103, None, "en")]
    passage = say(english, 20)
    rows += [(110, passage, "en"), (111, rows[5][1] + " " + passage, "en"), (112, say(english, 500) + " " + passage, "en"), (113, "reach me at joe@example.org " + say(english, 30), "en")]
    df = spark.createDataFrame([(i, t, lang, "s", len(t or ""), "x") for i, t, lang in rows], "doc_id long, text string, lang string, source string, n_chars long, FP string")
    bench = spark.createDataFrame([(1, passage)], "item_id long, text string")
    sf = folder(tmp_path, documents=df, benchmark=bench)
    assert [n for n, _ in corpus_pipeline.STAGES][0] == "language ID" and len(corpus_pipeline.STAGES) == 5
    state = spark.read.parquet(f"{sf}/documents.parquet")
    texts = {i: t for i, t, _ in rows}
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        before = {r["doc_id"]: r["text"] for r in state.collect()}
        out = stage(spark, state, sf)
        if k < 4:
            assert out.columns == df.columns
            path = f"{sf}/stage{k}"
            out.write.parquet(path)
            state = spark.read.parquet(path)
            after = {r["doc_id"]: r["text"] for r in state.collect()}
        if k == 0:
            assert set(before) - set(after) == {102, 103} and all(after[i] == texts[i] for i in after)
        elif k == 1:
            want, _ = near_components(sorted(before.items()))
            assert set(after) == {c for _, _, c in want} and not {100, 101} & set(after)
        elif k == 2:
            for i, t in before.items():
                words, hit, _ = len(decontaminate.words_of(t)), *brute_hit_words(t, passage)
                if hit and 20 * hit >= words:
                    assert i not in after
                else:
                    assert after[i] == (t if not hit else t.replace(passage, ""))
            assert 112 in after and 110 not in after
        elif k == 3:
            assert set(after) == set(before) and after[113].startswith("reach me at <email> ")
            assert all(after[i] == before[i] for i in after if i != 113)
            assert all(r["n_chars"] == len(r["text"]) for r in state.collect())
        else:
            rows_out = out.collect()
            assert {r["doc_id"] for r in rows_out} == set(before)
    again = {(r["doc_id"], r["piece"], r["length"], r["ids_crc32"]) for r in corpus_pipeline.run(spark, sf).collect()}
    assert again == {(r["doc_id"], r["piece"], r["length"], r["ids_crc32"]) for r in rows_out}
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, df.limit(0), sf).count() == 0
    assert langid.REJECT_BELOW and pii.ADD_FROM


def brute_hit_words(text, passage, window=13):
    words, own = decontaminate.words_of(text), decontaminate.words_of(passage)
    grams = {tuple(own[k : k + window]) for k in range(len(own) - window + 1)}
    hit = set()
    for p in range(len(words) - window + 1):
        if tuple(words[p : p + window]) in grams:
            hit |= set(range(p, p + window))
    return len(hit), None


# -- what is written in between --------------------------------------------------
def _folders(spark):
    return set(os.listdir(shared_dir(spark).removeprefix("file:")))


def test_scratch_keeps_what_leaves(spark):
    before = _folders(spark)
    with scratch() as outer:
        settle(spark.range(2))
        with scratch() as left:
            gone, stays = settle(spark.range(3)), settle(spark.range(4))
            left.append(stays)
        assert not os.path.exists(gone._settled.removeprefix("file:"))
        outer.append(stays)
    assert stays.count() == 4 and len(_folders(spark) - before) == 1
    with pytest.raises(ValueError), scratch() as left:
        left.append(settle(spark.range(5)))
        raise ValueError
    assert len(_folders(spark) - before) == 1


def test_operators_delete_what_they_need_no_more(spark):
    before = _folders(spark)
    passage = " ".join(f"w{k}" for k in range(120))
    table = docs(spark, [(k, f"{passage} {k}") for k in range(6)] + ODD)
    removed = repeats.remove_repeats(table, keep=["doc_id"])
    assert len(_folders(spark) - before) == 1
    assert removed.where("doc_id = 0").first()["repeats"]["n_removed"] > 400

    before = _folders(spark)
    edges = spark.createDataFrame([(k, k + 1) for k in range(20)], "u long, v long")
    assert connected_components(edges).where("root = 0").count() == 21
    assert len(_folders(spark) - before) == 1

    before = _folders(spark)
    rng = np.random.default_rng(1)
    vectors = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(rng.normal(size=(12, 4)))], "vec_id long, embedding array<double>")
    assert ann.nearest_neighbours(vectors, ann.F.col("id") == 0).count() == 10
    assert len(_folders(spark) - before) == 1

import random
import re

import numpy as np
import pytest
import zstandard
from hypothesis import given, settings, strategies as st

from regiotally.llm import order_minhash as near
from tests.llm.cases import changed, documents, empty, prose, row


def distance(a, b):
    line = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(line[j] + 1, new[-1] + 1, line[j - 1] + (x != y)))
        line = new
    return line[-1]


@given(st.lists(st.integers(0, 5), max_size=60), st.lists(st.integers(0, 5), max_size=60), st.booleans())
@settings(max_examples=1500, deadline=None)
def test_alignment_is_the_edit_similarity(a, b, close):
    if close:  # near pairs, where the band decides
        b = a[: len(a) // 2] + b[:3] + a[len(a) // 2 + 2 :]
    x, y = np.array(a, dtype=np.uint32), np.array(b, dtype=np.uint32)
    longer = max(len(a), len(b))
    want = 1 - distance(a, b) / longer if longer else None
    want = want if want is not None and distance(a, b) <= int(0.2 * longer + 1e-9) else None
    assert near.similarity(x, y) == want
    for most in (0, 1, 3, 25, 70):
        assert near.banded(x, y, most) == (distance(a, b) if distance(a, b) <= most else None)


def test_occurrences_are_told_apart():
    grams = np.array([5, 7, 5, 5, 7], dtype=np.uint64)
    assert len(set(near.labelled(grams).tolist())) == 5
    assert near.labelled(np.array([1, 2], dtype=np.uint64)).tolist() == [1, 2]


def test_sketches_follow_text_order():
    own = np.arange(1, 400, dtype=np.uint64) * np.uint64(7919)
    keys = near.sketch(own)
    assert (keys == near.sketch(own)).all()
    assert (keys != near.sketch(own[::-1].copy())).sum() > 20  # the same set in another order


def brute_classes(docs):
    """Components of all pairs with an edit similarity of 0.8."""
    words = [re.findall(r"\w+", (t or "").lower()) for _, t in docs]
    root = list(range(len(docs)))

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for i in range(len(docs)):
        for j in range(i):
            longer = max(len(words[i]), len(words[j]))
            same = words[i] == words[j] if longer else (docs[i][1] or "") == (docs[j][1] or "") and not words[j]
            if same or longer and abs(len(words[i]) - len(words[j])) <= 0.2 * longer and distance(words[i], words[j]) <= int(0.2 * longer + 1e-9):
                root[find(i)] = find(j)
    return [find(k) for k in range(len(docs))]


def test_classes_equal_brute_force(spark):
    pick = random.Random(5)
    more = []
    for g in range(12):
        base = prose(60 + 10 * g, 100 + g)
        for k in range(pick.randint(1, 5)):
            more.append(row(1000 + 10 * g + k, changed(base, 12 + 3 * k) if k else base))
    docs = documents(spark, more).filter("doc_id IS NULL OR doc_id <> 10")  # the long text is too slow for the plain version
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    roots = brute_classes(rows)
    want = []
    for (doc_id, _), r in zip(rows, roots):
        ids = [d for (d, _), s in zip(rows, roots) if s == r]
        want.append((doc_id, min((d for d in ids if d is not None), default=None), len(ids)))
    got = [(r.doc_id, r.class_id, r.class_size) for r in near.classes(docs).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)


def test_one_document_of_each_class_stays(spark):
    docs = documents(spark)
    kept = near.one_per_class(docs)
    assert kept.columns == docs.columns
    ids = [r.doc_id for r in kept.collect()]
    assert sorted(ids, key=str) == sorted([1, 4, 5, 7, 8, 9, 10, 11, 12, 13, None], key=str)  # null and empty text are copies
    assert near.one_per_class(empty(spark)).count() == 0


def test_large_group_and_shared_passage(spark):
    passage, base = prose(60, 900), prose(120, 901)
    group = [row(k, changed(base, 20 + k % 30) + f" tail{k}") for k in range(300)]
    others = [row(1000 + k, passage + " " + " ".join(f"w{k}x{i}" for i in range(80))) for k in range(200)]
    found = {r.doc_id: r.class_id for r in near.classes(spark.createDataFrame(group + others, documents(spark).schema)).collect()}
    assert {found[k] for k in range(300)} == {0}
    assert all(found[1000 + k] == 1000 + k for k in range(200))


def test_components(spark):
    edges = [(1, 2), (2, 3), (5, 4), (9, 9), (6, 7), (7, 8), (8, 3)]
    got = {r.node: r.root for r in near.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 6: 1, 7: 1, 8: 1, 4: 4, 5: 4}


def test_scattered_edits_meet_in_a_bucket():
    """Recall of the candidates for pairs whose edit similarity is 0.80 to 0.85, by the plain distance."""
    pick, met, pairs = random.Random(12), 0, 0
    for k in range(400):
        a = [pick.randrange(1 << 32) for _ in range(pick.randint(100, 250))]
        b = list(a)
        for i in pick.sample(range(len(a)), int(len(a) * pick.uniform(0.15, 0.2))):
            b[i] = pick.randrange(1 << 32)
        x, y = np.array(a, dtype=np.uint32), np.array(b, dtype=np.uint32)
        if k < 20:
            assert 0.8 <= 1 - distance(a, b) / len(a) <= 0.86
        pairs += 1
        met += bool((near.bucket_keys(near.shingles(x)) == near.bucket_keys(near.shingles(y))).any())
    assert met >= 0.995 * pairs, (met, pairs)


@given(st.lists(st.integers(0, 9), min_size=1, max_size=40), st.lists(st.integers(0, 9), min_size=1, max_size=40))
@settings(max_examples=300, deadline=None)
def test_bounds_rule_out_no_link(a, b):
    a, b = (np.array([(w * 2654435761) & 0xFFFFFFFF for w in x], dtype=np.uint32) for x in (a, b))
    cells = [np.frombuffer(near.histogram(x), dtype=np.uint8)[None] for x in (a, b)]
    may = near.may_align(np.array([len(a)]), np.array([len(b)]), *cells, near.SIMILARITY)[0]
    assert may or near.similarity(a, b) is None


def test_single_keys_are_those_of_one_shingle():
    own = near.shingles(np.arange(90, dtype=np.uint32))
    assert (near.bucket_keys(own)[near.SKETCHES :] == near.sketch(own, taken=1) ^ near._MIX).all()


@pytest.mark.parametrize("direct", [4, 60_000_000])
def test_pairs_in_buckets_of_strangers_are_linked(spark, monkeypatch, direct):
    """Pairs at 0.8 that share three quarters of their words with everybody; strangers are at 0.75 or less."""
    monkeypatch.setattr(near, "DIRECT", direct)
    pick, shared, rows = random.Random(31), [f"all{i}" for i in range(150)], []
    for k in range(80):
        own = [f"own{k}x{i}" for i in range(50)]
        kept = set(pick.sample(range(50), 10))
        rows.append(row(k, " ".join(shared + own)))
        rows.append(row(1000 + k, " ".join(shared + [w if i in kept else f"other{k}x{i}" for i, w in enumerate(own)])))
    found = {r.doc_id: (r.class_id, r.class_size) for r in near.classes(spark.createDataFrame(rows, documents(spark).schema)).collect()}
    assert found == {j + k: (k, 2) for k in range(80) for j in (0, 1000)}


def test_a_class_beside_strangers_is_met_by_them_once(spark, monkeypatch):
    """Pairs across the classes of a bucket, whole or by rare words, are those of the plain definition."""
    pick = random.Random(5)
    words = {n: np.array([pick.randrange(40) if i % 2 else n // 6 * 100 + i for i in range(30)], dtype=np.uint32) for n in range(30)}
    nodes = spark.createDataFrame([(n, n, [1, 2 + n % 2], zstandard.compress(w.tobytes()), len(w), near.histogram(w)) for n, w in words.items()], "id long, node long, keys array<long>, words binary, n_words int, bins binary")
    roots = spark.createDataFrame([(n, 7) for n in range(7, 15)], "node long, root long")
    root = {n: 7 if 7 <= n < 15 else n for n in words}
    key = lambda n: {1, 2 + n % 2}
    ends = {1: (0, 29), 2: (0, 28), 3: (1, 29)}
    want = {(a, b) for a in words for b in words if a < b and root[a] != root[b] and any(not {a, b} & set(ends[k]) for k in key(a) & key(b))}
    near_ones = {(a, b) for a, b in want if near.similarity(words[a], words[b], 0.3) is not None}
    for tile, direct in ((1000, 10**9), (3, 10**9), (2, 0)):
        monkeypatch.setattr(near, "TILE", tile)
        monkeypatch.setattr(near, "DIRECT", direct)
        got = [(r.a, r.b) for r in near.between(near.buckets(nodes), roots, nodes, near.shapes(nodes), 0.3).collect()]
        assert len(got) == len(set(got)) and near_ones <= set(got) <= want and near_ones


@given(st.lists(st.integers(0, 12), min_size=1, max_size=60), st.lists(st.tuples(st.integers(0, 59), st.integers(0, 12)), max_size=14), st.integers(0, 1000))
@settings(max_examples=500, deadline=None)
def test_near_texts_share_a_rarest_word(a, edits, seed):
    b = list(a)
    for at, w in edits:
        if at % 3 == 0:
            b[at % (len(b) + 1) : at % (len(b) + 1)] = [w]
        elif len(b) > 1:
            b[at % len(b) : at % len(b) + 1] = [w] if at % 3 == 1 else []
    common = np.random.default_rng(seed).integers(0, 5, near.CELLS)
    x, y = np.array(a, dtype=np.uint32), np.array(b, dtype=np.uint32)
    if near.similarity(x, y) is not None:
        assert set(near.rarest(x, common).tolist()) & set(near.rarest(y, common).tolist())


def test_texts_alike_in_the_folded_histogram_only_are_not_fetched(spark):
    """Strangers that a small histogram cannot tell apart are ruled out by all of its cells, packed or not."""
    words = {n: np.arange(40, dtype=np.uint32) + np.uint32(n % 4 * near.FOLDED + n * near.BINS) for n in range(5)}
    squeeze = zstandard.ZstdCompressor()
    for form in (near.histogram, lambda w: near.packed_bins(near.histogram(w), squeeze)):
        rows = [(1, 0, n, n, 9, 5, 5, len(w), form(w)) for n, w in words.items()]
        held = spark.createDataFrame(rows, "key long, token long, node long, root long, main long, size long, strangers long, n_words int, bins binary")
        assert [(r.a, r.b) for r in near.across(held).collect()] == [(0, 4)]


def test_keys_are_shuffled_once(spark):
    nodes = spark.createDataFrame([(n, [n // 2, 99]) for n in range(20)], "node long, keys array<long>")
    met = near.buckets(nodes)
    assert len(met.collect()) == 29
    assert "ReusedExchange" in met._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("slots", [1, 131_072])
def test_words_are_those_of_the_wanted_nodes_only(spark, monkeypatch, slots):
    """Nodes that share a bit of the bitmap, repeated rows and null ids give one row a wanted node."""
    monkeypatch.setattr(near, "SLOTS", slots)
    ids = [None, 1, 1, 2, 3, 4, 5]
    nodes = spark.createDataFrame([(i, n, bytes([n % 256])) for i, n in zip(ids, [64, 64, 64, 128, 5, 2**62 + 5, 5])], "id long, node long, words binary")
    wanted = spark.createDataFrame([(64,), (2**62 + 5,)], "node long")
    assert sorted((r.node, bytes(r.words)) for r in near.words_of(nodes, wanted).collect()) == [(64, b"\x40"), (2**62 + 5, b"\x05")]


def strangers(n, words=60, shared=40):
    """Nodes in all of 20 buckets that share so many words that no histogram tells them apart at 0.3."""
    texts = {k: np.array([*range(shared), *(1000 + (k * 7 + i) % 50 for i in range(words - shared))], dtype=np.uint32) for k in range(n)}
    return [(k, k, [*range(1, 21)], zstandard.compress(w.tobytes()), len(w), near.histogram(w)) for k, w in texts.items()]


@pytest.mark.parametrize("tile", [8, 1_024])
def test_a_pair_of_many_buckets_is_made_once(spark, monkeypatch, tile):
    """Strangers that share 20 buckets give one row a pair before any distinct, and their histograms are joined once a node."""
    monkeypatch.setattr(near, "TILE", tile)
    schema = "id long, node long, keys array<long>, words binary, n_words int, bins binary"
    # two kinds of buckets, as their smallest nodes differ: 0 is in those of even keys only
    rows = [(i, n, [k for k in keys if n or k % 2 == 0], *rest) for i, n, keys, *rest in strangers(40)]
    nodes = spark.createDataFrame(rows, schema)
    met = near.buckets(nodes)
    made = []
    distinct = type(nodes).distinct
    with monkeypatch.context() as patch:
        patch.setattr(type(nodes), "distinct", lambda df: distinct(df) if df.columns != ["a", "b"] else (made.append(df.collect()), distinct(df))[1])
        got = near.between(met, spark.createDataFrame([], "node long, root long"), nodes, near.shapes(nodes), 0.3).collect()
    # 0 and 39 meet all as ends; in the buckets of odd keys the smallest is 1
    want = {(a, b) for a in range(1, 39) for b in range(a + 1, 39)}
    assert sorted((r.a, r.b) for r in got) == sorted(want)
    assert len(made[-1]) == len(want)


def test_words_are_shuffled_once_on_their_way_to_the_pairs(spark):
    nodes = spark.createDataFrame([(n, n, bytes([n])) for n in range(20)], "id long, node long, words binary")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        wanted = spark.createDataFrame([(n,) for n in range(5)], "node long")
        plan = near.words_of(nodes, wanted)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    assert sum("Exchange hashpartitioning(node" in line for line in plan.splitlines()) == 1, plan


def test_long_strangers_are_not_fetched(spark):
    """Long texts of the same few thousand words differ in the finer histogram only; none near is ruled out, packed or not."""
    pick = np.random.default_rng(3)
    own = [pick.integers(0, 1 << 20, 7_000).astype(np.uint32) for _ in range(4)]
    few = pick.integers(0, 1 << 32, 7_000, dtype=np.uint64).astype(np.uint32)
    texts = {n: few[w % 7_000] for n, w in enumerate(own)}
    texts[4] = np.concatenate([texts[0][:6_000], texts[1][:900]])
    texts[5] = texts[0][: near.LONG]  # short enough for the plain histogram
    texts[6] = texts[0][: near.LONG + 400]
    want = {(a, b) for a in texts for b in texts if a < b and near.similarity(texts[a], texts[b]) is not None}
    assert want == {(0, 4), (5, 6)}
    squeeze = zstandard.ZstdCompressor(level=2)
    for form in (near.histogram, lambda w: near.packed_bins(near.histogram(w), squeeze)):
        rows = [(1, 0, n, n, 9, 7, 7, len(w), form(w)) for n, w in texts.items()]
        held = spark.createDataFrame(rows, "key long, token long, node long, root long, main long, size long, strangers long, n_words int, bins binary")
        assert {(r.a, r.b) for r in near.across(held).collect()} == want
        pairs = spark.createDataFrame([(a, b) for a in texts for b in texts if a < b], "a long, b long")
        assert {(r.a, r.b) for r in near.possible(pairs, held.select("node", "n_words", "bins")).collect()} == want

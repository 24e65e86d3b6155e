"""Jaccard join, embedding near-duplicates, top-k search and components against brute force."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from adlens.llm import bloom, components as cc, jaccard, neardup, topk
from adlens.llm.words import word_hashes
from conftest import rows


def _roots(nodes, links):
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x
    for a, b in links:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def test_components_match_union_find(spark):
    rng = random.Random(1)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)] + [(i, i + 1) for i in range(400, 460)]
    edges += [(500, i) for i in range(501, 560)] + [(7, 7), (None, 3), (3, None)]
    got = dict(rows(cc.components(spark.createDataFrame(edges, "a long, b long")), "node", "component"))
    nodes = {x for e in edges for x in e if x is not None}
    want = _roots(nodes, [e for e in edges if None not in e])
    assert {n: got.get(n, n) for n in nodes} == want


def test_components_of_nothing(spark):
    assert cc.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_bitmap_hash_is_sparks(spark):
    values = [0, 1, -1, 2**62, -2**63, 123456789]
    got = {r.x: r.h for r in spark.createDataFrame([(v,) for v in values], "x long").selectExpr("x", "xxhash64(x) as h").collect()}
    assert bloom.xxhash64(np.array(values)).tolist() == [got[v] for v in values]
    held = bloom.bitmap(spark.createDataFrame([(v,) for v in values], "x long"), "x", bits=1 << 10)
    assert bloom.might_hold(held, np.array(values)).all()
    assert bloom.might_hold(held, np.arange(1000, 2000)).mean() < 0.05


def _words(text):
    return (text or "").encode().lower().split()


def _shingles(text, k):
    w = _words(text)
    return {tuple(w)} if 0 < len(w) < k else {tuple(w[i:i + k]) for i in range(len(w) - k + 1)}


def _near_texts(rng, n, length):
    vocabulary = [f"w{i}" for i in range(400)]
    out = []
    for _ in range(n):
        base = [rng.choice(vocabulary) for _ in range(rng.randrange(1, length))]
        out.append(" ".join(base))
        for _ in range(rng.randrange(4)):
            near = list(base)
            for _ in range(rng.randrange(0, 2 + len(base) // 25)):
                near[rng.randrange(len(near))] = rng.choice(vocabulary)
            out.append(" ".join(near[:len(near) - rng.randrange(3)] or near))
    return out


@pytest.mark.parametrize("words, percent, hot, length", [(4, 85, 16, 120), (5, 80, 2, 60), (2, 80, 1, 30), (4, 85, 16, 8)])
def test_jaccard_matches_brute_force(spark, words, percent, hot, length):
    rng = random.Random(words * percent)
    texts = _near_texts(rng, 60, length)
    texts += ["A B c d e", "a b  C\td e", "", None, " \t\n", "one", "ONE", "é É", "É é", "x" * 5000, texts[0], texts[0]]
    docs = list(enumerate(texts))
    rng.shuffle(docs)
    frame = spark.createDataFrame([(i, t, i, "k") for i, t in docs], "doc_id long, text string, id long, key string")
    got = {r.doc_id: (r.n_shingles, r.component_id)
           for r in jaccard.jaccard_components(frame, words=words, percent=percent, hot=hot, block=3).collect()}
    sets = {i: _shingles(t, words) for i, t in docs}
    links = [(a, b) for a in sets for b in sets if a < b and sets[a] and sets[b]
             and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])]
    root = _roots(sets, links)
    assert got == {i: (len(sets[i]), root[i]) for i in sets}


@pytest.mark.parametrize("hot, block", [(16, 512), (3, 4), (100, 7)])
def test_jaccard_group_without_links(spark, hot, block):
    """Many texts share a hub's keys, few link with each other: every pair of a group must still be tested."""
    rng = random.Random(5)
    base = [f"b{i}" for i in range(60)]
    texts = []
    for _ in range(40):
        t = list(base)
        for i in rng.sample(range(60), rng.randrange(1, 6)):
            t[i] = f"z{rng.randrange(3)}"
        texts.append(" ".join(t))
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = dict(rows(jaccard.jaccard_components(frame, words=1, percent=90, hot=hot, block=block), "doc_id", "component_id"))
    sets = [_shingles(t, 1) for t in texts]
    links = [(a, b) for a in range(40) for b in range(a) if 100 * len(sets[a] & sets[b]) >= 90 * len(sets[a] | sets[b])]
    assert got == _roots(range(40), links)


def test_jaccard_empty_and_null_ids(spark):
    assert jaccard.jaccard_components(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    got = jaccard.jaccard_components(spark.createDataFrame(
        [(None, "a b c d e"), (3, "a b c d e"), (3, "other words here now"), (1, "a b c d e")], "doc_id long, text string"))
    assert rows(got) == sorted([(None, 2, None), (3, 2, 1), (3, 1, 3), (1, 2, 1)], key=repr)


def test_parts_leave_enough_non_empty_ones():
    for percent in (80, 85, 90):
        for n in (1, 2, 5, 7, 11, 30, 200, 5000):
            s = np.unique(np.random.default_rng(n).integers(0, 2**63, n).astype(np.uint64) * np.uint64(2))
            bands = range(jaccard.band(len(s)), jaccard.band(len(s) * 100 // percent) + 1)
            keys = jaccard.part_keys(s, percent)
            assert len(keys) == len(bands) and all(len(k) >= jaccard.needed(len(s), percent) for k in keys)


def test_word_hashes_cut_long_texts_at_blanks():
    text = " ".join(f"Word{i}" for i in range(300_000))
    assert len(text) > 1 << 20
    assert (word_hashes(text) == np.concatenate([word_hashes(p) for p in text.split()[:1]] + [word_hashes(text.split(" ", 1)[1])])).all()


# -- vectors -------------------------------------------------------------------
def _vectors(rng, n, dim):
    base = rng.standard_normal((n, dim)).astype(np.float32)
    near = base[: n // 2] + 0.1 * rng.standard_normal((n // 2, dim)).astype(np.float32)
    return np.concatenate([base, near, base[:5], base[:5]])


def _odd_vectors(dim):
    inf, nan = float("inf"), float("nan")
    return [None, [], [0.0] * dim, [None] + [1.0] * (dim - 1), [nan] * dim, [inf] * dim, [1.0] * (dim + 1), [1.0] * (dim + 1)]


@pytest.mark.parametrize("block_rows", [1024, 8])
def test_near_duplicates_match_brute_force(spark, block_rows):
    rng = np.random.default_rng(2)
    vecs = _vectors(rng, 150, 16)
    hot = np.float32(1) + 0.02 * rng.standard_normal((60, 16)).astype(np.float32)
    data = [(i, v.tolist(), 1) for i, v in enumerate(np.concatenate([vecs, hot]))]
    data += [(1000 + i, v, 1) for i, v in enumerate(_odd_vectors(16))]
    frame = spark.createDataFrame(data, "vec_id long, embedding array<float>, rep int")
    got = {r.vec_id: (r.n_links, r.component_id, r.kept)
           for r in neardup.near_duplicates(frame, recall=0.9999, block_rows=block_rows).collect()}
    mat = np.concatenate([vecs, hot]).astype(np.float64)
    unit = mat / np.linalg.norm(mat, axis=1, keepdims=True)
    linked = unit @ unit.T >= 0.95
    pairs = [(a, b) for a, b in zip(*np.nonzero(linked)) if a < b] + [(1006, 1007)]
    ids = [d[0] for d in data]
    root = _roots(ids, pairs)
    degree = {i: sum(i in p for p in pairs) for i in ids}
    assert got == {i: (degree[i], root[i], root[i] == i) for i in ids}


def test_near_duplicates_null_ids_and_empty_table(spark):
    schema = "vec_id long, embedding array<float>"
    assert neardup.near_duplicates(spark.createDataFrame([], schema)).count() == 0
    got = neardup.near_duplicates(spark.createDataFrame([(None, [1.0, 0.0]), (4, [1.0, 0.0]), (2, [1.0, 0.0])], schema))
    assert rows(got) == sorted([(None, 0, None, False), (4, 1, 2, False), (2, 1, 2, True)], key=repr)


def test_recall_of_planned_tables():
    bits, tables = neardup.plan_tables(10**6, 0.95, 0.99)
    share = (1 - math.acos(0.95) / math.pi) ** bits
    assert 1 - (1 - share) ** tables >= 0.99


@pytest.mark.parametrize("levels, shard_numbers, block", [(16, 1 << 20, 4096), (4, 600, 3)])
def test_top_k_matches_brute_force(spark, levels, shard_numbers, block):
    rng = np.random.default_rng(3)
    vecs = np.round(_vectors(rng, 120, 12), 1)  # coarse values, so scores tie
    data = [(i, v.tolist(), "s") for i, v in enumerate(vecs)] + [(2000 + i, v, "s") for i, v in enumerate(_odd_vectors(12))]
    data += [(None, vecs[0].tolist(), "s"), (10, vecs[10].tolist(), "s")]
    frame = spark.createDataFrame(data, "vec_id long, embedding array<float>, shard string")
    got = topk.top_k(frame, frame["vec_id"] % 10 == 0, k=7, levels=levels, shard_numbers=shard_numbers, block_queries=block)
    ints = [(i, np.floor(1024.0 * v.astype(np.float64)).astype(np.int64)) for i, v in [*enumerate(vecs), (10, vecs[10])]]
    want = []
    for q in range(0, len(vecs), 10):
        best = sorted((-int(a @ v), i) for j, a in ints if j == q for i, v in ints if i != q)[:7]
        want += [(q, r + 1, i, -s) for r, (s, i) in enumerate(best)]
    assert [r for r in rows(got, "query_id", "rank", "vec_id", "score") if r[0] < 2000] == sorted(want, key=repr)


def test_top_k_few_candidates(spark):
    schema = "vec_id long, embedding array<float>"
    assert topk.top_k(spark.createDataFrame([], schema), F.lit(True)).count() == 0
    two = spark.createDataFrame([(100, [1.0, 2.0]), (1, [0.5, -0.5])], schema)
    assert rows(topk.top_k(two, two["vec_id"] % 100 == 0)) == [(100, 1, 1, 1024 * 512 - 2048 * 512)]


def test_top_k_of_repeated_ids(spark):
    rng = np.random.default_rng(8)
    data = [(int(i), np.round(rng.standard_normal(4), 1).tolist()) for i in rng.integers(0, 40, 150)]
    data += [(1, [0.9] * 4), (1, [0.5] * 4), (10, [0.7] * 4), (10, [0.7] * 4), (10, [-0.7] * 4)] + [(3, [2.0] * 4)] * 30
    frame = spark.createDataFrame(data, "vec_id long, embedding array<double>")
    ints = [(i, np.floor(1024.0 * np.array(v)).astype(np.int64)) for i, v in data]
    want = []
    for q in sorted({i for i, _ in ints if i % 10 == 0}):
        scores = sorted((-int(a @ b), j) for i, a in ints if i == q for j, b in ints if j != q)[:7]
        want += [(q, r + 1, j, -s) for r, (s, j) in enumerate(scores)]
    for shard_numbers in (1 << 20, 60):
        got = topk.top_k(frame, frame["vec_id"] % 10 == 0, k=7, levels=4, shard_numbers=shard_numbers, block_queries=5)
        assert rows(got, "query_id", "rank", "vec_id", "score") == sorted(want, key=repr)


def test_near_duplicates_of_extreme_components(spark):
    data = [(0, [3e200, 4e200]), (1, [3.0, 4.0]), (2, [3e-200, 4e-200]), (3, [-3e200, -4e200]), (4, [1e308, 1e308]), (5, [1e-320, 1e-320])]
    got = neardup.near_duplicates(spark.createDataFrame(data, "vec_id long, embedding array<double>"))
    assert {r.vec_id: r.component_id for r in got.collect()} == {0: 0, 1: 0, 2: 0, 3: 3, 4: 0, 5: 0}

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexigraph.llm import near_dedup as nd
from lexigraph.llm import queries

from .helpers import components, no_docs, odd_docs


def held(spark, docs, k=4):
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = {r.doc_id: r for r in nd.near_duplicates(df, k).collect()}
    want, sizes = components(docs, k)
    assert {d: r.component_id for d, r in got.items()} == want
    assert {d: r.n_shingles for d, r in got.items()} == sizes
    assert all(r.kept == (d == want[d]) for d, r in got.items())


def test_query_against_brute_force(spark, sf):
    docs = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    got = {r.doc_id: r.component_id for r in queries.op10_near_dedup(spark, sf).collect()}
    assert got == components(docs, 4)[0]


def test_chains_and_hot_groups(spark):
    rng = random.Random(5)
    base = [f"w{rng.randrange(10**6)}" for _ in range(120)]
    docs, word = [], list(base)
    for i in range(40):  # a chain: each near the last, the ends far apart
        docs.append((i, " ".join(word)))
        word[3 * i] = f"n{i}"
    for i in range(120):  # a group of copies with edits, some too far from the first
        w = list(base[::-1])
        for _ in range(rng.randrange(6)):
            w[rng.randrange(len(w))] = f"e{rng.randrange(10**6)}"
        docs.append((1000 + i, " ".join(w)))
    docs += [(2000 + i, " ".join(base[20:100])) for i in range(50)]
    held(spark, docs)


def test_unlike_texts_with_shared_boilerplate(spark, monkeypatch):
    """Many texts that share half their words and are unlike: their buckets are banded again, and no link is lost."""
    monkeypatch.setattr(nd, "CROWD", 8)
    rng = random.Random(6)
    shared = [f"b{i}" for i in range(60)]
    docs = []
    for i in range(150):
        own = [f"o{rng.randrange(10**6)}" for _ in range(60)]
        docs.append((10 * i, " ".join(own + shared)))
        if i % 5 == 0:
            docs.append((10 * i + 1, " ".join(own[:-1] + ["edited"] + shared)))
    calls = []
    monkeypatch.setattr(nd, "rare_buckets", lambda *a, f=nd.rare_buckets: calls.append(1) or f(*a))
    held(spark, docs)
    assert calls


@pytest.mark.parametrize("side", [1 << 20, 9000])
def test_copies_short_of_the_threshold_are_compared_in_tiles(spark, monkeypatch, side):
    """Copies with so many edits that most lie outside their group: they are paired in two rounds only, and no link is lost."""
    monkeypatch.setattr(nd, "CROWD", 8)
    monkeypatch.setattr(nd, "SIDE", side, raising=False)
    rng = random.Random(8)
    base = [f"w{i}" for i in range(150)]
    docs = []
    for i in range(200):
        w = list(base)
        for k in rng.sample(range(150), rng.randrange(2) if i % 2 else rng.randrange(3, 9)):
            w[k] = f"e{rng.randrange(10**6)}"
        docs.append((i, " ".join(w)))
    pairs = []
    monkeypatch.setattr(nd, "likely", lambda p, *a, f=nd.likely: pairs.append(p.count()) or f(p, *a))
    held(spark, docs)
    assert len(pairs) <= 2, pairs


@pytest.mark.parametrize("most", [None, -1])
def test_components_of_few_edges_take_two_writes(spark, monkeypatch, most):
    """A chain, a hub and a random graph: in one task, and by stars; the task needs no rounds of jobs."""
    if most is not None:
        monkeypatch.setattr(nd, "EDGE_BYTES", most, raising=False)
    rng = random.Random(10)
    pairs = [(i, i + 1) for i in range(0, 300)] + [(1000, 1001 + i) for i in range(200)] + [(2000 + rng.randrange(900), 2000 + rng.randrange(900)) for _ in range(420)] + [(5, 5)]
    rng.shuffle(pairs)
    label = {x: x for p in pairs for x in p if p[0] != p[1]}
    while any(label[a] != label[b] for a, b in pairs if a != b):
        for a, b in pairs:
            if a != b:
                label[a] = label[b] = min(label[a], label[b])
    writes = []
    monkeypatch.setattr(nd, "staged", lambda df, name, f=nd.staged: writes.append(name) or f(df, name))
    got = {r.node: r.label for r in nd.components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert all(got.get(x, x) == y for x, y in label.items()) and got.keys() <= label.keys()
    assert most is not None or len(writes) == 2
    assert not nd.components(spark.createDataFrame([], "a long, b long")).collect()


def test_overlaps_of_sets():
    rng = np.random.default_rng(9)
    for shape, most in (((40, 70), 60), ((300, 200), 40000), ((1, 50), 900)):
        groups = [[np.unique(rng.integers(0, most if i % 2 else 90, rng.integers(1, 200))).astype(np.uint64) for i in range(n)] for n in shape]
        flat = [(np.concatenate(g), np.repeat(np.arange(len(g)), [len(x) for x in g])) for g in groups]
        want = [[len(np.intersect1d(a, b)) for b in groups[1]] for a in groups[0]]
        assert (nd.overlaps(*flat[0], *flat[1], shape) == want).all()


def test_odd_rows(spark):
    out = nd.near_duplicates(odd_docs(spark)).collect()
    assert len(out) == 13
    of = {(r.doc_id, r.n_shingles): r.component_id for r in out if r.doc_id is not None}
    assert of[1, 0] == 1 and of[2, 0] == 2 and of[3, 0] == 3 and of[6, 24] == 5 and of[9, 1] == 9 and of[7, 25] == 5 and of[7, 3] == 7
    assert sorted(r.component_id or -1 for r in out if r.doc_id is None) == [-1, 5]
    assert nd.near_duplicates(no_docs(spark)).collect() == []
    kept = nd.stage(spark, odd_docs(spark), "")
    assert kept.columns == odd_docs(spark).columns and sorted(r.doc_id or -1 for r in kept.collect()) == [-1, 1, 2, 3, 4, 5, 7, 8, 9]
    assert nd.stage(spark, no_docs(spark), "").count() == 0


def test_ids_of_any_type(spark):
    docs = odd_docs(spark)
    named = docs.withColumn("doc_id", F.concat(F.lit("d"), "doc_id"))
    got, want = (sorted((str(r.component_id or ""), r.n_shingles, r.kept) for r in nd.near_duplicates(x).collect()) for x in (named, docs))
    assert got == [("d" + c if c else "", n, k) for c, n, k in want]


def test_two_texts_under_one_id_both_stay(spark):
    docs = spark.createDataFrame([(7, "alpha beta gamma delta epsilon"), (7, "quite other words than these"), (8, "alpha beta gamma delta epsilon"), (8, "one more text of its own")], "doc_id long, text string")
    assert sorted((r.doc_id, r.text[:5]) for r in nd.stage(spark, docs, "").collect()) == [(7, "alpha"), (7, "quite"), (8, "one m")]


def test_registers_merge_and_estimate():
    rng = np.random.default_rng(1)
    a, b = np.unique(rng.integers(0, 2**64, 900, np.uint64)), np.unique(rng.integers(0, 2**64, 100, np.uint64))
    one = lambda h: nd.registers(h, np.zeros(len(h), np.int64), 1)
    assert (nd.merge(one(a), one(b)) == one(np.union1d(a, b))).all()
    errors = []
    for k in range(30):
        u = np.unique(rng.integers(0, 2**64, 1000, np.uint64))
        best, _ = nd.estimate(one(u), one(u[:800]), np.array([1000.0]), np.array([800.0]), 0.8)
        errors.append(best[0] - 0.8)
    assert abs(np.mean(errors)) < 0.03


@pytest.mark.parametrize("n", [1, 2, 50, 5000])
def test_registers_agree_as_often_as_sets(n):
    rng = np.random.default_rng(n)
    same = 0
    for _ in range(40):
        u = np.unique(rng.integers(0, 2**64, 10 * n, np.uint64))
        a, b = u[: 9 * n], u[n:]
        ra, rb = (nd.registers(x, np.zeros(len(x), np.int64), 1) for x in (a, b))
        same += (ra == rb).mean() / 40
    assert abs(same - 0.8) < 0.05

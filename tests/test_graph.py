import math

import pytest

from lexigraph.plans import catalogue
from lexigraph.operators import graph, sampling


def test_pagerank_golden(spark):
    edges = spark.createDataFrame([(1, 2), (1, 3), (2, 3), (3, 1)], "user_id long, follower_id long")
    got = {r.user_id: r["rank"] for r in graph.pagerank(edges).collect()}
    assert got == pytest.approx({1: 1.19262615, 2: 0.64364162, 3: 1.16373223}, abs=1e-8)
    assert min(got.values()) >= 0.15


def test_pagerank_counts_repeats(spark):
    edges = spark.createDataFrame([(1, 2), (1, 2), (3, 2)], "user_id long, follower_id long")
    got = {r.user_id: r["rank"] for r in graph.pagerank(edges, max_iter=1, tol=None).collect()}
    assert got == pytest.approx({1: 0.15 + 0.85 * 2 / 3, 2: 0.15, 3: 0.15 + 0.85 / 3})


def test_hits_golden(spark):
    lists = spark.createDataFrame([(7, 1, [2, 3]), (8, 2, [3])], "tid long, author_id long, retweeters array<long>")
    state = graph.hits(graph.retweet_edges(lists)).collect()
    assert {r.node: r.hub for r in state} == pytest.approx({1: 0.85026515, 2: 0.52635461, 3: 0}, abs=1e-8)
    assert {r.node: r.auth for r in state} == pytest.approx({1: 0, 2: 0.52635461, 3: 0.85026515}, abs=1e-8)
    assert math.isclose(sum(r.hub**2 for r in state), 1) and math.isclose(sum(r.auth**2 for r in state), 1)


def test_hits_without_edges(spark):
    assert graph.hits(spark.createDataFrame([], "src long, dst long"), max_iter=3).count() == 0


def test_turank_golden(spark):
    tweets = spark.createDataFrame([(1, 10), (2, 20)], "uid long, tid long")
    retweets = spark.createDataFrame([(10, 1, [2, 3])], "tid long, author_id long, retweeters array<long>")
    edges = spark.createDataFrame([(1, 2), (1, 3), (2, 3)], "user_id long, follower_id long")
    ranks = graph.turank(tweets, retweets, edges)
    got = {f"{r.node.kind}_{r.node.id}": r["rank"] for r in ranks.collect()}
    assert got == pytest.approx({"tweet_10": 0.60334, "tweet_20": 0.400358, "user_1": 0.534903, "user_2": 0.367376, "user_3": 0.15}, abs=1e-6)
    assert [r.tid for r in graph.tweet_ranks(ranks).orderBy("tid").collect()] == [10, 20]


def test_degrees(spark):
    edges = spark.createDataFrame([(1, 2), (1, 3), (2, 3)], "user_id long, follower_id long")
    counts = sampling.follower_counts(edges)
    assert {r.user_id: r.followers for r in counts.collect()} == {1: 2, 2: 1, 3: 0}
    assert {r.followers: r.users for r in sampling.follower_histogram(counts).collect()} == {0: 1, 1: 1, 2: 1}


def test_sample(spark):
    edges = spark.range(10000).selectExpr("id AS user_id", "id + 1 AS follower_id")
    a = sampling.sample_distinct(edges, 100, 10, seed=1)
    assert 800 < a.count() < 1200 and a.exceptAll(edges).count() == 0
    assert sorted(a.collect()) == sorted(sampling.sample_distinct(edges, 100, 10, seed=1).collect())
    with pytest.raises(ValueError):
        sampling.sample_distinct(edges, 10, 0)
    with pytest.raises(ValueError):
        sampling.sample_distinct(edges, 10, 11)


def test_hubs_are_salted(spark, sf, monkeypatch):
    """With edges of a source spread by a salt the ranks are the same."""
    edges, rt = catalogue.edges(spark, sf), graph.retweet_edges(catalogue.retweets(spark, sf))
    runs = {"pagerank": lambda: graph.pagerank(edges, max_iter=2, tol=None), "hits": lambda: graph.hits(rt, max_iter=2, tol=None)}
    plain = {k: sorted(tuple(round(x, 9) for x in r) for r in f().collect()) for k, f in runs.items()}
    monkeypatch.setattr(graph, "HUB_EDGES", 7)
    kept, hubs = graph._kept(graph.weighted(graph.follow_edges(edges)))
    assert hubs.count() > 0 and kept.select("salt").distinct().count() > 1
    assert {k: sorted(tuple(round(x, 9) for x in r) for r in f().collect()) for k, f in runs.items()} == plain


def test_no_silent_end(spark, sf):
    with pytest.raises(RuntimeError, match="after 2 rounds"):
        graph.pagerank(catalogue.edges(spark, sf), max_iter=2)


def test_samples_don_t_depend_on_partitions(spark):
    edges = spark.range(2000).selectExpr("id % 500 AS user_id", "id % 7 AS follower_id")
    one, two = (sorted(map(tuple, sampling.sample_distinct(e, 10, 1, seed=3).collect())) for e in (edges, edges.repartition(3).unionByName(edges)))
    assert one == two and len(one) == len(set(one)) and 0 < len(one) < 500

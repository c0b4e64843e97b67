"""Properties that hold for any input."""

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lexigraph.functions.text import STOP_WORDS, porter_stem
from lexigraph.operators import graph, ir, sampling, search
from lexigraph.plans import catalogue, pipelines


def test_degrees_sum_to_edges(spark, sf):
    edges = catalogue.edges(spark, sf)
    counts = sampling.follower_counts(edges)
    assert counts.agg(F.sum("followers")).first()[0] == edges.count()
    assert sampling.follower_histogram(counts).agg(F.sum(F.col("followers") * F.col("users"))).first()[0] == edges.count()


def test_ranks_are_bounded_below(spark, sf):
    ranks = graph.pagerank(catalogue.edges(spark, sf), max_iter=4, tol=None)
    assert ranks.agg(F.min("rank")).first()[0] >= 0.15 - 1e-12


def test_norms_are_one(spark, sf):
    state = graph.hits(graph.retweet_edges(catalogue.retweets(spark, sf)), max_iter=2, tol=None)
    assert tuple(graph.l2_norms(state, "hub", "auth").first()) == pytest.approx((1, 1))


def test_scaled_weights_lie_between_0_and_1(spark, sf):
    scaled = ir.normalise_tfidf(pipelines.score_terms(catalogue.tweets(spark, sf)).withColumnRenamed("score", "tfidf"), (3.0, 9.0))
    low, high = scaled.agg(F.min("tfidf"), F.max("tfidf")).first()
    assert low == 0 and high == 1


def test_more_words_find_no_more(spark, sf):
    index = pipelines.score_terms(catalogue.tweets(spark, sf)).cache()
    both, one = (search.search(index, search.parse_query(q)).select("tid") for q in (["thing", "from"], ["thing"]))
    assert both.count() > 0 and both.exceptAll(one).count() == 0


@settings(max_examples=400, deadline=None)
@given(st.text("abcdefghijklmnopqrstuvwxyz0123456789", max_size=14))
def test_stems_never_grow(word):
    stem = porter_stem(word)
    assert len(stem) <= len(word) and (stem == word or len(word) > 2)


def test_stop_words_are_33():
    assert len(set(STOP_WORDS)) == 33

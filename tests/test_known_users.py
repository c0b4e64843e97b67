"""Retweets by known users: the whole names table, and users it lacks."""

from lexigraph.operators import crawl
from lexigraph.plans import catalogue

from .conftest import same_as_sql


def test_query_uses_all_names(spark, sf, duck):
    sql = "SELECT l_orderkey AS tid, o_custkey AS author_id, l_suppkey AS retweeter FROM lineitem JOIN orders ON o_orderkey = l_orderkey WHERE l_suppkey IN (SELECT c_custkey FROM customer)"
    same_as_sql(catalogue.QUERIES["known_user_semi"](spark, sf), duck, sql)


def test_unknown_users_go(spark):
    rows = spark.createDataFrame([(1, 7), (2, 8), (3, 9), (4, None), (5, 7)], "tid long, retweeter long")
    users = spark.createDataFrame([(7, "a"), (9, "b"), (9, "b"), (11, "c")], "user_id long, screen_name string")
    assert sorted(r.tid for r in crawl.known_only(rows, users, "retweeter").collect()) == [1, 3, 5]

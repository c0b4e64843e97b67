import math
import re

import pytest
from pyspark.sql import functions as F

from lexigraph.operators import crawl, ir, search
from lexigraph.plans import pipelines
from lexigraph.sources import logs, stores


@pytest.fixture(scope="module")
def tweets(spark):
    return spark.createDataFrame([(1, 10, "cats running"), (1, 11, "cat \"ran\""), (2, 12, "dogs run"), (2, 12, "dogs run")], "uid long, tid long, text string")


def test_weights(spark, tweets):
    tf = {(r.stem, r.tid): r.tf for r in ir.term_frequency(tweets).collect()}
    assert tf == {("cat", 10): 1, ("run", 10): 1, ("cat", 11): 1, ("ran", 11): 1, ("dog", 12): 2, ("run", 12): 2}
    df = {r.stem: r.df for r in ir.document_frequency(tweets).collect()}
    assert df == {"cat": 2, "run": 3, "ran": 1, "dog": 2}
    got = {(r.stem, r.tid): r.score for r in pipelines.score_terms(tweets, n_docs=100).collect()}
    assert got["dog", 12] == pytest.approx(2 * math.log(50))


def test_strict_joins(spark, tweets):
    tf, idf = ir.term_frequency(tweets), ir.idf(ir.document_frequency(tweets), 4).where("stem <> 'ran'")
    assert ir.tfidf(tf, idf).where("stem = 'ran'").count() == 0
    with pytest.raises(Exception, match="no idf for ran"):
        ir.tfidf(tf, idf, strict=True).collect()
    ranks = spark.createDataFrame([(10, 1.0)], "tid long, turank double")
    with pytest.raises(Exception, match="no rank for"):
        ir.combine(ir.tfidf(tf, idf), ranks, strict=True).collect()


def test_min_max(spark):
    xs = spark.createDataFrame([(0.0,), (2.0,), (3.0,), (4.0,), (9.0,)], "x double")
    assert [r[0] for r in xs.select(ir.min_max(F.col("x"), 2.0, 4.0)).collect()] == [0, 0, 0.5, 1, 1]


def test_text_order_and_ties(spark):
    s = spark.createDataFrame([(1, 10.0), (2, 9.0), (3, 10.0)], "tid long, score double")
    assert [(r.score, r.tid) for r in ir.sort_dedupe(s).collect()] == [(9.0, 2), (10.0, 1)]
    assert [r.score for r in ir.sort_dedupe(s, as_text=True).collect()] == [10.0, 9.0]


def test_index_round_trip(spark, tweets):
    scores = pipelines.score_terms(tweets)
    for chunk in (None, 1):
        again = ir.explode_index(ir.build_index(scores, chunk))
        assert again.exceptAll(scores).count() == 0 and scores.exceptAll(again).count() == 0


def test_parse_query():
    assert search.parse_query("Running:the:cats!") == ["run", "cat"]
    assert search.parse_query("two words") == ["twoword"]
    with pytest.raises(ValueError):
        search.parse_query("the:of")


def test_search(spark):
    index = spark.createDataFrame([("a", 1, 1.0), ("b", 1, 2.0), ("a", 2, 3.0), ("b", 2, 0.0), ("a", 3, 9.0), ("a", 1, 0.5)], "stem string, tid long, score double")
    assert [tuple(r) for r in search.search(index, ["a", "b"]).collect()] == [(1, 3.0), (2, 3.0)]
    assert [tuple(r) for r in search.search(index, ["a", "b"], collapse_ties=True).collect()] == [(2, 3.0)]
    assert search.search(index, ["zzz"]).count() == 0
    both = {r.tid for r in search.search(index, ["a", "b"]).collect()}
    assert both <= {r.tid for r in search.search(index, ["a"]).collect()}
    texts = search.with_text(search.search(index, ["a"], limit=2), spark.createDataFrame([(3, "x")], "tid long, text string"))
    assert [tuple(r) for r in texts.collect()] == [(3, 9.0, "x"), (2, 3.0, "Error")]


def test_stored_search(spark, tweets, tmp_path):
    out = str(tmp_path)
    pipelines.write_search_tables(spark, pipelines.score_terms(tweets), tweets, out, buckets=7)
    assert [(r.tid, r.text) for r in pipelines.query(spark, out, "cats:running", buckets=7).collect()] == [(10, "cats running")]
    assert [(r.tid, r.text) for r in pipelines.query(spark, out, "cats:running", limit=1, buckets=7).collect()] == [(10, "cats running")]
    assert stores.lookup(spark, f"{out}/texts", "tid", [11], 7).first().text == "cat ran"
    assert stores.lookup(spark, f"{out}/texts", "tid", [], 7).count() == 0
    assert {r.tid for r in stores.read_term(spark, f"{out}/terms", "run").collect()} == {10, 12}
    plan = stores.lookup(spark, f"{out}/index", "stem", ["run"], 7)._jdf.queryExecution().toString()
    assert re.search(r"PartitionFilters: \[[^\]]*bucket#\d+ = 5", plan) and re.search(r"PushedFilters: \[[^\]]*EqualTo\(stem,run\)", plan)


def test_exports(spark, tweets, tmp_path):
    index = ir.build_index(pipelines.score_terms(tweets).withColumn("score", F.lit(1.5)))
    lines = stores.index_lines(index)
    assert lines.where("line LIKE '%dog%'").first().line == '\t"dog" : "12:1.5",'
    stores.write_parts(lines, f"{tmp_path}/i")
    part = lines.where("line LIKE '%\"run\"%'").first().part
    found = stores.parse_postings(stores.read_part(spark, f"{tmp_path}/i", part, "run"))
    assert sorted((r.tid, r.score) for r in found.collect()) == [(10, 1.5), (12, 1.5)]
    text = stores.text_lines(ir.text_store(tweets)).where("line LIKE '%\"11\"%'").first()
    assert text.line == '\t"11" : "cat ran",'
    html = stores.html_lines(spark.createDataFrame([(1, 0.5, '<b>&"')], "tid long, score double, text string")).first().line
    assert html == "<p>0.5 1 &lt;b&gt;&amp;&quot;</p>"


def test_logs(spark, tmp_path):
    rows = {
        "retweets": [(1, 2, [3, 4]), (5, 6, [7])], "tweets": [(1, 2, "a\tb")], "tf": [("w", 1, 2, 3)], "idf": [("w", 1.0e-4)], "social_graph": [(1, 2)], "turank": [(1, 1.0e7)],
    }
    for name, values in rows.items():
        schema = ", ".join(f"{c} {k}" for c, k in logs.LOGS[name])
        logs.write_log(spark.createDataFrame(values, schema), name, f"{tmp_path}/{name}")
        good, bad = logs.read_log(spark, name, f"{tmp_path}/{name}")
        assert sorted(map(tuple, good.collect())) == sorted(values) and bad.count() == 0
    assert sorted(r.value for r in spark.read.text(f"{tmp_path}/retweets").collect()) == ["1\t2\t3,4,", "5\t6\t7,"]
    (tmp_path / "bad").write_text("1\tx\n2\n3\t4\n")
    good, bad = logs.read_log(spark, "social_graph", f"{tmp_path}/bad")
    assert [tuple(r) for r in good.collect()] == [(3, 4)] and sorted(r.line for r in bad.collect()) == ["1\tx", "2"]
    kv = [tuple(r) for r in logs.read_key_values(spark, f"{tmp_path}/bad").collect()]
    assert kv == [("1", "x"), ("2", ""), ("3", "4")]
    assert sorted(r.user_id for r in logs.known_users(spark, f"{tmp_path}/bad").collect()) == [1, 2, 3]
    assert logs.crawled_users(spark, f"{tmp_path}/none").count() == 0
    logs.write_sequence(spark.createDataFrame([("auth", 0.5)], "k string, v double"), f"{tmp_path}/seq")
    assert [tuple(r) for r in logs.read_sequence(spark, f"{tmp_path}/seq").collect()] == [("auth", 0.5)]


def test_crawl(spark):
    users = spark.createDataFrame([(1,), (2,), (3,)], "user_id long")
    crawled = spark.createDataFrame([(3,)], "user_id long")
    statuses = spark.createDataFrame(
        [(1, False, 10, "a\nb", "{}", 2, None, None, [2, 9]), (1, False, 11, "c", "{}", 0, 50, 2, []), (1, False, 12, "d", "{}", 0, 51, 99, []), (2, True, 13, "e", "{}", 1, None, None, []), (3, False, 14, "f", "{}", 1, None, None, [])],
        "uid long, protected boolean, tid long, text string, raw string, favorite_count long, retweet_of long, retweet_author long, retweeters array<long>",
    )
    got = {k: sorted(map(tuple, v.collect())) for k, v in crawl.route(statuses, users, crawled).items()}
    assert got == {"tweets": [(1, 10, "a b")], "retweets": [(10, 1, [2]), (50, 2, [1])], "favorites": [(10, 2)], "full_tweets": [(10, "{}")], "crawl_log": [(1,)]}
    assert [tuple(r) for r in crawl.shard_round_robin(users, 2).orderBy("user_id").collect()] == [(1, 0), (2, 1), (3, 0)]
    assert sorted(r.user_ids for r in crawl.user_batches(users, 2).collect()) == [[1, 2], [3]]


def test_programs(spark, tmp_path):
    (tmp_path / "g").write_text("1\t2\n1\t3\n2\t3\n3\t1\n")
    (tmp_path / "n").write_text("1\tann\n9\tbob\n")
    (tmp_path / "t").write_text("1\t10\tx\n2\t20\ty\n")
    (tmp_path / "r").write_text("10\t1\t2,3,\n")
    out = str(tmp_path / "out")
    pipelines.sample_graph(spark, str(tmp_path / "g"), str(tmp_path / "n"), out, 4, 4)
    assert [r.value for r in spark.read.text(f"{out}/names").collect()] == ["1\tann"]
    assert sorted(r.value for r in spark.read.text(f"{out}/analytics").collect()) == ["1\t2", "2\t1", "3\t1"]
    pipelines.rank_users(spark, str(tmp_path / "g"), f"{out}/pr")
    pipelines.rank_hits(spark, str(tmp_path / "r"), f"{out}/hits")
    pipelines.rank_tweets(spark, str(tmp_path / "t"), str(tmp_path / "r"), str(tmp_path / "g"), f"{out}/tu")
    assert spark.read.parquet(f"{out}/pr").count() == 3 and spark.read.parquet(f"{out}/hits").count() == 3
    assert [r.value.split("\t")[0] for r in spark.read.text(f"{out}/tu").collect()] == ["10", "20"]


def test_stream(spark, tmp_path):
    from lexigraph.streaming import tokens

    rows = spark.createDataFrame([(1, 10, "cats running", "2024-01-01 00:00:00"), (1, 10, "cats running", "2024-01-01 00:10:00"), (2, 11, "dogs", "2024-01-03 00:00:00")], "uid long, tid long, text string, at string").withColumn("at", F.col("at").cast("timestamp"))
    rows.write.parquet(f"{tmp_path}/in")
    stream = tokens.token_stream(tokens.read_tweets(spark, f"{tmp_path}/in"))
    q = tokens.append(stream, f"{tmp_path}/out", f"{tmp_path}/ck")
    q.awaitTermination(120)
    assert sorted((r.tid, r.stem) for r in spark.read.parquet(f"{tmp_path}/out").collect()) == [(10, "cat"), (10, "run"), (11, "dog")]

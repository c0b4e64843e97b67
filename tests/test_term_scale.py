"""What moves when terms are counted and scored."""

import pytest
from pyspark.sql import functions as F

from lexigraph.functions import text as tx
from lexigraph.operators import ir
from lexigraph.plans import pipelines
from lexigraph.sources import stores


def moves(df):
    """The exchanges of a plan that hasn't run."""
    return [x.strip() for x in df._jdf.queryExecution().executedPlan().toString().split("\n") if "Exchange " in x]


@pytest.fixture(scope="module")
def tweets(spark):
    rows = [(1, 10, "cats running a cat"), (1, 11, "run ran"), (None, 12, "dogs run"), (None, 12, "dogs run dogs"), (2, 12, "dogs"), (3, 13, None), (3, 14, "")]
    return spark.createDataFrame(rows, "uid long, tid long, text string")


def test_terms_are_counted_within_their_row(spark, tweets):
    items = spark.createDataFrame([(["b", "a", "b"],), ([],), (None,), ([""],)], "x array<string>")
    got = [r[0] and [tuple(y) for y in r[0]] for r in items.select(tx.counted(F.col("x"))).collect()]
    assert got == [[("a", 1), ("b", 2)], [], None, [("", 1)]]
    assert moves(ir.term_counts(tweets.where("tid < 12"))) == []
    assert moves(ir.term_frequency(tweets.where("tid < 12"), stemmed=False)) == []
    counts = {(r.uid, r.tid, r.stem): (r.tf, r.rows) for r in ir.term_counts(tweets).collect()}
    assert counts == {(1, 10, "cat"): (2, 1), (1, 10, "run"): (1, 1), (1, 11, "run"): (1, 1), (1, 11, "ran"): (1, 1), (None, 12, "dog"): (3, 2), (None, 12, "run"): (2, 2), (2, 12, "dog"): (1, 1)}


def test_scored_terms_move_once(spark, tweets):
    single = tweets.where("tid < 12")
    assert len(moves(pipelines.score_terms(single))) == 1
    assert len(moves(ir.build_index(pipelines.score_terms(single)))) == 1
    found = pipelines.score_terms(single).where("stem = 'run'")._jdf.queryExecution().optimizedPlan().toString()
    assert found.index("Window") < found.index("= run)")  # nearer to the texts, so other terms don't move


def test_ranks_meet_texts(spark, tweets):
    """As if ranks were joined to the scores: several ranks of a tid give several rows, none gives none, df counts all."""
    ranks = spark.createDataFrame([(10, 1.0), (10, 2.0), (12, 50.0), (11, None), (99, 3.0)], "tid long, turank double")
    got = pipelines.score_terms(tweets, ranks, tfidf_bounds=(0.1, 2.0))
    want = ir.combine(ir.normalise_tfidf(pipelines.score_terms(tweets).withColumnRenamed("score", "tfidf"), (0.1, 2.0)), ranks)
    fix = lambda df: sorted(((r.stem, r.tid, r.score and round(r.score, 9)) for r in df.collect()), key=repr)
    assert fix(got) == fix(want) and len(fix(got)) == 9


def test_chunks_move_scores_once(spark, tweets):
    scores = pipelines.score_terms(tweets.where("tid < 12"))
    assert len(moves(ir.build_index(scores, chunk=1))) == 2  # by stem, then a stem's chunks apart


def test_search_tables_score_once(spark, tweets, tmp_path):
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    scores = pipelines.score_terms(tweets).mapInArrow(count, "stem string, tid long, score double").repartition(2)
    pipelines.write_search_tables(spark, scores, tweets, str(tmp_path), buckets=3)
    written = spark.read.parquet(f"{tmp_path}/index").count()
    assert seen.value == written == spark.read.parquet(f"{tmp_path}/terms").count()
    assert stores.read_term(spark, f"{tmp_path}/terms", "run").columns == ["stem", "tid", "score"]


def test_partitions_of_the_exports_need_no_list(spark):
    words = spark.createDataFrame([("",), ("a",), ("abcde",), ("abcdef",), ("zzzzzz",), ("￿￿￿￿￿",), ("éüßñø",)], "w string")
    part = F.when(F.length("w") > 5, F.substr("w", F.length("w") - 5, F.lit(5))).otherwise(F.col("w"))
    got = words.select(tx.index_partition(F.col("w")), (tx.string_hash(part) % 1000).cast("int"))
    assert all(a == b for a, b in got.collect())
    assert "aggregate(" not in got.select(got.columns[0])._jdf.queryExecution().optimizedPlan().toString()

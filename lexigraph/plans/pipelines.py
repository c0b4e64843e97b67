"""The programs of the library, end to end: sampling, ranking, offline scoring, search (entries A to D)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import graph, ir, sampling, search
from ..sources import logs, stores
from ..storage import small, staged


def sample_graph(spark: SparkSession, edges_path: str, names_path: str, out: str, total: int, sample: int, seed: int = 0) -> None:
    """The sampled graph, follower counts, histogram and filtered names, under out (entry D)."""
    lines = sampling.sample_distinct(logs.read_lines(spark, edges_path), total, sample, seed)
    lines.select(F.col("line").alias("value")).write.mode("overwrite").text(f"{out}/sample")
    edges, _ = logs.read_log(spark, "social_graph", f"{out}/sample")
    counts = staged(sampling.follower_counts(edges), "counts")
    logs.write_log(counts, "follower_counts", f"{out}/analytics")
    logs.write_log(sampling.follower_histogram(counts), "follower_histogram", f"{out}/histogram")
    names, _ = logs.read_log(spark, "screen_names", names_path)
    logs.write_log(sampling.screen_name_filter(names, counts), "screen_names", f"{out}/names")


def rank_users(spark: SparkSession, edges_path: str, out: str, **kw) -> None:
    edges, _ = logs.read_log(spark, "social_graph", edges_path)
    graph.pagerank(edges, **kw).write.mode("overwrite").parquet(out)


def rank_hits(spark: SparkSession, retweets_path: str, out: str, **kw) -> None:
    retweets, _ = logs.read_log(spark, "retweets", retweets_path)
    graph.hits(graph.retweet_edges(retweets), **kw).write.mode("overwrite").parquet(out)


def rank_tweets(spark: SparkSession, tweets_path: str, retweets_path: str, edges_path: str, out: str, **kw) -> None:
    """tid, turank as text, by tid (entry B)."""
    tweets, _ = logs.read_log(spark, "tweets", tweets_path)
    retweets, _ = logs.read_log(spark, "retweets", retweets_path)
    edges, _ = logs.read_log(spark, "social_graph", edges_path)
    ranks = graph.turank(tweets.select("uid", "tid"), retweets, edges, **kw)
    logs.write_log(graph.tweet_ranks(ranks).orderBy("tid"), "turank", out)


def score_terms(tweets: DataFrame, ranks: DataFrame | None = None, n_docs: int | None = None, tfidf_bounds: tuple[float, float] | None = None, rank_bounds: tuple[float, float] = ir.TURANK_BOUNDS, stemmed: bool = True) -> DataFrame:
    """stem, tid, score from tweets (uid, tid, text), read and stemmed once (entry A): frequencies, weights, scaling, ranks.

    n_docs: the corpus size, counted where None. tfidf_bounds: None leaves weights unscaled. Without ranks the score is
    the weight alone.
    """
    n = tweets.count() if n_docs is None else n_docs
    # ranks meet the texts, not their terms; a text without a rank still counts in df, one with several counts once
    lists = None if ranks is None else ranks.groupBy("tid").agg(F.collect_list(F.struct("turank")).alias("ranks"))
    weighted = ir.with_df(ir.term_counts(tweets, stemmed, lists))
    weight = F.col("tf") * F.log(F.lit(n) / F.col("df"))
    if tfidf_bounds:
        weight = ir.min_max(weight, *tfidf_bounds)
    if ranks is None:
        return weighted.select("stem", "tid", weight.alias("score"))
    each = weighted.select("stem", "tid", weight.alias("tfidf"), F.inline("ranks"))
    return each.select("stem", "tid", (ir.min_max(F.col("turank"), *rank_bounds) + F.col("tfidf")).alias("score"))


def write_search_tables(spark: SparkSession, combined: DataFrame, tweets: DataFrame, out: str, buckets: int = stores.BUCKETS) -> None:
    """The bucketed index and text store, and the term index. combined is computed once: the term index is made from the
    written index."""
    stores.write_bucketed(combined, "stem", f"{out}/index", buckets)
    stores.write_bucketed(ir.text_store(tweets), "tid", f"{out}/texts", buckets)
    stores.write_terms(spark.read.parquet(f"{out}/index").select(*combined.columns), f"{out}/terms")


def query(spark: SparkSession, tables: str, words: str | list[str], limit: int | None = None, buckets: int = stores.BUCKETS) -> DataFrame:
    """tid, score, text of a search over tables written by write_search_tables (entry C): only the terms' buckets are read,
    and of the texts, those of the hits.

    With a limit the hits' buckets are named to the scan; without one the hits, written once, are joined by bucket, so
    that the scan leaves out partitions when it runs.
    """
    terms = search.parse_query(words)
    hits = staged(search.search(stores.lookup(spark, f"{tables}/index", "stem", terms, buckets), terms, limit), "hits")
    if limit is not None:
        texts = stores.lookup(spark, f"{tables}/texts", "tid", [r.tid for r in hits.select("tid").collect()], buckets)
    else:
        own = hits.select(F.col("tid").alias("t"), stores.bucket(F.col("tid"), buckets).alias("b")).distinct()
        texts = spark.read.parquet(f"{tables}/texts")
        texts = texts.join(small(own), (texts["bucket"] == F.col("b")) & (texts["tid"] == F.col("t"))).select("tid", "text")
    return search.with_text(hits, texts)

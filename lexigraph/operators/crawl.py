"""What the crawler does to the data it gets, without its network: P12-P16, J9, J10, S15-S18."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import one_line
from ..storage import small, staged

OWN_TWEETS = 20


def known_only(df: DataFrame, users: DataFrame, column: str) -> DataFrame:
    """Rows whose user is known."""
    return df.join(users.select(F.col("user_id").alias("_u")), F.col(column) == F.col("_u"), "left_semi")


def to_crawl(users: DataFrame, crawled: DataFrame) -> DataFrame:
    """Users not crawled yet."""
    return users.join(crawled, "user_id", "left_anti")


def first_per_user(tweets: DataFrame, n: int = OWN_TWEETS) -> DataFrame:
    """The n newest tweets of each user, by tid (P12). Ranks are cut per task first, so a prolific user is no hot group."""
    w = W.partitionBy("uid").orderBy(F.desc("tid"))
    return tweets.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= n).drop("_r")


def numbered(df: DataFrame, column: str) -> DataFrame:
    """df with a gapless `position` from 0 in the order of column, without a window over all rows."""
    part = staged(df.repartitionByRange(column).withColumn("_part", F.spark_partition_id()), "ranges")
    sizes = part.groupBy("_part").agg(F.count("*").alias("_n"))
    before = sizes.select("_part", (F.sum("_n").over(W.orderBy("_part")) - F.col("_n")).alias("_before"))
    w = W.partitionBy("_part").orderBy(column)
    return part.join(small(before), "_part").withColumn("position", F.col("_before") + F.row_number().over(w) - 1).drop("_part", "_before")


def shard_round_robin(users: DataFrame, crawlers: int) -> DataFrame:
    """user_id, shard: users in order, dealt in turn."""
    return numbered(users.select("user_id"), "user_id").select("user_id", F.pmod("position", F.lit(crawlers)).cast("int").alias("shard"))


def route(statuses: DataFrame, users: DataFrame, crawled: DataFrame, n: int = OWN_TWEETS) -> dict[str, DataFrame]:
    """The five logs that a crawl of statuses gives.

    statuses: uid, protected, tid, text, raw, favorite_count, retweet_of (tid or null), retweet_author (or null),
    retweeters (a list). Protected and already crawled users go. Retweets of known authors become retweet rows; own
    tweets, the newest n a user, go to the tweet log, with their counts and known retweeters.
    """
    todo = statuses.where(~F.col("protected")).join(crawled.select(F.col("user_id").alias("uid")), "uid", "left_anti")
    own = first_per_user(todo.where("retweet_of IS NULL"), n)
    seen = known_only(todo.where("retweet_of IS NOT NULL"), users, "retweet_author")
    listed = known_only(own.where("size(retweeters) > 0").select("tid", "uid", F.explode("retweeters").alias("r")), users, "r")
    lists = listed.groupBy("tid", F.col("uid").alias("author_id")).agg(F.sort_array(F.collect_list("r")).alias("retweeters"))
    return {
        "tweets": own.select("uid", "tid", one_line(F.col("text")).alias("text")),
        "retweets": seen.select(F.col("retweet_of").alias("tid"), F.col("retweet_author").alias("author_id"), F.array("uid").alias("retweeters")).unionByName(lists),
        "favorites": own.where("favorite_count > 0").select("tid", "favorite_count"),
        "full_tweets": own.select("tid", "raw"),
        "crawl_log": todo.select("uid").distinct(),
    }


def user_batches(users: DataFrame, size: int = 100) -> DataFrame:
    """batch, user_ids: ids in order in lists of at most size, the last one shorter (S15, quirk 23)."""
    return numbered(users.select("user_id"), "user_id").groupBy(F.expr(f"position div {int(size)}").alias("batch")).agg(F.sort_array(F.collect_list("user_id")).alias("user_ids"))

"""Extension: the tweet log as a stream. New files in a folder become tokens; a tid counts once within the watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.text import tokenize

SCHEMA = "uid bigint, tid bigint, text string, at timestamp"


def read_tweets(spark: SparkSession, path: str, schema: str = SCHEMA) -> DataFrame:
    return spark.readStream.schema(schema).parquet(path)


def token_stream(tweets: DataFrame, late: str = "1 day", stemmed: bool = True) -> DataFrame:
    """uid, tid, at, stem of tweets whose tid wasn't seen within the watermark; older state is dropped."""
    once = tweets.withWatermark("at", late).dropDuplicatesWithinWatermark(["tid"])
    return tokenize(once.select("uid", "tid", "at", "text"), stemmed)


def term_counts(tokens: DataFrame, window: str = "1 hour") -> DataFrame:
    """start, stem, n for windows that the watermark has passed."""
    return tokens.groupBy(F.window("at", window), "stem").agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), "stem", "n")


def append(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Append to Parquet in path; with the checkpoint a restart goes on where it stopped."""
    return stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()

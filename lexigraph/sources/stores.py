"""The inverted index, the text store and the term index as files, and their point readers.

As tables they are Parquet, partitioned by a bucket that a reader recomputes, so a lookup opens one bucket. The text
exports keep the older layout: 1000 parts named by a string hash, lines of quoted pairs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import index_partition, part_name, text_partition

BUCKETS = 1000


def bucket(key: Column, n: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(n)).cast("int")


def write_bucketed(df: DataFrame, key: str, path: str, buckets: int = BUCKETS) -> None:
    """df by bucket of key, sorted by key within a file, so row groups' bounds prune further. One exchange; adaptive
    execution joins small buckets in a task and splits a large one, such as a frequent stem's, among several."""
    b = df.withColumn("bucket", bucket(F.col(key), buckets))
    b.hint("rebalance", F.col("bucket")).sortWithinPartitions("bucket", key).write.mode("overwrite").partitionBy("bucket").parquet(path)


def lookup(spark: SparkSession, path: str, key: str, values: list, buckets: int = BUCKETS) -> DataFrame:
    """Rows whose key is among values (S12, S13): only their buckets are listed and read."""
    df = spark.read.parquet(path)
    if not values:
        return df.where("false").drop("bucket")
    kind = df.schema[key].dataType
    wanted = F.array(*(F.lit(v).cast(kind) for v in values))
    at = spark.range(1).select(F.explode(wanted).alias("k")).select(bucket(F.col("k"), buckets).alias("b")).distinct()
    numbers = [r.b for r in at.collect()]
    return df.where(F.col("bucket").isin(numbers) & F.col(key).isin([F.lit(v).cast(kind) for v in values])).drop("bucket")


def write_terms(combined: DataFrame, path: str) -> None:
    """The term index (S11): rows sorted by stem, so that a term's rows lie in few row groups."""
    combined.repartitionByRange("stem").sortWithinPartitions("stem").write.mode("overwrite").parquet(path)


def read_term(spark: SparkSession, path: str, stem: str) -> DataFrame:
    """All rows of a stem (S14); no pages are needed."""
    return spark.read.parquet(path).where(F.col("stem") == stem)


def index_lines(index: DataFrame) -> DataFrame:
    """part, line of the index export: a tab, then the quoted stem and its postings."""
    postings = F.array_join(F.transform("postings", lambda p: F.concat_ws(":", p["tid"].cast("string"), p["score"].cast("string"))), ",")
    return index.select(part_name(index_partition(F.col("stem"))).alias("part"), F.format_string('\t"%s" : "%s",', F.col("stem"), postings).alias("line"))


def text_lines(store: DataFrame) -> DataFrame:
    """part, line of the text export."""
    return store.select(part_name(text_partition(F.col("tid"))).alias("part"), F.format_string('\t"%s" : "%s",', F.col("tid").cast("string"), F.col("text")).alias("line"))


def write_parts(lines: DataFrame, path: str) -> None:
    """part, line as text, a folder a part."""
    lines.hint("rebalance", F.col("part")).select("part", F.col("line").alias("value")).write.mode("overwrite").partitionBy("part").text(path)


def read_part(spark: SparkSession, path: str, part: str, key: str) -> DataFrame:
    """The value of a key in a part of an export: the second quoted string where the first is the key."""
    quoted = F.split("value", '"')
    return spark.read.text(f"{path}/part={part}").where(F.get(quoted, F.lit(1)) == key).select(F.get(quoted, F.lit(3)).alias("value"))


def parse_postings(values: DataFrame) -> DataFrame:
    """tid, score from `tid:score,tid:score`."""
    one = F.explode(F.split("value", ","))
    return values.select(one.alias("x")).select(F.split_part("x", F.lit(":"), F.lit(1)).try_cast("bigint").alias("tid"), F.split_part("x", F.lit(":"), F.lit(2)).try_cast("double").alias("score"))


def html_lines(results: DataFrame) -> DataFrame:
    """A paragraph a result (S22), with markup characters escaped (quirk 28)."""
    safe = F.col("text")
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        safe = F.replace(safe, F.lit(a), F.lit(b))
    return results.select(F.format_string("<p>%s %s %s</p>", F.col("score").cast("string"), F.col("tid").cast("string"), safe).alias("line"))

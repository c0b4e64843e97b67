"""Term weights and indexes: T2-T10, A4-A6, A14-A16, J1, J2, P10, P11, O1."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import clean_text, counted, distinct_terms, telling, term_lists
from ..storage import small, staged

#: The corpus size the source system assumes.
N_DOCS = 10_326_522
TFIDF_BOUNDS = (2.011063703278, 494.130787450104)
TURANK_BOUNDS = (0.18503099884985902, 81.62800157711727)


def term_counts(tweets: DataFrame, stemmed: bool = True, also: DataFrame | None = None) -> DataFrame:
    """uid, tid, stem, tf, rows: a telling term's count in the rows of a (uid, tid), and how many of them hold it.

    Terms are counted within their row, so none is moved; only those of keys that several rows have are, to be added up.
    also: columns by tid, a row a tid, that go along (null where it has none).
    """
    keys = ["uid", "tid", *([] if also is None else [c for c in also.columns if c != "tid"])]

    def within(rows: DataFrame) -> DataFrame:
        rows = rows if also is None else rows.join(also, "tid", "left")
        return rows.select(*keys, F.inline(counted(term_lists("text", stemmed)))).where(telling(F.col("stem")))

    def one(rows: DataFrame) -> DataFrame:
        return within(rows).select(*keys, "stem", F.col("n").alias("tf"), F.lit(1).cast("long").alias("rows"))

    several = tweets.groupBy("uid", "tid").agg(F.count("*").alias("n")).where("n > 1")
    several = staged(several.select(F.col("uid").alias("_u"), F.col("tid").alias("_t")), "repeated")
    if several.isEmpty():
        return one(tweets)
    same, several = F.col("uid").eqNullSafe(F.col("_u")) & F.col("tid").eqNullSafe(F.col("_t")), small(several)
    added = within(tweets.join(several, same, "left_semi")).groupBy(*keys, "stem").agg(F.sum("n").alias("tf"), F.count("*").alias("rows"))
    return one(tweets.join(several, same, "left_anti")).unionByName(added)


def term_frequency(tweets: DataFrame, stemmed: bool = True) -> DataFrame:
    """stem, uid, tid, tf; repeated (uid, tid) rows add up."""
    return term_counts(tweets, stemmed).select("stem", "uid", "tid", "tf")


def document_frequency(tweets: DataFrame, stemmed: bool = True) -> DataFrame:
    """stem, df: rows that hold the stem, repeated rows counted (A5)."""
    return tweets.select(F.explode(distinct_terms("text", stemmed)).alias("stem")).groupBy("stem").agg(F.count("*").alias("df"))


def with_df(counts: DataFrame) -> DataFrame:
    """term_counts with df, the rows that hold the stem. The rows are moved once, by stem, and a stem's are then in one task,
    which holds them on disk where memory ends; a filter on stem goes before the move."""
    return counts.withColumn("df", F.sum("rows").over(Window.partitionBy("stem")))


def idf(frequencies: DataFrame, n_docs: int | Column) -> DataFrame:
    """stem, idf = ln(n / df)."""
    n = n_docs if isinstance(n_docs, Column) else F.lit(n_docs)
    return frequencies.select("stem", F.log(n / F.col("df")).alias("idf"))


def tfidf(tf: DataFrame, idf_: DataFrame, strict: bool = False) -> DataFrame:
    """stem, tid, tfidf (T4, J1). strict: fail where a stem has no idf, as the source system does; else such rows go."""
    j = tf.join(idf_, "stem", "left" if strict else "inner")
    value = F.coalesce("idf", F.raise_error(F.concat(F.lit("no idf for "), F.col("stem"))).cast("double")) if strict else F.col("idf")
    return j.select("stem", "tid", (F.col("tf") * value).alias("tfidf"))


def min_max(x: Column, low: float, high: float) -> Column:
    """x scaled to 0..1 and clamped."""
    return F.when(x >= high, 1.0).when(x <= low, 0.0).otherwise((x - low) / (high - low))


def normalise_tfidf(weights: DataFrame, bounds: tuple[float, float] = TFIDF_BOUNDS) -> DataFrame:
    """stem, tid, tfidf in 0..1 (T5)."""
    return weights.select("stem", "tid", min_max(F.col("tfidf"), *bounds).alias("tfidf"))


def combine(weights: DataFrame, ranks: DataFrame, bounds: tuple[float, float] = TURANK_BOUNDS, strict: bool = False) -> DataFrame:
    """stem, tid, score = scaled turank + tfidf."""
    j = weights.join(ranks, "tid", "left" if strict else "inner")
    value = F.coalesce("turank", F.raise_error(F.concat(F.lit("no rank for "), F.col("tid").cast("string"))).cast("double")) if strict else F.col("turank")
    return j.select("stem", "tid", (min_max(value, *bounds) + F.col("tfidf")).alias("score"))


def sort_dedupe(scores: DataFrame, id_: str = "tid", score: str = "score", as_text: bool = False) -> DataFrame:
    """score and the least id that has it, by score (O1, A15, T7); as_text: by the score as text, as the source system does."""
    out = scores.groupBy(score).agg(F.min(id_).alias(id_))
    return out.orderBy(F.col(score).cast("string") if as_text else F.col(score))


def build_index(combined: DataFrame, chunk: int | None = None) -> DataFrame:
    """stem, postings (tid, score) by tid, repeats kept.

    chunk: postings a row at about most; a frequent stem then has several rows (a column `part`), so no task has to hold
    all of its postings.
    """
    posting = F.sort_array(F.collect_list(F.struct("tid", "score"))).alias("postings")
    if chunk is None:
        return combined.groupBy("stem").agg(posting)
    parts = F.ceil(F.count("*").over(Window.partitionBy("stem")) / F.lit(chunk))
    split = combined.withColumn("parts", parts).select("stem", "tid", "score", F.pmod(F.xxhash64("tid"), F.col("parts")).cast("int").alias("part"))
    return split.repartition("stem", "part").groupBy("stem", "part").agg(posting)


def explode_index(index: DataFrame) -> DataFrame:
    """stem, tid, score: build_index undone."""
    return index.select("stem", F.explode("postings").alias("p")).select("stem", "p.tid", "p.score")


def text_store(tweets: DataFrame) -> DataFrame:
    """tid, text without quotes and breaks; each row is written."""
    return tweets.select("tid", clean_text(F.col("text")).alias("text"))

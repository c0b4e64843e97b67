"""Keyword search over an index of (stem, tid, score): Q1-Q4, J7, J8, A16, A17, O2."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import STOP_WORDS, porter_stem


def parse_query(query: str | list[str], stemmed: bool = True) -> list[str]:
    """The query's terms, normalised as tokens are (Q1); a string is split at colons. Stop words go; none left: ValueError."""
    words = query.split(":") if isinstance(query, str) else query
    clean = ["".join(c for c in w if c.isascii() and c.isalnum()).lower() for w in words]
    terms = [porter_stem(w) if stemmed else w for w in clean]
    kept = list(dict.fromkeys(t for t in terms if t and t not in STOP_WORDS))
    if not kept:
        raise ValueError("the query has stop words only")
    return kept


def search(index: DataFrame, terms: list[str], limit: int | None = None, collapse_ties: bool = False) -> DataFrame:
    """tid, score of the rows that have all terms, by descending score (Q2, Q3). index: stem, tid, score.

    The filter on stem reaches the scan; scores of a stem and tid that repeat count once, the greatest. collapse_ties: of
    equal scores only the greatest tid stays.
    """
    once = index.where(F.col("stem").isin(terms)).groupBy("tid", "stem").agg(F.max("score").alias("score"))
    hits = once.groupBy("tid").agg(F.sum("score").alias("score"), F.count("*").alias("n")).where(F.col("n") == len(terms)).drop("n")
    if collapse_ties:
        hits = hits.groupBy("score").agg(F.max("tid").alias("tid")).select("tid", "score")
    ranked = hits.orderBy(F.desc("score"), "tid")
    return ranked.limit(limit) if limit is not None else ranked


def with_text(hits: DataFrame, store: DataFrame, missing: str = "Error") -> DataFrame:
    """tid, score, text; a tid without text has `missing`, one with several the least."""
    texts = hits.join(store.select("tid", "text"), "tid", "left").groupBy("tid", "score").agg(F.min("text").alias("text"))
    return texts.select("tid", "score", F.coalesce("text", F.lit(missing)).alias("text")).orderBy(F.desc("score"), "tid")

"""Quality rules whose cutoffs adapt to language and source, by mergeable quantile sketches; DataFrame functions only.

Texts that pass the base rule get three rates in thousandths (symbols a word, capitals a letter, repeated lines). A rate's
sketch, and that of what it is a share of, is a count for each logarithmic bucket (relative error under 5 %), so sketches
merge by adding counts and no order matters. A language and source is judged by its own sketch to which the shape of its
language's is added with the weight of PRIOR_DOCS documents, as that of all documents is to the language's; so a group of
any size has thresholds, a small one mostly its language's. A limit comes from three quantiles: median and upper quartile
of the rate give its centre and spread on a logarithmic scale, and the median length gives the unit, one event in a text of
that length. A text fails where its count exceeds what the limit gives for its own length by more than SIGMAS standard
deviations of such a count; no cutoff is fixed.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .runtime import bind, small, staged

GAMMA = 1.05
#: The last bucket, for rates and lengths over two millions.
LAST = 300
#: A limit lies so many times the logarithm from median to upper quartile over the median (5.4 standard deviations of a
#: lognormal rate).
SPREADS = 8
SIGMAS = 4
PRIOR_DOCS = 50
WINDOW = 8
#: Each rate's count and what it is a share of.
RATES = {"symbols": ("n_symbols", "n_words"), "capitals": ("n_capitals", "word_chars"), "dup_lines": ("n_dup_lines", "n_lines")}
_SPACE = r"[\x20\x09-\x0D]+"
_BASE = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def _covered(windows: Column) -> Column:
    """Words in windows that occur twice or more; windows: a hash for each window, by position."""
    at = lambda s, i: F.get(s, i)["h"]
    ordered = F.sort_array(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("p"))))
    again = lambda s: F.filter(s, lambda x, i: x["h"].eqNullSafe(at(s, i - 1)) | x["h"].eqNullSafe(at(s, i + 1)))
    positions = bind(ordered, lambda s: F.sort_array(F.transform(again(s), lambda x: x["p"])))
    start = F.struct(F.lit(0).alias("end"), F.lit(0).cast("long").alias("n"))
    grown = lambda acc, p: F.struct((p + WINDOW).alias("end"), (acc["n"] + p + WINDOW - F.greatest(p, acc["end"])).alias("n"))
    return F.when(F.size(F.array_distinct(windows)) == F.size(windows), F.lit(0).cast("long")).otherwise(F.aggregate(positions, start, grown, lambda acc: acc["n"]))


def _of_words(words: Column, n: Column) -> Column:
    windows = F.transform(F.sequence(F.lit(0), n - WINDOW), lambda i: F.xxhash64(*(F.get(words, i + k) for k in range(WINDOW))))
    repeats = F.when(n > WINDOW, bind(windows, _covered)).otherwise(F.lit(0).cast("long"))
    return F.struct(n.cast("long").alias("n_words"), repeats.alias("n_repeat_words"))


def measures(text: Column) -> Column:
    """A struct of the base counts and n_lines (lines with a word), n_capitals; a null text counts as empty."""

    def of(t: Column) -> Column:
        trimmed = F.btrim(t, F.lit(" \t\n\x0b\x0c\r"))
        counts = bind(F.split(trimmed, _SPACE), lambda w: bind(F.when(trimmed == "", 0).otherwise(F.size(w)), lambda n: _of_words(w, n)))
        lines = F.filter(F.split(t, "\n", -1), lambda line: line.rlike(r"[^\x20\x09-\x0D]"))
        by_line = bind(lines, lambda x: F.struct(F.size(x).cast("long").alias("n"), F.size(F.array_distinct(x)).cast("long").alias("d")))
        together = lambda c, x: F.struct(
            c["n_words"].alias("n_words"),
            F.length(F.regexp_replace(t, _SPACE, "")).cast("long").alias("word_chars"),
            F.length(F.regexp_replace(t, r"[^#*$%&|<>]+", "")).cast("long").alias("n_symbols"),
            (x["n"] - x["d"]).alias("n_dup_lines"),
            c["n_repeat_words"].alias("n_repeat_words"),
            x["n"].alias("n_lines"),
            F.length(F.regexp_replace(t, r"\P{Lu}+", "")).cast("long").alias("n_capitals"),
        )
        return bind(counts, lambda c: bind(by_line, lambda x: together(c, x)))

    return bind(F.coalesce(text.cast("string"), F.lit("")), of)


def failed(m: Column) -> Column:
    """The base rule."""
    return (m["n_words"] < 20) | (100 * m["n_repeat_words"] > 30 * m["n_words"])


def values(m: Column) -> dict[str, Column]:
    """What is sketched: each rate in whole thousandths, 0 without a base, and that base."""
    out = {}
    for k, (a, b) in RATES.items():
        out[k] = F.when(m[b] > 0, F.floor(m[a] * 1000 / m[b])).otherwise(0).cast("long")
        out[b] = m[b]
    return out


def sketch(measured: DataFrame, m: str) -> DataFrame:
    """lang, source, what, bucket, n of the texts that pass the base rule: at most LAST rows a value and group, counted
    before any row is moved."""
    x = values(F.col(m))
    bucket = lambda v: F.when(v > 0, F.least(F.lit(LAST), 1 + F.floor(F.log(v.cast("double")) / F.log(F.lit(GAMMA))))).otherwise(0).cast("int")
    each = F.explode(F.array(*(F.struct(F.lit(k).alias("what"), bucket(v).alias("bucket")) for k, v in x.items())))
    return measured.where(~failed(F.col(m))).select("lang", "source", each.alias("x")).groupBy("lang", "source", "x.what", "x.bucket").agg(F.count("*").alias("n"))


def merged(sketches: DataFrame, *by: str) -> DataFrame:
    return sketches.groupBy(*by, "what", "bucket").agg(F.sum("n").alias("n"))


def shapes(sketches: DataFrame, *by: str) -> DataFrame:
    """by, what, counts: each merged sketch as one array over all buckets."""
    pairs = F.map_from_entries(F.collect_list(F.struct("bucket", "n")))
    counts = F.transform(F.sequence(F.lit(0), F.lit(LAST)), lambda b: F.coalesce(F.element_at("at", b), F.lit(0)).cast("double"))
    return merged(sketches, *by).groupBy(*by, "what").agg(pairs.alias("at")).select(*by, "what", counts.alias("counts"))


def _total(counts: Column) -> Column:
    return F.aggregate(counts, F.lit(0.0), lambda a, x: a + x)


def _with_prior(own: Column, prior: Column) -> Column:
    """own's counts and prior's, scaled to PRIOR_DOCS documents."""
    return bind(_total(prior), lambda t: F.zip_with(own, prior, lambda a, b: a + b * PRIOR_DOCS / t))


def _quantile(counts: Column, total: Column, share: float) -> Column:
    """The value of the first bucket up to which a share of the counts lies."""
    start = F.struct(F.lit(-1).alias("b"), F.lit(0.0).alias("upto"))
    step = lambda acc, n: F.struct(F.when(acc["upto"] < total * share - 1e-6, acc["b"] + 1).otherwise(acc["b"]).alias("b"), (acc["upto"] + n).alias("upto"))
    value = lambda b: F.when(b == 0, 0.0).otherwise(F.round(F.pow(F.lit(GAMMA), b)))
    return F.aggregate(counts, start, step, lambda acc: value(acc["b"]))


def thresholds(sketches: DataFrame) -> DataFrame:
    """lang, source and a limit in thousandths for each rate."""
    every = shapes(sketches).select(F.col("what").alias("w"), F.col("counts").alias("every"))
    lang = shapes(sketches, "lang").join(F.broadcast(every), F.col("what") == F.col("w")).select(F.col("lang").alias("l"), F.col("what").alias("w"), _with_prior(F.col("counts"), F.col("every")).alias("prior"))
    own = shapes(sketches, "lang", "source").join(lang, F.col("lang").eqNullSafe(F.col("l")) & (F.col("what") == F.col("w"))).select("lang", "source", "what", _with_prior(F.col("counts"), F.col("prior")).alias("counts"))
    q = lambda share: _quantile(F.col("counts"), F.col("total"), share)
    at = own.withColumn("total", _total(F.col("counts"))).select("lang", "source", "what", F.struct(q(0.5).alias("mid"), q(0.75).alias("high")).alias("q"))
    wide = at.groupBy("lang", "source").agg(*(F.max(F.when(F.col("what") == k, F.col("q"))).alias(k) for k in dict.fromkeys(x for k, (_, b) in RATES.items() for x in (k, b))))

    def limit(k: str, base: str) -> Column:
        unit = F.ceil(1000 / F.greatest(F.col(f"{base}.mid"), F.lit(1)))
        mid, high = F.col(f"{k}.mid") + unit, F.col(f"{k}.high") + unit
        return F.greatest(F.floor(mid * F.pow(high / mid, F.lit(SPREADS)) - unit + 0.5), mid).cast("long").alias(f"limit_{k}")

    return wide.select("lang", "source", *(limit(k, b) for k, (_, b) in RATES.items()))


def _within(m: Column, k: str) -> Column:
    """Whether a text's count is within its group's limit, give or take SIGMAS deviations of such a count."""
    count, base = RATES[k]
    x, e = m[count].cast("double") * 1000, F.col(f"limit_{k}").cast("double") * m[base]
    return (x <= e) | ((x - e) * (x - e) <= SIGMAS * SIGMAS * 1000 * e)


def judged(measured: DataFrame, m: str) -> DataFrame:
    """measured (lang, source, struct column m; written before) with base_failed, kept and the limits (null in a group
    none of whose texts pass the base rule)."""
    limit = thresholds(staged(sketch(measured, m), "quantiles")).withColumnsRenamed({"lang": "_l", "source": "_s"})
    j = measured.join(small(staged(limit, "limits")), F.col("lang").eqNullSafe(F.col("_l")) & F.col("source").eqNullSafe(F.col("_s")), "left").drop("_l", "_s")
    x = F.col(m)
    within = reduce(lambda a, b: a & b, (_within(x, k) for k in RATES))
    return j.withColumn("base_failed", failed(x)).withColumn("kept", ~failed(x) & within)


def quality_rules(docs: DataFrame) -> DataFrame:
    """One row a row of docs (doc_id, text, lang, source): the base counts, base_failed, kept, limits.

    Null and empty texts fail; a very long text is measured whole; null lang or source is a group of its own; repeated
    rows, and texts with equal rates, are judged alike; other columns are ignored; an empty table gives an empty result.
    """
    measured = staged(docs.select("doc_id", "lang", "source", measures(F.col("text")).alias("m")), "measures")
    return judged(measured, "m").select("doc_id", *(F.col("m")[c].alias(c) for c in _BASE), "base_failed", "kept", *(f"limit_{k}" for k in RATES))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: documents that the rules reject go. Texts are written once with their measures, not measured twice."""
    row = F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("_row")
    measured = staged(docs.select(row, F.col("lang").alias("lang"), F.col("source").alias("source"), measures(F.col("text")).alias("m")), "measured")
    return judged(measured, "m").where("kept").select("_row.*")


ORACLE_SQL = r"""
WITH base AS (
  SELECT doc_id, lang, source, coalesce(text, '') AS t FROM documents
), split AS (
  SELECT doc_id, lang, source, t, list_filter(string_split_regex(t, '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w,
    list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM base
), win AS (
  SELECT doc_id, p, array_to_string(w[p : p + 7], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 6)) AS p FROM split WHERE len(w) >= 8)
), rep AS (
  SELECT doc_id, p FROM (SELECT doc_id, p, count(*) OVER (PARTITION BY doc_id, g) AS c FROM win) WHERE c > 1
), cov AS (
  SELECT doc_id, sum(least(8, coalesce(nxt - p, 8)))::BIGINT AS n FROM (SELECT doc_id, p, lead(p) OVER (PARTITION BY doc_id ORDER BY p) AS nxt FROM rep) GROUP BY doc_id
), m AS (
  SELECT s.doc_id, lang, source, len(w)::BIGINT AS n_words, length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g'))::BIGINT AS word_chars,
    length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g'))::BIGINT AS n_symbols, (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines,
    coalesce(n, 0)::BIGINT AS n_repeat_words, len(l)::BIGINT AS n_lines, length(regexp_replace(t, '\P{Lu}+', '', 'g'))::BIGINT AS n_capitals
  FROM split s LEFT JOIN cov USING (doc_id)
), r AS (
  SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed, CASE WHEN n_words > 0 THEN n_symbols * 1000 // n_words ELSE 0 END AS symbols,
    CASE WHEN word_chars > 0 THEN n_capitals * 1000 // word_chars ELSE 0 END AS capitals, CASE WHEN n_lines > 0 THEN n_dup_lines * 1000 // n_lines ELSE 0 END AS dup_lines FROM m
), long AS (
  SELECT lang, source, what, CASE WHEN v > 0 THEN least(300, 1 + floor(ln(v) / ln(1.05))) ELSE 0 END AS b
  FROM (SELECT lang, source, unnest(['symbols', 'n_words', 'capitals', 'word_chars', 'dup_lines', 'n_lines']) AS what, unnest([symbols, n_words, capitals, word_chars, dup_lines, n_lines]) AS v FROM r WHERE NOT base_failed)
), own AS (
  SELECT lang, source, what, b, count(*)::DOUBLE AS n FROM long GROUP BY ALL
), groups AS (
  SELECT DISTINCT lang, source, what FROM own
), every AS (
  SELECT what, b, n * 50 / sum(n) OVER (PARTITION BY what) AS n FROM (SELECT what, b, sum(n) AS n FROM own GROUP BY ALL)
), lang_own AS (
  SELECT lang, what, b, sum(n) AS n FROM own GROUP BY ALL UNION ALL SELECT lang, what, b, n FROM (SELECT DISTINCT lang, what FROM groups) JOIN every USING (what)
), prior AS (
  SELECT lang, what, b, n * 50 / sum(n) OVER (PARTITION BY lang, what) AS n FROM (SELECT lang, what, b, sum(n) AS n FROM lang_own GROUP BY ALL)
), mixed AS (
  SELECT lang, source, what, b, sum(n) AS n FROM (SELECT * FROM own UNION ALL SELECT g.lang, g.source, g.what, p.b, p.n FROM groups g JOIN prior p ON p.what = g.what AND p.lang IS NOT DISTINCT FROM g.lang) GROUP BY ALL
), cum AS (
  SELECT *, sum(n) OVER (PARTITION BY lang, source, what ORDER BY b) AS upto, sum(n) OVER (PARTITION BY lang, source, what) AS total FROM mixed
), q AS (
  SELECT lang, source, what, min(b) FILTER (upto >= total * 0.5 - 1e-6) AS b50, min(b) FILTER (upto >= total * 0.75 - 1e-6) AS b75 FROM cum GROUP BY ALL
), v AS (
  SELECT lang, source, what, CASE WHEN b50 = 0 THEN 0 ELSE round(pow(1.05, b50)) END AS mid, CASE WHEN b75 = 0 THEN 0 ELSE round(pow(1.05, b75)) END AS high FROM q
), units AS (
  SELECT a.lang, a.source, a.what, a.mid + ceil(1000 / greatest(u.mid, 1)) AS mid, a.high + ceil(1000 / greatest(u.mid, 1)) AS high, ceil(1000 / greatest(u.mid, 1)) AS unit
  FROM v a JOIN v u ON a.lang IS NOT DISTINCT FROM u.lang AND a.source IS NOT DISTINCT FROM u.source
    AND u.what = CASE a.what WHEN 'symbols' THEN 'n_words' WHEN 'capitals' THEN 'word_chars' WHEN 'dup_lines' THEN 'n_lines' END
), lim AS (
  SELECT lang, source, what, greatest(floor(mid * pow(high / mid, 8) - unit + 0.5), mid)::BIGINT AS x FROM units
), wide AS (
  SELECT lang, source, max(x) FILTER (what = 'symbols') AS limit_symbols, max(x) FILTER (what = 'capitals') AS limit_capitals, max(x) FILTER (what = 'dup_lines') AS limit_dup_lines FROM lim GROUP BY ALL
), e AS (
  SELECT r.*, limit_symbols, limit_capitals, limit_dup_lines, n_symbols * 1000.0::DOUBLE AS x1, limit_symbols::DOUBLE * n_words AS e1, n_capitals * 1000.0::DOUBLE AS x2,
    limit_capitals::DOUBLE * word_chars AS e2, n_dup_lines * 1000.0::DOUBLE AS x3, limit_dup_lines::DOUBLE * n_lines AS e3
  FROM r LEFT JOIN wide w ON r.lang IS NOT DISTINCT FROM w.lang AND r.source IS NOT DISTINCT FROM w.source
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND (x1 <= e1 OR (x1 - e1) * (x1 - e1) <= 16000 * e1)
  AND (x2 <= e2 OR (x2 - e2) * (x2 - e2) <= 16000 * e2) AND (x3 <= e3 OR (x3 - e3) * (x3 - e3) <= 16000 * e3) AS kept, limit_symbols, limit_capitals, limit_dup_lines
FROM e
"""

"""Toxicity by cumulative-link ordinal regression on sparse text features.

P(grade <= j) = sigmoid(threshold_j - w.x): the weights are shared, the thresholds ordered. x has, for each chosen
feature (a word, or a beginning of a word, by hash), the logarithm of 1 plus its count. Features are chosen by how much
more or less often toxic documents hold them; the expected grade is the severity.

Where labels only say toxic or not, the grades come from scores that a row had no part in: the learning rows are split in
two by hash, a model of either half (features and weights) scores the other, and the toxic rows of a half are graded by
which third of its toxic scores they lie in.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import textvec as tv
from .runtime import ship, staged

#: Labelled rows to learn from, at most: the first of each class by hash of doc_id.
TOXIC_ROWS, OTHER_ROWS = 4000, 8000
FEATURES = 4096
LEAST_DOCS = 3
#: A feature's log-likelihood ratio (chance alone exceeds it once in two million features).
LEAST_GAIN = 25.0
PREFIXES = (3, 4, 5, 6, 7)
GRADES = 3


def held_out(doc_id: Column) -> Column:
    """Rows that nothing is learnt from: crc32 of doc_id as text, a multiple of 5."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0


def features(w: tv.Words) -> tuple[np.ndarray, np.ndarray]:
    """Hash and text of each occurrence of a feature."""
    parts = [(w.hash, w.row)]
    for k in PREFIXES:
        h, at = w.prefixes(k)
        parts.append((h, w.row[at]))
    return np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])


def _frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts, part = tv.filled(batch.column("text")), batch.column("part").to_numpy().astype(np.int64)
        for at, to in tv.slices(texts, 4 * tv.SLICE_BYTES):
            h, row = tv.distinct(*features(tv.Words(texts.slice(at, to - at), tv.ALNUM, lower="latin")))
            for k in np.unique(part[at:to]):
                f, n = np.unique(h[part[at:to][row] == k], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(f.view(np.int64)), pa.array(np.full(len(f), k, np.int32)), pa.array(n)], ["feature", "part", "n"])


def _lookup(known: np.ndarray, w: tv.Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text, index into known (sorted) and count of the known features of each text."""
    seen = np.zeros(1 << 20, bool)
    seen[known >> np.uint64(44)] = True
    h, row = features(w)
    maybe = seen[h >> np.uint64(44)]
    h, row = h[maybe], row[maybe]
    at = np.minimum(np.searchsorted(known, h), max(0, len(known) - 1))
    hit = known[at] == h if len(known) else np.zeros(0, bool)
    pair, n = np.unique(row[hit] * (len(known) + 1) + at[hit], return_counts=True)
    return pair // (len(known) + 1), pair % (len(known) + 1), n


def _rows(shared, keys: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        for batch in batches:
            texts = tv.filled(batch.column("text"))
            for at, to in tv.slices(texts):
                w = tv.Words(texts.slice(at, to - at), tv.ALNUM, lower="latin")
                row, f, n = _lookup(known, w)
                cut = np.searchsorted(row, np.arange(to - at + 1)).tolist()
                lists = lambda x, kind: pa.array([x[a:b] for a, b in zip(cut, cut[1:])], pa.list_(kind))
                own = [batch.column(k).slice(at, to - at) for k in keys]
                yield pa.RecordBatch.from_arrays([*own, lists(f.astype(np.int32), pa.int32()), lists(n.astype(np.int32), pa.int32())], [*keys, "f", "n"])

    return run


@dataclass
class Model:
    """known: feature hashes, sorted; weights; thresholds, ascending, one fewer than grades."""

    known: np.ndarray
    weights: np.ndarray
    thresholds: np.ndarray

    def above(self, score: np.ndarray) -> np.ndarray:
        """P(grade > j), a column for each threshold."""
        return 1 / (1 + np.exp(np.clip(self.thresholds[None, :] - score[:, None], -500, 500)))

    def scores(self, w: tv.Words) -> np.ndarray:
        row, f, n = _lookup(self.known, w)
        return np.bincount(row, np.log1p(n) * self.weights[f] if len(f) else None, minlength=len(w.count))


def fit_ordinal(row: np.ndarray, f: np.ndarray, x: np.ndarray, grade: np.ndarray, n_features: int, grades: int, l2: float = 1e-5, steps: int = 600, rate: float = 0.1) -> tuple[np.ndarray, np.ndarray]:
    """Weights and thresholds of the cumulative-link model, by Adam on the whole (sparse) matrix. Thresholds are the first
    and the logarithms of the gaps, so they stay in order."""
    n = len(grade)
    share = np.clip([(grade <= j).mean() for j in range(grades - 1)], 1e-3, 1 - 1e-3)
    start = np.maximum.accumulate(np.log(share / (1 - share)) + 1e-2 * np.arange(grades - 1))
    p = np.concatenate([np.zeros(n_features), start[:1], np.log(np.maximum(np.diff(start), 1e-2))])
    m, v = np.zeros_like(p), np.zeros_like(p)
    sig = lambda z: 1 / (1 + np.exp(-np.clip(z, -50, 50)))
    for t in range(1, steps + 1):
        w, gaps = p[:n_features], np.exp(p[n_features + 1 :])
        theta = np.concatenate([p[n_features : n_features + 1], p[n_features] + np.cumsum(gaps)])
        s = np.bincount(row, x * w[f], minlength=n)
        padded = np.concatenate([[-np.inf], theta, [np.inf]])
        hi, lo = padded[grade + 1], padded[grade]
        ch, cl = np.where(np.isinf(hi), 1.0, sig(hi - s)), np.where(np.isinf(lo), 0.0, sig(lo - s))
        prob = np.maximum(ch - cl, 1e-12)
        dh, dl = ch * (1 - ch) / prob, cl * (1 - cl) / prob
        g = np.zeros_like(p)
        g[:n_features] = np.bincount(f, x * (dh - dl)[row], minlength=n_features) / n + l2 * w
        gt = np.zeros(grades - 1)
        np.add.at(gt, grade[grade < grades - 1], -dh[grade < grades - 1] / n)
        np.add.at(gt, grade[grade > 0] - 1, dl[grade > 0] / n)
        g[n_features] = gt.sum()
        g[n_features + 1 :] = np.cumsum(gt[::-1])[::-1][1:] * gaps
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        p -= rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    gaps = np.exp(p[n_features + 1 :])
    return p[:n_features], np.concatenate([p[n_features : n_features + 1], p[n_features] + np.cumsum(gaps)])


def _gain(n: Column, m: Column, positives: int, negatives: int) -> Column:
    """The log-likelihood ratio G2 of a feature that n of the positives and m of the negatives hold."""
    total = positives + negatives
    cell = lambda o, e: F.when(o > 0, o * F.log(o / e)).otherwise(0.0)
    held_, left = n + m, total - n - m
    parts = [cell(n, held_ * positives / total), cell(m, held_ * negatives / total), cell(positives - n, left * positives / total), cell(negatives - m, left * negatives / total)]
    return 2 * (parts[0] + parts[1] + parts[2] + parts[3])


def _chosen(counts: DataFrame, halves: tuple[int, ...], sizes: dict[int, int]) -> np.ndarray:
    """The FEATURES best features of the given halves, sorted. counts: feature, n0, n1 (toxic rows of each half that hold
    it), m0, m1 (others); sizes: rows by part (a half, plus 2 if toxic)."""
    total = lambda name: sum((F.col(f"{name}{h}") for h in halves[1:]), F.col(f"{name}{halves[0]}"))
    p, q = (sum(sizes.get(h + k, 0) for h in halves) for k in (2, 0))
    if not p or not q:
        return np.zeros(0, np.uint64)
    odds = F.log((F.col("n") + 0.5) / (p + 1)) - F.log((F.col("m") + 0.5) / (q + 1))
    best = counts.select("feature", total("n").alias("n"), total("m").alias("m")).where(F.col("n") + F.col("m") >= LEAST_DOCS)
    best = best.select("feature", _gain(F.col("n"), F.col("m"), p, q).alias("gain"), odds.alias("odds")).where((F.abs("odds") > 1) & (F.col("gain") > LEAST_GAIN))
    return np.sort(np.array([r.feature for r in best.orderBy(F.desc("gain"), "feature").limit(FEATURES).collect()], np.int64).view(np.uint64))


def _grades(known: np.ndarray, halves: list[np.ndarray], half: np.ndarray, toxic: np.ndarray, row: np.ndarray, f: np.ndarray, x: np.ndarray) -> np.ndarray:
    """0 for rows that aren't toxic, else 1 to GRADES: each half's toxic rows by the model of the other half."""
    grade = toxic.astype(np.int64)
    for k in (0, 1):
        own = np.flatnonzero((half == k) & toxic)
        column = np.searchsorted(halves[1 - k], known)
        column = np.where((column < len(halves[1 - k])) & np.isin(known, halves[1 - k]), column, -1)
        learn, use = half == 1 - k, column[f] >= 0
        if not len(own) or not use.any() or len(np.unique(toxic[learn])) < 2:
            continue
        renumbered = np.cumsum(learn) - 1
        a = use & learn[row]
        w, _ = fit_ordinal(renumbered[row[a]], column[f[a]], x[a], toxic[learn].astype(np.int64), len(halves[1 - k]), 2)
        score = np.bincount(row[use], x[use] * w[column[f[use]]], minlength=len(half))[own]
        grade[own] = 1 + np.searchsorted(np.quantile(score, [j / GRADES for j in range(1, GRADES)]), score, "left")
    return grade


def fit(docs: DataFrame, labels: DataFrame) -> Model:
    """Learn from docs (doc_id, text) and labels (doc_id, toxic 0 or 1, or a whole grade from 0 in column `grade`).

    From at most TOXIC_ROWS rows above grade 0 and OTHER_ROWS at 0, none held out. Of clashing labels of a doc_id the
    greatest counts, of different texts the one of the least hash. Without rows of both kinds, the model has no features
    and predicts grade 0.
    """
    spark = docs.sparkSession
    ship(spark)
    given = "grade" in labels.columns
    y = labels.select("doc_id", F.col("grade" if given else "toxic").cast("int").alias("y")).where("doc_id IS NOT NULL AND y IS NOT NULL").where(~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("y").alias("y"))
    first = lambda part, n: part.orderBy(F.xxhash64("doc_id"), "doc_id").limit(n)
    chosen = first(y.where("y > 0"), TOXIC_ROWS).unionByName(first(y.where("y = 0"), OTHER_ROWS))
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    one = docs.select("doc_id", text.alias("text")).join(F.broadcast(chosen), "doc_id").groupBy("doc_id").agg(F.first("y").alias("y"), F.min_by("text", F.xxhash64("text")).alias("text"))
    half = F.pmod(F.xxhash64(F.col("doc_id").cast("string"), F.lit("half")), F.lit(2)).cast("int")
    rows = staged(one.withColumn("part", half + F.when(F.col("y") > 0, 2).otherwise(0)), "labelled")
    sizes = {r.part: r["count"] for r in rows.groupBy("part").count().collect()}
    none = Model(np.zeros(0, np.uint64), np.zeros(0), np.full(GRADES, 30.0))
    found = rows.select("text", "part").repartition(16).mapInArrow(_frequencies, "feature long, part int, n long")
    of = lambda part, name: F.coalesce(F.sum(F.when(F.col("part") == part, F.col("n"))), F.lit(0)).alias(name)
    counts = found.groupBy("feature").agg(of(0, "m0"), of(1, "m1"), of(2, "n0"), of(3, "n1"))
    counts = staged(counts.where(F.expr("m0 + m1 + n0 + n1") >= LEAST_DOCS), "frequencies")
    chosen_ = [_chosen(counts, h, sizes) for h in ((0, 1), (0,), (1,))]
    if not len(chosen_[0]):
        return none
    known = np.unique(np.concatenate(chosen_))
    got = rows.select("doc_id", "y", "part", "text").mapInArrow(_rows(spark.sparkContext.broadcast(known), ["y", "part"]), "y int, part int, f array<int>, n array<int>").toPandas()
    row = np.repeat(np.arange(len(got)), got["f"].map(len).to_numpy())
    f = np.concatenate([*got["f"], np.zeros(0, np.int32)]).astype(np.int64)
    x = np.log1p(np.concatenate([*got["n"], np.zeros(0, np.int32)]).astype(float))
    y_, part = got["y"].to_numpy().astype(np.int64), got["part"].to_numpy().astype(np.int64)
    grade = y_ if given else _grades(known, chosen_[1:], part % 2, part >= 2, row, f, x)
    own = np.isin(known, chosen_[0])
    keep, number = own[f], np.cumsum(own) - 1
    weights, thresholds = fit_ordinal(row[keep], number[f[keep]], x[keep], grade, len(chosen_[0]), int(grade.max()) + 1)
    return Model(chosen_[0], weights, thresholds)


def _score(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            texts = tv.filled(batch.column("text"))
            for at, to in tv.slices(texts):
                above = model.above(model.scores(tv.Words(texts.slice(at, to - at), tv.ALNUM, lower="latin")))
                grade = (above >= 0.5).sum(axis=1)
                cols = [pa.array(above.sum(axis=1)), pa.array(above[:, 0]), pa.array(grade.astype(np.int32)), pa.array((grade > 0).astype(np.int32))]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(at, to - at), *cols], ["doc_id", "expected_severity", "p_toxic", "grade", "toxic"])

    return run


def score(docs: DataFrame, model: Model) -> DataFrame:
    """One row a row of docs: doc_id, expected_severity, p_toxic (above grade 0), grade (the median), toxic (grade above 0).

    A null or empty text has no features, so the severity of the thresholds alone; a very long text is scored whole;
    repeated rows, and texts with the same features, score alike; other columns are ignored; an empty table gives an empty
    result. The model that is broadcast has at most FEATURES weights.
    """
    spark = docs.sparkSession
    ship(spark)
    kind = dict(docs.dtypes)["doc_id"]
    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(_score(spark.sparkContext.broadcast(model)), f"doc_id {kind}, expected_severity double, p_toxic double, grade int, toxic int")

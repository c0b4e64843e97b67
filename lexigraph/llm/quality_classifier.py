"""A quality classifier learnt from positive and unlabelled text by the non-negative unbiased risk.

With prior p, positives P and unlabelled U, the risk of a score g under the logistic loss l is
p E_P[l(g)] + max(0, E_U[l(-g)] - p E_P[l(-g)]). Trusted positives are the learning rows labelled 1; U is every document.
While the second term is positive the risk is convex in the weights and Newton's steps are taken; where it falls below
zero the step goes up that term instead. Sums over P and U are taken in parallel in each step; only their totals, of a
size that the number of features fixes, reach the driver.
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

STEPS = 12
L2 = 1e-4
CUT = 0.3
_LINE = np.ones(256, bool)
_LINE[10] = False


def _class(chars: str) -> np.ndarray:
    out = np.zeros(256, bool)
    out[[ord(c) for c in chars]] = True
    return out


_CLASSES = {"symbols": _class("#*$%&<>@^~=+_\\/{}[]"), "bars": _class("|"), "bangs": _class("!?"), "stops": _class(".,;:"), "digits": _class("0123456789")}
NAMES = ["one", *_CLASSES, "capitals", "word_length", "log_words", "few_words", "distinct_words", "top_word", "windows3", "windows8", "lines", "dup_lines", "line_length"]


def held_out(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0


def features(texts: pa.Array) -> np.ndarray:
    """A row of NAMES for each text; all but the constant are 0 for an empty one."""
    n = len(texts)
    w = tv.Words(texts, tv.WORD)
    raw, cut = w.bytes, w.offsets
    total = lambda mask: np.diff(np.concatenate([[0], np.cumsum(mask, dtype=np.int64)])[cut])
    words = np.maximum(w.count, 1)
    chars = np.maximum(total((raw & 0xC0) != 0x80), 1)
    capital = (raw >= 65) & (raw <= 90)
    if len(raw) > 1:
        capital[1:] |= (raw[:-1] == 0xC3) & (raw[1:] >= 0x80) & (raw[1:] <= 0x9E)
    h, row = tv.distinct(w.hash, w.row)
    kinds = np.bincount(row, minlength=n)
    order = np.lexsort((w.hash, w.row))
    sh, sr = w.hash[order], w.row[order]
    new = np.ones(len(sh), bool)
    new[1:] = (sh[1:] != sh[:-1]) | (sr[1:] != sr[:-1])
    starts = np.flatnonzero(new)
    runs = np.diff(np.concatenate([starts, [len(sh)]]))
    top = np.zeros(n)
    np.maximum.at(top, sr[starts], runs)

    def again(k: int) -> np.ndarray:
        a, r = w.windows(k)
        all_, kept = np.bincount(r, minlength=n), np.bincount(tv.distinct(a, r)[1], minlength=n)
        return (all_ - kept) / np.maximum(all_, 1)

    lines = tv.Words(texts, _LINE, lower=False)
    unlike = np.bincount(tv.distinct(lines.hash, lines.row)[1], minlength=n)
    some = w.count > 0
    squash = lambda r: np.log1p(50 * r) / np.log(51)
    cols = [np.ones(n), *(squash(total(c[raw]) / words) for c in _CLASSES.values()), squash(total(capital) / chars), np.log1p(chars / words) / 3, np.log1p(w.count) / 7, np.maximum(0, 1 - w.count / 20) * some, kinds / words, top / words, again(3), again(8), squash(lines.count / words), (lines.count - unlike) / np.maximum(lines.count, 1), np.log1p(words / np.maximum(lines.count, 1)) / 7]
    x = np.stack(cols, axis=1)
    x[~some, 1:] = 0
    return x


def _featured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = tv.filled(batch.column("text"))
        for at, to in tv.slices(texts):
            x = features(texts.slice(at, to - at)).astype(np.float32)
            lists = pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), x.shape[1]).cast(pa.list_(pa.float32()))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(at, to - at), lists], ["doc_id", "x"])


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1).astype(float)


def _sums(weights: np.ndarray):
    """Totals for a step: count, x, softplus(g), sigmoid(g) x, and sigmoid'(g) x x' (row by row) of the rows of a batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _matrix(batch.column("x"))
            positive = batch.column("positive").to_numpy(zero_copy_only=False).astype(bool)
            g = x @ weights
            s = 1 / (1 + np.exp(-np.clip(g, -500, 500)))
            out = []
            for own in (np.ones(len(x), bool), positive):
                a, b = x[own], s[own]
                out.append(np.concatenate([[own.sum()], a.sum(axis=0), [np.logaddexp(0, g[own]).sum()], b @ a, ((a * (b * (1 - b))[:, None]).T @ a).ravel()]))
            yield pa.RecordBatch.from_arrays([pa.array([np.concatenate(out)], pa.list_(pa.float64()))], ["v"])

    return run


@dataclass
class Model:
    weights: np.ndarray
    prior: float

    def scores(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(x @ self.weights, -500, 500)))


def class_prior(labels: DataFrame) -> float:
    """The share of good text, estimated from the learning rows that carry a label (one more of each kind is assumed)."""
    r = labels.agg(F.count("*").alias("n"), F.sum("y").alias("k")).first()
    return ((r.k or 0) + 1) / (r.n + 2)


def fit(rows: DataFrame, prior: float) -> Model:
    """rows: x and positive, written before; every row is unlabelled text, those that are positive are trusted too."""
    d = len(NAMES)
    w, size = np.zeros(d), 2 * (2 + 2 * d + d * d)
    for _ in range(STEPS):
        parts = rows.select("x", "positive").mapInArrow(_sums(w), "v array<double>").select(F.posexplode("v").alias("i", "v"))
        totals = np.zeros(size)
        for r in parts.groupBy("i").agg(F.sum("v").alias("s")).collect():
            totals[r.i] = r.s
        u, p = totals.reshape(2, -1)
        if not p[0]:
            break
        part = lambda t: (t[1 : 1 + d] / t[0], t[1 + d] / t[0], t[2 + d : 2 + 2 * d] / t[0], t[2 + 2 * d :].reshape(d, d) / t[0])
        (_, loss_u, grad_u, hess_u), (mean_p, loss_p, grad_p, _) = part(u), part(p)
        if loss_u - prior * loss_p < 0:
            w = w + 0.1 * (grad_u - prior * grad_p)
            continue
        step = np.linalg.solve(hess_u + L2 * np.eye(d) + 1e-9 * np.eye(d), grad_u - prior * mean_p + L2 * w)
        w = w - step * min(1.0, 5.0 / max(np.linalg.norm(step), 1e-12))
        if np.abs(step).max() < 1e-4:
            break
    return Model(w, prior)


def _score(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            s = shared.value.scores(_matrix(batch.column("x")))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(s), pa.array((s >= CUT).astype(np.int32))], ["doc_id", "score", "predicted"])

    return run


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row a row of docs (doc_id, text): doc_id, held_out, score, predicted (score >= 0.3). labels: doc_id, quality.

    Labels of held-out rows are never read; of clashing labels of a doc_id the least counts, so it isn't trusted. A null
    text counts as empty and has the score of the constant alone; a very long text is scored whole; repeated rows score
    alike; without trusted positives every score is 0.5; other columns are ignored; an empty table gives an
    empty result. Rows with no doc_id are neither held out nor labelled.
    """
    spark = docs.sparkSession
    ship(spark)
    kind = dict(docs.dtypes)["doc_id"]
    out_ = F.coalesce(held_out(F.col("doc_id")), F.lit(False))
    y = labels.select("doc_id", F.col("quality").cast("int").alias("y")).where("doc_id IS NOT NULL AND y IN (0, 1)").where(~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.min("y").alias("y"))
    featured = docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(_featured, f"doc_id {kind}, x array<float>")
    good = y.where("y = 1").select("doc_id", F.lit(True).alias("positive"))
    rows = staged(featured.join(good, "doc_id", "left").select("doc_id", "x", F.coalesce("positive", F.lit(False)).alias("positive")), "features")
    model = fit(rows, class_prior(y))
    scored = rows.select("doc_id", "x").mapInArrow(_score(spark.sparkContext.broadcast(model)), f"doc_id {kind}, score double, predicted int")
    return scored.select("doc_id", out_.alias("held_out"), "score", "predicted")

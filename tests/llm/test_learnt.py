"""Quality and toxicity: held-out accuracy, odd rows, and the losses by themselves."""

import math
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lexigraph.llm import quality_classifier as qc
from lexigraph.llm import queries, textvec as tv, toxicity

from .helpers import no_docs, odd_docs

BIG = "/root/testdata/sf0.01"


def auc(y, s):
    pos, neg = [b for a, b in zip(y, s) if a], [b for a, b in zip(y, s) if not a]
    return sum((p > n) + 0.5 * (p == n) for p in pos for n in neg) / (len(pos) * len(neg))


def held(i):
    return zlib.crc32(str(i).encode()) % 5 == 0


def test_quality(spark):
    rows = {r.doc_id: r for r in queries.op1_quality_classifier(spark, BIG).collect()}
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{BIG}/labels.parquet").collect()}
    assert all(r.held_out == held(d) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for d, r in rows.items())
    out = [d for d in labels if held(d)]
    assert auc([labels[d] for d in out], [rows[d].score for d in out]) > 0.95
    assert np.mean([rows[d].predicted for d in out if labels[d]]) > 0.95


def test_quality_reads_no_held_out_label(spark):
    docs, labels = (spark.read.parquet(f"{BIG}/{t}.parquet") for t in ("documents", "labels"))
    turned = labels.selectExpr("doc_id", "CASE WHEN crc32(CAST(CAST(doc_id AS STRING) AS BINARY)) % 5 = 0 THEN 1 - quality ELSE quality END AS quality")
    a, b = ({r.doc_id: r.score for r in qc.classify(docs, y).collect()} for y in (labels, turned))
    assert a == pytest.approx(b, abs=1e-9)


def test_quality_of_odd_rows(spark):
    labels = spark.createDataFrame([(5, 1), (4, 0), (None, 1), (7, None)], "doc_id long, quality int")
    rows = qc.classify(odd_docs(spark), labels).collect()
    assert len(rows) == 13 and all(0 <= r.score <= 1 for r in rows)
    assert len({round(r.score, 12) for r in rows if r.doc_id in (1, 2, 3)}) == 1
    assert {r.score for r in qc.classify(odd_docs(spark), labels.where("false")).collect()} == {0.5}
    assert qc.classify(no_docs(spark), labels).count() == 0


def by_hand(text):
    """The quality features of one text in plain Python, in the order of qc.NAMES."""
    words = re.findall("[^\x20\x09-\x0d]+", text)
    if not words:
        return [1.0] + [0.0] * (len(qc.NAMES) - 1)
    low = [w.translate({i: i + 32 for i in range(65, 91)}) for w in words]
    n, chars = len(words), len(text)
    squash = lambda r: math.log1p(50 * r) / math.log(51)
    of = lambda chars: sum(c in chars for c in text)
    capitals = sum("A" <= c <= "Z" or ("\u00c0" <= c <= "\u00de") for c in text)

    def again(k):
        w = [tuple(low[i : i + k]) for i in range(n - k + 1)]
        return (len(w) - len(set(w))) / max(len(w), 1)

    lines = [x for x in text.split("\n") if x]
    rates = [squash(of(x) / n) for x in ("#*$%&<>@^~=+_\\/{}[]", "|", "!?", ".,;:", "0123456789")]
    return [1.0, *rates, squash(capitals / chars), math.log1p(chars / n) / 3, math.log1p(n) / 7, max(0, 1 - n / 20), len(set(low)) / n, max(Counter(low).values()) / n, again(3), again(8), squash(len(lines) / n), (len(lines) - len(set(lines))) / max(len(lines), 1), math.log1p(n / max(len(lines), 1)) / 7]


def fit_by_hand(x, positive, prior):
    """The non-negative risk minimised step by step over one matrix; also how often the second term was negative."""
    w, up = np.zeros(x.shape[1]), 0
    u, p = x, x[positive]
    for _ in range(qc.STEPS):
        sig = lambda m: 1 / (1 + np.exp(-(m @ w)))
        risk = np.logaddexp(0, u @ w).mean() - prior * np.logaddexp(0, p @ w).mean()
        grad = (sig(u)[:, None] * u).mean(axis=0) - prior * (sig(p)[:, None] * p).mean(axis=0)
        if risk < 0:
            w, up = w + 0.1 * grad, up + 1
            continue
        # p E_P[l(g)] - p E_P[l(-g)] = -p E_P[g], so what is left is convex.
        full = (sig(u)[:, None] * u).mean(axis=0) - prior * p.mean(axis=0) + qc.L2 * w
        s = sig(u) * (1 - sig(u))
        step = np.linalg.solve((u * s[:, None]).T @ u / len(u) + (qc.L2 + 1e-9) * np.eye(len(w)), full)
        w = w - step * min(1.0, 5.0 / max(np.linalg.norm(step), 1e-12))
        if np.abs(step).max() < 1e-4:
            break
    return w, up


def test_quality_against_brute_force(spark, sf):
    """The query's scores: features, prior, fit and scoring in plain Python and one matrix."""
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").orderBy("doc_id").collect()
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect() if not held(r.doc_id)}
    x = np.array([by_hand(r.text or "") for r in docs])
    assert np.abs(x - qc.features(pa.array([r.text or "" for r in docs]))).max() < 1e-9
    positive = np.array([labels.get(r.doc_id) == 1 for r in docs])
    w, _ = fit_by_hand(x.astype(np.float32).astype(float), positive, (sum(labels.values()) + 1) / (len(labels) + 2))
    want = dict(zip((r.doc_id for r in docs), 1 / (1 + np.exp(-np.clip(x @ w, -500, 500)))))
    got = {r.doc_id: r.score for r in queries.op1_quality_classifier(spark, sf).collect()}
    assert got == pytest.approx(want, abs=1e-3)


def test_risk_steps_up_when_negative(spark):
    """Where the prior is far too high the second term gets negative: the fit then goes up that term, as by hand."""
    rng = np.random.default_rng(4)
    x = np.concatenate([np.ones((400, 1)), rng.normal(size=(400, len(qc.NAMES) - 1))], axis=1).astype(np.float32)
    positive = x[:, 1] > 0.8
    rows = spark.createDataFrame([(r.tolist(), bool(p)) for r, p in zip(x, positive)], "x array<float>, positive boolean")
    w, up = fit_by_hand(x.astype(float), positive, 0.9)
    assert 0 < up < qc.STEPS
    assert qc.fit(rows, 0.9).weights == pytest.approx(w, abs=1e-6)
    assert fit_by_hand(x.astype(float), positive, positive.mean())[1] == 0


def test_clashing_labels(spark):
    docs = spark.createDataFrame([(i, f"text {i} of words") for i in range(40)] + [(1, "another text")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)] + [(i, 1 - i % 2) for i in range(10)], "doc_id long, quality int").withColumn("toxic", F.col("quality"))
    turned = labels.orderBy(F.desc("quality"), F.desc("doc_id"))
    one, two = ({(r.doc_id, round(r.score, 9)) for r in qc.classify(docs, y).collect()} for y in (labels, turned))
    assert one == two
    one, two = ({(r.doc_id, round(r.expected_severity, 9)) for r in toxicity.score(docs, toxicity.fit(docs, y)).collect()} for y in (labels, turned))
    assert one == two


def test_scores_against_brute_force(spark):
    """The query's severities on a whole table, from the model's weights, by splitting and counting in plain Python."""
    d = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text")
    model = toxicity.fit(docs, spark.read.parquet(f"{d}/labels.parquet").select("doc_id", "toxic"))
    assert len(model.known) and (np.diff(model.thresholds) > 0).all()
    weight = dict(zip(model.known.tolist(), model.weights.tolist()))
    low = {**{i: i + 32 for i in range(65, 91)}, **{i: i + 32 for i in range(0xC0, 0xDF) if i != 0xD7}}
    hashes = {}

    def of(piece, whole):
        if (piece, whole) not in hashes:
            w = tv.Words(pa.array([piece if whole else piece + "z"]), tv.ALNUM, lower=False)
            hashes[piece, whole] = int(w.hash[0] if whole else w.prefixes(len(piece.encode()))[0][0])
        return hashes[piece, whole]

    got = {r.doc_id: r for r in toxicity.score(docs, model).collect()}
    assert len(got) == docs.count()
    for r in docs.where("length(text) < 4000").collect():
        n = Counter()
        for w in re.findall("[0-9A-Za-z\x80-\U0010ffff]+", (r.text or "").translate(low)):
            n[of(w, True)] += 1
            raw = w.encode()
            for k in toxicity.PREFIXES:
                if len(raw) > k and all(b < 128 for b in raw[: k + 1]):
                    n[of(w[:k], False)] += 1
        s = sum(math.log1p(c) * weight.get(h, 0) for h, c in n.items())
        above = [1 / (1 + math.exp(min(max(t - s, -500), 500))) for t in model.thresholds]
        if all(ord(c) < 128 for c in r.text or ""):
            assert got[r.doc_id].expected_severity == pytest.approx(sum(above), abs=1e-6) and got[r.doc_id].grade == sum(a >= 0.5 for a in above)


def test_grades_come_from_the_other_half():
    """Toxic rows whose words only their own half knows get no score from the other, so they are all of one grade."""
    known = np.arange(4, dtype=np.uint64)
    half, toxic = np.array([0] * 20 + [1] * 20), np.array(([True] * 10 + [False] * 10) * 2)
    row = np.concatenate([np.arange(10), np.arange(20, 30), np.arange(10)])
    f = np.array([0] * 10 + [0] * 10 + [1] * 10)
    x = np.concatenate([np.arange(1, 11), np.arange(1, 11), np.arange(10, 0, -1)]).astype(float)
    grade = toxicity._grades(known, [np.array([0, 1], np.uint64), np.array([0], np.uint64)], half, toxic, row, f, x)
    assert (grade[~toxic] == 0).all() and (np.diff(grade[:10]) >= 0).all() and set(grade[:10]) == {1, 2, 3}


def test_toxicity(spark):
    rows = {r.doc_id: r for r in queries.op5_toxicity(spark, "/root/testdata/sf0.1").collect()}
    labels = {r.doc_id: r.toxic for r in spark.read.parquet("/root/testdata/sf0.1/labels.parquet").collect()}
    out = [d for d in labels if held(d)]
    assert auc([labels[d] for d in out], [rows[d].expected_severity for d in out]) > 0.95
    assert np.mean([rows[d].toxic for d in out if labels[d]]) > 0.85 and np.mean([rows[d].toxic for d in out if not labels[d]]) < 0.01


def test_ordinal_fit_orders_grades():
    rng = np.random.default_rng(0)
    n, x = 600, rng.normal(size=600)
    grade = np.searchsorted([-0.5, 0.5, 1.2], x + rng.logistic(size=n) * 0.1)
    w, theta = toxicity.fit_ordinal(np.arange(n), np.zeros(n, np.int64), x, grade, 1, 4)
    assert w[0] > 1 and (np.diff(theta) > 0).all()
    above = toxicity.Model(np.zeros(1, np.uint64), w, theta).above(x * w[0])
    assert np.corrcoef(above.sum(axis=1), grade)[0, 1] > 0.95 and ((above >= 0.5).sum(axis=1) == grade).mean() > 0.8


def test_toxicity_of_odd_rows(spark):
    labels = spark.createDataFrame([(5, 1), (4, 0), (None, 1), (7, None)], "doc_id long, toxic int")
    for y in (labels, labels.where("false")):
        rows = toxicity.score(odd_docs(spark), toxicity.fit(odd_docs(spark), y)).collect()
        assert len(rows) == 13 and all(np.isfinite(r.expected_severity) for r in rows)
    assert toxicity.score(no_docs(spark), toxicity.fit(no_docs(spark), labels)).count() == 0

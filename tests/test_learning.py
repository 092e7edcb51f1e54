import math

import numpy as np
import pytest
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from doseweave.operators import learning, metrics, resampling


def sparse_rows(seed=0, n=400, width=30, heads=3):
    rng = np.random.default_rng(seed)
    x = np.where(rng.random((n, width)) < 0.2, rng.normal(size=(n, width)), 0.0)
    y = rng.random((n, heads)) < 1 / (1 + np.exp(-(x @ rng.normal(size=(width, heads)) - 1)))
    rows = [
        (i, np.flatnonzero(x[i]).tolist(), x[i][x[i] != 0].tolist(), np.flatnonzero(y[i]).tolist()) for i in range(n)
    ]
    return x, y, rows


def test_heads_reach_the_optimum_together(spark):
    x, y, rows = sparse_rows()
    df = spark.createDataFrame(rows, "id long, indices array<int>, values array<double>, ones array<int>")
    weights, reg = np.array([1.0, 3.0, 0.5]), 1e-3
    model = learning.fit_heads(df, 3, 30, weights, reg)
    assert model.converged.all() and (model.gradient <= learning.TOLERANCE).all()
    z = x @ model.coefficients[:, :-1].T + model.coefficients[:, -1]
    w = np.where(y, weights, 1.0)
    error = w * (1 / (1 + np.exp(-z)) - y)
    slope = (x.T @ error) / w.sum(0) + reg * model.coefficients[:, :-1].T
    assert np.abs(slope).max() < 2e-6 and np.abs(error.sum(0) / w.sum(0)).max() < 2e-6
    got = {(r["id"], r["event_idx"]): r["score"] for r in learning.head_scores(df, model, [5, 6, 7], ["id"]).collect()}
    want = 1 / (1 + np.exp(-z))
    assert len(got) == 1200 and all(abs(got[i, 5 + h] - want[i, h]) < 1e-9 for i in range(400) for h in range(3))


def test_a_stopped_fit_says_so(spark):
    df = spark.createDataFrame(sparse_rows()[2], "id long, indices array<int>, values array<double>, ones array<int>")
    assert not learning.fit_heads(df, 3, 30, [1, 1, 1], steps=1).converged.any()
    with pytest.raises(ValueError, match="more than a fit holds"):
        learning.fit_heads(df, 1 << 12, 1 << 12, [1])


def test_bit_pairs_are_sparse_and_symmetric(spark):
    bits = spark.createDataFrame([(1, [0, 3, 5]), (2, [3, 4]), (3, [])], "drug long, features array<int>")
    pairs = spark.createDataFrame([(1, 2, 1), (2, 1, 1), (1, 3, 0)], "drug_a long, drug_b long, label int")
    rows = {(r.drug_a, r.drug_b): sorted(r["indices"]) for r in learning.pair_rows(pairs, bits, bits=8).collect()}
    assert rows == {(1, 2): [3, 8, 12, 13], (2, 1): [3, 8, 12, 13], (1, 3): [8, 11, 13]}
    scored, _ = learning.pair_logistic(learning.pair_rows(pairs, bits, bits=8).withColumn("partition", F.lit("train")), 16, reg=0.1)
    scores = {(r.drug_a, r.drug_b): r.score for r in scored.collect()}
    assert scores[1, 2] == scores[2, 1] > scores[1, 3]


def test_log_gamma(spark):
    values = [1e-6, 0.1, 0.5, 1.0, 1.5, 2.0, 3.96, 9.999, 10.0, 10.5, 171.3, 1e5, 1e9]
    df = spark.createDataFrame([(v,) for v in values], "x double").select("x", metrics.log_gamma(F.col("x")).alias("g"))
    assert all(abs(r.g - math.lgamma(r.x)) <= 1e-10 * max(1, abs(math.lgamma(r.x))) for r in df.collect())


def test_signed_ranks_are_exact_at_any_length():
    def brute(d):
        d = [v for v in d if v]
        order = sorted(abs(v) for v in d)
        ranks = [np.mean([i + 1 for i, o in enumerate(order) if o == abs(v)]) for v in d]
        least = min(sum(r for r, v in zip(ranks, d, strict=True) if v > 0), sum(r for r, v in zip(ranks, d, strict=True) if v < 0))
        sums = [sum(r for i, r in enumerate(ranks) if m >> i & 1) for m in range(1 << len(d))]
        return min(1.0, 2 * sum(s <= least for s in sums) / len(sums))

    for d in ([0.1, -0.2, 0.3, 0.0], [1, 1, -1, 2, 2, 3, -4], [1, 2, 3, 4, 5, 6, 7, 8]):
        assert abs(resampling.signed_rank_p(d) - brute(d)) < 1e-12
    assert resampling.signed_rank_p([0.0]) is None
    rng = np.random.default_rng(1)
    long = [*rng.normal(0.3, 1, 41), *([0.5] * 20)]
    below = resampling.signed_rank_p(long[:40]), resampling.signed_rank_p(long)
    assert all(0 < p < 1 for p in below)
    assert abs(resampling.signed_rank_p([1.0] * 50) - 2 * 0.5**50) < 1e-18


def test_forest_tasks_follow_the_rows_and_not_the_shuffle(spark, monkeypatch):
    rows = spark.range(400).selectExpr("id", "id % 40 AS group", "id / 400 AS target", "array(double(id % 7), double(id) / 400) AS f")
    rows = rows.select("id", "group", "target", array_to_vector("f").alias("features"))
    seen, fit = [], learning.RandomForestRegressor.fit
    monkeypatch.setattr(learning.RandomForestRegressor, "fit", lambda self, df: seen.append(df.rdd.getNumPartitions()) or fit(self, df))
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "64")
    try:
        out = learning.severity_forest(rows, "group", "target", seeds=(0,), folds=2, trees=3, depth=3).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert len(seen) == 2 and max(seen) <= 8
    assert len(out) == 400 and sum(abs(r.prediction - r.target) for r in out) / 400 < 0.15

"""Order statistics against pandas, with a value that a third of the rows share."""

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from doseweave.operators import ranking
from doseweave.plans import hashing, ordering


def frame(n=3000, seed=1):
    rng = np.random.default_rng(seed)
    score = np.where(rng.random(n) < 0.34, 0.5, np.round(rng.normal(0, 3, n), 2))
    return pd.DataFrame({"id": np.arange(n), "g": rng.choice(["a", "b", "hot"], n, p=[0.2, 0.1, 0.7]), "score": score, "y": (rng.random(n) < 0.3).astype(int)})


def test_quantiles_match_numpy(spark):
    pdf = frame()
    got = ordering.quantiles(spark.createDataFrame(pdf), "score", {"a": 0.0, "b": 0.37, "c": 1.0}, ["g"]).toPandas().set_index("g")
    for g, rows in pdf.groupby("g"):
        assert np.allclose(got.loc[g, ["a", "b", "c"]].astype(float), np.quantile(rows.score, [0, 0.37, 1.0]))


def test_kth_out_of_range_is_null(spark):
    df = spark.createDataFrame([(1.0,), (2.0,)], "v double")
    row = ordering.kth_values(df, "v", {"first": lambda n: F.lit(1), "none": lambda n: n + 1, "zero": lambda n: F.lit(0)}).head()
    assert (row["first"], row["none"], row["zero"], row["n"]) == (1.0, None, None, 2)


def test_dense_ids_and_partition_invariance(spark):
    names = [f"k{i * 7919 % 4000:05d}" for i in range(4000)]
    df = spark.createDataFrame([(x,) for x in names], "k string")
    for parts in (1, 7):
        got = ordering.dense_ids(df.repartition(parts), "k", "i").toPandas().sort_values("k")
        assert got.i.tolist() == list(range(4000))


def test_fraction_split_is_exact_and_stable(spark):
    df = spark.range(1001)
    first = hashing.by_fraction(df, ["id"], 5, {"test": 0.2, "val": 0.1}, "train", "role")
    again = hashing.by_fraction(df.repartition(9), ["id"], 5, {"test": 0.2, "val": 0.1}, "train", "role")
    counts = {r["role"]: r["count"] for r in first.groupBy("role").count().collect()}
    assert counts == {"test": 200, "val": 100, "train": 701}
    assert first.exceptAll(again).count() == 0


def test_tie_safe_positions(spark):
    pdf = frame()
    got = ranking.tie_safe_positions(spark.createDataFrame(pdf), "score", ["id"], 0, descending=True).toPandas()
    assert sorted(got.position) == list(range(1, len(pdf) + 1))
    assert got.sort_values("position").score.is_monotonic_decreasing


def test_auroc_and_ap_with_ties(spark):
    pdf = frame()
    got = ranking.ranking_metrics(spark.createDataFrame(pdf), "y", "score", ["g"]).toPandas().set_index("g")
    for g, r in pdf.groupby("g"):
        pos, neg = r.score[r.y == 1].to_numpy(), r.score[r.y == 0].to_numpy()
        pairs = (pos[:, None] > neg[None, :]).mean() + 0.5 * (pos[:, None] == neg[None, :]).mean()
        assert abs(got.loc[g, "auroc"] - pairs) < 1e-9
        ap = sum((r.y[r.score == s].sum() / r.y.sum()) * r.y[r.score >= s].mean() for s in r.score.unique())
        assert abs(got.loc[g, "average_precision"] - ap) < 1e-9


def test_one_class_is_null(spark):
    row = ranking.auroc(spark.createDataFrame([(1, 0.2), (1, 0.9)], "y int, s double"), "y", "s").head()
    assert row["auroc"] is None


def test_average_rank(spark):
    pdf = frame(500)
    got = ranking.average_rank(spark.createDataFrame(pdf), "score", ["g"]).toPandas().sort_values("id")
    assert np.allclose(got.avg_rank, pdf.groupby("g").score.rank())

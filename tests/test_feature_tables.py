"""Pair features made from a table that every task holds: the same models and scores, without a pair's features on disk."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from doseweave.operators import learning


def study(spark, n=60, width=4):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(n, width))
    drugs = [(i, [None if i == 3 and k == 1 else float(v) for k, v in enumerate(row)]) for i, row in enumerate(x)] + [(7, [0.0] * width)]
    pairs = [(p, int(a), int(b), "train" if p % 3 else "s1") for p, (a, b) in enumerate(rng.integers(0, n + 5, (900, 2)))]
    labels = [(p, e) for p, a, b, _ in pairs for e in (2, 5, 9) if rng.random() < 0.2 + 0.2 * (a % 2) + 0.1 * (e == 5)]
    return (spark.createDataFrame(drugs, "drug long, features array<double>"), spark.createDataFrame(pairs, "pair_id long, drug_a long, drug_b long, partition string"),
            spark.createDataFrame(labels, "pair_id long, event_idx long"))


@pytest.mark.parametrize("mode", ["symmetric", "concat"])
def test_numbers_score_as_features_do(spark, mode):
    drugs, pairs, labels = study(spark)
    width = 12 if mode == "symmetric" else 8
    held = learning.feature_table(drugs, mode)
    plain, numbers = learning.pair_rows(pairs, drugs, mode), learning.pair_rows(pairs, held, mode)
    assert isinstance(held, learning.FeatureTable) and plain.count() == numbers.count() > pairs.count() * 0.8
    vocabulary = spark.createDataFrame([(2, 1.5), (5, 2.0)], "event_idx long, pos_weight double")
    prior = spark.createDataFrame([(2, 0.1), (5, 0.2), (9, 0.25)], "event_idx long, prior double")
    want = sorted((r.pair_id, r.event_idx, round(r.score, 5)) for r in learning.event_logistic(plain, labels, vocabulary, prior, width).collect())
    out = learning.event_logistic(numbers, labels, vocabulary, prior, width, features=held, keep=["partition"], label="y").collect()
    got = sorted((r.pair_id, r.event_idx, round(r.score, 5)) for r in out)
    assert len(got) == 3 * plain.count() and all(x[:2] == y[:2] and abs(x[2] - y[2]) < 2e-5 for x, y in zip(got, want, strict=True))
    ones, parts = {tuple(r) for r in labels.collect()}, {r.pair_id: r.partition for r in pairs.collect()}
    assert all(r.y == ((r.pair_id, r.event_idx) in ones) and r.partition == parts[r.pair_id] for r in out)


def test_pair_scores_of_numbers(spark):
    drugs, pairs, labels = study(spark)
    held = learning.feature_table(drugs)
    tagged = pairs.withColumn("label", (F.col("drug_a") % 2).cast("int"))
    want, model = learning.pair_logistic(learning.pair_rows(tagged, drugs), 12)
    got, other = learning.pair_logistic(learning.pair_rows(tagged, held), 12, features=held, keep=["pair_id"])
    assert model.converged.all() and other.converged.all() and got.columns == ["pair_id", "score"]
    a, b = (sorted((r.pair_id, r.score) for r in df.collect()) for df in (want, got))
    assert [x[0] for x in a] == [x[0] for x in b] and max(abs(x[1] - y[1]) for x, y in zip(a, b, strict=True)) < 1e-5


def test_a_pair_is_written_as_numbers(spark, monkeypatch):
    """48 features of 20,000 pairs are 11 MB; their numbers are not."""
    drugs = spark.range(200).select(F.col("id").alias("drug"), F.transform(F.sequence(F.lit(1), F.lit(16)), lambda k: F.rand(1) + k).alias("features"))
    pairs = spark.range(20_000).select(F.col("id").alias("pair_id"), (F.col("id") % 200).alias("drug_a"), (F.col("id") % 199).alias("drug_b"), F.lit("train").alias("partition"))
    labels = spark.range(0, 20_000, 3).select(F.col("id").alias("pair_id"), F.lit(1).alias("event_idx"))
    written, real = [], learning.durable

    def durable(df, **options):
        out = real(df, **options)
        written.append(sum(spark._jvm.org.apache.hadoop.fs.Path(f).getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(spark._jvm.org.apache.hadoop.fs.Path(f)).getLen() for f in out.inputFiles()))
        return out

    monkeypatch.setattr(learning, "durable", durable)
    held = learning.feature_table(drugs)
    vocabulary = spark.createDataFrame([(1, 1.0)], "event_idx long, pos_weight double")
    out = learning.event_logistic(learning.pair_rows(pairs, held), labels, vocabulary, vocabulary.selectExpr("event_idx", "0.5D AS prior"), 48, steps=2, features=held)
    assert out.count() == 20_000 and sum(written) < 1_500_000


def test_features_that_do_not_fit_stay_rows(spark, monkeypatch):
    drugs, pairs, _ = study(spark)
    ragged = spark.createDataFrame([(1, [1.0]), (2, [1.0, 2.0])], "drug long, features array<double>")
    assert not isinstance(learning.feature_table(ragged), learning.FeatureTable)
    monkeypatch.setattr(learning, "FEATURE_CELLS", 100)
    left = learning.feature_table(drugs)
    assert not isinstance(left, learning.FeatureTable) and {"indices", "values"} <= set(learning.pair_rows(pairs, left).columns)
    assert learning.pair_logistic(learning.pair_rows(pairs, left).withColumn("label", F.lit(1)), 12, features=left, steps=1)[0].count() > 0

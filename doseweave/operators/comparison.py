"""Ensembles, seed summaries and paired comparisons of runs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from doseweave.functions.numeric import jaccard, reason_string, total


def ensemble_mean_std(aligned: DataFrame, scores: Sequence[str]) -> DataFrame:
    """Mean, population standard deviation and count over the aligned member columns of each row."""
    values = F.array(*scores)
    mean = total(values) / len(scores)
    spread = F.sqrt(total(F.transform(values, lambda v: (v - F.col("mean_score")) * (v - F.col("mean_score")))) / len(scores))
    return (
        aligned.withColumn("mean_score", mean).withColumn("std_score", spread)
        .withColumn("n_members", F.lit(len(scores)).cast("long"))
    )


def safe_abstention(rows: DataFrame, tau: float) -> DataFrame:
    """Abstain on conformal ambiguity, member disagreement above tau, or out-of-domain structure, with reasons."""
    flags: dict[str, Column] = {
        "conformal_ambiguous": F.col("conformal"),
        "ensemble_disagreement": F.col("sd") > F.lit(float(tau)),
        "outside_domain": F.col("ood"),
    }
    any_flag = F.col("conformal") | (F.col("sd") > F.lit(float(tau))) | F.col("ood")
    return rows.withColumn("abstain", any_flag).withColumn("abstain_reasons", reason_string(flags))


def abstention_summary(rows: DataFrame) -> DataFrame:
    """Overall and per-reason rates; zero on an empty table."""

    def rate(c: Column) -> Column:
        return F.coalesce(F.avg(c.cast("double")), F.lit(0.0))

    return rows.agg(
        F.count(F.lit(1)).alias("n_rows"), rate(F.col("abstain")).alias("abstention_rate"),
        rate(F.col("abstain_reasons").contains("conformal_ambiguous")).alias("conformal_rate"),
        rate(F.col("abstain_reasons").contains("ensemble_disagreement")).alias("disagreement_rate"),
        rate(F.col("abstain_reasons").contains("outside_domain")).alias("domain_rate"),
    )


def explanation_stability(artifacts: DataFrame) -> DataFrame:
    """artifacts(example, member, features): pairwise overlap of members on shared examples, averaged per member pair.

    Members are the few seeds of a study, so the members of one example travel as one small array.
    """
    per = artifacts.groupBy("example").agg(F.sort_array(F.collect_list(F.struct("member", "features"))).alias("m"))
    pairs = F.flatten(
        F.transform(
            "m",
            lambda x, i: F.transform(
                F.slice(F.col("m"), i + 2, F.size("m")),
                lambda y: F.struct(
                    x.member.alias("member_a"), y.member.alias("member_b"), jaccard(x.features, y.features).alias("overlap")
                ),
            ),
        )
    )
    return (
        per.select(F.explode(pairs).alias("p")).select("p.*").groupBy("member_a", "member_b")
        .agg(F.count(F.lit(1)).alias("shared_examples"), F.avg("overlap").alias("mean_overlap"))
    )

"""Threshold, set, calibration-error and regression metrics as grouped conditional aggregates."""

from __future__ import annotations

from collections.abc import Sequence

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from doseweave.functions.numeric import clip
from doseweave.operators.ranking import average_rank, ranking_metrics, youden_threshold
from doseweave.plans.ordering import quantiles

EPS = 1e-12


def ratio(top: Column, bottom: Column) -> Column:
    return top / F.nullif(bottom.cast("double"), F.lit(0.0))


def evaluable(ranked: DataFrame, min_pos: int = 5) -> DataFrame:
    """Adds ``evaluable``: enough of both classes."""
    return ranked.withColumn("evaluable", (F.col("n_pos") >= min_pos) & (F.col("n_neg") >= min_pos))


def macro_ranking(cells: DataFrame, event: str, label: str, score: str, min_pos: int = 5, by: Sequence[str] = ()) -> DataFrame:
    """Means of AUROC and average precision over the evaluable events, with how many there were."""
    per = evaluable(ranking_metrics(cells, label, score, [*by, event]), min_pos)
    ok = F.col("evaluable")
    return per.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n_events"), F.count_if(ok).alias("n_events_evaluable"),
        F.avg(F.when(ok, F.col("auroc"))).alias("macro_auroc"), F.avg(F.when(ok, F.col("average_precision"))).alias("macro_auprc"),
    )


def multitask_metrics(cells: DataFrame, event: str, label: str, score: str) -> DataFrame:
    """Micro and macro ranking metrics over the tasks that have both classes."""
    macro = macro_ranking(cells, event, label, score, min_pos=1)
    micro = ranking_metrics(cells, label, score).select(F.struct("auroc", "average_precision"))
    return macro.withColumn("_m", micro.scalar()).select(
        "n_events", "n_events_evaluable", "macro_auroc", "macro_auprc",
        F.col("_m.auroc").alias("micro_auroc"), F.col("_m.average_precision").alias("micro_auprc"),
    )


def _f1(tp: Column, fp: Column, fn: Column, empty: Column) -> Column:
    denominator = 2 * tp + fp + fn
    return F.when(denominator > 0, 2 * tp / denominator).otherwise(empty)


def set_metrics(cells: DataFrame, pair: str, event: str, label: str, score: str, threshold: float) -> DataFrame:
    """Example, micro and macro F1, Jaccard (1 when both sets are empty) and Hamming loss at one threshold."""
    hit, yes = F.col(score) >= F.lit(float(threshold)), F.col(label) == 1
    counts = [
        F.count_if(hit & yes).alias("tp"), F.count_if(hit & ~yes).alias("fp"), F.count_if(~hit & yes).alias("fn"),
        F.count(F.lit(1)).alias("n"),
    ]
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    jaccard = F.when(tp + fp + fn > 0, tp / (tp + fp + fn)).otherwise(1.0)
    by_pair = cells.groupBy(pair).agg(*counts).agg(
        F.avg(_f1(tp, fp, fn, F.lit(1.0))).alias("example_f1"), F.avg(jaccard).alias("jaccard")
    )
    by_event = cells.groupBy(event).agg(*counts).agg(
        F.avg(_f1(tp, fp, fn, F.lit(None).cast("double"))).alias("macro_f1"),
        (2 * F.sum("tp") / F.greatest(2 * F.sum("tp") + F.sum("fp") + F.sum("fn"), F.lit(1))).alias("micro_f1"),
        ((F.sum("fp") + F.sum("fn")) / F.sum("n")).alias("hamming_loss"),
    )
    return by_event.withColumn("_p", by_pair.select(F.struct("*")).scalar()).select(
        F.lit(float(threshold)).alias("threshold"), F.col("_p.example_f1").alias("example_f1"), "micro_f1", "macro_f1",
        F.col("_p.jaccard").alias("jaccard"), "hamming_loss",
    )


def best_threshold(cells: DataFrame, label: str, score: str, grid: Sequence[float] | None = None) -> DataFrame:
    """The grid threshold with the largest micro F1, the lowest one on ties; all thresholds in one aggregate."""
    grid = [round(0.05 * k, 2) for k in range(1, 20)] if grid is None else list(grid)
    yes = F.col(label) == 1
    sums = []
    for i, t in enumerate(grid):
        hit = F.col(score) >= F.lit(t)
        sums += [F.count_if(hit & yes).alias(f"tp{i}"), F.count_if(hit & ~yes).alias(f"fp{i}")]
    row = cells.agg(F.count_if(yes).alias("p"), *sums)
    points = F.array(
        *[
            F.struct(
                (2 * F.col(f"tp{i}") / F.greatest(F.col(f"tp{i}") + F.col(f"fp{i}") + F.col("p"), F.lit(1))).alias("micro_f1"),
                F.lit(-t).alias("neg_t"),
            )
            for i, t in enumerate(grid)
        ]
    )
    return row.select(F.array_max(points).alias("b")).select((-F.col("b.neg_t")).alias("threshold"), "b.micro_f1")


def brier(label: str, p: str) -> Column:
    return F.avg((F.col(p) - F.col(label)) * (F.col(p) - F.col(label)))


def nll(label: str, p: str) -> Column:
    q = clip(F.col(p), EPS, 1 - EPS)
    return -F.avg(F.col(label) * F.ln(q) + (1 - F.col(label)) * F.ln(1 - q))


def binary_metrics(
    rows: DataFrame, label: str, score: str, threshold: float | Column, by: Sequence[str] = (), raw: str | None = None
) -> DataFrame:
    """Confusion matrix and everything derived from it, Brier, equal-width ECE, AUROC and average precision."""
    t = threshold if isinstance(threshold, Column) else F.lit(float(threshold))
    hit, yes = F.col(score) >= t, F.col(label) == 1
    keys = list(by) or ["_all"]
    base = rows if by else rows.withColumn("_all", F.lit(0))
    counts = base.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(hit & yes).alias("tp"), F.count_if(hit & ~yes).alias("fp"),
        F.count_if(~hit & yes).alias("fn"), F.count_if(~hit & ~yes).alias("tn"), brier(label, score).alias("brier"),
        *([brier(label, raw).alias("brier_raw")] if raw else []),
    )
    ranked = ranking_metrics(base, label, score, keys).select(*keys, "auroc", "average_precision")
    ece = ece_equal_width(base, label, score, keys).select(*keys, "ece")
    tp, fp, fn, tn = (F.col(c).cast("double") for c in ("tp", "fp", "fn", "tn"))
    tpr, tnr = ratio(tp, tp + fn), ratio(tn, tn + fp)
    out = counts.join(ranked, keys).join(ece, keys).withColumns(
        {
            "accuracy": (tp + tn) / F.col("n"), "recall": tpr, "specificity": tnr, "precision": ratio(tp, tp + fp),
            "npv": ratio(tn, tn + fn), "fpr": ratio(fp, fp + tn), "fnr": ratio(fn, fn + tp),
            "balanced_accuracy": (tpr + tnr) / 2, "f1": ratio(2 * tp, 2 * tp + fp + fn),
            "mcc": F.coalesce(ratio(tp * tn - fp * fn, F.sqrt(tp + fp) * F.sqrt(tp + fn) * F.sqrt(tn + fp) * F.sqrt(tn + fn)), F.lit(0.0)),
            "status": F.when((F.col("tp") + F.col("fn") == 0) | (F.col("tn") + F.col("fp") == 0), "single_class").otherwise("ok"),
        }
    )
    return out.drop("_all")


def threshold_metrics(rows: DataFrame, label: str, score: str, threshold: float | None = None, by: Sequence[str] = ()) -> DataFrame:
    """Binary metrics at a given threshold, or at each group's own Youden threshold."""
    if threshold is not None:
        return binary_metrics(rows, label, score, threshold, by).withColumn("threshold", F.lit(float(threshold)))
    best = youden_threshold(rows, label, score, by).select(*by, "threshold")
    if not by:
        tagged = rows.withColumn("_t", best.select("threshold").scalar())
    else:
        tagged = rows.join(best.withColumnRenamed("threshold", "_t"), list(by))
    out = binary_metrics(tagged, label, score, F.col("_t"), by)
    return out.join(best, list(by)) if by else out.withColumn("threshold", best.select("threshold").scalar())


def metric_table(metrics: DataFrame, label_meaning: str) -> DataFrame:
    """One row per split with the fixed report columns and what a zero label means."""
    return metrics.select(
        "split", "n", "tp", "fp", "fn", "tn", "accuracy", "balanced_accuracy", "precision", "recall", "specificity", "f1",
        "mcc", "auroc", "average_precision", "brier", "ece", "status", F.lit(label_meaning).alias("negative_label_meaning"),
    )


def ece_equal_mass(rows: DataFrame, label: str, p: str, bins: int = 15, by: Sequence[str] = ()) -> DataFrame:
    """Expected and maximum calibration error over quantile bins; repeated edges merge, search is right-closed."""
    probs = {f"e{k}": k / bins for k in range(1, bins)}
    edges = quantiles(rows.select(*by, F.col(p).cast("double").alias("p")), "p", probs, by)
    inner = edges.select(*by, F.array_distinct(F.array(*probs)).alias("_edges"))
    cells = rows.groupBy(*by, F.col(p).cast("double").alias("p")).agg(F.count(F.lit(1)).alias("c"), F.sum(label).alias("y"))
    tagged = cells.join(inner, list(by)) if by else cells.withColumn("_edges", inner.select("_edges").scalar())
    place = F.aggregate("_edges", F.lit(0), lambda k, e: k + F.when(e <= F.col("p"), 1).otherwise(0))
    per_bin = tagged.withColumn("bin", place).groupBy(*by, "bin").agg(
        F.sum("c").alias("c"), F.sum("y").alias("y"), F.sum(F.col("p") * F.col("c")).alias("s")
    )
    gap = F.abs(F.col("y") / F.col("c") - F.col("s") / F.col("c"))
    return per_bin.groupBy(*by).agg(
        (F.sum(gap * F.col("c")) / F.sum("c")).alias("ece"), F.max(gap).alias("mce"), F.count(F.lit(1)).alias("bins_used")
    )


def reliability_bins(rows: DataFrame, label: str, p: str, bins: int = 10, by: Sequence[str] = ()) -> DataFrame:
    """Per equal-width bin (last one closed): count, mean probability, observed fraction; empty bins listed."""
    place = F.least(F.floor(F.col(p) * bins), F.lit(bins - 1)).cast("int")
    found = rows.groupBy(*by, place.alias("bin")).agg(
        F.count(F.lit(1)).alias("n"), F.avg(p).alias("mean_p"), F.avg(label).alias("fraction_positive")
    )
    groups = found.select(*by).distinct() if by else found.agg(F.count(F.lit(1)).alias("_one"))
    grid = groups.withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(bins - 1)))).drop("_one")
    return grid.join(found, [*by, "bin"], "left").withColumn("n", F.coalesce("n", F.lit(0)))


def ece_equal_width(rows: DataFrame, label: str, p: str, by: Sequence[str] = (), bins: int = 10) -> DataFrame:
    filled = reliability_bins(rows, label, p, bins, by).filter("n > 0")
    gap = F.abs(F.col("mean_p") - F.col("fraction_positive"))
    return filled.groupBy(*by).agg((F.sum(gap * F.col("n")) / F.sum("n")).alias("ece"), F.max(gap).alias("mce"))


def regression_metrics(rows: DataFrame, truth: str, pred: str, n_col: str | None = None) -> DataFrame:
    """MAE, RMSE, R2 (null for a constant truth), Spearman, and the MAE weighted by the root of a count column."""
    error = F.col(pred) - F.col(truth)
    weight = F.sqrt(F.col(n_col)) if n_col else F.lit(1.0)
    base = rows.agg(
        F.count(F.lit(1)).alias("n"), F.avg(F.abs(error)).alias("mae"), F.sqrt(F.avg(error * error)).alias("rmse"),
        F.sum(error * error).alias("_sse"), (F.var_pop(truth) * F.count(F.lit(1))).alias("_sst"),
        (F.sum(F.abs(error) * weight) / F.sum(weight)).alias("weighted_mae"),
    )
    ranked = average_rank(average_rank(rows.select(truth, pred), truth, name="_rt"), pred, name="_rp")
    rho = ranked.agg(F.corr("_rt", "_rp")).scalar()
    return base.withColumns({"r2": 1 - F.col("_sse") / F.nullif(F.col("_sst"), F.lit(0.0)), "spearman": rho}).drop("_sse", "_sst")


#: Coefficients B(2k) / (2k (2k - 1)) of the Stirling series, k from 1, and the argument from which it is exact in doubles.
STIRLING = [1 / 12, -1 / 360, 1 / 1260, -1 / 1680, 1 / 1188, -691 / 360360, 1 / 156]
STIRLING_FROM = 10


def log_gamma(x: Column) -> Column:
    """Logarithm of the gamma function of a positive number: the Stirling series after a shift of ``STIRLING_FROM``."""
    shift = F.when(x < STIRLING_FROM, F.lit(float(STIRLING_FROM))).otherwise(0.0)
    product = F.aggregate(F.sequence(F.lit(0), F.lit(STIRLING_FROM - 1)), F.lit(1.0), lambda p, i: p * F.when(x < STIRLING_FROM, x + i).otherwise(1.0))
    z = x + shift
    series = F.lit(0.0)
    for c in reversed(STIRLING):
        series = series / (z * z) + F.lit(c)
    return (z - 0.5) * F.log(z) - z + F.lit(0.5 * math.log(2 * math.pi)) + series / z - F.log(product)


def beta_binomial_nll(rows: DataFrame, k: str, n: str, mean: str, precision: str) -> DataFrame:
    """Mean negative log likelihood of counts under a beta-binomial with the given mean and precision."""
    alpha, beta = F.col(mean) * F.col(precision), (1 - F.col(mean)) * F.col(precision)
    kk, nn = F.col(k).cast("double"), F.col(n).cast("double")
    terms = [
        (nn + 1, 1), (kk + 1, -1), (nn - kk + 1, -1), (kk + alpha, 1), (nn - kk + beta, 1), (nn + alpha + beta, -1),
        (alpha + beta, 1), (alpha, -1), (beta, -1),
    ]
    wide = rows.select(*[log_gamma(x.cast("double")).alias(f"g{i}") for i, (x, _) in enumerate(terms)])
    log_likelihood = sum((F.col(f"g{i}") * sign for i, (_, sign) in enumerate(terms)), F.lit(0.0))
    return wide.agg(F.count(F.lit(1)).alias("n"), (-F.avg(log_likelihood)).alias("nll"))


def similarity_slices(rows: DataFrame, similarity: str, label: str, score: str, threshold: float, cuts: tuple[float, float] = (0.4, 0.7)) -> DataFrame:
    """Binary metrics in three similarity bands; an empty band is listed with n = 0."""
    low, high = cuts
    s = F.col(similarity)
    band = F.when(s < low, "low").when(s < high, "medium").otherwise("high")
    found = binary_metrics(rows.withColumn("band", band), label, score, threshold, ["band"])
    every = rows.agg(F.count(F.lit(1)).alias("_n")).select(F.explode(F.array(*map(F.lit, ("low", "medium", "high")))).alias("band"))
    return every.join(found, "band", "left").withColumn("n", F.coalesce("n", F.lit(0)))


def stratum_metrics(cells: DataFrame, stratum: str, pair: str, event: str, label: str, score: str, min_pairs: int = 50, min_pos: int = 5) -> DataFrame:
    """Macro metrics per stratum with enough pairs."""
    sizes = cells.select(stratum, pair).distinct().groupBy(stratum).agg(F.count(F.lit(1)).alias("n_pairs"))
    return macro_ranking(cells, event, label, score, min_pos, [stratum]).join(sizes.filter(F.col("n_pairs") >= min_pairs), stratum)


def pair_score_summary(scores: DataFrame, pair: str, event: str, score: str, k: int = 20) -> DataFrame:
    """Per pair: mean probability, mean of the best k, mean logit."""
    from doseweave.functions.numeric import logit
    from doseweave.operators.ranking import top_k_mean

    means = scores.groupBy(pair).agg(F.avg(score).alias("mean_prob"), F.avg(logit(F.col(score))).alias("mean_logit"))
    return means.join(top_k_mean(scores, pair, event, score, k), pair)

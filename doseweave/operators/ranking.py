"""Tie-aware ranks, ranking metrics, curves and worklists.

Rows first collapse to counts per (group, score), on the map side, so a score shared by a third of all rows is one
row afterwards; running sums over the distinct scores then use the bucketed plan.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from doseweave.plans.hashing import priority
from doseweave.plans.ordering import hash_bucket, positions, running_sums


def score_cells(
    rows: DataFrame, label: str, score: str, by: Sequence[str] = (), weight: Column | None = None
) -> DataFrame:
    """by..., score, pos, neg: weighted class counts per distinct score."""
    w = F.lit(1.0) if weight is None else weight.cast("double")
    return rows.groupBy(*by, F.col(score).cast("double").alias("score")).agg(
        F.sum(F.when(F.col(label) == 1, w).otherwise(0.0)).alias("pos"),
        F.sum(F.when(F.col(label) == 1, 0.0).otherwise(w)).alias("neg"),
    )


def auroc(rows: DataFrame, label: str, score: str, by: Sequence[str] = (), weight: Column | None = None) -> DataFrame:
    """Tie-aware area under the ROC curve per group, null when one class is absent."""
    run = running_sums(score_cells(rows, label, score, by, weight), "score", ["neg"], by)
    return run.groupBy(*by).agg(
        F.sum("pos").alias("n_pos"), F.sum("neg").alias("n_neg"),
        F.sum(F.col("pos") * (F.col("run_neg") - F.col("neg") / 2)).alias("_u"),
    ).withColumn("auroc", F.col("_u") / F.nullif(F.col("n_pos") * F.col("n_neg"), F.lit(0.0))).drop("_u")


def average_precision(rows: DataFrame, label: str, score: str, by: Sequence[str] = (), weight: Column | None = None) -> DataFrame:
    """Sum of precision times the recall step over distinct scores, null without a positive."""
    run = running_sums(score_cells(rows, label, score, by, weight), "score", ["pos", "neg"], by, descending=True)
    precision = F.col("run_pos") / F.nullif(F.col("run_pos") + F.col("run_neg"), F.lit(0.0))
    return run.groupBy(*by).agg(
        F.sum("pos").alias("n_pos"), F.sum("neg").alias("n_neg"), F.sum(F.col("pos") * precision).alias("_ap")
    ).withColumn("average_precision", F.col("_ap") / F.nullif(F.col("n_pos"), F.lit(0.0))).drop("_ap")


def ranking_metrics(rows: DataFrame, label: str, score: str, by: Sequence[str] = (), weight: Column | None = None) -> DataFrame:
    """AUROC and average precision together, from one running sum."""
    run = running_sums(score_cells(rows, label, score, by, weight), "score", ["pos", "neg"], by)
    totals = run.groupBy(*by).agg(F.sum("pos").alias("n_pos"), F.sum("neg").alias("n_neg"))
    joined = run.join(totals, list(by)) if by else run.withColumn("_t", totals.select(F.struct("n_pos", "n_neg")).scalar()).select(
        "*", "_t.n_pos", "_t.n_neg"
    ).drop("_t")
    pos_at = F.col("n_pos") - F.col("run_pos") + F.col("pos")
    neg_at = F.col("n_neg") - F.col("run_neg") + F.col("neg")
    step = F.when(F.col("pos") > 0, F.col("pos") * pos_at / (pos_at + neg_at)).otherwise(0.0)
    return joined.groupBy(*by).agg(
        F.max("n_pos").alias("n_pos"), F.max("n_neg").alias("n_neg"),
        F.sum(F.col("pos") * (F.col("run_neg") - F.col("neg") / 2)).alias("_u"), F.sum(step).alias("_ap"),
    ).withColumns(
        {
            "auroc": F.col("_u") / F.nullif(F.col("n_pos") * F.col("n_neg"), F.lit(0.0)),
            "average_precision": F.col("_ap") / F.nullif(F.col("n_pos"), F.lit(0.0)),
        }
    ).drop("_u", "_ap")


def average_rank(rows: DataFrame, score: str, by: Sequence[str] = (), name: str = "avg_rank") -> DataFrame:
    """Ranks from the lowest score, ties share their mean rank; the rank table has one row per distinct score."""
    counts = rows.groupBy(*by, F.col(score).cast("double").alias("_s")).agg(F.count(F.lit(1)).alias("n"))
    run = running_sums(counts, "_s", ["n"], by)
    ranks = run.select(*by, "_s", (F.col("run_n") - (F.col("n") - 1) / 2).alias(name))
    return rows.withColumn("_s", F.col(score).cast("double")).join(ranks, [*by, "_s"]).drop("_s")


def rank_percentile(scores: DataFrame, pair: str, event: str, score: str) -> DataFrame:
    """Mean over events of each pair's percentile rank within the event."""
    ranked = average_rank(scores, score, [event])
    sizes = scores.groupBy(event).agg(F.count(F.lit(1)).alias("_n"))
    return ranked.join(sizes, event).groupBy(pair).agg(F.avg(F.col("avg_rank") / F.col("_n")).alias("mean_rank"))


def top_k(rows: DataFrame, by: Sequence[str], order: Sequence[Column], k: int) -> DataFrame:
    """The first k rows per group with ``rn``; for a constant k every map task keeps only its own k."""
    ranked = rows.withColumn("rn", F.row_number().over(Window.partitionBy(*by).orderBy(*order)))
    return ranked.filter(F.col("rn") <= k)


def top_k_mean(scores: DataFrame, pair: str, event: str, score: str, k: int = 20) -> DataFrame:
    best = top_k(scores, [pair], [F.desc(score), F.asc(event)], k)
    return best.groupBy(pair).agg(F.avg(score).alias("top_k_mean"))


def precision_recall_at_k(
    cells: DataFrame, pair: str, event: str, label: str, score: str, ks: Sequence[int] = (1, 5, 10, 20)
) -> DataFrame:
    """(k, precision, recall) averaged over the pairs with at least one true event; k is capped at the events."""
    best = top_k(cells, [pair], [F.desc(score), F.asc(event)], max(ks))
    m = cells.agg(F.count_distinct(event)).scalar()
    hits = best.groupBy(pair).agg(*[F.sum(F.when(F.col("rn") <= k, F.col(label)).otherwise(0)).alias(f"h{k}") for k in ks])
    truth = cells.groupBy(pair).agg(F.sum(label).alias("n_true")).filter("n_true > 0")
    long = hits.join(truth, pair).unpivot([pair, "n_true"], [f"h{k}" for k in ks], "k", "hit")
    long = long.withColumn("k", F.substring("k", 2, 10).cast("int")).withColumn("_m", m)
    return long.groupBy("k").agg(
        F.avg(F.col("hit") / F.least(F.col("k"), F.col("_m"))).alias("precision"),
        F.avg(F.col("hit") / F.col("n_true")).alias("recall"), F.count(F.lit(1)).alias("n_pairs"),
    )


def curve_points(rows: DataFrame, label: str, score: str, by: Sequence[str] = ()) -> DataFrame:
    """Cumulative true and false positives by distinct score from the top."""
    run = running_sums(score_cells(rows, label, score, by), "score", ["pos", "neg"], by, descending=True)
    return run.select(*by, "score", F.col("run_pos").alias("tp"), F.col("run_neg").alias("fp"))


def youden_threshold(rows: DataFrame, label: str, score: str, by: Sequence[str] = ()) -> DataFrame:
    """The threshold with the largest TPR - FPR, the highest one on ties, clipped to [0, 1]."""
    points = curve_points(rows, label, score, by)
    totals = points.groupBy(*by).agg(F.max("tp").alias("_p"), F.max("fp").alias("_q"))
    joined = points.join(totals, list(by)) if by else points.withColumn("_t", totals.select(F.struct("*")).scalar()).select(
        "*", "_t._p", "_t._q").drop("_t")
    gain = F.col("tp") / F.nullif(F.col("_p"), F.lit(0.0)) - F.col("fp") / F.nullif(F.col("_q"), F.lit(0.0))
    return joined.groupBy(*by).agg(F.max(F.struct(gain.alias("j"), F.col("score").alias("t"))).alias("_b")).select(
        *by, F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("_b.t"))).alias("threshold"), F.col("_b.j").alias("youden_j")
    )


def tie_safe_positions(
    rows: DataFrame, value: str, keys: Sequence[str], seed: int | str = 0, descending: bool = False,
    by: Sequence[str] = (), name: str = "position",
) -> DataFrame:
    """Position by value with ties in hash order, even when nearly all values are equal.

    The position is the number of rows with a better value (running counts over distinct values) plus the hash
    position among the equal ones.
    """
    hashed = rows.withColumn("_prio", priority(seed, *[F.col(k) for k in keys])).withColumn("_val", F.col(value).cast("double"))
    counts = hashed.groupBy(*by, "_val").agg(F.count(F.lit(1)).alias("n"))
    better = running_sums(counts, "_val", ["n"], by, descending).select(*by, "_val", (F.col("run_n") - F.col("n")).alias("_better"))
    tied = positions(hashed, ["_prio"], hash_bucket(F.col("_prio")), by=[*by, "_val"], name="_tie")
    return tied.join(better, [*by, "_val"]).withColumn(name, F.col("_better") + F.col("_tie")).drop("_prio", "_val", "_tie", "_better")


def retained_prefixes(
    rows: DataFrame, value: str, keys: Sequence[str], levels: Sequence[float], seed: int | str = 0, descending: bool = True,
    rounding: str = "round",
) -> DataFrame:
    """Each row once per coverage level whose best-first prefix holds it, with ``level``.

    ``round`` keeps max(1, round(n c)) rows, ``ceil`` keeps ceil(n c).
    """
    placed = tie_safe_positions(rows, value, keys, seed, descending)
    n = rows.agg(F.count(F.lit(1))).scalar()
    size = (
        (lambda c: F.greatest(F.lit(1), F.bround(F.col("_n") * F.lit(float(c)))))
        if rounding == "round" else (lambda c: F.ceil(F.col("_n") * F.lit(float(c))))
    )
    held = F.array(*[F.when(F.col("position") <= size(c), F.lit(float(c))) for c in levels])
    return placed.withColumn("_n", n).withColumn("level", F.explode(F.array_compact(held))).drop("_n")


def confident_errors(rows: DataFrame, label: str, score: str, key: str, threshold: float = 0.5, m: int = 100) -> DataFrame:
    """The m surest false positives (highest scores) and false negatives (lowest), with their margin and rank."""
    t = F.lit(float(threshold))
    kind = F.when((F.col(label) == 0) & (F.col(score) >= t), "FP").when((F.col(label) == 1) & (F.col(score) < t), "FN")
    wrong = rows.withColumn("error_type", kind).filter(F.col("error_type").isNotNull()).withColumn(
        "margin", F.abs(F.col(score) - t)
    )
    return top_k(wrong, ["error_type"], [F.desc("margin"), F.asc(key)], m)


def representatives(rows: DataFrame, label: str, score: str, key: str, threshold: float, m: int) -> DataFrame:
    """One surest row of each of FN, FP, TP, TN first, then the rest by margin, m rows in all."""
    t = F.lit(float(threshold))
    yes, hit = F.col(label) == 1, F.col(score) >= t
    order = F.when(yes & ~hit, 0).when(~yes & hit, 1).when(yes & hit, 2).otherwise(3)
    marked = rows.withColumn("class_order", order).withColumn("margin", F.abs(F.col(score) - t))
    first = top_k(marked, ["class_order"], [F.desc("margin"), F.asc(key)], 1).select(key, F.lit(True).alias("_first"))
    return (
        marked.join(first, key, "left").withColumn("picked", F.coalesce("_first", F.lit(False))).drop("_first")
        .orderBy(F.desc("picked"), F.when(F.col("picked"), F.col("class_order")).otherwise(F.lit(9)), F.desc("margin"), F.asc(key))
        .limit(m)
    )

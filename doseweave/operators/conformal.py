"""Conformal thresholds and sets, p-values, regimes and selective prediction."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from doseweave.operators.calibration import apply_calibrator, event_calibrator
from doseweave.operators.metrics import evaluable, macro_ranking
from doseweave.operators.ranking import retained_prefixes
from doseweave.operators.replicates import listed, replicate_auroc
from doseweave.operators.splits import split_calibration
from doseweave.plans.ordering import kth_values, quantiles, running_sums
from doseweave.session import durable


def conformal_thresholds(cells: DataFrame, label: str, p: str, keys: Sequence[str], alpha: float = 0.1) -> DataFrame:
    """keys..., q1, q0, n1, n0: per class the ceil((n+1)(1-alpha))-th smallest nonconformity, infinity when too few."""
    rows = cells.select(
        *keys, F.col(label).alias("y"), F.when(F.col(label) == 1, 1 - F.col(p)).otherwise(F.col(p)).alias("nonconf")
    )
    found = kth_values(rows, "nonconf", {"q": lambda n: F.ceil((n + 1) * F.lit(1 - alpha))}, [*keys, "y"])

    def pick(y: int, value: Column) -> Column:
        return F.max(F.when(F.col("y") == y, value))

    inf = F.lit(float("inf"))
    return found.groupBy(*keys).agg(
        F.coalesce(pick(1, F.col("q")), inf).alias("q1"), F.coalesce(pick(0, F.col("q")), inf).alias("q0"),
        F.coalesce(pick(1, F.col("n")), F.lit(0)).alias("n1"), F.coalesce(pick(0, F.col("n")), F.lit(0)).alias("n0"),
    )


def conformal_sets(cells: DataFrame, thresholds: DataFrame, p: str, keys: Sequence[str]) -> DataFrame:
    """Adds in1 and in0: whether each label is in the set."""
    return cells.join(thresholds.select(*keys, "q1", "q0"), list(keys)).withColumns(
        {"in1": (1 - F.col(p)) <= F.col("q1"), "in0": F.col(p) <= F.col("q0")}
    ).drop("q1", "q0")


def conformal_report(cells: DataFrame, event: str, label: str, min_pos: int = 5, alpha: float = 0.1, by: Sequence[str] = ()) -> DataFrame:
    """Coverage per class over the evaluable events, and set sizes over all cells."""
    yes, size = F.col(label) == 1, F.col("in1").cast("int") + F.col("in0").cast("int")
    per = cells.groupBy(*by, event).agg(
        F.count_if(yes).alias("pos"), F.count_if(~yes).alias("neg"), F.count_if(yes & F.col("in1")).alias("hit1"),
        F.count_if(~yes & F.col("in0")).alias("hit0"), F.count(F.lit(1)).alias("n"), F.sum(size).alias("size"),
        F.count_if((size == 1) & F.col("in1")).alias("only1"), F.count_if((size == 1) & F.col("in0")).alias("only0"),
        F.count_if(size == 2).alias("both"), F.count_if(size == 0).alias("empty"),
    )
    ok = (F.col("pos") >= min_pos) & (F.col("neg") >= min_pos)
    cov1, cov0 = F.when(ok, F.col("hit1") / F.col("pos")), F.when(ok, F.col("hit0") / F.col("neg"))
    return per.groupBy(*by).agg(
        F.count_if(ok).alias("n_events_evaluated"), F.avg(cov1).alias("coverage_positive_macro"),
        F.avg(cov0).alias("coverage_negative_macro"), F.min(cov1).alias("coverage_positive_min_event"),
        F.avg((cov1 >= 1 - alpha - 0.05).cast("double")).alias("frac_events_pos_cov_within_5pts"),
        (F.sum("size") / F.sum("n")).alias("mean_set_size"), (F.sum("only1") / F.sum("n")).alias("frac_singleton_1"),
        (F.sum("only0") / F.sum("n")).alias("frac_singleton_0"), (F.sum("both") / F.sum("n")).alias("frac_both"),
        (F.sum("empty") / F.sum("n")).alias("frac_empty"),
    )


def binary_conformal(calibration: DataFrame, query: DataFrame, label: str, p: str, alpha: float = 0.1) -> DataFrame:
    """Adds p_value_1 and p_value_0 = (calibration rows at least as nonconforming + 1) / (n + 1), the set as text and
    ``abstain`` unless it holds exactly one label.

    Counts come from one running sum over the union of calibration and query scores, never from comparing rows with
    rows.
    """
    noncal = F.when(F.col(label) == 1, 1 - F.col(p)).otherwise(F.col(p))
    cal = calibration.groupBy(noncal.alias("s")).agg(F.count(F.lit(1)).alias("c"))
    wanted = query.select(F.explode(F.array(1 - F.col(p), F.col(p))).alias("s")).distinct().withColumn("c", F.lit(0).cast("long"))
    union = cal.unionByName(wanted).groupBy("s").agg(F.sum("c").alias("c"))
    atleast = running_sums(union, "s", ["c"], descending=True).select("s", "run_c")
    n = calibration.agg(F.count(F.lit(1))).scalar()
    out = query.withColumn("_n", n)
    for y, s in ((1, 1 - F.col(p)), (0, F.col(p))):
        out = out.withColumn("s", s).join(atleast, "s").withColumn(f"p_value_{y}", (F.col("run_c") + 1) / (F.col("_n") + 1)).drop("s", "run_c")
    in1, in0 = F.col("p_value_1") > alpha, F.col("p_value_0") > alpha
    text = F.when(in1 & in0, "{0,1}").when(in1, "{1}").when(in0, "{0}").otherwise("{}")
    return out.withColumns({"prediction_set": text, "abstain": in1 == in0}).drop("_n")


def binary_conformal_threshold(calibration: DataFrame, label: str, p: str, alpha: float = 0.1) -> DataFrame:
    noncal = F.when(F.col(label) == 1, 1 - F.col(p)).otherwise(F.col(p))
    found = kth_values(calibration.select(noncal.alias("s")), "s", {"q": lambda n: F.ceil((n + 1) * F.lit(1 - alpha))})
    return found.select("n", F.coalesce("q", F.lit(float("inf"))).alias("threshold"))


def regime(pairs: DataFrame, train: DataFrame, a: str = "drug_a", b: str = "drug_b") -> DataFrame:
    """Adds ``regime``: how many endpoints (0, 1, 2) never occur in training."""
    seen = train.select(F.explode(F.array(a, b)).alias("drug")).distinct().withColumn("_s", F.lit(1))
    out = pairs
    for side, name in ((a, "_sa"), (b, "_sb")):
        out = out.join(seen.select(F.col("drug").alias(side), F.col("_s").alias(name)), side, "left")
    return out.withColumn("regime", F.col("_sa").isNull().cast("int") + F.col("_sb").isNull().cast("int")).drop("_sa", "_sb")


def regime_aware(
    cells: DataFrame, pair: str, event: str, label: str, score: str, alpha: float = 0.1, lam: float = 3.0, min_pairs: int = 200,
    seed: int = 0,
) -> DataFrame:
    """cells(pair, event, label, score, regime) to regime, event, intercept, slope, q1, q0, fallback_to_pooled.

    Each regime with enough pairs fits on its own halves; the pooled fit answers for the others. Both are the same
    grouped job with the regime as one more key.
    """
    pairs = cells.select(pair, "regime").distinct()
    sizes = pairs.groupBy("regime").agg(F.count(F.lit(1)).alias("n_pairs"))
    big = sizes.filter(F.col("n_pairs") >= min_pairs).select("regime")
    scopes = cells.join(big, "regime", "left_semi").withColumn("scope", F.col("regime")).unionByName(
        cells.withColumn("scope", F.lit(-1))
    )
    halves = split_calibration(scopes.select(pair, "scope").distinct(), ["scope", pair], 0.5, seed, by=["scope"])
    tagged = durable(scopes.join(halves, [pair, "scope"]))
    params = durable(event_calibrator(tagged.filter("half = 'platt_fit'"), event, label, score, lam, ["scope"]))
    calibrated = apply_calibrator(tagged.filter("half = 'conformal_cal'"), params, score, ["scope", event])
    cuts = conformal_thresholds(calibrated, label, "calibrated", ["scope", event], alpha)
    fitted = durable(params.join(cuts, ["scope", event], "left"))
    own = sizes.select("regime", "n_pairs", F.when(F.col("n_pairs") >= min_pairs, F.col("regime")).otherwise(-1).alias("scope"))
    inf = F.lit(float("inf"))
    return own.join(fitted, "scope").select(
        "regime", "n_pairs", event, "intercept", "slope", F.coalesce("q1", inf).alias("q1"), F.coalesce("q0", inf).alias("q0"),
        (F.col("scope") == -1).alias("fallback_to_pooled"),
    )


# Selective prediction.
def risk_coverage(
    cells: DataFrame, reliability: DataFrame, pair: str, event: str, label: str, score: str,
    levels: Sequence[float] = (1.0, 0.9, 0.75, 0.5, 0.25), min_pos: int = 5, seed: int = 0,
) -> DataFrame:
    """Macro AUROC on the most reliable share of the pairs; reliability(pair, reliability), ties in hash order."""
    kept = retained_prefixes(reliability, "reliability", [pair], levels, seed)
    sizes = kept.groupBy("level").agg(F.count(F.lit(1)).alias("n_pairs"), F.min("reliability").alias("min_reliability"))
    scored = macro_ranking(cells.join(kept.select(pair, "level"), pair), event, label, score, min_pos, ["level"])
    return sizes.join(scored.select("level", "macro_auroc", "n_events_evaluable"), "level", "left")


def random_abstention(
    cells: DataFrame, pairs: DataFrame, pair: str, event: str, label: str, score: str,
    levels: Sequence[float] = (1.0, 0.9, 0.75, 0.5, 0.25), reps: int = 10, min_pos: int = 5, seed: int = 0,
) -> DataFrame:
    """The null: mean and spread of macro AUROC when the kept pairs are random, over repetitions in one job."""
    from doseweave.plans.hashing import by_fraction

    repeated = pairs.select(pair).withColumn("rep", F.explode(F.sequence(F.lit(1), F.lit(reps))))
    ordered = sorted(set(levels))
    steps = {str(c): c - (ordered[i - 1] if i else 0.0) for i, c in enumerate(ordered)}
    placed = by_fraction(repeated, ["rep", pair], f"{seed}:null", steps, "none", "_band", by=["rep"])
    # A pair's weights: how often it is kept, by repetition and level.
    places = [(rep, c) for rep in range(1, reps + 1) for c in ordered]
    inside = [(F.col("rep") == rep) & F.col("_band").isin(*[str(x) for x in ordered if x <= c]) for rep, c in places]
    kept = placed.groupBy(pair).agg(F.array(*[F.count_if(x).cast("smallint") for x in inside]).alias("_w"))
    per = replicate_auroc(cells.select(pair, event, label, score).join(kept.hint("merge"), pair), label, score, [event], F.col("_w"), listed)
    place = F.col("replicate") - 1
    level = F.get(F.array(*[F.lit(c) for c in ordered]), place % len(ordered))
    marked = evaluable(per, min_pos).withColumns({"rep": F.floor(place / len(ordered)), "level": level})
    scored = marked.groupBy("rep", "level").agg(F.avg(F.when(F.col("evaluable"), F.col("auroc"))).alias("macro_auroc"))
    return scored.groupBy("level").agg(F.avg("macro_auroc").alias("null_mean"), F.stddev_pop("macro_auroc").alias("null_sd"))


def threshold_for_coverage(reliability: DataFrame, coverage: float) -> DataFrame:
    """The validation reliability that keeps the target share."""
    return quantiles(reliability, "reliability", {"tau": 1.0 - coverage}).select("tau")


def deployed_summary(
    cells: DataFrame, reliability: DataFrame, validation: DataFrame, coverage: float, pair: str, event: str, label: str, score: str,
    min_pos: int = 5,
) -> DataFrame:
    """The validation threshold applied to test pairs: realised coverage and macro AUROC answered and overall."""
    tau = durable(threshold_for_coverage(validation, coverage))
    marked = reliability.withColumn("_tau", tau.scalar()).withColumn("answered", F.col("reliability") >= F.col("_tau"))
    scored = cells.join(marked.select(pair, "answered"), pair)
    answered = macro_ranking(scored.filter("answered"), event, label, score, min_pos)
    overall = macro_ranking(cells, event, label, score, min_pos)
    return marked.agg(
        F.max("_tau").alias("tau"), F.avg(F.col("answered").cast("double")).alias("realised_coverage"), F.count_if("answered").alias("n_answered"),
    ).withColumns(
        {
            "macro_auroc_answered": answered.select("macro_auroc").scalar(),
            "n_events_evaluable": answered.select("n_events_evaluable").scalar(),
            "macro_auroc_all": overall.select("macro_auroc").scalar(),
        }
    )


def selective_summary(rows: DataFrame, label: str, score: str, threshold: float) -> DataFrame:
    """Binary metrics on the rows that do not abstain, with their share."""
    from doseweave.operators.metrics import binary_metrics

    share = rows.agg(F.avg((~F.col("abstain")).cast("double"))).scalar()
    return binary_metrics(rows.filter(~F.col("abstain")), label, score, threshold).withColumn("coverage", share)


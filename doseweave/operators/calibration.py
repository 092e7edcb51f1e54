"""Logistic recalibration of many events at once: one grouped sum of the data per Newton step.

Rows first collapse to (group, score) counts, which are written once; each step then joins the small parameter table
to them and returns one row per group. A step that does not improve the objective is halved instead of taken.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from doseweave.functions.numeric import clip, logit, sigmoid
from doseweave.session import durable

EPS = 1e-12
RIDGE = 1e-9
MAX_STEPS = 40
TOLERANCE = 1e-10


def logit_cells(rows: DataFrame, label: str, score: str, by: Sequence[str] = ()) -> DataFrame:
    """by..., x, n, pos: counts per distinct score on the logit scale."""
    return rows.groupBy(*by, logit(F.col(score)).alias("x")).agg(
        F.count(F.lit(1)).cast("double").alias("n"), F.sum(F.col(label).cast("double")).alias("pos")
    )


def _loss(a: Column, b: Column, x: Column, n: Column, pos: Column) -> Column:
    q = clip(sigmoid(a + b * x), EPS, 1 - EPS)
    return -(pos * F.ln(q) + (n - pos) * F.ln(1 - q))


def fit_logistic(
    cells: DataFrame, by: Sequence[str] = (), prior: DataFrame | tuple[float, float] = (0.0, 1.0), lam: float = 0.0,
    lam_intercept: float | None = None, min_slope: float | None = None,
) -> DataFrame:
    """Per group (a, b) minimising the logistic loss plus lam_intercept (a - a0)^2 + lam (b - b0)^2.

    ``prior`` is one (a0, b0) or a table by..., a0, b0. Returns by..., intercept, slope.
    """
    la = lam if lam_intercept is None else lam_intercept
    keys = list(by) or ["_all"]
    data = durable(cells if by else cells.withColumn("_all", F.lit(0)))
    groups = data.select(*keys).distinct()
    if isinstance(prior, DataFrame):
        start = groups.join(prior if by else prior.withColumn("_all", F.lit(0)), keys)
    else:
        start = groups.withColumns({"a0": F.lit(float(prior[0])), "b0": F.lit(float(prior[1]))})
    state = start.select(
        *keys, "a0", "b0", F.col("a0").alias("a"), F.col("b0").alias("b"), F.lit(float("inf")).alias("best"),
        F.lit(0.0).alias("sa"), F.lit(0.0).alias("sb"), F.lit(1.0).alias("t"), F.lit(False).alias("done"),
    )
    state = durable(state)
    floor = F.lit(min_slope) if min_slope is not None else None

    def limited(slope: Column) -> Column:
        return F.greatest(slope, floor) if floor is not None else slope

    for _ in range(MAX_STEPS):
        tried = state.withColumns({"ta": F.col("a") - F.col("t") * F.col("sa"), "tb": limited(F.col("b") - F.col("t") * F.col("sb"))})
        x, n, pos = F.col("x"), F.col("n"), F.col("pos")
        q = sigmoid(F.col("ta") + F.col("tb") * x)
        w = F.greatest(q * (1 - q), F.lit(1e-9)) * n
        g = q * n - pos
        # The state of a group depends on its key alone, so it rides along as grouping columns.
        sums = data.join(tried, keys).groupBy(*tried.columns).agg(
            F.sum(_loss(F.col("ta"), F.col("tb"), x, n, pos)).alias("loss"), F.sum(g).alias("ga"), F.sum(g * x).alias("gb"),
            F.sum(w).alias("haa"), F.sum(w * x).alias("hab"), F.sum(w * x * x).alias("hbb"),
        )
        da, db = F.col("ta") - F.col("a0"), F.col("tb") - F.col("b0")
        objective = F.col("loss") + la * da * da + lam * db * db
        ga, gb = F.col("ga") + 2 * la * da, F.col("gb") + 2 * lam * db
        haa, hbb, hab = F.col("haa") + 2 * la + RIDGE, F.col("hbb") + 2 * lam + RIDGE, F.col("hab")
        det = haa * hbb - hab * hab
        accepted = objective <= F.col("best") + 1e-12
        taken = ~F.col("done") & accepted
        stepped = sums.select(
            *keys, "a0", "b0",
            F.when(taken, F.col("ta")).otherwise(F.col("a")).alias("a"),
            F.when(taken, F.col("tb")).otherwise(F.col("b")).alias("b"),
            F.when(taken, objective).otherwise(F.col("best")).alias("best"),
            F.when(taken, (hbb * ga - hab * gb) / det).otherwise(F.col("sa")).alias("sa"),
            F.when(taken, (haa * gb - hab * ga) / det).otherwise(F.col("sb")).alias("sb"),
            F.when(F.col("done") | accepted, F.lit(1.0)).otherwise(F.col("t") / 2).alias("t"),
            (
                F.col("done") | (accepted & (F.col("best") - objective < TOLERANCE)) | (~accepted & (F.col("t") < 1e-8))
            ).alias("done"),
        )
        seen = Observation()
        state = durable(stepped.observe(seen, F.count_if(~F.col("done")).alias("open")))
        if seen.get["open"] == 0:
            break
    out = state.select(*keys, F.col("a").alias("intercept"), F.col("b").alias("slope"))
    return out if by else out.drop("_all")


def calibration_slope_intercept(rows: DataFrame, label: str, score: str, by: Sequence[str] = ()) -> DataFrame:
    """y on logit(p): ideal is intercept 0, slope 1."""
    return fit_logistic(logit_cells(rows, label, score, by), by)


def fit_platt(rows: DataFrame, label: str, score: str, by: Sequence[str] = (), prior=(0.0, 1.0), lam: float = 0.0,
              lam_intercept: float | None = None, min_slope: float = 1e-4) -> DataFrame:
    return fit_logistic(logit_cells(rows, label, score, by), by, prior, lam, lam_intercept, min_slope)


def fit_shared_slope(rows: DataFrame, event: str, label: str, score: str, ridge: float = 1e-3, by: Sequence[str] = ()) -> DataFrame:
    """One slope for all events with an intercept each: by..., event, intercept, slope.

    The Hessian is an arrow, so the slope step comes from per-event sums after eliminating the intercepts; events
    without both classes keep their smoothed base rate and do not move the slope.
    """
    keys = [*by, event]
    data = durable(logit_cells(rows, label, score, keys))
    totals = data.groupBy(*keys).agg(F.sum("n").alias("n_all"), F.sum("pos").alias("p_all"))
    rate = clip(F.col("p_all") / F.col("n_all"), 1e-4, 1 - 1e-4)
    state = durable(
        totals.select(
            *keys, ((F.col("p_all") > 0) & (F.col("p_all") < F.col("n_all"))).alias("ok"),
            F.ln(rate / (1 - rate)).alias("intercept"), F.lit(1.0).alias("slope"), F.lit(1.0).alias("moved"),
        )
    )
    group = list(by) or ["_all"]
    for _ in range(MAX_STEPS):
        base = state if by else state.withColumn("_all", F.lit(0))
        joined = data.join(base.filter("ok").select(*keys, *([] if by else ["_all"]), "intercept", "slope"), keys)
        q = sigmoid(F.col("intercept") + F.col("slope") * F.col("x"))
        w, g = q * (1 - q) * F.col("n"), q * F.col("n") - F.col("pos")
        sums = joined.groupBy(*dict.fromkeys([*group, *keys])).agg(
            F.sum(g).alias("ga"), F.sum(g * F.col("x")).alias("gb"), (F.sum(w) + 1e-6).alias("haa"),
            F.sum(w * F.col("x")).alias("hab"), F.sum(w * F.col("x") * F.col("x")).alias("hbb"),
        )
        step = sums.groupBy(*group).agg(
            F.sum(F.col("gb") - F.col("hab") * F.col("ga") / F.col("haa")).alias("_g"),
            (F.sum(F.col("hbb") - F.col("hab") * F.col("hab") / F.col("haa")) + ridge).alias("_h"),
        ).select(*group, clip(F.col("_g") / F.col("_h"), -1.0, 1.0).alias("db"))
        moved = base.join(step, group, "left").join(sums.select(*keys, "ga", "haa", "hab"), keys, "left")
        db = F.coalesce("db", F.lit(0.0))
        slope = F.greatest(F.col("slope") - db, F.lit(1e-4))
        da = clip((F.col("ga") - F.col("hab") * db) / F.col("haa"), -2.0, 2.0)
        state = durable(
            moved.select(
                *keys, "ok", F.when(F.col("ok"), F.col("intercept") - da).otherwise(F.col("intercept")).alias("intercept"),
                slope.alias("slope"), F.greatest(F.abs(db), F.coalesce(F.abs(da), F.lit(0.0))).alias("moved"),
            )
        )
        if state.agg(F.max("moved")).head()[0] < 1e-7:
            break
    return state.select(*keys, "intercept", "slope", "ok")


def event_calibrator(
    rows: DataFrame, event: str, label: str, score: str, lam: float = 3.0, by: Sequence[str] = (), prior_mode: str = "pooled",
    lam_intercept: float = 0.01, min_pos: int = 1,
) -> DataFrame:
    """by..., event, intercept, slope: per-event maps shrunk to the pooled one (or to a shared slope).

    An event without both classes takes the prior as it is. The pooled map uses every cell.
    """
    keys = [*by, event]
    stats = rows.groupBy(*keys).agg(F.sum(label).alias("_p"), F.count(F.lit(1)).alias("_n"))
    if prior_mode == "pooled":
        pooled = fit_platt(rows, label, score, by).withColumnsRenamed({"intercept": "a0", "slope": "b0"})
        priors = stats.join(pooled, list(by)) if by else stats.withColumn("_s", pooled.select(F.struct("a0", "b0")).scalar()).select("*", "_s.*").drop("_s")
        la = lam
    else:
        shared = fit_shared_slope(rows, event, label, score, by=by).withColumnsRenamed({"intercept": "a0", "slope": "b0"})
        priors, la = stats.join(shared.drop("ok"), keys), lam_intercept
    priors = durable(priors)
    own = priors.filter((F.col("_p") >= min_pos) & (F.col("_p") < F.col("_n")))
    fitted = fit_logistic(
        logit_cells(rows, label, score, keys).join(own.select(*keys), keys, "left_semi"), keys, own.select(*keys, "a0", "b0"),
        lam, la, 1e-4,
    )
    return priors.join(fitted, keys, "left").select(
        *keys, F.coalesce("intercept", "a0").alias("intercept"), F.coalesce("slope", "b0").alias("slope"),
        F.col("intercept").isNotNull().alias("own_fit"),
    )


def apply_calibrator(rows: DataFrame, params: DataFrame, score: str, keys: Sequence[str], out: str = "calibrated") -> DataFrame:
    return rows.join(params.select(*keys, "intercept", "slope"), list(keys)).withColumn(
        out, sigmoid(F.col("intercept") + F.col("slope") * logit(F.col(score)))
    ).drop("intercept", "slope")


def fit_temperature(rows: DataFrame, label: str, score: str, low: float = 0.05, high: float = 10.0, steps: int = 40) -> float:
    """The temperature with the least log loss, by golden section; each probe is one aggregate row."""
    data = durable(logit_cells(rows, label, score))

    def losses(points: Sequence[float]) -> list[float]:
        row = data.agg(
            *[F.sum(_loss(F.lit(0.0), F.lit(1.0 / t), F.col("x"), F.col("n"), F.col("pos"))).alias(f"l{i}") for i, t in enumerate(points)]
        ).head()
        return list(row)

    for _ in range(steps):
        points = [low + (high - low) * k / 16 for k in range(17)]
        found = losses(points)
        best = min(range(17), key=found.__getitem__)
        low, high = points[max(0, best - 1)], points[min(16, best + 1)]
        if high - low < 1e-6:
            break
    return (low + high) / 2


def fit_binary_calibrator(rows: DataFrame, label: str, score: str, method: str = "platt") -> dict[str, float | str]:
    """Unconstrained Platt, or a temperature when its slope is not positive or when asked for."""
    if method == "platt":
        fit = fit_logistic(logit_cells(rows, label, score)).head()
        if fit["slope"] > 0:
            return {"method": "platt", "slope": fit["slope"], "intercept": fit["intercept"]}
    t = fit_temperature(rows, label, score)
    return {"method": "temperature", "slope": 1.0 / t, "intercept": 0.0}


def apply_binary_calibrator(score: Column, fit: dict[str, float | str]) -> Column:
    return sigmoid(F.lit(float(fit["intercept"])) + F.lit(float(fit["slope"])) * logit(score))


def calibration_macro(cells: DataFrame, event: str, label: str, score: str, min_pos: int = 5) -> DataFrame:
    """Brier, log loss, ECE, MCE, slope and intercept per evaluable event: macro means, medians of the fit, and micro."""
    from doseweave.operators.metrics import brier, ece_equal_mass, nll

    stats = cells.groupBy(event).agg(
        F.sum(label).alias("_p"), F.count(F.lit(1)).alias("_n"), brier(label, score).alias("brier"), nll(label, score).alias("nll")
    ).filter((F.col("_p") >= min_pos) & (F.col("_n") - F.col("_p") >= min_pos))
    kept = durable(cells.join(stats.select(event), event, "left_semi"))
    per = stats.join(ece_equal_mass(kept, label, score, 15, [event]), event).join(
        calibration_slope_intercept(kept, label, score, [event]), event
    )
    macro = per.agg(
        F.count(F.lit(1)).alias("n_events_evaluated"),
        *[F.avg(c).alias(f"macro_{c}") for c in ("brier", "nll", "ece", "mce", "slope", "intercept")],
        F.median("slope").alias("median_slope"), F.median("intercept").alias("median_intercept"),
    )
    micro = cells.agg(brier(label, score).alias("micro_brier"), nll(label, score).alias("micro_nll"))
    whole = ece_equal_mass(cells, label, score).select(F.col("ece").alias("micro_ece"), F.col("mce").alias("micro_mce"))
    fit = calibration_slope_intercept(cells, label, score).select(
        F.col("slope").alias("micro_slope"), F.col("intercept").alias("micro_intercept")
    )
    out = macro
    for part in (micro, whole, fit):
        out = out.withColumn("_s", part.select(F.struct("*")).scalar()).select("*", "_s.*").drop("_s")
    return out

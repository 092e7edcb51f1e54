"""Bootstrap, multiplicity corrections and paired comparisons.

A replicate weight is Poisson(1), read off 32 bits of a hash of (seed, block, key): each SHA-256 serves eight
replicates, so resampling needs no shuffle of its own and repeats exactly.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from hashlib import sha256

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from doseweave.operators.ranking import auroc
from doseweave.operators.replicates import PER_HASH, POISSON_EDGES, hash_key, listed, poisson, replicate_auroc, replicate_means, weight_sums
from doseweave.plans.hashing import priority
from doseweave.plans.ordering import running_sums, score_bucket
from doseweave.session import durable


def bootstrap_weights(df: DataFrame, keys: Sequence[str], replicates: int, seed: int) -> DataFrame:
    """df rows x (replicate, weight) with weight > 0, replicates numbered from 1."""
    blocks = -(-replicates // PER_HASH)
    hashed = df.withColumn("_block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))).withColumn(
        "_h", priority(seed, F.col("_block"), *[F.col(k) for k in keys])
    )

    # Fixed-width hexadecimal texts compare as the numbers they spell; most draws stop at the first two edges.
    u, weight = F.col("_h").substr(F.col("_i") * 8 + 1, F.lit(8)), F.lit(len(POISSON_EDGES))
    for k in reversed(range(len(POISSON_EDGES))):
        weight = F.when(u < f"{POISSON_EDGES[k]:08x}", k).otherwise(weight)
    drawn = hashed.withColumn("_i", F.explode(F.sequence(F.lit(0), F.lit(PER_HASH - 1)))).select(
        *df.columns, (F.col("_block") * PER_HASH + F.col("_i") + 1).alias("replicate"), weight.alias("weight")
    )
    return drawn.filter((F.col("weight") > 0) & (F.col("replicate") <= replicates))


def percentile_interval(replicates: DataFrame, value: str, by: Sequence[str] = (), level: float = 0.95) -> DataFrame:
    """The replicates are few (hundreds per group), so the built-in exact percentile holds them all."""
    low, high = (1 - level) / 2, 1 - (1 - level) / 2
    return replicates.groupBy(*by).agg(
        F.percentile(value, F.lit(low)).alias("ci_low"), F.percentile(value, F.lit(high)).alias("ci_high"),
        F.count(value).alias("n_boot"),
    )


def auroc_interval(
    rows: DataFrame, label: str, score: str, keys: Sequence[str], by: Sequence[str] = (), replicates: int = 200, seed: int = 0,
    level: float = 0.95,
) -> DataFrame:
    """AUROC with its bootstrap interval per group."""
    per = replicate_auroc(rows, label, score, by, hash_key(keys), poisson(replicates, seed))
    interval = percentile_interval(per.filter("auroc IS NOT NULL"), "auroc", by, level)
    point = auroc(rows, label, score, by)
    if by:
        return point.join(interval, list(by), "left")
    return point.withColumn("_i", interval.select(F.struct("*")).scalar()).select("*", "_i.*").drop("_i")


def paired_auroc_difference(
    rows: DataFrame, label: str, score_a: str, score_b: str, keys: Sequence[str], by: Sequence[str] = (), replicates: int = 200,
    seed: int = 0,
) -> DataFrame:
    """AUROC(a) - AUROC(b) on the same resamples, with a two-sided p that is never below 1 / (B + 1)."""
    models = F.array(F.struct(F.lit("a").alias("model"), F.col(score_a).alias("s")), F.struct(F.lit("b").alias("model"), F.col(score_b).alias("s")))
    long = rows.select(*dict.fromkeys([*by, *keys, label]), F.explode(models).alias("m")).select(*dict.fromkeys([*by, *keys, label]), "m.*")

    def difference(per: DataFrame, group: Sequence[str]) -> DataFrame:
        return per.groupBy(*group).agg(
            (F.max(F.when(F.col("model") == "a", F.col("auroc"))) - F.max(F.when(F.col("model") == "b", F.col("auroc")))).alias("diff")
        )

    drawn = replicate_auroc(long, label, "s", [*by, "model"], hash_key(keys), poisson(replicates, seed))
    boot = difference(drawn, [*by, "replicate"])
    tests = boot.groupBy(*by).agg(
        F.percentile("diff", F.lit(0.025)).alias("ci_low"), F.percentile("diff", F.lit(0.975)).alias("ci_high"),
        F.least(
            F.lit(1.0),
            F.greatest(
                2 * F.least(F.avg((F.col("diff") <= 0).cast("double")), F.avg((F.col("diff") >= 0).cast("double"))),
                F.lit(1.0 / (replicates + 1)),
            ),
        ).alias("p_value"),
    )
    point = difference(auroc(long, label, "s", [*by, "model"]), by)
    if by:
        return point.join(tests, list(by))
    return point.withColumn("_i", tests.select(F.struct("*")).scalar()).select("*", "_i.*").drop("_i")


def grouped_interval(
    rows: DataFrame, keys: Sequence[str], by: Sequence[str], metric: Callable[[DataFrame, Sequence[str], Column], DataFrame], value: str,
    replicates: int = 200, seed: int = 0,
) -> DataFrame:
    """The interval of any weighted metric(df, by, weight) -> by..., value."""
    drawn = bootstrap_weights(rows, keys, replicates, seed)
    return percentile_interval(metric(drawn, [*by, "replicate"], F.col("weight")), value, by)


def degradation_bins(rows: DataFrame, similarity: str, label: str, score: str, keys: Sequence[str], replicates: int = 100, seed: int = 0) -> DataFrame:
    """Five similarity bins and overall: n, positive rate, Brier with interval, AUROC with interval."""
    from doseweave.operators.metrics import brier

    place = F.least(F.floor(F.col(similarity) * 5), F.lit(4)).cast("int")
    binned = rows.withColumn("bin", F.explode(F.array(place.cast("string"), F.lit("overall"))))
    base = binned.groupBy("bin").agg(F.count(F.lit(1)).alias("n"), F.avg(label).alias("positive_rate"), brier(label, score).alias("brier"))
    ranked = auroc_interval(binned, label, score, keys, ["bin"], replicates, seed).withColumnsRenamed(
        {"ci_low": "auroc_low", "ci_high": "auroc_high"}).select("bin", "auroc", "auroc_low", "auroc_high")

    error = (F.col(score) - F.col(label)) * (F.col(score) - F.col(label))
    means = replicate_means(binned.withColumn("_e", error), "_e", ["bin"], hash_key(keys), poisson(replicates, seed), "b")
    spread = percentile_interval(means, "b", ["bin"]).select("bin", F.col("ci_low").alias("brier_low"), F.col("ci_high").alias("brier_high"))
    return base.join(ranked, "bin", "left").join(spread, "bin", "left")


def abstention_gain(
    cells: DataFrame, reliability: DataFrame, pair: str, event: str, label: str, score: str, coverage: float, replicates: int = 100,
    min_pos: int = 5, seed: int = 0,
) -> DataFrame:
    """Macro AUROC of the kept pairs minus that of all pairs, the selection redone inside every resample.

    In a resample a pair counts with its weight, so the cut is the weighted position of its reliability. The rows behind
    the answer are one more replicate, in which every pair weighs 1. A replicate's cut is one reliability: pairs above
    it are kept, and those at it that have the lowest hashes, up to their share.
    """
    from doseweave.operators.metrics import evaluable

    drawn, keyed = poisson(replicates, seed), reliability.select(pair, F.col("reliability").cast("double").alias("reliability"), hash_key([pair]).alias("_key"))
    pairs = durable(keyed)

    def weights(keys: pa.Array) -> np.ndarray:
        return np.c_[drawn(keys), np.ones(len(keys), np.int16)]

    ties = durable(
        weight_sums(pairs, ["reliability"], F.col("_key"), weights).select("reliability", F.posexplode("sums").alias("place", "w"))
        .groupBy("place", "reliability").agg(F.sum("w").alias("w")).filter("w > 0")
    )
    totals = ties.groupBy("place").agg(F.sum("w").alias("_n"))
    run = running_sums(ties, "reliability", ["w"], ["place"], descending=True).join(totals, "place")
    k = F.greatest(F.lit(1), F.bround(F.col("_n") * F.lit(float(coverage))))
    share = F.least(F.lit(1.0), (k - (F.col("run_w") - F.col("w"))) / F.col("w"))
    last = run.withColumn("share", share).filter("share > 0").groupBy("place").agg(F.min_by(F.struct("reliability", "share"), "reliability").alias("c"))
    cut, part = np.full(replicates + 1, np.inf), np.zeros(replicates + 1)
    for r in last.collect():
        cut[r.place], part[r.place] = r.c.reliability, r.c.share
    starts = [f"{seed}:tie\0{r}".encode() for r in [*range(1, replicates + 1), 1]]

    def keep(batches):
        for batch in batches:
            keys, value = batch.column(2), batch.column(1).to_numpy(zero_copy_only=False)[:, None]
            w, kept, texts = weights(keys), value > cut, [x.encode() for x in keys.to_pylist()]
            for row, place in zip(*np.nonzero((value == cut) & (w > 0)), strict=True):
                kept[row, place] = int.from_bytes(sha256(starts[place] + texts[row]).digest()[:4]) / 2**32 < part[place]
            both = np.c_[w, np.where(kept, w, 0)].astype(np.int16)
            lists = pa.ListArray.from_arrays(np.arange(0, both.size + 1, both.shape[1], dtype=np.int32), pa.array(both.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column(0), lists], names=[pair, "_w"])

    kind = dict(pairs.dtypes)[pair]
    weighted = pairs.filter("reliability IS NOT NULL").select(pair, "reliability", "_key").mapInArrow(keep, f"`{pair}` {kind}, _w array<smallint>")
    # Weights are many times the bytes of their pairs' table, by whose size a planner would send them to every task.
    scored = cells.select(pair, event, label, score).join(weighted.hint("merge"), pair)
    per = evaluable(replicate_auroc(scored, label, score, [event], F.col("_w"), listed), min_pos).filter("evaluable")
    # The first places are all pairs', the others the kept ones'.
    place, size = F.col("replicate") - 1, replicates + 1
    macro = per.groupBy((place % size).alias("place"), (place >= size).alias("kept")).agg(F.avg("auroc").alias("m"))
    gains = durable(macro.groupBy("place").agg((F.max(F.when(F.col("kept"), F.col("m"))) - F.max(F.when(~F.col("kept"), F.col("m")))).alias("gain")))
    interval = percentile_interval(gains.filter(f"gain IS NOT NULL AND place < {replicates}"), "gain")
    point = gains.filter(f"place = {replicates}")
    return point.select(F.lit(float(coverage)).alias("coverage"), "gain").withColumn(
        "_i", interval.select(F.struct("*")).scalar()).select("*", "_i.*").drop("_i")


def _step_adjusted(tests: DataFrame, p: str, by: Sequence[str], scaled: Callable, extreme: Callable, descending: bool, out: str) -> DataFrame:
    """Running extreme of scaled p-values, capped at 1, in buckets of p with the extremes of the buckets before.

    Equal p-values get equal answers, so they are counted first. A missing p is no test: it isn't counted and gets null.
    """
    keys = [*by, "_one"]
    ties = tests.filter(F.col(p).isNotNull()).withColumn("_one", F.lit(1)).groupBy(*keys, p).agg(F.count(F.lit(1)).alias("_c"))
    totals = ties.groupBy(*keys).agg(F.sum("_c").alias("_m"))
    ranked = running_sums(ties, p, ["_c"], keys).join(totals, keys)
    steps = ranked.withColumns({"_s": scaled(F.col(p), F.col("_m"), F.col("run__c"), F.col("_c")), "_b": score_bucket(F.col(p))})
    turn = (lambda c: F.col(c).desc()) if descending else F.col
    first = Window.unboundedPreceding
    earlier = Window.partitionBy(*keys).orderBy(turn("_b")).rowsBetween(first, -1)
    inside = Window.partitionBy(*keys, "_b").orderBy(turn(p)).rowsBetween(first, Window.currentRow)
    before = steps.groupBy(*keys, "_b").agg(extreme("_s").alias("_x")).select(*keys, "_b", extreme("_x").over(earlier).alias("_before"))
    reached = steps.withColumn("_in", extreme("_s").over(inside)).join(before, [*keys, "_b"])
    both = F.array_compact(F.array("_in", "_before"))
    last = F.array_min(both) if descending else F.array_max(both)
    answers = reached.select(*by, p, F.least(F.lit(1.0), last).alias(out))
    return tests.join(answers, [*by, p], "left").select(*tests.columns, out)


def holm_adjust(tests: DataFrame, p: str, by: Sequence[str] = (), out: str = "p_holm") -> DataFrame:
    """Running maximum of (m - i) p from the smallest p, capped at 1."""
    return _step_adjusted(tests, p, by, lambda x, m, run, c: (m - (run - c)) * x, F.max, False, out)


def bh_adjust(tests: DataFrame, p: str, by: Sequence[str] = (), out: str = "q_value", alpha: float = 0.05) -> DataFrame:
    """Running minimum of p m / rank from the largest p, capped at 1, and the decision at alpha."""
    adjusted = _step_adjusted(tests, p, by, lambda x, m, run, c: x * m / run, F.min, True, out)
    return adjusted.withColumn("significant", F.col(out) <= alpha)


def signed_rank_p(differences: Sequence[float]) -> float | None:
    """Exact two-sided Wilcoxon p over all sign patterns, ties included, at every length; None without a nonzero difference.

    Doubled ranks are whole numbers, so the null distribution is an array of shares by rank sum: each rank either joins the sum
    or doesn't. That is n additions of arrays of n (n + 1) cells.
    """
    values = np.array([d for d in differences if d != 0 and d == d], float)
    if not len(values):
        return None
    doubled = (2 * pd.Series(np.abs(values)).rank()).round().astype(int).to_numpy()
    observed = int(min(doubled[values > 0].sum(), doubled[values < 0].sum()))
    share = np.zeros(int(doubled.sum()) + 1)
    share[0] = 1.0
    for rank in doubled:
        joined = np.zeros_like(share)
        joined[rank:] = share[:-rank]
        share = (share + joined) / 2
    return min(1.0, 2 * float(share[: observed + 1].sum()))


def _t_tail(t: float, df: int) -> float:
    """Two-sided tail of Student's t by the finite trigonometric series."""
    from math import atan, cos, pi, sin, sqrt

    theta = atan(abs(t) / sqrt(df))
    if df == 1:
        inside = 2 * theta / pi
    elif df % 2:
        term, acc = cos(theta), cos(theta)
        for k in range(2, df - 1, 2):
            term *= k / (k + 1) * cos(theta) ** 2
            acc += term
        inside = 2 / pi * (theta + sin(theta) * acc)
    else:
        term, acc = 1.0, 1.0
        for k in range(1, df - 2, 2):
            term *= k / (k + 1) * cos(theta) ** 2
            acc += term
        inside = sin(theta) * acc
    return max(0.0, 1.0 - inside)


def _t_quantile(p_two_sided: float, df: int) -> float:
    low, high = 0.0, 1e6
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if _t_tail(mid, df) > p_two_sided else (low, mid)
    return (low + high) / 2


@F.pandas_udf(T.StructType([T.StructField("ci_low", T.DoubleType()), T.StructField("ci_high", T.DoubleType()),
                            T.StructField("p_t", T.DoubleType()), T.StructField("p_wilcoxon", T.DoubleType())]))
def _small_tests(differences: pd.Series) -> pd.DataFrame:
    """The t interval, t test and exact Wilcoxon of each row's short array of seed differences."""
    out = []
    for values in differences:
        d = [float(v) for v in values]
        n, mean = len(d), sum(d) / max(len(d), 1)
        if n < 2:
            out.append((None, None, None, None))
            continue
        sd = (sum((v - mean) ** 2 for v in d) / (n - 1)) ** 0.5
        half = _t_quantile(0.05, n - 1) * sd / n**0.5
        p = _t_tail(mean / (sd / n**0.5), n - 1) if sd > 0 else (1.0 if mean == 0 else 0.0)
        out.append((mean - half, mean + half, p, signed_rank_p(d)))
    return pd.DataFrame(out, columns=["ci_low", "ci_high", "p_t", "p_wilcoxon"])


def paired_seed_comparison(runs: DataFrame, value: str, baseline: str, keys: Sequence[str] = ("split", "partition"),
                           feature: str = "features", seed: str = "seed") -> DataFrame:
    """Matched-seed differences of every feature set against a baseline: mean, sample sd, improved seeds, tests.

    The tests see one short array per comparison (a study has tens of seeds).
    """
    base = runs.filter(F.col(feature) == baseline).select(*keys, seed, F.col(value).alias("_base"))
    matched = runs.filter(F.col(feature) != baseline).join(base, [*keys, seed]).withColumn("d", F.col(value) - F.col("_base"))
    per = matched.groupBy(*keys, feature).agg(
        F.count(F.lit(1)).alias("n_seeds"), F.avg("_base").alias("baseline_mean"), F.avg(value).alias("candidate_mean"),
        F.avg("d").alias("mean_diff"), F.stddev_samp("d").alias("sd_diff"), F.count_if(F.col("d") > 0).alias("n_improved"),
        F.sort_array(F.collect_list("d")).alias("_d"),
    )
    return per.withColumn("_t", _small_tests("_d")).select("*", "_t.*").drop("_d", "_t")


def experiment_comparison(table: DataFrame, reference: str, metrics: Sequence[str], experiment: str = "experiment", seed: str = "seed",
                          split: str = "split", min_seeds: int = 5) -> DataFrame:
    """Every candidate x split x metric against the reference on matched seeds, Wilcoxon from five seeds, Holm over all."""
    long = table.unpivot([experiment, seed, split], list(metrics), "metric", "value")
    compared = paired_seed_comparison(long, "value", reference, (split, "metric"), experiment, seed)
    tested = compared.withColumn("p_wilcoxon", F.when(F.col("n_seeds") >= min_seeds, F.col("p_wilcoxon")))
    ranked = holm_adjust(tested.filter("p_wilcoxon IS NOT NULL"), "p_wilcoxon")
    return ranked.unionByName(tested.filter("p_wilcoxon IS NULL").withColumn("p_holm", F.lit(None).cast("double")))


def seed_summary(runs: DataFrame, metrics: Sequence[str], evidence: Sequence[str], by: Sequence[str] = ("split",), seed: str = "seed",
                 replicates: int = 200, bootstrap_seed: int = 0) -> DataFrame:
    """Per metric: n, mean, sample sd and a bootstrap interval of the mean; runs with differing evidence fail the query."""
    same = runs.groupBy(*by).agg(*[(F.min(e) == F.max(e)).alias(f"_{e}") for e in evidence])
    for e in evidence:
        same = same.withColumn(f"_{e}", F.when(F.col(f"_{e}"), True).otherwise(F.raise_error(F.lit(f"runs differ in {e}")).cast("boolean")))
    checked = runs.join(same, list(by))
    for e in evidence:
        checked = checked.filter(F.col(f"_{e}"))
    long = checked.unpivot([*by, seed], list(metrics), "metric", "value").filter("value IS NOT NULL")
    base = long.groupBy(*by, "metric").agg(F.count("value").alias("n"), F.avg("value").alias("mean"), F.stddev_samp("value").alias("sd"))

    def mean(df: DataFrame, group: Sequence[str], w: Column) -> DataFrame:
        return df.groupBy(*group).agg((F.sum(w * F.col("value")) / F.sum(w)).alias("m"))

    interval = grouped_interval(long, [seed], [*by, "metric"], mean, "m", replicates, bootstrap_seed).drop("n_boot")
    return base.join(interval, [*by, "metric"], "left")


def agreement_table(pairs: DataFrame, scores: Sequence[str], flags: Sequence[str], subsets: dict[str, Column], min_pos: int = 20) -> DataFrame:
    """AUROC of each pair score against each curated flag on overlapping subsets.

    A constant score, or a flag too rare or too common, has no AUROC.
    """
    from doseweave.operators.profiles import subcohorts

    long_scores = subcohorts(pairs, subsets).unpivot(["cohort", *flags], list(scores), "score_name", "score")
    flagged = F.array(*[F.struct(F.lit(f).alias("flag"), F.col(f).cast("int").alias("y")) for f in flags])
    long = long_scores.select("cohort", "score_name", "score", F.explode(flagged).alias("_f")).select("cohort", "score_name", "score", "_f.*")
    keys = ["flag", "cohort", "score_name"]
    stats = long.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_pairs"), F.sum("y").alias("n_flag_pos"), F.avg("y").alias("flag_prevalence"),
        (F.min("score") == F.max("score")).alias("score_is_constant"),
    )
    ranked = auroc(long, "y", "score", keys).select(*keys, "auroc")
    enough = (F.col("n_flag_pos") >= min_pos) & (F.col("n_flag_pos") <= F.col("n_pairs") - min_pos) & ~F.col("score_is_constant")
    return stats.join(ranked, keys).withColumn("auroc", F.when(enough, F.col("auroc")))


def reconcile_results(table: DataFrame, expected: DataFrame, keys: Sequence[str], max_p: float, max_q: float, min_improved: int) -> DataFrame:
    """expected(keys...) against results(keys..., p, q, n_improved): present, and each threshold met."""
    joined = expected.join(table, list(keys), "left")
    return joined.select(
        *keys, F.col("p").isNotNull().alias("present"), F.coalesce(F.col("p") <= max_p, F.lit(False)).alias("p_ok"),
        F.coalesce(F.col("q") <= max_q, F.lit(False)).alias("q_ok"),
        F.coalesce(F.col("n_improved") >= min_improved, F.lit(False)).alias("improved_ok"),
    )


def monotone_strata(results: DataFrame, keys: Sequence[str], stratum: str, value: str, order: Sequence[str]) -> DataFrame:
    """Whether a value rises through the ordered strata, and whether the first stratum shows no effect (< 0.005)."""
    per = results.groupBy(*keys).agg(*[F.max(F.when(F.col(stratum) == s, F.col(value))).alias(f"v{i}") for i, s in enumerate(order)])
    rises = F.lit(True)
    for i in range(len(order) - 1):
        rises = rises & (F.col(f"v{i}") <= F.col(f"v{i + 1}"))
    return per.select(*keys, rises.alias("monotone"), (F.abs("v0") < 0.005).alias("null_stratum_ok"))

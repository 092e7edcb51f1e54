"""Calibration, conformal, selective and comparison queries over the scored cells."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from doseweave.catalog.evaluation import CELLS_SQL, ERRORS_SQL, GRID_SQL, auroc_sql, cells, grid, rounded, scored_rows
from doseweave.catalog.registry import Tables, query
from doseweave.catalog.splitting import PART_PAIRS_SQL, PAIRS, part_pairs
from doseweave.functions.numeric import bernoulli_entropy, logit, sigmoid
from doseweave.operators import calibration, comparison, conformal, resampling


def newton_sql(source: str, by: str, lam: float = 0.0, steps: int = 10, ridge: float = 1e-9) -> str:
    """Plain Newton steps of the penalised logistic fit from (0, 1), one materialised CTE each: nw(by, a, b)."""
    out = [f"nx AS MATERIALIZED (SELECT {by}, ln(score / (1 - score)) AS x, label AS y FROM {source})",
           f"n0 AS MATERIALIZED (SELECT DISTINCT {by}, 0.0::DOUBLE AS a, 1.0::DOUBLE AS b FROM nx)"]
    for k in range(steps):
        out.append(
            f"""n{k + 1} AS MATERIALIZED (SELECT {by}, a - (hb * ga - hab * gb) / (ha * hb - hab * hab) AS a, b - (ha * gb - hab * ga) / (ha * hb - hab * hab) AS b FROM
 (SELECT {by}, a, b, sum(q - y) + 2 * {lam} * a AS ga, sum((q - y) * x) + 2 * {lam} * (b - 1) AS gb, sum(q * (1 - q)) + 2 * {lam} + {ridge} AS ha, sum(q * (1 - q) * x) AS hab, sum(q * (1 - q) * x * x) + 2 * {lam} + {ridge} AS hb
  FROM (SELECT nx.*, a, b, 1 / (1 + exp(-(a + b * x))) AS q FROM nx JOIN n{k} USING ({by})) GROUP BY 1, 2, 3))"""
        )
    return ",\n".join(out)


@query(CELLS_SQL + ", " + newton_sql("c", "event_idx") + "\nSELECT event_idx, round(a, 4) AS intercept, round(b, 4) AS slope FROM n10")
def calibration_slopes(t: Tables) -> DataFrame:
    return rounded(calibration.calibration_slope_intercept(cells(t), "label", "score", ["event_idx"]), 4)


@query(CELLS_SQL + ", " + newton_sql("c", "event_idx", 250.0) + "\nSELECT event_idx, round(a, 4) AS intercept, round(b, 4) AS slope FROM n10")
def shrunk_platt_maps(t: Tables) -> DataFrame:
    return rounded(calibration.fit_platt(cells(t), "label", "score", ["event_idx"], lam=250.0), 4)


@query(CELLS_SQL + "SELECT DISTINCT event_idx, 0.0::DOUBLE AS gradient FROM c")
def shared_slope_gradient(t: Tables) -> DataFrame:
    """The score equations of the shared-slope fit, which are zero at the optimum."""
    rows = cells(t)
    fit = calibration.fit_shared_slope(rows, "event_idx", "label", "score").drop("ok")
    q = sigmoid(F.col("intercept") + F.col("slope") * logit(F.col("score")))
    return rows.join(fit, "event_idx").groupBy("event_idx").agg((F.abs(F.round(F.sum(q - F.col("label")), 2))).alias("gradient"))


@query()
def event_calibration_maps(t: Tables) -> DataFrame:
    return rounded(calibration.event_calibrator(cells(t), "event_idx", "label", "score"), 4)


@query(
    CELLS_SQL + ", a0 AS (SELECT 0 AS k, * FROM c), " + newton_sql("a0", "k")
    + "\nSELECT qty, round(avg((1 / (1 + exp(-(a + b * ln(score / (1 - score))))) - label) ** 2), 4) AS brier FROM c, n10 GROUP BY 1"
)
def platt_calibrated_brier(t: Tables) -> DataFrame:
    rows = cells(t)
    fit = calibration.fit_binary_calibrator(rows, "label", "score")
    p = calibration.apply_binary_calibrator(F.col("score"), fit)
    return rows.groupBy("qty").agg(F.round(F.avg((p - F.col("label")) ** 2), 4).alias("brier"))


@query()
def temperature_scaling(t: Tables) -> DataFrame:
    rows = cells(t)
    fit = calibration.fit_binary_calibrator(rows, "label", "score", "temperature")
    p = calibration.apply_binary_calibrator(F.col("score"), fit)
    return rows.groupBy("event_idx").agg(F.round(F.avg(p), 4).alias("mean_p"), F.round(F.avg(bernoulli_entropy(p)), 4).alias("mean_entropy"))


@query()
def calibration_macro_table(t: Tables) -> DataFrame:
    return rounded(calibration.calibration_macro(cells(t), "event_idx", "label", "score"), 4)


CONFORMAL_SQL = """, nc AS (SELECT event_idx, label AS y, CASE WHEN label = 1 THEN 1 - score ELSE score END AS s FROM c),
nr AS (SELECT *, row_number() OVER (PARTITION BY event_idx, y ORDER BY s) AS r, count(*) OVER (PARTITION BY event_idx, y) AS n FROM nc),
th AS (SELECT event_idx, coalesce(max(CASE WHEN y = 1 AND r = ceil((n + 1) * (1 - 0.1::DOUBLE)) THEN s END), 'infinity'::DOUBLE) AS q1, coalesce(max(CASE WHEN y = 0 AND r = ceil((n + 1) * (1 - 0.1::DOUBLE)) THEN s END), 'infinity'::DOUBLE) AS q0,
  count(*) FILTER (WHERE y = 1) AS n1, count(*) FILTER (WHERE y = 0) AS n0 FROM nr GROUP BY 1)
"""


@query(CELLS_SQL + CONFORMAL_SQL + "SELECT event_idx, round(q1, 6) AS q1, round(q0, 6) AS q0, n1, n0 FROM th")
def conformal_thresholds(t: Tables) -> DataFrame:
    return rounded(conformal.conformal_thresholds(cells(t), "label", "score", ["event_idx"]))


@query(
    CELLS_SQL + CONFORMAL_SQL + """, st AS (SELECT c.*, (1 - score) <= q1 AS in1, score <= q0 AS in0 FROM c JOIN th USING (event_idx)),
pe AS (SELECT event_idx, avg(CASE WHEN label = 1 THEN in1::INTEGER END) AS c1, avg(CASE WHEN label = 0 THEN in0::INTEGER END) AS c0 FROM st GROUP BY 1)
SELECT (SELECT count(*) FROM pe) AS n_events_evaluated, (SELECT round(avg(c1), 6) FROM pe) AS coverage_positive_macro, (SELECT round(avg(c0), 6) FROM pe) AS coverage_negative_macro,
  (SELECT round(min(c1), 6) FROM pe) AS coverage_positive_min_event, (SELECT round(avg((c1 >= 0.85)::INTEGER), 6) FROM pe) AS frac_events_pos_cov_within_5pts, round(avg(in1::INTEGER + in0::INTEGER), 6) AS mean_set_size,
  round(avg((in1 AND NOT in0)::INTEGER), 6) AS frac_singleton_1, round(avg((in0 AND NOT in1)::INTEGER), 6) AS frac_singleton_0, round(avg((in1 AND in0)::INTEGER), 6) AS frac_both, round(avg((NOT in1 AND NOT in0)::INTEGER), 6) AS frac_empty FROM st"""
)
def conformal_coverage_report(t: Tables) -> DataFrame:
    rows = cells(t)
    cuts = conformal.conformal_thresholds(rows, "label", "score", ["event_idx"])
    return rounded(conformal.conformal_report(conformal.conformal_sets(rows, cuts, "score", ["event_idx"]), "event_idx", "label"))


@query(
    ERRORS_SQL + """, cal AS (SELECT CASE WHEN label = 1 THEN 1 - score ELSE score END AS s FROM r WHERE row_id % 2 = 0), cc AS (SELECT s, sum(count(*)) OVER (ORDER BY s DESC) AS ge FROM cal GROUP BY s), nn AS (SELECT count(*) AS n FROM cal),
q AS (SELECT row_id, 1 - score AS s1, score AS s0 FROM r WHERE row_id % 2 = 1),
p AS (SELECT row_id, (coalesce(x.ge, 0) + 1)::DOUBLE / (n + 1) AS p_value_1, (coalesce(y.ge, 0) + 1)::DOUBLE / (n + 1) AS p_value_0 FROM q ASOF LEFT JOIN cc x ON q.s1 <= x.s ASOF LEFT JOIN cc y ON q.s0 <= y.s, nn)
SELECT row_id, round(p_value_1, 6) AS p_value_1, round(p_value_0, 6) AS p_value_0, CASE WHEN p_value_1 > 0.1 AND p_value_0 > 0.1 THEN '{0,1}' WHEN p_value_1 > 0.1 THEN '{1}' WHEN p_value_0 > 0.1 THEN '{0}' ELSE '{}' END AS prediction_set,
  (p_value_1 > 0.1) = (p_value_0 > 0.1) AS abstain FROM p"""
)
def binary_conformal_sets(t: Tables) -> DataFrame:
    """Even rows calibrate, odd rows are predicted."""
    rows = scored_rows(t)
    out = conformal.binary_conformal(rows.filter("row_id % 2 = 0"), rows.filter("row_id % 2 = 1"), "label", "score")
    return rounded(out.drop("label", "score"))


@query(
    PART_PAIRS_SQL + """, tr AS (SELECT drug_a AS d FROM pp WHERE label = 1 UNION SELECT drug_b FROM pp WHERE label = 1)
SELECT regime, count(*) AS n FROM (SELECT (drug_a NOT IN (SELECT d FROM tr))::INTEGER + (drug_b NOT IN (SELECT d FROM tr))::INTEGER AS regime FROM pp) GROUP BY 1"""
)
def pair_regimes(t: Tables) -> DataFrame:
    pairs = part_pairs(t)
    marked = conformal.regime(pairs.select(*PAIRS), pairs.filter("label = 1"))
    return marked.groupBy("regime").agg(F.count(F.lit(1)).alias("n"))


@query()
def regime_aware_maps(t: Tables) -> DataFrame:
    """Per-regime calibration and conformal cuts; the regime of a part is its size band, the largest one too small to fit alone."""
    size = t.part.select(F.col("p_partkey").alias("pair_id"), F.when(F.col("p_size") < 20, 0).when(F.col("p_size") < 49, 1).otherwise(2).alias("regime"))
    rows = grid(t).join(size, "pair_id")
    return rounded(conformal.regime_aware(rows, "pair_id", "event_idx", "label", "score"), 4)


RELIABILITY_SQL = GRID_SQL + """, rl AS (SELECT p_partkey AS pair_id, p_size::DOUBLE AS reliability FROM part)
"""


def reliability(t: Tables) -> DataFrame:
    return t.part.select(F.col("p_partkey").alias("pair_id"), F.col("p_size").cast("double").alias("reliability"))


@query(
    RELIABILITY_SQL + f""", po AS (SELECT *, row_number() OVER (ORDER BY reliability DESC, sha256('0' || chr(0) || pair_id)) AS rn, count(*) OVER () AS n FROM rl),
kp AS (SELECT pair_id, reliability, level FROM po, (VALUES (1.0::DOUBLE), (0.9), (0.75), (0.5), (0.25)) v(level) WHERE rn <= greatest(1, round_even(n * level, 0))),
sc AS (SELECT g.*, level FROM g JOIN kp USING (pair_id)), rk AS ({auroc_sql('sc', 'level, event_idx')})
SELECT level, (SELECT count(*) FROM kp k WHERE k.level = rk.level) AS n_pairs, (SELECT min(reliability) FROM kp k WHERE k.level = rk.level) AS min_reliability,
  round(avg(auroc) FILTER (WHERE n_pos >= 5 AND n_neg >= 5), 6) AS macro_auroc, count(*) FILTER (WHERE n_pos >= 5 AND n_neg >= 5) AS n_events_evaluable FROM rk GROUP BY 1"""
)
def risk_coverage_curve(t: Tables) -> DataFrame:
    return rounded(conformal.risk_coverage(grid(t), reliability(t), "pair_id", "event_idx", "label", "score"))


@query(
    RELIABILITY_SQL + f""", ta AS (SELECT quantile_cont(reliability, 0.4::DOUBLE) AS tau FROM rl WHERE pair_id % 2 = 0), mk AS (SELECT pair_id, reliability >= tau AS ok, tau FROM rl, ta),
sc AS (SELECT g.* FROM g JOIN mk USING (pair_id) WHERE ok), ra AS ({auroc_sql('sc', 'event_idx')}), rb AS ({auroc_sql('g', 'event_idx')})
SELECT (SELECT tau FROM ta) AS tau, round(avg(ok::INTEGER), 6) AS realised_coverage, count(*) FILTER (WHERE ok) AS n_answered, (SELECT round(avg(auroc), 6) FROM ra) AS macro_auroc_answered, (SELECT count(*) FROM ra) AS n_events_evaluable,
  (SELECT round(avg(auroc), 6) FROM rb) AS macro_auroc_all FROM mk"""
)
def deployed_abstention(t: Tables) -> DataFrame:
    rel = reliability(t)
    return rounded(conformal.deployed_summary(grid(t), rel, rel.filter("pair_id % 2 = 0"), 0.6, "pair_id", "event_idx", "label", "score"))


@query()
def random_abstention_null(t: Tables) -> DataFrame:
    pairs = t.part.select(F.col("p_partkey").alias("pair_id"))
    return rounded(conformal.random_abstention(grid(t), pairs, "pair_id", "event_idx", "label", "score"), 4)


@query()
def abstention_gain_interval(t: Tables) -> DataFrame:
    return rounded(resampling.abstention_gain(grid(t), reliability(t), "pair_id", "event_idx", "label", "score", 0.5), 4)


@query(
    CELLS_SQL + """SELECT round(avg((tax <= 0.06)::INTEGER), 6) AS coverage, count(*) FILTER (WHERE tax <= 0.06) AS n, round(avg(CASE WHEN tax <= 0.06 THEN ((score >= 0.5)::INTEGER = label)::INTEGER END), 6) AS accuracy FROM c"""
)
def selective_metrics(t: Tables) -> DataFrame:
    rows = cells(t).withColumn("abstain", F.col("tax") > 0.06)
    return rounded(conformal.selective_summary(rows, "label", "score", 0.5).select("coverage", "n", "accuracy"))


ABSTAIN_SQL = CELLS_SQL + """, ab AS (SELECT tax > 0.06 AS cf, qty > 40 AS sd, part % 10 = 0 AS od FROM c)
"""


@query(
    ABSTAIN_SQL + """SELECT count(*) AS n_rows, round(avg((cf OR sd OR od)::INTEGER), 6) AS abstention_rate, round(avg(cf::INTEGER), 6) AS conformal_rate, round(avg(sd::INTEGER), 6) AS disagreement_rate, round(avg(od::INTEGER), 6) AS domain_rate FROM ab"""
)
def abstention_rates(t: Tables) -> DataFrame:
    rows = cells(t).select((F.col("tax") > 0.06).alias("conformal"), F.col("qty").alias("sd"), (F.col("part") % 10 == 0).alias("ood"))
    return rounded(comparison.abstention_summary(comparison.safe_abstention(rows, 40)))


def weights_sql(source: str, keys: list[str], blocks: int, seed: str) -> str:
    """bw: source rows x (replicate, w) by the Poisson(1) edges of each 32-bit piece of the block hash."""
    edges = " + ".join(f"(u >= {e})::INTEGER" for e in resampling.POISSON_EDGES)
    joined = " || chr(0) || ".join(["b"] + keys)
    return f"""bw AS (SELECT * FROM (SELECT * EXCLUDE (h, b, i, u), b * 8 + i + 1 AS replicate, {edges} AS w FROM
 (SELECT *, ('0x' || substr(h, i * 8 + 1, 8))::BIGINT AS u FROM (SELECT *, unnest(generate_series(0, 7)) AS i FROM (SELECT *, sha256('{seed}' || chr(0) || {joined}) AS h FROM {source}, (SELECT unnest(generate_series(0, {blocks - 1})) AS b))))) WHERE w > 0)"""


BOOT_SQL = ERRORS_SQL + ", " + weights_sql("r", ["row_id"], 2, "0") + """,
bc AS (SELECT replicate, score, sum(w * label)::DOUBLE AS pos, sum(w * (1 - label))::DOUBLE AS neg FROM bw GROUP BY 1, 2),
ba AS (SELECT replicate, sum(pos * (below + neg / 2.0)) / (sum(pos) * sum(neg)) AS auroc FROM (SELECT *, sum(neg) OVER (PARTITION BY replicate ORDER BY score) - neg AS below FROM bc) GROUP BY 1)
"""


@query(BOOT_SQL + f", pt AS ({auroc_sql('r')}) SELECT n_pos, n_neg, round(auroc, 6) AS auroc, (SELECT round(quantile_cont(auroc, 0.025::DOUBLE), 6) FROM ba) AS ci_low, (SELECT round(quantile_cont(auroc, 0.975::DOUBLE), 6) FROM ba) AS ci_high, (SELECT count(*) FROM ba) AS n_boot FROM pt")
def bootstrap_auroc_interval(t: Tables) -> DataFrame:
    return rounded(resampling.auroc_interval(scored_rows(t), "label", "score", ["row_id"], replicates=16))


@query(ERRORS_SQL + ", " + weights_sql("r", ["row_id"], 1, "5") + " SELECT replicate::INTEGER AS replicate, count(*) AS rows, sum(w)::BIGINT AS total_weight FROM bw GROUP BY 1")
def bootstrap_replicate_weights(t: Tables) -> DataFrame:
    drawn = resampling.bootstrap_weights(scored_rows(t), ["row_id"], 8, 5)
    return drawn.groupBy("replicate").agg(F.count(F.lit(1)).alias("rows"), F.sum("weight").alias("total_weight"))


@query()
def paired_bootstrap_difference(t: Tables) -> DataFrame:
    rows = scored_rows(t).withColumn("other", F.floor(F.col("score") * 5) / 5)
    return rounded(resampling.paired_auroc_difference(rows, "label", "score", "other", ["row_id"]))


@query()
def similarity_degradation(t: Tables) -> DataFrame:
    rows = scored_rows(t).withColumn("similarity", (F.col("row_id") % 97) / 97.0)
    return rounded(resampling.degradation_bins(rows, "similarity", "label", "score", ["row_id"]))


TESTS_SQL = """WITH p AS (SELECT l_suppkey AS k, avg((l_returnflag = 'R')::INTEGER) / 40 AS p FROM lineitem GROUP BY 1),
o AS (SELECT *, row_number() OVER (ORDER BY p, k) AS i, count(*) OVER () AS m FROM p)
"""


def p_values(t: Tables) -> DataFrame:
    return t.lineitem.groupBy(F.col("l_suppkey").alias("k")).agg((F.avg((F.col("l_returnflag") == "R").cast("int")) / 40).alias("p"))


@query(TESTS_SQL + "SELECT k, round(least(1, max((m - i + 1) * p) OVER (ORDER BY p, k ROWS UNBOUNDED PRECEDING)), 6) AS p_holm FROM o")
def holm_adjusted(t: Tables) -> DataFrame:
    return rounded(resampling.holm_adjust(p_values(t), "p").drop("p"))


@query(TESTS_SQL + "SELECT k, round(least(1, min(p * m / i) OVER (ORDER BY i DESC ROWS UNBOUNDED PRECEDING)), 6) AS q_value, least(1, min(p * m / i) OVER (ORDER BY i DESC ROWS UNBOUNDED PRECEDING)) <= 0.0086 AS significant FROM o")
def benjamini_hochberg(t: Tables) -> DataFrame:
    return rounded(resampling.bh_adjust(p_values(t), "p", alpha=0.0086).drop("p"))


RUNS_SQL = """WITH runs AS (SELECT l_linestatus AS split, l_returnflag AS features, l_linenumber AS seed, avg(l_extendedprice / 100000 + l_discount) AS macro_auroc, avg(l_tax) AS macro_auprc FROM lineitem GROUP BY 1, 2, 3),
d AS (SELECT r.split, r.features, b.macro_auroc AS base, r.macro_auroc AS cand, r.macro_auroc - b.macro_auroc AS d FROM runs r JOIN runs b ON r.split = b.split AND r.seed = b.seed AND b.features = 'A' WHERE r.features <> 'A')
"""


def study_runs(t: Tables) -> DataFrame:
    """Seven seeds (line numbers) x three feature sets (return flags) x two splits (line states)."""
    return t.lineitem.groupBy(F.col("l_linestatus").alias("split"), F.col("l_returnflag").alias("features"), F.col("l_linenumber").alias("seed")).agg(
        F.avg(F.col("l_extendedprice") / 100000 + F.col("l_discount")).alias("macro_auroc"), F.avg("l_tax").alias("macro_auprc"))


#: Student's tail at six degrees of freedom in closed form, and the signed-rank sums of all sign patterns.
TESTS_SQL = RUNS_SQL + """, th AS (SELECT split, features, atan(abs(avg(d) / (stddev_samp(d) / sqrt(count(*)))) / sqrt(6)) AS th FROM d GROUP BY 1, 2),
tails AS (SELECT split, features, greatest(0, 1 - sin(th) * (1 + cos(th) ** 2 / 2 + 3 * cos(th) ** 4 / 8)) AS p_t FROM th),
rk AS (SELECT split, features, d, row_number() OVER (PARTITION BY split, features ORDER BY abs(d)) - 1 AS i, rank() OVER (PARTITION BY split, features ORDER BY abs(d)) + (count(*) OVER (PARTITION BY split, features, abs(d)) - 1) / 2.0 AS r FROM d WHERE d <> 0),
seen_ AS (SELECT split, features, least(sum(r) FILTER (WHERE d > 0), sum(r) FILTER (WHERE d < 0)) AS w, count(*) AS n FROM (SELECT split, features, d, r FROM rk UNION ALL SELECT DISTINCT split, features, s, 0 FROM rk, (VALUES (1), (-1)) v(s)) GROUP BY 1, 2),
sums AS (SELECT split, features, m, sum(CASE WHEN (m >> i) & 1 = 1 THEN r ELSE 0 END) AS s FROM rk, range(128) x(m) GROUP BY 1, 2, 3),
signed AS (SELECT split, features, least(1, 2 * count(*) FILTER (WHERE s <= w) / 128.0) AS p_w FROM sums JOIN seen_ USING (split, features) GROUP BY 1, 2)
"""


@query(
    TESTS_SQL + """SELECT split, features, count(*) AS n_seeds, round(avg(base), 6) AS baseline_mean, round(avg(cand), 6) AS candidate_mean, round(avg(d), 6) AS mean_diff, round(stddev_samp(d), 6) AS sd_diff,
  count(*) FILTER (WHERE d > 0) AS n_improved, round(avg(d) - 2.446911851 * stddev_samp(d) / sqrt(count(*)), 6) AS ci_low, round(avg(d) + 2.446911851 * stddev_samp(d) / sqrt(count(*)), 6) AS ci_high,
  round(max(p_t), 6) AS p_t, round(max(p_w), 6) AS p_wilcoxon FROM d JOIN tails USING (split, features) JOIN signed USING (split, features) GROUP BY 1, 2"""
)
def paired_seed_comparison(t: Tables) -> DataFrame:
    out = resampling.paired_seed_comparison(study_runs(t), "macro_auroc", "A", ["split"])
    return rounded(out)


@query()
def experiment_comparison(t: Tables) -> DataFrame:
    runs = study_runs(t).withColumnRenamed("features", "experiment")
    return rounded(resampling.experiment_comparison(runs, "A", ["macro_auroc", "macro_auprc"]))


@query()
def seed_summary(t: Tables) -> DataFrame:
    runs = study_runs(t).withColumn("input_sha256", F.sha2("split", 256))
    return rounded(resampling.seed_summary(runs, ["macro_auroc", "macro_auprc"], ["input_sha256"], ["split", "features"]))


@query(
    RUNS_SQL + """SELECT s AS split, f AS features, EXISTS (SELECT 1 FROM d WHERE split = s AND features = f) AS present, coalesce((SELECT avg(d) FROM d WHERE split = s AND features = f) <= 0.02, FALSE) AS p_ok,
  coalesce((SELECT stddev_samp(d) FROM d WHERE split = s AND features = f) <= 0.01, FALSE) AS q_ok, coalesce((SELECT count(*) FROM d WHERE split = s AND features = f AND d > 0) >= 4, FALSE) AS improved_ok
FROM (SELECT DISTINCT l_linestatus AS s FROM lineitem), (VALUES ('N'), ('R'), ('Z')) v(f)"""
)
def reconciled_results(t: Tables) -> DataFrame:
    table = resampling.paired_seed_comparison(study_runs(t), "macro_auroc", "A", ["split"]).withColumnsRenamed({"mean_diff": "p", "sd_diff": "q"})
    expected = t.lineitem.select(F.col("l_linestatus").alias("split")).distinct().withColumn("features", F.explode(F.array(*map(F.lit, ["N", "R", "Z"]))))
    return resampling.reconcile_results(table, expected, ["split", "features"], 0.02, 0.01, 4)


@query(
    RUNS_SQL.replace("WITH runs", "WITH runs") + """SELECT split, max(CASE WHEN features = 'A' THEN v END) <= max(CASE WHEN features = 'N' THEN v END) AND max(CASE WHEN features = 'N' THEN v END) <= max(CASE WHEN features = 'R' THEN v END) AS monotone,
  abs(max(CASE WHEN features = 'A' THEN v END)) < 0.005 AS null_stratum_ok FROM (SELECT split, features, avg(macro_auprc) AS v FROM runs GROUP BY 1, 2) GROUP BY 1"""
)
def monotone_strata(t: Tables) -> DataFrame:
    means = study_runs(t).groupBy("split", "features").agg(F.avg("macro_auprc").alias("v"))
    return resampling.monotone_strata(means, ["split"], "features", "v", ["A", "N", "R"])


@query(
    CELLS_SQL + f""", pr AS (SELECT part % 7 AS g, label = 1 AS f1, tax > 0.05 AS f2, score AS sc0, 0.5::DOUBLE AS flat FROM c), lg AS (SELECT * FROM (SELECT g, fl.flag, fl.y, sn.score_name, sn.score, co.cohort FROM pr,
  LATERAL (SELECT unnest(['f1', 'f2']) AS flag, unnest([f1::INTEGER, f2::INTEGER]) AS y) fl, LATERAL (SELECT unnest(['score', 'flat']) AS score_name, unnest([sc0, flat]) AS score) sn, LATERAL (SELECT unnest(['all', CASE WHEN g < 3 THEN 'low' END]) AS cohort) co) WHERE cohort IS NOT NULL),
rk AS ({auroc_sql('lg', 'flag, cohort, score_name', label='y')})
SELECT flag, cohort, score_name, (n_pos + n_neg)::BIGINT AS n_pairs, n_pos::BIGINT AS n_flag_pos, round(n_pos / (n_pos + n_neg), 6) AS flag_prevalence, score_name = 'flat' AS score_is_constant, CASE WHEN score_name <> 'flat' THEN round(auroc, 6) END AS auroc FROM rk"""
)
def curated_agreement(t: Tables) -> DataFrame:
    rows = cells(t).select((F.col("part") % 7).alias("g"), (F.col("label") == 1).alias("f1"), (F.col("tax") > 0.05).alias("f2"), "score", F.lit(0.5).alias("flat"))
    return rounded(resampling.agreement_table(rows, ["score", "flat"], ["f1", "f2"], {"all": F.lit(True), "low": F.col("g") < 3}))


@query(
    """WITH a AS (SELECT l_orderkey AS ex, l_linestatus AS m, list_distinct(list(l_linenumber)) AS f FROM lineitem GROUP BY 1, 2)
SELECT x.m AS member_a, y.m AS member_b, count(*) AS shared_examples, round(avg(len(list_intersect(x.f, y.f))::DOUBLE / len(list_distinct(list_concat(x.f, y.f)))), 6) AS mean_overlap
FROM a x JOIN a y ON x.ex = y.ex AND x.m < y.m GROUP BY 1, 2"""
)
def explanation_stability(t: Tables) -> DataFrame:
    artifacts = t.lineitem.groupBy(F.col("l_orderkey").alias("example"), F.col("l_linestatus").alias("member")).agg(F.collect_set("l_linenumber").alias("features"))
    return rounded(comparison.explanation_stability(artifacts))


@query(CELLS_SQL + "SELECT qty, round(avg(-(score * ln(score)) - (1 - score) * ln(1 - score)), 6) AS entropy, round(avg(ln(score / (1 - score))), 6) AS mean_logit FROM c GROUP BY 1")
def score_entropy(t: Tables) -> DataFrame:
    return rounded(cells(t).groupBy("qty").agg(F.avg(bernoulli_entropy(F.col("score"))).alias("entropy"), F.avg(logit(F.col("score"))).alias("mean_logit")))


@query(
    CELLS_SQL + """, s AS (SELECT CASE WHEN label = 1 THEN 1 - score ELSE score END AS s FROM c), r AS (SELECT s, row_number() OVER (ORDER BY s) AS i, count(*) OVER () AS n FROM s)
SELECT n, round(s, 6) AS threshold FROM r WHERE i = ceil((n + 1) * (1 - 0.1::DOUBLE))"""
)
def pooled_conformal_threshold(t: Tables) -> DataFrame:
    return rounded(conformal.binary_conformal_threshold(cells(t), "label", "score"))

"""Metric queries. A line is a scored cell: its label is the return flag, its event the order's priority or the
quantity, its score a cut of price and discount on a grid of thousandths with ties."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from doseweave.catalog.registry import Tables, query
from doseweave.operators import metrics, ranking

CELLS_SQL = """
WITH c AS (SELECT l_orderkey AS pair_id, l_linenumber AS event_idx, l_quantity::BIGINT AS qty, l_partkey AS part, l_suppkey AS supp, l_tax AS tax, (l_returnflag = 'R')::INTEGER AS label,
  greatest(0.001, least(0.999, floor((l_extendedprice / 150000.0 + l_discount + CASE WHEN l_returnflag = 'R' THEN 0.07 ELSE 0 END) * 1000) / 1000)) AS score FROM lineitem)
"""


def cells(t: Tables) -> DataFrame:
    lift = F.when(F.col("l_returnflag") == "R", F.lit(0.07)).otherwise(F.lit(0.0))
    raw = F.floor((F.col("l_extendedprice") / 150000.0 + F.col("l_discount") + lift) * 1000) / 1000
    return t.lineitem.select(
        F.col("l_orderkey").alias("pair_id"), F.col("l_linenumber").alias("event_idx"), F.col("l_quantity").cast("long").alias("qty"),
        F.col("l_partkey").alias("part"), F.col("l_suppkey").alias("supp"), F.col("l_tax").alias("tax"),
        (F.col("l_returnflag") == "R").cast("int").alias("label"),
        F.greatest(F.lit(0.001), F.least(F.lit(0.999), raw)).alias("score"),
    )


GRID_SQL = CELLS_SQL + ", g AS (SELECT part AS pair_id, event_idx, max(label) AS label, max(score) AS score FROM c GROUP BY 1, 2)\n"


def grid(t: Tables) -> DataFrame:
    """One cell per (part, line number): pair and event with a label and a score."""
    return cells(t).groupBy(F.col("part").alias("pair_id"), "event_idx").agg(F.max("label").alias("label"), F.max("score").alias("score"))


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    kinds = dict(df.dtypes)
    return df.select(*[F.round(c, digits).alias(c) if kinds[c] == "double" else F.col(c) for c in df.columns])


def auroc_sql(source: str, by: str = "", label: str = "label", score: str = "score") -> str:
    """One row per group with n_pos, n_neg, auroc and average_precision, by rank formulas."""
    part = f"PARTITION BY {by}" if by else ""
    lead = f"{by}, " if by else ""
    return f"""SELECT {lead}sum(pos)::DOUBLE AS n_pos, sum(neg)::DOUBLE AS n_neg,
  sum(pos * (below + neg / 2.0)) / nullif(sum(pos) * sum(neg), 0)::DOUBLE AS auroc, sum(pos * (pa / nullif(pa + na, 0))) / nullif(sum(pos), 0)::DOUBLE AS average_precision
 FROM (SELECT *, sum(neg) OVER ({part} ORDER BY {score}) - neg AS below, sum(pos) OVER ({part} ORDER BY {score} DESC)::DOUBLE AS pa, sum(neg) OVER ({part} ORDER BY {score} DESC)::DOUBLE AS na
  FROM (SELECT {lead}{score}, sum({label})::DOUBLE AS pos, sum(1 - {label})::DOUBLE AS neg FROM {source} GROUP BY ALL)) {'GROUP BY ' + by if by else ''}"""


@query(CELLS_SQL + f"SELECT qty, n_pos, n_neg, round(auroc, 6) AS auroc FROM ({auroc_sql('c', 'qty')})")
def auroc_by_event(t: Tables) -> DataFrame:
    return rounded(ranking.auroc(cells(t), "label", "score", ["qty"]))


@query(CELLS_SQL + f"SELECT qty, n_pos, n_neg, round(average_precision, 6) AS average_precision FROM ({auroc_sql('c', 'qty')})")
def average_precision_by_event(t: Tables) -> DataFrame:
    return rounded(ranking.average_precision(cells(t), "label", "score", ["qty"]))


@query(CELLS_SQL + f"SELECT n_pos, n_neg, round(auroc, 6) AS auroc, round(average_precision, 6) AS average_precision FROM ({auroc_sql('c')})")
def micro_ranking(t: Tables) -> DataFrame:
    return rounded(ranking.ranking_metrics(cells(t), "label", "score"))


@query(
    CELLS_SQL + f""", r AS ({auroc_sql('c', 'qty')})
SELECT count(*) AS n_events, count(*) FILTER (WHERE n_pos >= 390 AND n_neg >= 390) AS n_events_evaluable, round(avg(auroc) FILTER (WHERE n_pos >= 390 AND n_neg >= 390), 6) AS macro_auroc,
  round(avg(average_precision) FILTER (WHERE n_pos >= 390 AND n_neg >= 390), 6) AS macro_auprc FROM r"""
)
def macro_ranking(t: Tables) -> DataFrame:
    return rounded(metrics.macro_ranking(cells(t), "qty", "label", "score", 390))


@query(
    CELLS_SQL + f""", r AS ({auroc_sql('c', 'qty')}), m AS ({auroc_sql('c')})
SELECT (SELECT count(*) FROM r) AS n_events, (SELECT count(*) FROM r WHERE n_pos > 0 AND n_neg > 0) AS n_events_evaluable, round((SELECT avg(auroc) FROM r), 6) AS macro_auroc,
  round((SELECT avg(average_precision) FROM r), 6) AS macro_auprc, round(auroc, 6) AS micro_auroc, round(average_precision, 6) AS micro_auprc FROM m"""
)
def multitask_ranking(t: Tables) -> DataFrame:
    return rounded(metrics.multitask_metrics(cells(t), "qty", "label", "score"))


@query(
    GRID_SQL + "SELECT pair_id, event_idx, rank() OVER (PARTITION BY event_idx ORDER BY score) + (count(*) OVER (PARTITION BY event_idx, score) - 1) / 2.0::DOUBLE AS avg_rank FROM g"
)
def tie_average_ranks(t: Tables) -> DataFrame:
    return ranking.average_rank(grid(t), "score", ["event_idx"]).select("pair_id", "event_idx", "avg_rank")


@query(
    GRID_SQL + """, r AS (SELECT *, (rank() OVER (PARTITION BY event_idx ORDER BY score) + (count(*) OVER (PARTITION BY event_idx, score) - 1) / 2.0)::DOUBLE / count(*) OVER (PARTITION BY event_idx) AS p FROM g)
SELECT pair_id, round(avg(p), 6) AS mean_rank FROM r GROUP BY 1"""
)
def pair_rank_percentiles(t: Tables) -> DataFrame:
    return rounded(ranking.rank_percentile(grid(t), "pair_id", "event_idx", "score"))


@query(
    GRID_SQL + """, k AS (SELECT * FROM g QUALIFY row_number() OVER (PARTITION BY pair_id ORDER BY score DESC, event_idx) <= 3)
SELECT a.pair_id, mean_prob, mean_logit, top_k_mean FROM (SELECT pair_id, round(avg(score), 6) AS mean_prob, round(avg(ln(score / (1 - score))), 6) AS mean_logit FROM g GROUP BY 1) a
JOIN (SELECT pair_id, round(avg(score), 6) AS top_k_mean FROM k GROUP BY 1) b USING (pair_id)"""
)
def pair_score_summaries(t: Tables) -> DataFrame:
    return rounded(metrics.pair_score_summary(grid(t), "pair_id", "event_idx", "score", 3))


@query(
    GRID_SQL + """, r AS (SELECT *, row_number() OVER (PARTITION BY pair_id ORDER BY score DESC, event_idx) AS rn FROM g), p AS (SELECT pair_id, sum(label) AS nt FROM g GROUP BY 1 HAVING sum(label) > 0)
SELECT k, round(avg(h / least(k, 7)::DOUBLE), 6) AS precision, round(avg(h / nt::DOUBLE), 6) AS recall, count(*) AS n_pairs FROM
 (SELECT k, pair_id, any_value(nt) AS nt, sum(CASE WHEN rn <= k THEN label ELSE 0 END) AS h FROM r JOIN p USING (pair_id), (VALUES (1), (5), (10), (20)) v(k) GROUP BY 1, 2) GROUP BY 1"""
)
def precision_recall_at_k(t: Tables) -> DataFrame:
    return rounded(ranking.precision_recall_at_k(grid(t), "pair_id", "event_idx", "label", "score"))


@query(
    CELLS_SQL + "SELECT score, sum(sum(label)) OVER (ORDER BY score DESC)::DOUBLE AS tp, sum(sum(1 - label)) OVER (ORDER BY score DESC)::DOUBLE AS fp FROM c GROUP BY score"
)
def precision_recall_curve(t: Tables) -> DataFrame:
    return ranking.curve_points(cells(t), "label", "score")


YOUDEN_SQL = """, cv AS (SELECT qty, score, sum(sum(label)) OVER (PARTITION BY qty ORDER BY score DESC)::DOUBLE AS tp, sum(sum(1 - label)) OVER (PARTITION BY qty ORDER BY score DESC)::DOUBLE AS fp FROM c GROUP BY qty, score),
yj AS (SELECT qty, score AS threshold, tp / max(tp) OVER (PARTITION BY qty) - fp / max(fp) OVER (PARTITION BY qty) AS j FROM cv),
yt AS (SELECT * FROM yj QUALIFY row_number() OVER (PARTITION BY qty ORDER BY j DESC, threshold DESC) = 1)
"""


@query(CELLS_SQL + YOUDEN_SQL + "SELECT qty, threshold, round(j, 6) AS youden_j FROM yt")
def youden_thresholds(t: Tables) -> DataFrame:
    return rounded(ranking.youden_threshold(cells(t), "label", "score", ["qty"]))


def binary_sql(source: str, by: str, threshold: str, score: str = "score") -> str:
    return f"""bm AS (SELECT {by}, count(*) AS n, count(*) FILTER (WHERE {score} >= {threshold} AND label = 1) AS tp, count(*) FILTER (WHERE {score} >= {threshold} AND label = 0) AS fp,
  count(*) FILTER (WHERE {score} < {threshold} AND label = 1) AS fn, count(*) FILTER (WHERE {score} < {threshold} AND label = 0) AS tn, avg(({score} - label) ** 2) AS brier FROM {source} GROUP BY 1),
rk AS ({auroc_sql(source, by, score=score)}),
eb AS (SELECT {by}, least(floor({score} * 10), 9) AS bin, count(*) AS n, avg({score}) AS p, avg(label) AS y FROM {source} GROUP BY 1, 2),
ee AS (SELECT {by}, sum(abs(p - y) * n) / sum(n) AS ece FROM eb GROUP BY 1),
bx AS (SELECT bm.*, auroc, average_precision, ece FROM bm JOIN rk USING ({by}) JOIN ee USING ({by}))
"""


BINARY_COLUMNS_SQL = """n, tp, fp, fn, tn, round(brier, 6) AS brier, round(auroc, 6) AS auroc, round(average_precision, 6) AS average_precision, round(ece, 6) AS ece,
  round((tp + tn)::DOUBLE / n, 6) AS accuracy, round(tp::DOUBLE / nullif(tp + fn, 0), 6) AS recall, round(tn::DOUBLE / nullif(tn + fp, 0), 6) AS specificity, round(tp::DOUBLE / nullif(tp + fp, 0), 6) AS precision,
  round(tn::DOUBLE / nullif(tn + fn, 0), 6) AS npv, round(fp::DOUBLE / nullif(fp + tn, 0), 6) AS fpr, round(fn::DOUBLE / nullif(fn + tp, 0), 6) AS fnr,
  round((tp::DOUBLE / nullif(tp + fn, 0) + tn::DOUBLE / nullif(tn + fp, 0)) / 2, 6) AS balanced_accuracy, round(2.0::DOUBLE * tp / nullif(2 * tp + fp + fn, 0), 6) AS f1,
  round(coalesce((tp::DOUBLE * tn - fp::DOUBLE * fn) / nullif(sqrt(tp + fp) * sqrt(tp + fn) * sqrt(tn + fp) * sqrt(tn + fn), 0), 0), 6) AS mcc,
  CASE WHEN tp + fn = 0 OR tn + fp = 0 THEN 'single_class' ELSE 'ok' END AS status"""


@query(CELLS_SQL + ", " + binary_sql("c", "qty", "0.45") + f"SELECT qty, {BINARY_COLUMNS_SQL} FROM bx")
def binary_metrics_by_event(t: Tables) -> DataFrame:
    return rounded(metrics.binary_metrics(cells(t), "label", "score", 0.45, ["qty"]))


@query(
    CELLS_SQL + YOUDEN_SQL + ", cy AS (SELECT c.*, threshold AS th FROM c JOIN yt USING (qty)), " + binary_sql("cy", "qty", "th")
    + f"SELECT qty, threshold, {BINARY_COLUMNS_SQL} FROM bx JOIN yt USING (qty)"
)
def youden_binary_metrics(t: Tables) -> DataFrame:
    return rounded(metrics.threshold_metrics(cells(t), "label", "score", by=["qty"]))


@query(
    CELLS_SQL + ", s AS (SELECT *, CASE WHEN event_idx < 3 THEN 'train' WHEN event_idx < 6 THEN 's1_test' ELSE 's2_test' END AS split FROM c), " + binary_sql("s", "split", "0.5")
    + """SELECT split, n, tp, fp, fn, tn, accuracy, balanced_accuracy, precision, recall, specificity, f1, mcc, auroc, average_precision, brier, ece, status, 'unreported' AS negative_label_meaning
FROM (SELECT split, """ + BINARY_COLUMNS_SQL + " FROM bx)"
)
def split_metric_table(t: Tables) -> DataFrame:
    split = F.when(F.col("event_idx") < 3, "train").when(F.col("event_idx") < 6, "s1_test").otherwise("s2_test")
    rows = cells(t).withColumn("split", split)
    return rounded(metrics.metric_table(metrics.binary_metrics(rows, "label", "score", 0.5, ["split"]), "unreported"))


@query(
    CELLS_SQL + ", s AS (SELECT *, CASE WHEN tax < 0.04 THEN 'low' WHEN tax < 0.07 THEN 'medium' ELSE 'high' END AS band FROM c), " + binary_sql("s", "band", "0.5") + f"SELECT band, {BINARY_COLUMNS_SQL} FROM bx"
)
def similarity_band_metrics(t: Tables) -> DataFrame:
    return rounded(metrics.similarity_slices(cells(t).withColumn("sim", F.col("tax")), "sim", "label", "score", 0.5, (0.04, 0.07)))


@query(
    GRID_SQL + """, h AS (SELECT *, score >= 0.5 AS hit FROM g),
pp AS (SELECT pair_id, count(*) FILTER (WHERE hit AND label = 1) AS tp, count(*) FILTER (WHERE hit AND label = 0) AS fp, count(*) FILTER (WHERE NOT hit AND label = 1) AS fn FROM h GROUP BY 1),
ev AS (SELECT event_idx, count(*) AS n, count(*) FILTER (WHERE hit AND label = 1) AS tp, count(*) FILTER (WHERE hit AND label = 0) AS fp, count(*) FILTER (WHERE NOT hit AND label = 1) AS fn FROM h GROUP BY 1)
SELECT 0.5::DOUBLE AS threshold, (SELECT round(avg(CASE WHEN 2 * tp + fp + fn > 0 THEN 2.0::DOUBLE * tp / (2 * tp + fp + fn) ELSE 1 END), 6) FROM pp) AS example_f1,
  (SELECT round(2.0::DOUBLE * sum(tp) / (2 * sum(tp) + sum(fp) + sum(fn)), 6) FROM ev) AS micro_f1, (SELECT round(avg(2.0::DOUBLE * tp / nullif(2 * tp + fp + fn, 0)), 6) FROM ev) AS macro_f1,
  (SELECT round(avg(CASE WHEN tp + fp + fn > 0 THEN tp::DOUBLE / (tp + fp + fn) ELSE 1 END), 6) FROM pp) AS jaccard, (SELECT round((sum(fp) + sum(fn))::DOUBLE / sum(n), 6) FROM ev) AS hamming_loss"""
)
def set_valued_metrics(t: Tables) -> DataFrame:
    return rounded(metrics.set_metrics(grid(t), "pair_id", "event_idx", "label", "score", 0.5))


@query(
    CELLS_SQL + """SELECT t AS threshold, round(f, 6) AS micro_f1 FROM (SELECT t, 2.0::DOUBLE * count(*) FILTER (WHERE score >= t AND label = 1) / (count(*) FILTER (WHERE score >= t) + sum(label)) AS f
  FROM c, (SELECT round(0.05 * unnest(generate_series(1, 19)), 2)::DOUBLE AS t) GROUP BY 1) ORDER BY f DESC, t LIMIT 1"""
)
def best_global_threshold(t: Tables) -> DataFrame:
    return rounded(metrics.best_threshold(cells(t), "label", "score"))


@query(
    CELLS_SQL + """, q AS (SELECT qty, list_distinct([""" + ", ".join(f"quantile_cont(score::DOUBLE, {k / 15!r})" for k in range(1, 15)) + """]) AS e FROM c GROUP BY 1),
b AS (SELECT qty, len(list_filter(e, lambda x: x <= score)) AS bin, count(*) AS n, avg(score) AS p, avg(label) AS y FROM c JOIN q USING (qty) GROUP BY 1, 2)
SELECT qty, round(sum(abs(p - y) * n) / sum(n), 9) AS ece, round(max(abs(p - y)), 9) AS mce, count(*) AS bins_used FROM b GROUP BY 1"""
)
def equal_mass_calibration_error(t: Tables) -> DataFrame:
    return rounded(metrics.ece_equal_mass(cells(t), "label", "score", 15, ["qty"]), 9)


@query(
    CELLS_SQL + """SELECT b AS bin, count(score) AS n, round(avg(score), 6) AS mean_p, round(avg(label), 6) AS fraction_positive FROM (SELECT unnest(generate_series(0, 9))::INTEGER AS b)
  LEFT JOIN c ON least(floor(score * 10), 9) = b GROUP BY 1"""
)
def reliability_bins(t: Tables) -> DataFrame:
    return rounded(metrics.reliability_bins(cells(t), "label", "score"))


@query(CELLS_SQL + "SELECT qty, round(avg((score - label) ** 2), 6) AS brier, round(-avg(label * ln(score) + (1 - label) * ln(1 - score)), 6) AS nll FROM c GROUP BY 1")
def proper_scores(t: Tables) -> DataFrame:
    return rounded(cells(t).groupBy("qty").agg(metrics.brier("label", "score").alias("brier"), metrics.nll("label", "score").alias("nll")))


@query(
    CELLS_SQL + """, r AS (SELECT *, tax * 5 + 0.1 AS pred, rank() OVER (ORDER BY score) + (count(*) OVER (PARTITION BY score) - 1) / 2.0::DOUBLE AS rt,
  rank() OVER (ORDER BY tax * 5 + 0.1) + (count(*) OVER (PARTITION BY tax * 5 + 0.1) - 1) / 2.0::DOUBLE AS rp FROM c)
SELECT count(*) AS n, round(avg(abs(pred - score)), 6) AS mae, round(sqrt(avg((pred - score) ** 2)), 6) AS rmse, round(sum(abs(pred - score) * sqrt(qty)) / sum(sqrt(qty)), 6) AS weighted_mae,
  round(1 - sum((pred - score) ** 2) / (var_pop(score) * count(*)), 6) AS r2, round(corr(rt, rp), 6) AS spearman FROM r"""
)
def regression_errors(t: Tables) -> DataFrame:
    return rounded(metrics.regression_metrics(cells(t).withColumn("pred", F.col("tax") * 5 + 0.1), "score", "pred", "qty"))


@query(
    CELLS_SQL + """, k AS (SELECT supp, sum(label) AS k, count(*) AS n FROM c GROUP BY 1), v AS (SELECT k::DOUBLE AS k, n::DOUBLE AS n, 0.33::DOUBLE * 12 AS a, 0.67::DOUBLE * 12 AS b FROM k)
SELECT count(*) AS n, round(-avg(lgamma(n + 1) - lgamma(k + 1) - lgamma(n - k + 1) + lgamma(k + a) + lgamma(n - k + b) - lgamma(n + a + b) + lgamma(a + b) - lgamma(a) - lgamma(b)), 6) AS nll FROM v"""
)
def beta_binomial_loss(t: Tables) -> DataFrame:
    counts = cells(t).groupBy("supp").agg(F.sum("label").alias("k"), F.count(F.lit(1)).alias("n_reports"))
    rows = counts.withColumns({"m": F.lit(0.33), "s": F.lit(12.0)})
    return rounded(metrics.beta_binomial_nll(rows, "k", "n_reports", "m", "s"))


ERRORS_SQL = CELLS_SQL + """, r AS (SELECT pair_id * 100000000 + part * 10000 + supp * 10 + event_idx AS row_id, max(label) AS label, max(score) AS score FROM c GROUP BY 1)
"""


def scored_rows(t: Tables) -> DataFrame:
    key = F.col("pair_id") * 100000000 + F.col("part") * 10000 + F.col("supp") * 10 + F.col("event_idx")
    return cells(t).groupBy(key.alias("row_id")).agg(F.max("label").alias("label"), F.max("score").alias("score"))


@query(
    ERRORS_SQL + """, e AS (SELECT *, CASE WHEN label = 0 AND score >= 0.5 THEN 'FP' WHEN label = 1 AND score < 0.5 THEN 'FN' END AS error_type, abs(score - 0.5) AS margin FROM r)
SELECT row_id, label, score, error_type, round(margin, 6) AS margin, row_number() OVER (PARTITION BY error_type ORDER BY margin DESC, row_id)::INTEGER AS rn FROM e WHERE error_type IS NOT NULL QUALIFY rn <= 100"""
)
def confident_errors(t: Tables) -> DataFrame:
    return rounded(ranking.confident_errors(scored_rows(t), "label", "score", "row_id"))


@query(
    ERRORS_SQL + """, e AS (SELECT *, CASE WHEN label = 1 AND score < 0.5 THEN 0 WHEN label = 0 AND score >= 0.5 THEN 1 WHEN label = 1 THEN 2 ELSE 3 END AS class_order, abs(score - 0.5) AS margin FROM r),
f AS (SELECT *, row_number() OVER (PARTITION BY class_order ORDER BY margin DESC, row_id) = 1 AS picked FROM e)
SELECT row_id, label, score, class_order, round(margin, 6) AS margin, picked FROM f ORDER BY f.picked DESC, CASE WHEN f.picked THEN class_order ELSE 9 END, f.margin DESC, row_id LIMIT 12"""
)
def representative_rows(t: Tables) -> DataFrame:
    return rounded(ranking.representatives(scored_rows(t), "label", "score", "row_id", 0.5, 12))


@query(
    ERRORS_SQL + """, u AS (SELECT *, row_number() OVER (ORDER BY -abs(score - 0.5), sha256('0' || chr(0) || row_id)) AS rn, count(*) OVER () AS n FROM r)
SELECT v AS level, count(*) AS n, round(avg((score - label) ** 2), 6) AS brier, round(avg(((score >= 0.5)::INTEGER = label)::INTEGER), 6) AS accuracy
FROM u, (VALUES (0.25::DOUBLE), (0.5), (0.75), (1.0)) x(v) WHERE rn <= ceil(n * v) GROUP BY 1"""
)
def risk_coverage_prefixes(t: Tables) -> DataFrame:
    rows = scored_rows(t).withColumn("uncertainty", -F.abs(F.col("score") - 0.5))
    kept = ranking.retained_prefixes(rows, "uncertainty", ["row_id"], [0.25, 0.5, 0.75, 1.0], 0, descending=False, rounding="ceil")
    right = ((F.col("score") >= 0.5).cast("int") == F.col("label")).cast("int")
    return rounded(kept.groupBy("level").agg(F.count(F.lit(1)).alias("n"), metrics.brier("label", "score").alias("brier"), F.avg(right).alias("accuracy")))


@query(
    GRID_SQL.replace("part AS pair_id", "supp AS pair_id") + f""", s AS (SELECT g.*, CASE WHEN pair_id % 3 = 0 THEN 'none' WHEN pair_id % 3 = 1 THEN 'one' ELSE 'both' END AS stratum FROM g),
k AS (SELECT stratum, count(DISTINCT pair_id) AS n_pairs FROM s GROUP BY 1 HAVING count(DISTINCT pair_id) >= 30), r AS ({auroc_sql('s', 'stratum, event_idx')})
SELECT stratum, count(*) AS n_events, count(*) FILTER (WHERE n_pos >= 1 AND n_neg >= 1) AS n_events_evaluable, round(avg(auroc) FILTER (WHERE n_pos >= 1 AND n_neg >= 1), 6) AS macro_auroc,
  round(avg(average_precision) FILTER (WHERE n_pos >= 1 AND n_neg >= 1), 6) AS macro_auprc, any_value(n_pairs) AS n_pairs FROM r JOIN k USING (stratum) GROUP BY 1"""
)
def stratum_metrics(t: Tables) -> DataFrame:
    base = cells(t).groupBy(F.col("supp").alias("pair_id"), "event_idx").agg(F.max("label").alias("label"), F.max("score").alias("score"))
    stratum = F.when(F.col("pair_id") % 3 == 0, "none").when(F.col("pair_id") % 3 == 1, "one").otherwise("both")
    return rounded(metrics.stratum_metrics(base.withColumn("stratum", stratum), "stratum", "pair_id", "event_idx", "label", "score", 30, 1))

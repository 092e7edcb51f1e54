"""Report queries: orders are reports, line items their drugs, return flags their outcomes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from doseweave.catalog.registry import Tables, query
from doseweave.operators import clean, reports

SEVERE = ["R"]


def drug_rows(t: Tables) -> DataFrame:
    return t.lineitem.select(
        F.col("l_orderkey").alias("primaryid"), F.concat(F.lit("s"), F.col("l_suppkey")).alias("drugname")
    )


def outcome_rows(t: Tables) -> DataFrame:
    return t.lineitem.select(F.col("l_orderkey").alias("primaryid"), F.col("l_returnflag").alias("outc_cod"))


SEVERITY_SQL = """
WITH sev AS (SELECT l_orderkey AS primaryid, max(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END) AS is_severe
             FROM lineitem GROUP BY 1)
"""


def rates_sql(extra_cte: str, merged: str, total: str = "sev") -> str:
    return f"""{extra_cte},
tot AS (SELECT sum(is_severe) AS s, sum(1 - is_severe) AS o FROM {total}),
g AS (SELECT drugname, count(*) AS n, sum(is_severe) AS a FROM ({merged}) GROUP BY 1 HAVING count(*) >= 5),
cells AS (SELECT drugname, n, a, n - a AS b, greatest(0, s - a) AS c, greatest(0, o - (n - a)) AS d FROM g, tot),
adj AS (SELECT *, CASE WHEN a <= 0 OR b <= 0 OR c <= 0 OR d <= 0 THEN 0.5 ELSE 0 END::DOUBLE AS h FROM cells),
v AS (SELECT *, (a+h)::DOUBLE AS w, (b+h)::DOUBLE AS x, (c+h)::DOUBLE AS y, (d+h)::DOUBLE AS z FROM adj),
r AS (SELECT *, (w*z)/(x*y) AS orr, 1.96*sqrt(1/w+1/x+1/y+1/z) AS sp FROM v)
SELECT drugname, n::BIGINT AS n_reports, a::BIGINT AS severe_reports, b::BIGINT AS non_severe_reports,
       a::DOUBLE / n AS toxicity_score, round(orr, 3) AS ror, round(exp(ln(orr) - sp), 3) AS ror_ci_lower,
       round(exp(ln(orr) + sp), 3) AS ror_ci_upper, round((w/(w+x))/(y/(y+z)), 3) AS prr,
       (a >= 3 AND exp(ln(orr) - sp) > 1) AS is_disproportionality_signal
FROM r"""


@query(
    rates_sql(
        SEVERITY_SQL + ", dr AS (SELECT DISTINCT l_orderkey AS primaryid, 'S' || l_suppkey AS drugname FROM lineitem)",
        "SELECT drugname, is_severe FROM dr JOIN sev USING (primaryid)",
    )
)
def drug_severity_signals(t: Tables) -> DataFrame:
    """Disproportionality per supplier over all orders."""
    return reports.drug_severity(drug_rows(t), outcome_rows(t), severe_codes=SEVERE)


@query(
    rates_sql(
        """
WITH sev AS (SELECT l_orderkey AS primaryid, max(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END) AS is_severe
             FROM lineitem WHERE l_linestatus = 'F' GROUP BY 1),
dr AS (SELECT DISTINCT l_orderkey AS primaryid, 'S' || l_suppkey AS drugname FROM lineitem)""",
        "SELECT drugname, coalesce(is_severe, 0) AS is_severe FROM dr LEFT JOIN sev USING (primaryid)",
    )
)
def drug_severity_missing_outcomes(t: Tables) -> DataFrame:
    """The same with outcomes known for finished lines only and missing ones counted as non-severe."""
    known = t.lineitem.filter("l_linestatus = 'F'").select(
        F.col("l_orderkey").alias("primaryid"), F.col("l_returnflag").alias("outc_cod")
    )
    return reports.drug_severity(drug_rows(t), known, missing_outcome_policy="non_severe", severe_codes=SEVERE)


@query(
    "SELECT l_orderkey AS primaryid, max(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END)::INTEGER AS is_severe "
    "FROM lineitem GROUP BY 1"
)
def report_severity_flags(t: Tables) -> DataFrame:
    return reports.report_severity(outcome_rows(t), SEVERE)


# A stream of case versions: three consecutive events form a case, the month half is the quarter.
CASES_SQL = """
WITH demo AS (
  SELECT event_id::VARCHAR AS primaryid, (event_id // 3)::VARCHAR AS caseid, (event_id % 3)::VARCHAR AS caseversion,
         strftime(ts, '%Y%m%d') AS fda_dt,
         CASE WHEN day(ts) <= 20 THEN '2025q' || (1 + day(ts) // 6) ELSE '2026q' || (day(ts) // 16) END AS quarter,
         event_type, user_id, value FROM events),
deleted AS (SELECT caseid FROM demo WHERE event_type = 'error' AND user_id % 10 = 0),
live AS (SELECT * FROM demo WHERE caseid NOT IN (SELECT caseid FROM deleted)),
trainrows AS (SELECT * FROM live WHERE quarter LIKE '2025%'),
testrows AS (SELECT * FROM live WHERE quarter LIKE '2026%' AND caseid NOT IN (SELECT caseid FROM trainrows)),
picked AS (
  SELECT *, 'train' AS split FROM trainrows UNION ALL SELECT *, 'test_new_cases' AS split FROM testrows),
selected AS (
  SELECT * FROM picked QUALIFY row_number() OVER (PARTITION BY caseid ORDER BY caseversion::DOUBLE DESC,
    fda_dt::DOUBLE DESC, quarter DESC, primaryid DESC) = 1),
drugs AS (
  SELECT primaryid, caseid, quarter, 'user' || user_id AS drugname,
         CASE event_type WHEN 'click' THEN 'PS' WHEN 'view' THEN 'SS' WHEN 'signup' THEN 'C' WHEN 'purchase' THEN 'I'
              ELSE 'X' END AS role_cod FROM demo
  UNION ALL
  SELECT primaryid, caseid, quarter, 'user' || (user_id + 1), 'SS' FROM demo),
bridge AS (
  SELECT upper('user' || user_id) AS name_key, 'M' || (user_id % 40) AS smiles FROM events WHERE user_id % 7 <> 3),
names AS (SELECT name_key, min(smiles) AS smiles FROM bridge GROUP BY 1 HAVING count(DISTINCT smiles) = 1),
outc AS (SELECT primaryid, CASE WHEN value > 90 THEN 'DE' WHEN value > 70 THEN 'OT' END AS outc_cod FROM demo),
serious AS (SELECT DISTINCT primaryid FROM outc JOIN selected USING (primaryid) WHERE outc_cod IN ('DE', 'OT')),
rows_ AS (
  SELECT s.primaryid, s.caseid, s.quarter, s.split, d.role_cod, upper(d.drugname) AS name_key, smiles
  FROM drugs d JOIN selected s USING (primaryid, caseid, quarter) LEFT JOIN names n ON n.name_key = upper(d.drugname)),
pol AS (
  SELECT *, 'suspect_roles' AS role_policy FROM rows_ WHERE role_cod IN ('PS', 'SS')
  UNION ALL SELECT *, 'all_administered_roles' FROM rows_ WHERE role_cod IN ('PS', 'SS', 'C', 'I')),
cases AS (
  SELECT split, role_policy, smiles AS canonical_smiles, caseid, quarter,
         max(CASE WHEN p.primaryid IN (SELECT primaryid FROM serious) THEN 1 ELSE 0 END) AS serious
  FROM pol p WHERE smiles IS NOT NULL GROUP BY ALL),
labels_ AS (
  SELECT split, role_policy, canonical_smiles, count(*) AS n_reports, sum(serious) AS k,
         string_agg(DISTINCT quarter, '|' ORDER BY quarter) AS source_quarters FROM cases GROUP BY ALL)
"""


def case_tables(t: Tables) -> dict[str, DataFrame]:
    day = F.dayofmonth("ts")
    quarter = F.when(day <= 20, F.concat(F.lit("2025q"), (1 + F.floor(day / 6)).cast("string"))).otherwise(
        F.concat(F.lit("2026q"), F.floor(day / 16).cast("string"))
    )
    base = t.events.select(
        F.col("event_id").cast("string").alias("primaryid"),
        F.floor(F.col("event_id") / 3).cast("string").alias("caseid"),
        (F.col("event_id") % 3).cast("string").alias("caseversion"),
        F.date_format("ts", "yyyyMMdd").alias("fda_dt"), quarter.alias("quarter"), "event_type", "user_id", "value",
    )
    role = F.coalesce(
        F.when(F.col("event_type") == "click", "PS").when(F.col("event_type") == "view", "SS")
        .when(F.col("event_type") == "signup", "C").when(F.col("event_type") == "purchase", "I"), F.lit("X"),
    )
    listed = F.array(
        F.struct(F.concat(F.lit("user"), F.col("user_id")).alias("drugname"), role.alias("role_cod")),
        F.struct(F.concat(F.lit("user"), F.col("user_id") + 1).alias("drugname"), F.lit("SS").alias("role_cod")),
    )
    return {
        "demo": base.select("primaryid", "caseid", "caseversion", "fda_dt", "quarter"),
        "deleted": base.filter("event_type = 'error' AND user_id % 10 = 0").select("caseid"),
        "drugs": base.select("primaryid", "caseid", "quarter", F.explode(listed).alias("d")).select(
            "primaryid", "caseid", "quarter", "d.*"
        ),
        "outcomes": base.select(
            "primaryid", F.when(F.col("value") > 90, "DE").when(F.col("value") > 70, "OT").alias("outc_cod")
        ),
        "bridge": t.events.filter("user_id % 7 <> 3").select(
            F.concat(F.lit("user"), F.col("user_id")).alias("drugname"),
            F.concat(F.lit("M"), F.col("user_id") % 40).alias("canonical_smiles"),
        ),
    }


YEARS = {"train_years": ["2025"], "test_years": ["2026"]}


def case_labels(t: Tables) -> DataFrame:
    c = case_tables(t)
    return reports.cohort_labels(c["demo"], c["drugs"], c["outcomes"], c["deleted"], c["bridge"], **YEARS)


@query(CASES_SQL + "SELECT caseid, primaryid, quarter, split FROM selected")
def case_latest_versions(t: Tables) -> DataFrame:
    c = case_tables(t)
    return reports.selected_cases(c["demo"], c["deleted"], **YEARS).select("caseid", "primaryid", "quarter", "split")


@query(
    CASES_SQL + "SELECT split, role_policy, canonical_smiles, n_reports, k::BIGINT AS serious_outcome_reports, "
    "source_quarters, round(k::DOUBLE / n_reports, 9) AS serious_outcome_recorded_fraction FROM labels_"
)
def cohort_structure_labels(t: Tables) -> DataFrame:
    fraction = "serious_outcome_recorded_fraction"
    return case_labels(t).withColumn(fraction, F.round(fraction, 9))


@query(
    CASES_SQL + """, sus AS (SELECT split, canonical_smiles FROM labels_ WHERE role_policy = 'suspect_roles')
SELECT 'cases_' || split AS item, count(*) AS value FROM selected GROUP BY 1
UNION ALL SELECT 'suspect_structures_' || split, count(*) FROM sus GROUP BY 1
UNION ALL SELECT 'suspect_structure_overlap', count(*) FROM
  (SELECT canonical_smiles FROM sus GROUP BY 1 HAVING count(*) = 2)
UNION ALL SELECT 'deleted_cases_present', count(DISTINCT caseid) FROM deleted
UNION ALL SELECT 'selected_drug_rows', count(*) FROM rows_
UNION ALL SELECT 'selected_drug_rows_mapped', count(smiles) FROM rows_
UNION ALL SELECT 'unmapped_names', count(DISTINCT name_key) FROM rows_ WHERE smiles IS NULL
UNION ALL SELECT 'role_' || role_cod, count(*) FROM rows_ GROUP BY 1"""
)
def cohort_manifest_counts(t: Tables) -> DataFrame:
    c = case_tables(t)
    return reports.cohort_manifest(c["demo"], c["drugs"], c["deleted"], c["bridge"], case_labels(t), **YEARS)


@query(
    CASES_SQL + "SELECT outc_cod, count(*) AS n FROM outc JOIN selected USING (primaryid) "
    "WHERE outc_cod IS NOT NULL GROUP BY 1"
)
def outcomes_of_selected_reports(t: Tables) -> DataFrame:
    c = case_tables(t)
    kept = reports.selected_outcomes(c["outcomes"], reports.selected_cases(c["demo"], c["deleted"], **YEARS))
    return kept.filter("outc_cod IS NOT NULL").groupBy("outc_cod").agg(F.count(F.lit(1)).alias("n"))


@query(CASES_SQL + "SELECT outc_cod FROM outc JOIN selected USING (primaryid) WHERE outc_cod = 'OT' GROUP BY 1")
def outcome_codes_without_policy(t: Tables) -> DataFrame:
    c = case_tables(t)
    selected = reports.selected_cases(c["demo"], c["deleted"], **YEARS)
    return reports.unexpected_codes(c["outcomes"], selected, reports.SEVERE_CODES)


# A name bridge: part names with a structure (brand and type), a coarse score and a report count.
BRIDGE_SQL = """
WITH bridge AS (
  SELECT upper(trim(p_name)) AS drugname, p_brand || '/' || p_type AS canonical_smiles,
         CASE WHEN p_partkey % 29 = 0 THEN 0.75 ELSE 0.25 END::DOUBLE AS toxicity_score, p_size::BIGINT AS n_reports
  FROM part)
"""


def bridge_rows(t: Tables) -> DataFrame:
    raw = t.part.select(
        F.col("p_name").alias("drugname"), F.concat_ws("/", "p_brand", "p_type").alias("canonical_smiles"),
        F.when(F.col("p_partkey") % 29 == 0, "0.75").otherwise("0.25").alias("toxicity_score"),
        F.col("p_size").cast("string").alias("n_reports"),
    )
    return clean.validate_bridge(raw, "drugname", "toxicity_score", "n_reports")


@query(
    BRIDGE_SQL + """SELECT canonical_smiles, count(*) AS rows, count(DISTINCT drugname)::INTEGER AS distinct_names,
  count(DISTINCT toxicity_score)::INTEGER AS distinct_scores,
  string_agg(DISTINCT drugname, '|' ORDER BY drugname) AS names, count(*) > 1 AS is_duplicate,
  count(DISTINCT toxicity_score) > 1 AS is_conflict FROM bridge GROUP BY 1"""
)
def bridge_structure_audit(t: Tables) -> DataFrame:
    return reports.bridge_audit(bridge_rows(t))


@query(
    BRIDGE_SQL + """, sound AS (SELECT canonical_smiles FROM bridge GROUP BY 1 HAVING count(DISTINCT toxicity_score) = 1)
SELECT * FROM bridge WHERE canonical_smiles IN (SELECT canonical_smiles FROM sound)
QUALIFY row_number() OVER (PARTITION BY canonical_smiles ORDER BY n_reports DESC, drugname) = 1"""
)
def bridge_resolved(t: Tables) -> DataFrame:
    return reports.resolve_bridge(bridge_rows(t))


@query(
    """WITH lab AS (SELECT 'S' || l_suppkey AS drugname, count(DISTINCT l_orderkey) AS n_reports FROM lineitem GROUP BY 1),
tg AS (SELECT 'S' || s_suppkey AS drugname FROM supplier WHERE s_nationkey = 3)
SELECT drugname, n_reports, CASE WHEN drugname IN (SELECT drugname FROM tg) THEN 1 ELSE 0 END::INTEGER AS is_target
FROM lab ORDER BY is_target DESC, n_reports DESC, drugname LIMIT 25"""
)
def target_priority_worklist(t: Tables) -> DataFrame:
    labels = (
        t.lineitem.select(F.concat(F.lit("S"), F.col("l_suppkey")).alias("drugname"), "l_orderkey").distinct()
        .groupBy("drugname").agg(F.count(F.lit(1)).alias("n_reports"))
    )
    targets = t.supplier.filter("s_nationkey = 3").select(F.concat(F.lit("S"), F.col("s_suppkey")).alias("drugname"))
    return reports.target_priority_top_n(labels, targets, 25)


@query(
    """SELECT event_id, CASE event_type WHEN 'click' THEN value WHEN 'view' THEN value / 12.0 ELSE value * 10.0 END
  AS age_years, (user_id % 2)::INTEGER AS sex_code FROM events WHERE event_type <> 'error'"""
)
def patient_context(t: Tables) -> DataFrame:
    unit = (
        F.when(F.col("event_type") == "click", "yr").when(F.col("event_type") == "view", "MON")
        .when(F.col("event_type") == "error", "HR").otherwise("DEC")
    )
    demo = t.events.select(
        "event_id", F.col("value").cast("string").alias("age"), unit.alias("age_cod"),
        F.when(F.col("user_id") % 2 == 0, "M").otherwise("F").alias("sex"),
    )
    return clean.normalise_age(demo, "age", "age_cod", "sex").select("event_id", "age_years", "sex_code")

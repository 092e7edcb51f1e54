"""Case reports: versions, severity, disproportionality signals and cohort labels."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from doseweave.operators.clean import ContractError, one_per

# Serious outcome codes (two vocabularies are in use) and report roles.
SEVERE_CODES = ("DE", "HO", "LT", "DS", "CA", "RI")
SERIOUS_CODES = (*SEVERE_CODES, "OT")
SUSPECT_ROLES = ("PS", "SS")
ADMINISTERED_ROLES = ("PS", "SS", "C", "I")


def report_severity(outcomes: DataFrame, severe_codes: Sequence[str] = SEVERE_CODES) -> DataFrame:
    """One 0/1 severity flag per report."""
    code = F.upper(F.trim(F.col("outc_cod")))
    severe = F.coalesce(code.isin(*severe_codes).cast("int"), F.lit(0))
    return (
        outcomes.filter(F.col("primaryid").isNotNull()).groupBy("primaryid").agg(F.max(severe).alias("is_severe"))
    )


def severity_join(drug_reports: DataFrame, severity: DataFrame, missing_outcome_policy: str = "exclude") -> DataFrame:
    """Per-report severity on each drug row; severity is already one row per report, so rows never fan out."""
    if missing_outcome_policy == "exclude":
        return drug_reports.join(severity, "primaryid")
    if missing_outcome_policy == "non_severe":
        joined = drug_reports.join(severity, "primaryid", "left")
        return joined.withColumn("is_severe", F.coalesce("is_severe", F.lit(0)))
    raise ContractError("missing_outcome_policy must be 'exclude' or 'non_severe'")


def ror_prr(a: Column, b: Column, c: Column, d: Column) -> dict[str, Column]:
    """Odds ratio with its 95% interval, proportional ratio and the signal rule, each rounded to three places.

    All four cells get +0.5 when any of them is not positive.
    """
    empty = (a <= 0) | (b <= 0) | (c <= 0) | (d <= 0)
    shift = F.when(empty, F.lit(0.5)).otherwise(F.lit(0.0))
    w, x, y, z = (cell.cast("double") + shift for cell in (a, b, c, d))
    ror = (w * z) / (x * y)
    spread = F.lit(1.96) * F.sqrt(1.0 / w + 1.0 / x + 1.0 / y + 1.0 / z)
    lower, upper = F.exp(F.ln(ror) - spread), F.exp(F.ln(ror) + spread)
    prr = (w / (w + x)) / (y / (y + z))
    return {
        "ror": F.round(ror, 3),
        "ror_ci_lower": F.round(lower, 3),
        "ror_ci_upper": F.round(upper, 3),
        "prr": F.round(prr, 3),
        "is_disproportionality_signal": (a >= 3) & (lower > 1.0),
    }


def drug_severity(
    drug: DataFrame, outcomes: DataFrame, min_reports: int = 5, missing_outcome_policy: str = "exclude",
    severe_codes: Sequence[str] = SEVERE_CODES,
) -> DataFrame:
    """Distinct reports, severe share and disproportionality per drug name.

    Severity collapses to one row per report before the join; distinct (report, name) rows make every later count a
    plain partial aggregate.
    """
    if min_reports < 1:
        raise ContractError("min_reports must be at least 1")
    names = F.upper(F.trim(F.col("drugname").cast("string")))
    drug_reports = (
        drug.select("primaryid", names.alias("drugname"))
        .filter(F.col("primaryid").isNotNull() & (F.col("drugname") != ""))
        .distinct()
    )
    severity = report_severity(outcomes, severe_codes)
    totals = severity.agg(
        F.struct(
            F.coalesce(F.sum("is_severe"), F.lit(0)).alias("severe"),
            F.count_if(F.col("is_severe") == 0).alias("other"),
        )
    ).scalar()
    per_drug = (
        severity_join(drug_reports, severity, missing_outcome_policy)
        .groupBy("drugname")
        .agg(F.count(F.lit(1)).alias("n_reports"), F.sum("is_severe").alias("severe_reports"))
        .filter(F.col("n_reports") >= min_reports)
        .withColumn("non_severe_reports", F.col("n_reports") - F.col("severe_reports"))
        .withColumn("toxicity_score", F.col("severe_reports") / F.col("n_reports"))
    )
    a, b = F.col("severe_reports"), F.col("non_severe_reports")
    rest = per_drug.withColumn("_totals", totals).withColumns(
        {
            "_c": F.greatest(F.lit(0), F.col("_totals.severe") - a),
            "_d": F.greatest(F.lit(0), F.col("_totals.other") - b),
        }
    )
    return rest.select(*per_drug.columns, *[v.alias(k) for k, v in ror_prr(a, b, F.col("_c"), F.col("_d")).items()])


def latest_case_version(demo: DataFrame) -> DataFrame:
    """The highest version per case, then date, quarter and report id; unreadable numbers count as -1."""

    def number(name: str) -> Column:
        return F.coalesce(F.col(name).try_cast("double"), F.lit(-1.0))

    return one_per(
        demo, ["caseid"],
        [number("caseversion").desc(), number("fda_dt").desc(), F.desc("quarter"), F.desc("primaryid")],
    )


def anti_deleted(cases: DataFrame, deleted: DataFrame) -> DataFrame:
    return cases.join(deleted.select("caseid").distinct(), "caseid", "left_anti")


def temporal_new_cases(train: DataFrame, later: DataFrame) -> DataFrame:
    """Later rows whose case does not occur in training."""
    return later.join(train.select("caseid").distinct(), "caseid", "left_anti")


def selected_cases(demo: DataFrame, deleted: DataFrame, train_years: Sequence[str], test_years: Sequence[str]) -> DataFrame:
    """Latest version of each kept case with ``split``: training years, and later years' new cases."""
    live = anti_deleted(
        demo.withColumns({"primaryid": F.trim("primaryid"), "caseid": F.trim("caseid")}).filter(
            (F.col("primaryid") != "") & (F.col("caseid") != "")
        ),
        deleted,
    )
    year = F.substring("quarter", 1, 4)
    train_rows = live.filter(year.isin(*train_years))
    test_rows = temporal_new_cases(train_rows, live.filter(year.isin(*test_years)))
    train = latest_case_version(train_rows).withColumn("split", F.lit("train"))
    return train.unionByName(latest_case_version(test_rows).withColumn("split", F.lit("test_new_cases")))


def selected_outcomes(outcomes: DataFrame, selected: DataFrame) -> DataFrame:
    """Outcome rows of the selected reports only, with normalised codes."""
    clean = outcomes.select(F.trim("primaryid").alias("primaryid"), F.upper(F.trim("outc_cod")).alias("outc_cod"))
    return clean.join(selected.select("primaryid"), "primaryid", "left_semi")


def latest_report_join(drugs: DataFrame, selected: DataFrame) -> DataFrame:
    """Drug rows whose report, case and quarter are the selected version's."""
    clean = drugs.withColumns(
        {"primaryid": F.trim("primaryid"), "caseid": F.trim("caseid"), "role_cod": F.upper(F.trim("role_cod"))}
    )
    return clean.join(selected.select("primaryid", "caseid", "quarter", "split"), ["primaryid", "caseid", "quarter"])


def structure_names(bridge: DataFrame) -> DataFrame:
    """name_key -> canonical_smiles for names that lead to exactly one structure."""
    key = F.upper(F.trim("drugname"))
    return (
        bridge.select(key.alias("name_key"), "canonical_smiles")
        .filter((F.col("name_key") != "") & (F.trim("canonical_smiles") != ""))
        .groupBy("name_key")
        .agg(F.min("canonical_smiles").alias("canonical_smiles"), F.max("canonical_smiles").alias("_last"))
        .filter(F.col("canonical_smiles") == F.col("_last"))
        .drop("_last")
    )


def mapped_drug_rows(drugs: DataFrame, selected: DataFrame, bridge: DataFrame) -> DataFrame:
    """Selected drug rows with their structure, null where the name is unmapped or ambiguous."""
    rows = latest_report_join(drugs, selected).withColumn("name_key", F.upper(F.trim("drugname")))
    return rows.join(structure_names(bridge), "name_key", "left")


def cohort_labels(
    demo: DataFrame, drugs: DataFrame, outcomes: DataFrame, deleted: DataFrame, bridge: DataFrame,
    train_years: Sequence[str], test_years: Sequence[str], serious_codes: Sequence[str] = SERIOUS_CODES,
) -> DataFrame:
    """Per split, role policy and structure: unique case reports, serious ones, fraction and source quarters.

    A case counts once per structure, so name aliases in one report never inflate it; the (case, structure)
    aggregate runs before the structure aggregate and both combine on the map side.
    """
    selected = selected_cases(demo, deleted, train_years, test_years)
    serious = (
        selected_outcomes(outcomes, selected)
        .filter(F.col("outc_cod").isin(*serious_codes)).select("primaryid").distinct()
        .withColumn("serious", F.lit(1))
    )
    mapped = mapped_drug_rows(drugs, selected, bridge).filter(F.col("canonical_smiles").isNotNull())
    policies = F.array_compact(
        F.array(
            F.when(F.col("role_cod").isin(*SUSPECT_ROLES), F.lit("suspect_roles")),
            F.when(F.col("role_cod").isin(*ADMINISTERED_ROLES), F.lit("all_administered_roles")),
        )
    )
    cases = (
        mapped.join(serious, "primaryid", "left")
        .select("split", F.explode(policies).alias("role_policy"), "canonical_smiles", "caseid", "quarter", "serious")
        .groupBy("split", "role_policy", "canonical_smiles", "caseid", "quarter")
        .agg(F.max(F.coalesce("serious", F.lit(0))).alias("serious"))
    )
    return (
        cases.groupBy("split", "role_policy", "canonical_smiles")
        .agg(
            F.count(F.lit(1)).alias("n_reports"),
            F.sum("serious").alias("serious_outcome_reports"),
            F.concat_ws("|", F.sort_array(F.collect_set("quarter"))).alias("source_quarters"),
        )
        .withColumn(
            "serious_outcome_recorded_fraction", F.col("serious_outcome_reports") / F.col("n_reports")
        )
    )


def unexpected_codes(outcomes: DataFrame, selected: DataFrame, serious_codes: Sequence[str] = SERIOUS_CODES) -> DataFrame:
    """Codes without a reviewed policy among the selected reports: any row is an error for the caller."""
    codes = selected_outcomes(outcomes, selected).select("outc_cod").distinct()
    return codes.filter((F.col("outc_cod") != "") & ~F.col("outc_cod").isin(*serious_codes))


def cohort_manifest(
    demo: DataFrame, drugs: DataFrame, deleted: DataFrame, bridge: DataFrame, labels: DataFrame,
    train_years: Sequence[str], test_years: Sequence[str],
) -> DataFrame:
    """(item, value) counts that describe a cohort build."""
    selected = selected_cases(demo, deleted, train_years, test_years)
    mapped = mapped_drug_rows(drugs, selected, bridge)

    def item(df: DataFrame, name: Column | str, value: Column) -> DataFrame:
        label = F.lit(name) if isinstance(name, str) else name
        grouped = df.groupBy(label.alias("item")) if not isinstance(name, str) else df
        out = grouped.agg(value.cast("long").alias("value"))
        return out if not isinstance(name, str) else out.select(label.alias("item"), "value")

    suspects = labels.filter(F.col("role_policy") == "suspect_roles").select("split", "canonical_smiles")
    shared = suspects.groupBy("canonical_smiles").agg(F.count(F.lit(1)).alias("n")).filter("n = 2")
    touched = demo.join(deleted.select("caseid").distinct(), "caseid", "left_semi").select("caseid").distinct()
    parts = [
        item(selected, F.concat(F.lit("cases_"), F.col("split")), F.count(F.lit(1))),
        item(suspects, F.concat(F.lit("suspect_structures_"), F.col("split")), F.count(F.lit(1))),
        item(shared, "suspect_structure_overlap", F.count(F.lit(1))),
        item(touched, "deleted_cases_present", F.count(F.lit(1))),
        item(mapped, "selected_drug_rows", F.count(F.lit(1))),
        item(mapped, "selected_drug_rows_mapped", F.count("canonical_smiles")),
        item(
            mapped.filter(F.col("canonical_smiles").isNull()).select("name_key").distinct(),
            "unmapped_names", F.count(F.lit(1)),
        ),
        item(mapped, F.concat(F.lit("role_"), F.col("role_cod")), F.count(F.lit(1))),
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def bridge_audit(bridge: DataFrame) -> DataFrame:
    """Per structure: rows, distinct names and scores, sorted names, and whether the scores conflict."""
    per_value = bridge.groupBy("canonical_smiles", "drugname", "toxicity_score").agg(F.count(F.lit(1)).alias("rows"))
    return (
        per_value.groupBy("canonical_smiles")
        .agg(
            F.sum("rows").alias("rows"),
            F.size(F.collect_set("drugname")).alias("distinct_names"),
            F.size(F.collect_set("toxicity_score")).alias("distinct_scores"),
            F.concat_ws("|", F.sort_array(F.collect_set("drugname"))).alias("names"),
        )
        .withColumn("is_duplicate", F.col("rows") > 1)
        .withColumn("is_conflict", F.col("distinct_scores") > 1)
    )


def resolve_bridge(bridge: DataFrame) -> DataFrame:
    """One row per structure without conflicting scores: most reports, then name.

    Conflict is min <> max, so one aggregate decides it without a distinct count.
    """
    sound = (
        bridge.groupBy("canonical_smiles")
        .agg(F.min("toxicity_score").alias("_lo"), F.max("toxicity_score").alias("_hi"))
        .filter(F.col("_lo") == F.col("_hi")).select("canonical_smiles")
    )
    return one_per(
        bridge.join(sound, "canonical_smiles", "left_semi"), ["canonical_smiles"],
        [F.desc("n_reports"), F.asc("drugname")],
    )


def target_priority_top_n(labels: DataFrame, targets: DataFrame, n: int) -> DataFrame:
    """Target names first, then most reports: the top-n worklist."""
    flagged = labels.join(targets.select("drugname").distinct().withColumn("_t", F.lit(1)), "drugname", "left")
    is_target = F.coalesce("_t", F.lit(0))
    return flagged.withColumn("is_target", is_target).drop("_t").orderBy(
        F.desc("is_target"), F.desc("n_reports"), F.asc("drugname")
    ).limit(n)

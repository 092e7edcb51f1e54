"""Contracts, projections, filters and cleaning of pair tables."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from doseweave.plans.hashing import lowest, priority


class ContractError(ValueError):
    """A table breaks a documented contract."""


def require_columns(df: DataFrame, names: Iterable[str], table: str = "table") -> DataFrame:
    missing = sorted(set(names) - set(df.columns))
    if missing:
        raise ContractError(f"{table} is missing required columns: {missing}")
    return df


def resolve_column(df: DataFrame, candidates: Sequence[str]) -> str | None:
    """The table's spelling of the first candidate present, whatever its case."""
    spelled = {c.strip().lower(): c for c in df.columns}
    return next((spelled[c.lower()] for c in candidates if c.lower() in spelled), None)


def canonical_pair(df: DataFrame, a: str, b: str, out: tuple[str, str] | None = None) -> DataFrame:
    """Order-independent endpoints (byte order); a missing or empty endpoint fails the query."""
    left, right = out or (a, b)

    def checked(name: str) -> Column:
        text = F.col(name).cast("string")
        return F.when(text.isNull() | (F.trim(text) == ""), F.raise_error(F.lit(f"{name}: missing endpoint"))).otherwise(
            F.col(name)
        )

    return df.withColumns({"_end_1": checked(a), "_end_2": checked(b)}).withColumns(
        {left: F.least("_end_1", "_end_2"), right: F.greatest("_end_1", "_end_2")}
    ).drop("_end_1", "_end_2")


def map_distinct(df: DataFrame, column: str, out: str, fn: Callable[[Column], Column]) -> DataFrame:
    """Applies an expensive function once per distinct value; several raw values may merge, nulls stay null."""
    values = df.select(column).distinct().filter(F.col(column).isNotNull())
    return df.join(values.withColumn(out, fn(F.col(column))), column, "left")


def usable_edges(df: DataFrame, a: str, b: str, event: str) -> DataFrame:
    """Rows with both endpoints and an event that are not self pairs."""
    return df.filter(
        F.col(a).isNotNull() & F.col(b).isNotNull() & F.col(event).isNotNull() & (F.col(a) != F.col(b))
    )


def edge_drop_counts(df: DataFrame, a: str, b: str, event: str) -> DataFrame:
    missing = F.col(a).isNull() | F.col(b).isNull() | F.col(event).isNull()
    return df.agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.count_if(missing).alias("n_missing"),
        F.count_if(~missing & (F.col(a) == F.col(b))).alias("n_self"),
    )


# The accepted encodings of a binary label.
POSITIVE_TEXT = ("1", "1.0", "true", "yes", "positive")
NEGATIVE_TEXT = ("0", "0.0", "false", "no", "negative")


def parse_binary_label(column: Column) -> Column:
    """0 or 1 from an accepted encoding, null otherwise; callers reject the nulls or call ``strict_binary_label``."""
    text = F.lower(F.trim(column.cast("string")))
    return F.when(text.isin(*POSITIVE_TEXT), F.lit(1)).when(text.isin(*NEGATIVE_TEXT), F.lit(0))


def strict_binary_label(column: Column) -> Column:
    parsed = parse_binary_label(column)
    return F.when(parsed.isNull(), F.raise_error(F.lit("label is not binary")).cast("int")).otherwise(parsed)


def exclude_pairs_by_endpoint(pairs: DataFrame, ids: DataFrame, a: str, b: str) -> tuple[DataFrame, DataFrame]:
    """(kept rows, distinct excluded unordered pairs) for a table ``ids(id)`` of reviewed endpoints."""
    reviewed = ids.select("id").distinct()
    hit_a = reviewed.select(F.col("id").alias(a), F.lit(True).alias("_hit_a"))
    hit_b = reviewed.select(F.col("id").alias(b), F.lit(True).alias("_hit_b"))
    marked = pairs.join(hit_a, a, "left").join(hit_b, b, "left")
    touched = F.col("_hit_a").isNotNull() | F.col("_hit_b").isNotNull()
    excluded = canonical_pair(marked.filter(touched).select(a, b), a, b).distinct()
    return marked.filter(~touched).select(*pairs.columns), excluded


def unknown_ids(ids: DataFrame, pairs: DataFrame, a: str, b: str) -> DataFrame:
    """Reviewed ids that occur in no pair: callers treat any row as an error."""
    known = pairs.select(F.explode(F.array(a, b)).alias("id")).distinct()
    return ids.select("id").distinct().join(known, "id", "left_anti")


def partition_compatible(pairs: DataFrame, reasons: DataFrame, a: str, b: str) -> DataFrame:
    """Adds each endpoint's status and ``compatible``; reasons(value, reason) lists the incompatible values."""
    one = reasons.groupBy("value").agg(F.min("reason").alias("reason"))
    ok = F.lit("graph_compatible")
    return (
        pairs.join(one.select(F.col("value").alias(a), F.col("reason").alias("status_a")), a, "left")
        .join(one.select(F.col("value").alias(b), F.col("reason").alias("status_b")), b, "left")
        .withColumn("compatible", F.col("status_a").isNull() & F.col("status_b").isNull())
        .withColumns({"status_a": F.coalesce("status_a", ok), "status_b": F.coalesce("status_b", ok)})
    )


def curation_queue(marked: DataFrame, a: str, b: str) -> DataFrame:
    """Per rejected value: reason, occurrences and the sides it was seen on, pending review."""
    sides = marked.filter(~F.col("compatible")).select(
        F.explode(
            F.array(
                F.struct(F.col(a).alias("value"), F.col("status_a").alias("reason"), F.lit("source").alias("side")),
                F.struct(F.col(b).alias("value"), F.col("status_b").alias("reason"), F.lit("target").alias("side")),
            )
        ).alias("s")
    ).select("s.*")
    return (
        sides.filter(F.col("reason") != "graph_compatible")
        .groupBy("value", "reason")
        .agg(
            F.count(F.lit(1)).alias("occurrences"),
            F.concat_ws("|", F.sort_array(F.collect_set("side"))).alias("sides_observed"),
        )
        .withColumn("review_status", F.lit("pending_review"))
    )


def validate_bridge(df: DataFrame, name: str, score: str, reports: str) -> DataFrame:
    """Trimmed upper-case names and strict numbers; a negative count or unreadable number fails the query."""
    count = F.col(reports).cast("long")
    bad = F.raise_error(F.lit("negative report count")).cast("long")
    return df.withColumns(
        {
            name: F.upper(F.trim(F.col(name))),
            score: F.col(score).cast("double"),
            reports: F.when(count < 0, bad).otherwise(count),
        }
    )


def count_violations(df: DataFrame, key: str, k: str, n: str, fraction: str) -> DataFrame:
    """One row of violation counts: 0 <= k <= n, n > 0, k / n equals the stored fraction, unique key."""
    per_key = df.groupBy(key).agg(
        F.count(F.lit(1)).alias("rows"),
        F.count_if(~F.col(k).between(F.lit(0), F.col(n))).alias("bad_range"),
        F.count_if(F.col(n) <= 0).alias("bad_total"),
        F.count_if((F.col(n) > 0) & (F.abs(F.col(k) / F.nullif(F.col(n), F.lit(0)) - F.col(fraction)) > 1e-10)).alias(
            "bad_fraction"
        ),
    )
    return per_key.agg(
        F.sum("bad_range").alias("bad_range"),
        F.sum("bad_total").alias("bad_total"),
        F.sum("bad_fraction").alias("bad_fraction"),
        F.count_if(F.col("rows") > 1).alias("duplicate_keys"),
    )


# The key pattern and split names of the catalogue contract.
INCHIKEY_PATTERN = "^[A-Z]{14}-[A-Z]{10}-[A-Z]$"
SPLIT_GROUPS = ("train", "validation", "test", "unassigned")


def catalogue_violations(nodes: DataFrame, edges: DataFrame, groups: Sequence[str] = SPLIT_GROUPS) -> DataFrame:
    """(rule, violations) for nodes(id, inchikey, n_reports) and edges(a, b, confidence, split_group)."""
    per_id = nodes.groupBy("id").agg(
        F.count(F.lit(1)).alias("rows"),
        F.count_if(F.col("inchikey").isNotNull() & ~F.col("inchikey").rlike(INCHIKEY_PATTERN)).alias("bad_key"),
        F.count_if(F.col("n_reports") < 0).alias("bad_count"),
    )
    node_rules = per_id.agg(
        F.count_if(F.col("id").isNull() | (F.trim(F.col("id").cast("string")) == "")).alias("empty_id"),
        F.count_if(F.col("rows") > 1).alias("duplicate_id"),
        F.sum("bad_key").alias("bad_inchikey"),
        F.sum("bad_count").alias("negative_reports"),
    )
    edge_rules = edges.agg(
        F.count_if(F.col("a") == F.col("b")).alias("self_loop"),
        F.count_if(~F.col("confidence").between(0, 1)).alias("bad_confidence"),
        F.count_if(~F.col("split_group").isin(*groups)).alias("bad_split_group"),
    )
    ends = edges.select(F.explode(F.array("a", "b")).alias("id")).distinct()
    dangling = ends.join(nodes.select("id"), "id", "left_anti").agg(F.count(F.lit(1)).alias("dangling_endpoint"))

    def long(df: DataFrame) -> DataFrame:
        return df.unpivot([], df.columns, "rule", "violations")

    return long(node_rules).unionByName(long(edge_rules)).unionByName(long(dangling))


def looks_like_structure(column: Column) -> Column:
    """True for structure-like text (bonds, brackets, ring digits) where a name is expected."""
    compact = ~column.rlike(r"\s")
    return compact & (
        column.contains("=")
        | column.contains("#")
        | column.rlike(r"\[[A-Za-z@+\-0-9]+\]")
        | (column.contains("(") & column.rlike(r"[A-Za-z]\d"))
        | column.rlike("^InChI=")
    )


def normalise_age(df: DataFrame, age: str, unit: str, sex: str) -> DataFrame:
    """``age_years`` and ``sex_code`` (M 0, F 1); rows without either are dropped."""
    code = F.upper(F.trim(F.coalesce(F.col(unit).cast("string"), F.lit(""))))
    value = F.col(age).cast("string").try_cast("double")
    years = (
        F.when(code.isin("YR", "", "NAN"), value).when(code == "MON", value / 12.0).when(code == "DEC", value * 10.0)
    )
    gender = F.when(F.col(sex) == "M", F.lit(0)).when(F.col(sex) == "F", F.lit(1))
    return df.withColumns({"age_years": years, "sex_code": gender}).dropna(subset=["age_years", "sex_code"])


def seeded_cap(df: DataFrame, keys: Sequence[str], n: int, seed: int) -> DataFrame:
    """A seeded sample of n rows by hash order of a unique key."""
    hashed = df.withColumn("_prio", priority(seed, *[F.col(k) for k in keys]))
    return lowest(hashed, "_prio", n).drop("_prio")


def orient_relations(df: DataFrame) -> DataFrame:
    """Distinct (drug_name, gene) of rows that link a chemical and a gene in either direction."""
    t1, t2 = F.lower(F.trim("entity1_type")), F.lower(F.trim("entity2_type"))
    forward, backward = (t1 == "chemical") & (t2 == "gene"), (t1 == "gene") & (t2 == "chemical")
    rest = [c for c in df.columns if not c.startswith("entity")]
    return (
        df.filter(forward | backward)
        .select(
            F.trim(F.when(forward, F.col("entity1_name")).otherwise(F.col("entity2_name"))).alias("drug_name"),
            F.trim(F.when(forward, F.col("entity2_name")).otherwise(F.col("entity1_name"))).alias("gene"),
            *rest,
        )
        .filter((F.col("drug_name") != "") & (F.col("gene") != ""))
        .dropDuplicates()
    )


def prediction_table(rows: DataFrame, threshold: float, provenance: Sequence[str]) -> DataFrame:
    """Provenance, label, raw and calibrated score, threshold, predicted label and margin to the threshold."""
    score = F.col("calibrated_score")
    return rows.select(
        *provenance, "label", "raw_score", "calibrated_score",
        F.lit(float(threshold)).alias("threshold"),
        (score >= F.lit(float(threshold))).cast("int").alias("predicted_label"),
        F.abs(score - F.lit(float(threshold))).alias("margin"),
    )


# Accession and gene-symbol patterns, point mutations, and words that are not targets.
ACCESSION_PATTERN = "^([OPQ][0-9][A-Z0-9]{3}[0-9]|[A-NR-Z][0-9]([A-Z][A-Z0-9]{2}[0-9]){1,2})$"
GENE_PATTERN = "^[A-Z][A-Z0-9-]{1,14}$"
MUTATION_PATTERN = "^[A-Z][0-9]+[A-Z]$"
TARGET_STOP_WORDS = ("HUMAN", "NONE", "NULL", "NAN", "UNKNOWN", "PROTEIN", "RECEPTOR", "ENZYME", "CHAIN", "DNA", "RNA")


def target_tokens(nodes: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Distinct accession or gene tokens over the target columns with their kind."""
    parts = [F.split(F.coalesce(F.col(c).cast("string"), F.lit("")), r"[,;|\s]+") for c in columns]
    tokens = nodes.select(F.explode(F.concat(*parts)).alias("raw")).select(F.upper(F.trim("raw")).alias("token"))
    accession = F.col("token").rlike(ACCESSION_PATTERN)
    gene = F.col("token").rlike(GENE_PATTERN) & ~F.col("token").rlike(MUTATION_PATTERN)
    return (
        tokens.distinct()
        .filter((accession | gene) & ~F.col("token").isin(*TARGET_STOP_WORDS))
        .withColumn("kind", F.when(accession, F.lit("accession")).otherwise(F.lit("gene")))
    )


def one_per(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """The first row per key. The limit of one reaches the map side, so a hot key ships one row per task."""
    first = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(first)).filter(F.col("_rn") == 1).drop("_rn")

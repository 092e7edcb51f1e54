"""Per-drug profiles, coverage reports and set operations over partitions."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from doseweave.functions.text import norm_name
from doseweave.operators.clean import one_per
from doseweave.plans.ordering import running_sums, with_key_bucket


def gene_profiles(evidence: DataFrame, structure: str = "structure", gene: str = "gene") -> DataFrame:
    """Per structure: sorted distinct genes, their number and the evidence rows behind them."""
    per_gene = evidence.filter(F.col(structure).isNotNull()).groupBy(structure, gene).agg(F.count(F.lit(1)).alias("n"))
    return per_gene.groupBy(structure).agg(
        F.sort_array(F.collect_list(gene)).alias("genes"), F.count(F.lit(1)).alias("n_genes"),
        F.sum("n").alias("evidence_rows"),
    )


def structure_profile(records: DataFrame, default: float = 2.5) -> DataFrame:
    """Per key: sorted ids, sorted targets and the mean value to three places."""
    return records.groupBy("key").agg(
        F.sort_array(F.collect_set("record_id")).alias("ids"), F.sort_array(F.collect_set("target")).alias("targets"),
        F.round(F.coalesce(F.avg("value"), F.lit(default)), 3).alias("mean_value"),
    )


def affinity_profile(edges: DataFrame, order: str) -> DataFrame:
    """drug -> map target -> value, the latest row per target by a file-order key, and the sorted target list."""
    last = edges.groupBy("drug", "target").agg(F.max_by("value", order).alias("value"))
    entries = F.sort_array(F.collect_list(F.struct("target", "value")))
    return last.groupBy("drug").agg(entries.alias("_e")).select(
        "drug", F.map_from_entries("_e").alias("affinities"), F.transform("_e", lambda e: e["target"]).alias("targets")
    )


def gene_scores(expression: DataFrame, by: Sequence[str] = (), top: int | None = None) -> DataFrame:
    """Per gene the largest probe spread, scaled by the largest score; if asked for, the ``top`` genes per source only.

    expression(by..., gene, probe, value): a probe with one value scores its absolute value.
    """
    probes = expression.filter(F.col("value").isNotNull()).groupBy(*by, "gene", "probe").agg(
        F.stddev_pop("value").alias("sd"), F.count("value").alias("n"), F.max("value").alias("one")
    )
    spread = F.when(F.col("n") > 1, F.col("sd")).otherwise(F.abs("one"))
    genes = probes.groupBy(*by, "gene").agg(F.max(spread).alias("score"))
    if not by:
        best = genes.agg(F.max("score")).scalar()
        kept = (genes if top is None else genes.orderBy(F.desc("score"), F.asc("gene")).limit(top)).withColumn("_m", best)
    else:
        if top is None:
            ranked = genes
        else:
            order = Window.partitionBy(*by).orderBy(F.desc("score"), F.asc("gene"))
            ranked = genes.withColumn("_rn", F.row_number().over(order)).filter(F.col("_rn") <= top).drop("_rn")
        kept = ranked.join(genes.groupBy(*by).agg(F.max("score").alias("_m")), list(by))
    return kept.withColumn("score", F.when(F.col("_m") > 0, F.col("score") / F.col("_m")).otherwise(F.lit(0.0))).drop("_m")


def signature_overlap(drug_genes: DataFrame, signatures: DataFrame) -> DataFrame:
    """Mean signature score of a drug's genes per disease over all its matched genes; an absent row means zero."""
    hits = drug_genes.select("drug", "gene").distinct().join(signatures, "gene")
    return hits.groupBy("drug", "disease").agg(F.round(F.avg("score"), 4).alias("overlap"))


def weighted_mean_vector(targets: DataFrame, embeddings: DataFrame) -> DataFrame:
    """targets(drug, target, weight) x embeddings(target, vector): the weighted mean vector per drug.

    The vector aggregator combines on the map side, so each drug ships one vector per task.
    """
    rows = targets.join(embeddings, "target").withColumn("_v", array_to_vector(F.transform("vector", lambda x: x.cast("double"))))
    mean = rows.groupBy("drug").agg(Summarizer.mean(F.col("_v"), F.col("weight").cast("double")).alias("_m"))
    return targets.select("drug").distinct().join(
        mean.select("drug", vector_to_array("_m").alias("vector")), "drug", "left"
    ).withColumn("is_known", F.col("vector").isNotNull())


def coverage_report(features: DataFrame, drugs: DataFrame) -> DataFrame:
    """features(drug, block, item): per block the dimensions, known drugs and share of the catalogue, plus any block."""
    n = drugs.select("drug").distinct().agg(F.count(F.lit(1))).scalar()
    items = features.groupBy("block", "item").agg(F.count(F.lit(1)).alias("n")).groupBy("block").agg(
        F.count(F.lit(1)).alias("dimensions"), F.sum("n").alias("nonzero_cells")
    )
    known = features.select("block", "drug").distinct().groupBy("block").agg(F.count(F.lit(1)).alias("known_drugs"))
    any_block = features.select("drug").distinct().agg(
        F.lit("any").alias("block"), F.lit(None).cast("long").alias("dimensions"),
        F.lit(None).cast("long").alias("nonzero_cells"), F.count(F.lit(1)).alias("known_drugs"),
    )
    both = items.join(known, "block").unionByName(any_block)
    return both.withColumn("_n", n).withColumn(
        "coverage_pct", F.round(100.0 * F.col("known_drugs") / F.col("_n"), 4)
    ).drop("_n")


def feature_audit(features: DataFrame, drugs: DataFrame) -> DataFrame:
    """Per block: dimensions, nonzero cells, drugs without the block, and a hash of its cells."""
    from doseweave.functions.numeric import set_hash

    report = coverage_report(features, drugs).filter("block <> 'any'").drop("coverage_pct")
    n = drugs.select("drug").distinct().agg(F.count(F.lit(1))).scalar()
    cells = features.select("block", F.concat_ws("\u0000", F.col("drug").cast("string"), "item").alias("cell"))
    hashes = set_hash(cells, "cell", ["block"]).drop("n")
    return (
        report.withColumn("_n", n).withColumn("drugs_without", F.col("_n") - F.col("known_drugs"))
        .drop("_n", "known_drugs").join(hashes, "block")
    )


def label_rollup(records: DataFrame, max_chars: int | None = None) -> DataFrame:
    """records(record_id, drug_idx, text): labels per drug and their text in record order, up to a cap if one is given.

    With a cap a record is appended while the text so far is below the cap. The running length decides which records that
    is before any text is gathered, so a drug with very many labels never brings them all to one task.
    """
    chosen = records
    if max_chars is not None:
        sized = with_key_bucket(records.withColumn("_len", F.length(F.coalesce("text", F.lit(""))) + 1), "record_id", "_cut")
        lengths = running_sums(
            sized.select("drug_idx", "record_id", "_len", "_cut"), "record_id", ["_len"], ["drug_idx"], bucket=F.col("_cut")
        )
        needed = lengths.filter(F.col("run__len") - F.col("_len") < max_chars).select("drug_idx", "record_id")
        chosen = records.join(needed, ["drug_idx", "record_id"])
    texts = chosen.groupBy("drug_idx").agg(
        F.sort_array(F.collect_list(F.struct("record_id", F.coalesce("text", F.lit("")).alias("t")))).alias("_t")
    )
    counts = records.groupBy("drug_idx").agg(F.count(F.lit(1)).alias("n_labels"))
    joined = F.concat(F.lit(" "), F.array_join(F.transform("_t", lambda x: x["t"]), " "))
    return counts.join(texts, "drug_idx").select("drug_idx", "n_labels", joined.alias("text")).withColumn(
        "text_chars", F.length("text")
    )


def drug_catalogue(raw: DataFrame, name: str | None, structure: str | None, ident: str | None) -> DataFrame:
    """(drug_name, norm_name, structure, chem_id, mapping_ready); empty when a needed column is missing."""
    from doseweave.functions.text import with_norm_drug_name

    if not name or not structure:
        empty = raw.sparkSession.createDataFrame(
            [], "drug_name string, norm_name string, structure string, chem_id string, mapping_ready boolean"
        )
        return empty
    rows = raw.select(
        F.trim(name).alias("drug_name"), F.trim(structure).alias("structure"),
        (F.col(ident).cast("string") if ident else F.lit(None).cast("string")).alias("chem_id"),
    ).filter((F.col("drug_name") != "") & (F.col("structure") != ""))
    keyed = with_norm_drug_name(rows.distinct(), "drug_name", "norm_name").filter(F.col("norm_name").isNotNull())
    return keyed.select("drug_name", "norm_name", "structure", "chem_id").withColumn("mapping_ready", F.lit(True))


def source_coverage(sources: dict[str, DataFrame | None], universe: DataFrame) -> DataFrame:
    """Per source(drug, target): present, rows, drugs of the universe it covers, distinct targets."""
    ids = universe.select("drug").distinct()

    def one(name: str, df: DataFrame | None) -> DataFrame:
        if df is None:
            return ids.sparkSession.createDataFrame(
                [(name, False, 0, 0, 0)], "source string, present boolean, rows long, matched_drugs long, targets long"
            )
        matched = df.select("drug").distinct().join(ids, "drug", "left_semi").agg(F.count(F.lit(1)))
        targets = df.select("target").filter("target IS NOT NULL").distinct().agg(F.count(F.lit(1)))
        return df.agg(F.count(F.lit(1)).alias("rows")).select(
            F.lit(name).alias("source"), F.lit(True).alias("present"), "rows",
            matched.scalar().alias("matched_drugs"), targets.scalar().alias("targets"),
        )

    return reduce(DataFrame.unionByName, [one(n, d) for n, d in sources.items()])


# Set operations.
def union_distinct_evidence(relations: DataFrame, pathways: DataFrame) -> DataFrame:
    return relations.unionByName(pathways, allowMissingColumns=True).distinct()


def all_drugs(pairs: DataFrame, a: str, b: str) -> DataFrame:
    return pairs.select(F.explode(F.array(a, b)).alias("drug")).distinct()


def overlap_counts(members: DataFrame, partition: str = "partition", key: str = "key") -> DataFrame:
    """Keys shared by each two partitions. Each key carries its own few partitions, so no self join is needed."""
    per = members.select(partition, key).distinct().groupBy(key).agg(F.sort_array(F.collect_list(partition)).alias("p"))
    pairs = F.flatten(
        F.transform("p", lambda x, i: F.transform(F.slice("p", i + 2, F.size("p")), lambda y: F.struct(x.alias("a"), y.alias("b"))))
    )
    return per.filter(F.size("p") > 1).select(F.explode(pairs).alias("s")).groupBy("s").agg(
        F.count(F.lit(1)).alias("shared")
    ).select(F.col("s.a").alias("partition_a"), F.col("s.b").alias("partition_b"), "shared")


def non_train_structures(splits: DataFrame, a: str, b: str, train: str = "transductive_train") -> DataFrame:
    return all_drugs(splits.filter(F.col("split") != train), a, b)


def interaction_dedupe(rows: DataFrame, fields: Sequence[str]) -> DataFrame:
    return rows.dropDuplicates(list(fields))


def latest_run_dedupe(runs: DataFrame, keys: Sequence[str], order: str) -> DataFrame:
    return one_per(runs, keys, [F.desc(order)])


def candidate_names(*sources: tuple[DataFrame, int]) -> DataFrame:
    """(drug_idx, name) sources with a priority to distinct names, the best priority kept."""
    rows = reduce(
        DataFrame.unionByName,
        [df.select("drug_idx", norm_name(F.col("name")).alias("name")).withColumn("priority", F.lit(p)) for df, p in sources],
    )
    return rows.filter(F.col("name").isNotNull() & (F.col("name") != "")).groupBy("drug_idx", "name").agg(
        F.min("priority").alias("priority")
    )


# Cohorts by profile coverage.
def coverage_tiers(pairs: DataFrame, profiled: DataFrame, a: str, b: str) -> DataFrame:
    """Adds n_profiled (0, 1, 2) and the tier name by how many endpoints have a profile."""
    known = profiled.select("drug").distinct().withColumn("_k", F.lit(1))
    out = pairs
    for side, name in ((a, "_ka"), (b, "_kb")):
        out = out.join(known.select(F.col("drug").alias(side), F.col("_k").alias(name)), side, "left")
    n = F.coalesce("_ka", F.lit(0)) + F.coalesce("_kb", F.lit(0))
    tier = F.when(F.col("n_profiled") == 2, "both").when(F.col("n_profiled") == 1, "one").otherwise("zero")
    return out.withColumn("n_profiled", n).withColumn("tier", tier).drop("_ka", "_kb")


def subcohorts(rows: DataFrame, predicates: dict[str, Column]) -> DataFrame:
    """Each row once per named cohort it belongs to; cohorts may overlap."""
    named = F.array(*[F.when(p, F.lit(n)) for n, p in predicates.items()])
    return rows.withColumn("cohort", F.explode(F.array_compact(named)))

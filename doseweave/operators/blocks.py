"""Feature blocks per drug with known flags, feature matrices, node catalogues and regimen alerts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from doseweave.functions.numeric import cyp_overlap
from doseweave.functions.text import ISOFORMS, ROLE_WORDS, atc_levels, parse_gene_list, split_accessions
from doseweave.operators.clean import one_per
from doseweave.operators.profiles import all_drugs
from doseweave.plans.ordering import dense_ids
from doseweave.session import durable

#: Values of the feature matrix that a task spreads out.
MATRIX_CELLS = 1 << 26
CYP_COLUMNS = tuple(f"cyp{iso}_{role}" for iso in ISOFORMS for role in ROLE_WORDS)


def _clean_items(items: DataFrame, owner: str) -> DataFrame:
    clean = items.filter(F.col(owner).isNotNull() & F.col("item").isNotNull() & ~F.lower(F.trim("item")).isin("", "nan"))
    return clean.select(owner, F.trim("item").alias("item")).distinct()


def item_block(drugs: DataFrame, items: DataFrame) -> DataFrame:
    """items(drug, item) to drug, items (sorted distinct), known; a drug without items keeps an empty list."""
    per = _clean_items(items, "drug").groupBy("drug").agg(F.sort_array(F.collect_list("item")).alias("items"))
    return drugs.select("drug").distinct().join(per, "drug", "left").select(
        "drug", F.coalesce("items", F.array().cast("array<string>")).alias("items"), F.col("items").isNotNull().alias("known")
    )


def target_block(drugs: DataFrame, targets: DataFrame, human_only: bool = False) -> DataFrame:
    rows = targets.filter(F.col("organism") == "Homo sapiens") if human_only and "organism" in targets.columns else targets
    return item_block(drugs, rows.select("drug", F.col("uniprot").alias("item")))


def class_block(drugs: DataFrame, targets: DataFrame) -> DataFrame:
    if "target_class" not in targets.columns:
        return item_block(drugs, drugs.select("drug", F.lit(None).cast("string").alias("item")).limit(0))
    return item_block(drugs, targets.select("drug", F.col("target_class").alias("item")))


def atc_block(drugs: DataFrame, codes: DataFrame) -> DataFrame:
    return item_block(drugs, codes.select("drug", F.explode(atc_levels(F.col("atc_code"))).alias("item")))


def cyp_block(drugs: DataFrame, label_features: DataFrame) -> DataFrame:
    """The 24 flags as one 0/1 array; known only where label text was found."""
    flags = F.array(*[F.coalesce(F.col(c), F.lit(0)).cast("int") for c in CYP_COLUMNS])
    rows = label_features.select("drug", flags.alias("flags"), (F.col("pk_text_chars") > 0).alias("known"))
    zero = F.array(*[F.lit(0)] * len(CYP_COLUMNS))
    return drugs.select("drug").distinct().join(rows, "drug", "left").select(
        "drug", F.coalesce("flags", zero).alias("flags"), F.coalesce("known", F.lit(False)).alias("known")
    )


def gene_block(drugs: DataFrame, profiles: DataFrame) -> DataFrame:
    """drugs(drug, structure) x profiles(structure, genes_list): exact structure match, profiles united.

    Lists are united once per combination of structures that some drug has, not once per drug.
    """
    genes = profiles.select("structure", F.explode(parse_gene_list(F.col("genes_list"))).alias("item"))
    owners = drugs.groupBy("drug").agg(F.sort_array(F.collect_set(F.when(F.col("drug").isNotNull(), F.col("structure")))).alias("structures"))
    held = _clean_items(genes, "structure").groupBy("structure").agg(F.collect_list("item").alias("items"))
    united = (
        owners.select("structures").distinct().withColumn("structure", F.explode("structures")).join(held, "structure")
        .groupBy("structures").agg(F.sort_array(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))
    )
    return owners.join(united, "structures", "left").select(
        "drug", F.coalesce("items", F.array().cast("array<string>")).alias("items"), F.col("items").isNotNull().alias("known")
    )


def unmatched_profiles(drugs: DataFrame, profiles: DataFrame) -> DataFrame:
    missing = profiles.join(drugs.select("structure").distinct(), "structure", "left_anti").agg(F.count(F.lit(1)))
    return profiles.agg(F.count(F.lit(1)).alias("profiles")).withColumn("unmatched_profiles", missing.scalar())


def build_targets(matched: DataFrame, targets: DataFrame, moa_only: bool = False) -> DataFrame:
    """matched(drug, struct_id) x targets(struct_id, accession, ...): one row per accession, first per (drug, target).

    The first of a structure's rows per accession is found before drugs join, so a structure of many rows and many drugs
    doesn't multiply them.
    """
    rows = targets.filter(F.lower(F.col("moa").cast("string")).isin("1", "1.0", "true")) if moa_only else targets
    single = rows.withColumn("uniprot", F.explode(split_accessions(F.col("accession")))).drop("accession")
    first = one_per(single, ["struct_id", "uniprot"], [F.asc_nulls_last("target_class")])
    joined = first.join(matched.select("drug", "struct_id").distinct(), "struct_id")
    return one_per(joined, ["drug", "uniprot"], [F.asc("struct_id"), F.asc_nulls_last("target_class")])


def name_bridge(matched: DataFrame) -> DataFrame:
    """The first matched structure per drug, with its names under the bridge's column names."""
    return one_per(matched, ["drug"], [F.asc("struct_id")]).select(
        "drug", F.col("struct_id"), F.col("INN").alias("inn"), F.col("CAS_RN").alias("cas_rn")
    )


def _places(block: DataFrame, name: str) -> DataFrame:
    """drug, the places of its items in the order of all items, how many items there are, and the block's flag."""
    items = durable(block.select("drug", F.explode("items").alias("item")).distinct())
    numbered = dense_ids(items.select("item").distinct(), "item", "place")
    width = items.agg(F.count_distinct("item").cast("int")).scalar()
    own = items.join(numbered, "item").groupBy("drug").agg(F.sort_array(F.collect_list(F.col("place").cast("int"))).alias("_p"))
    return block.select("drug", "known").join(own, "drug", "left").select(
        "drug", F.coalesce("_p", F.array().cast("array<int>")).alias(f"_{name}"), width.alias(f"_w{name}"), F.col("known").alias(f"_k{name}"))


def _spread(places: Column, width: Column) -> Column:
    """0/1 values, as runs of zeros between the places of the ones."""
    zeros = lambda n: F.array_repeat(F.lit(0), n)
    before = lambda i: F.when(i == 0, F.lit(-1)).otherwise(F.get(places, i - 1))
    runs = F.flatten(F.transform(places, lambda x, i: F.concat(zeros(x - before(i) - 1), F.array(F.lit(1)))))
    return F.concat(runs, zeros(width - F.coalesce(F.array_max(places), F.lit(-1)) - 1))


def feature_matrix(drugs: DataFrame, blocks: dict[str, DataFrame]) -> DataFrame:
    """drug, features: each block's multi-hot values followed by its known flag, blocks in the order given.

    Items are numbered by a join, so a drug costs its own items and its row of values, whatever the vocabulary. Rows are
    spread out last, in tasks of about ``MATRIX_CELLS`` values: the matrix grows with drugs times items, a task does not.
    """
    out = drugs.select("drug").distinct()
    parts, widths = [], []
    for name, block in blocks.items():
        if "items" in block.columns:
            out = out.join(_places(block, name), "drug", "left")
            parts.append(_spread(F.col(f"_{name}"), F.col(f"_w{name}")))
            widths.append(F.col(f"_w{name}"))
        else:
            out = out.join(block.select("drug", F.col("flags").alias(f"_{name}"), F.col("known").alias(f"_k{name}")), "drug", "left")
            parts.append(F.col(f"_{name}"))
            widths.append(F.size(f"_{name}"))
        parts.append(F.array(F.coalesce(F.col(f"_k{name}"), F.lit(False)).cast("int")))
    rows = durable(out)
    cells = rows.agg(F.sum(sum((F.coalesce(w, F.lit(0)).cast("long") for w in widths), F.lit(0).cast("long")))).head()[0] or 0
    return rows.repartition(max(1, -(-cells // MATRIX_CELLS))).select("drug", F.concat(*parts).alias("features"))


def feature_layout(blocks: dict[str, DataFrame]) -> DataFrame:
    """(block, start, stop) spans of the feature matrix; the flag column is the last of its span."""
    rows = []
    for i, (name, block) in enumerate(blocks.items()):
        if "items" in block.columns:
            counted = block.select(F.explode("items").alias("item")).agg(F.count_distinct("item").cast("int").alias("w"))
            rows.append(counted.select(F.lit(i).alias("i"), F.lit(name).alias("block"), (F.col("w") + 1).alias("width")))
        else:
            rows.append(block.agg(F.max(F.size("flags")).alias("w")).select(F.lit(i).alias("i"), F.lit(name).alias("block"), (F.col("w") + 1).alias("width")))
    widths = rows[0]
    for row in rows[1:]:
        widths = widths.unionByName(row)
    spans = widths.agg(F.sort_array(F.collect_list(F.struct("i", "block", "width"))).alias("w"))
    start = lambda w, i: F.aggregate(F.slice("w", F.lit(1), i), F.lit(0), lambda s, x: s + x["width"])
    return spans.select(
        F.explode(F.transform("w", lambda x, i: F.struct(x["block"].alias("block"), start(x, i).alias("start"), (start(x, i) + x["width"]).alias("stop")))).alias("s")
    ).select("s.*")


def max_merge_profiles(profiles: DataFrame, key: str, vector: str) -> DataFrame:
    """Duplicate keys to the elementwise maximum; one row per key and position combines on the map side."""
    long = profiles.select(key, F.posexplode(vector).alias("pos", "v")).groupBy(key, "pos").agg(F.max("v").alias("v"))
    ordered = F.transform(F.sort_array(F.collect_list(F.struct("pos", "v"))), lambda s: s["v"])
    return long.groupBy(key).agg(ordered.alias(vector))


def masked_branches(rows: DataFrame, masks: dict[str, str]) -> DataFrame:
    """Each value column zeroed where its mask is not set; a row with every mask unset fails the query."""
    some = F.lit(False)
    for mask in masks.values():
        some = some | (F.col(mask) == 1)
    checked = rows.withColumn("_ok", F.when(some, True).otherwise(F.raise_error(F.lit("no active branch")).cast("boolean"))).filter("_ok")
    return checked.withColumns({v: F.when(F.col(m) == 1, F.col(v)).otherwise(F.lit(0.0)) for v, m in masks.items()}).drop("_ok")


def node_catalogue(edges: DataFrame, genes: DataFrame, severity: DataFrame, targets: DataFrame) -> DataFrame:
    """Distinct edge endpoints with gene, severity and target profiles and whether each is active."""
    nodes = all_drugs(edges, "source", "target")
    return (
        nodes.join(genes.select("drug", "genes"), "drug", "left").join(severity.select("drug", "severity_score"), "drug", "left")
        .join(targets.select("drug", "targets"), "drug", "left")
        .withColumns({"has_genes": F.col("genes").isNotNull(), "has_severity": F.col("severity_score").isNotNull(), "has_targets": F.col("targets").isNotNull()})
    )


def zeroed_control(features: DataFrame, block: str) -> DataFrame:
    return features.filter(F.col("block") != block)


# Regimens: pairs of a regimen are given (a list per prescription), their profiles join in.
# The enzymes of a regimen load and the alert limits.
REGIMEN_ENZYMES = ("CYP3A4", "CYP2D6", "CYP2C9", "CYP1A2", "CYP2C19")
MIN_OVERLAP, LOW_FREE, HIGH_LOGP, SEVERE_PAIR, NTI_PAIR, SEVERE_DISPLACEMENT = 0.25, 0.05, 3.0, 0.5, 0.3, 0.4


def regimen_pairs(pairs: DataFrame, profiles: DataFrame) -> DataFrame:
    """pairs(regimen, drug_a, drug_b) with profiles(drug, cyp map, free, logp, nti): overlap, displacement, severity."""
    out = pairs
    for side in ("a", "b"):
        out = out.join(
            profiles.select(F.col("drug").alias(f"drug_{side}"), F.col("cyp").alias(f"_c{side}"), F.col("free").alias(f"_f{side}"),
                            F.col("logp").alias(f"_l{side}"), F.col("nti").alias(f"_n{side}")), f"drug_{side}")

    def shared(enzyme: str) -> Column:
        return F.least(F.coalesce(F.col("_ca")[enzyme], F.lit(0.0)), F.coalesce(F.col("_cb")[enzyme], F.lit(0.0)))

    overlap = sum((F.when(shared(e) > MIN_OVERLAP, shared(e)).otherwise(0.0) for e in REGIMEN_ENZYMES), F.lit(0.0))
    colliding = F.concat_ws("|", *[F.when(shared(e) > MIN_OVERLAP, F.lit(e)) for e in REGIMEN_ENZYMES])
    free = F.least("_fa", "_fb")
    displaced = F.when((free < LOW_FREE) & (F.greatest("_la", "_lb") > HIGH_LOGP), F.round(0.75 * (1 - free), 3)).otherwise(0.0)
    scored = out.withColumns({"_overlap": overlap, "colliding_enzymes": colliding, "displacement_risk": displaced}).withColumn(
        "pair_risk", F.least(F.lit(1.0), F.col("_overlap") + F.col("displacement_risk")))
    severe = (
        ((F.col("colliding_enzymes") != "") & (F.col("pair_risk") > SEVERE_PAIR)) | (F.col("displacement_risk") > SEVERE_DISPLACEMENT)
        | ((F.col("_na") | F.col("_nb")) & (F.col("pair_risk") > NTI_PAIR))
    )
    return scored.withColumn("severe", severe).drop("_ca", "_cb", "_fa", "_fb", "_la", "_lb", "_na", "_nb", "_overlap")


def regimen_rollup(members: DataFrame, profiles: DataFrame, alerts: DataFrame) -> DataFrame:
    """members(regimen, drug) and pair alerts to summed enzyme loads, alert counts and the verdict.

    A regimen with a drug that fails a guardrail (profiles.guardrail_ok) abstains.
    """
    joined = members.join(profiles, "drug")
    loads = [F.sum(F.coalesce(F.col("cyp")[e], F.lit(0.0))).alias(e) for e in REGIMEN_ENZYMES]
    per = joined.groupBy("regimen").agg(
        F.count(F.lit(1)).alias("n_drugs"), *loads, F.sum("herg_alerts").alias("herg_alerts"), F.sum("hepato_alerts").alias("hepato_alerts"),
        F.count_if("nti").alias("nti_drugs"), F.bool_and("guardrail_ok").alias("_ok"),
    )
    pairs = alerts.groupBy("regimen").agg(F.max("pair_risk").alias("max_pair_risk"), F.count_if("severe").alias("severe_pairs"))
    ranked = F.array_max(F.array(*[F.struct(F.round(F.col(e), 9).alias("load"), F.lit(-i).alias("o"), F.lit(e).alias("enzyme")) for i, e in enumerate(REGIMEN_ENZYMES)]))
    full = per.join(pairs, "regimen", "left").withColumns(
        {"max_pair_risk": F.coalesce("max_pair_risk", F.lit(0.0)), "severe_pairs": F.coalesce("severe_pairs", F.lit(0)), "_top": ranked})
    bottleneck = F.col("_top.load") >= 1.2 + 0.3 * (F.col("n_drugs") - 2)
    cardiac = F.col("herg_alerts") >= 2
    high = (F.col("severe_pairs") > 0) | bottleneck | cardiac
    verdict = (
        F.when(~F.col("_ok"), "ABSTAIN_CANNOT_EVALUATE").when(~high & (F.col("max_pair_risk") < 0.35), "NO_STRONG_STRUCTURAL_SIGNAL")
        .when(high, "HIGH_PRIORITY_RESEARCH_SIGNAL").otherwise("MODERATE_PRIORITY_RESEARCH_SIGNAL")
    )
    return full.select(
        "regimen", "n_drugs", F.col("_top.enzyme").alias("top_enzyme"), F.col("_top.load").alias("top_load"), "herg_alerts", "hepato_alerts",
        "nti_drugs", F.round("max_pair_risk", 3).alias("max_pair_risk"), "severe_pairs", verdict.alias("verdict"),
    )


def collision(pairs: DataFrame, a: str, b: str, free_a: str, free_b: str) -> DataFrame:
    """The liability collision columns of two profile maps on the same row."""
    return pairs.withColumns(cyp_overlap(F.col(a), F.col(b), F.col(free_a), F.col(free_b)))


"""Name and structure resolution: nothing is guessed, an ambiguous key never resolves."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from doseweave.functions.text import norm_name, split_multi
from doseweave.operators.clean import ContractError, canonical_pair, one_per
from doseweave.session import durable

# The ordinal severity scale.
SEVERITIES = ("unknown", "minor", "moderate", "major")


def severity_rank(c: Column) -> Column:
    return F.array_position(F.array(*map(F.lit, SEVERITIES)), c) - 1


def _owners(names: DataFrame, name: str, ident: str) -> DataFrame:
    """Per name the lowest and highest owner: equal means exactly one, without collecting the owners."""
    return names.groupBy(name).agg(F.min(ident).alias(ident), F.max(ident).alias("_other"))


def unambiguous_name_map(names: DataFrame, name: str = "name", ident: str = "drug_idx") -> DataFrame:
    """Normalised name -> id for the names with exactly one owner."""
    clean = names.select(norm_name(F.col(name)).alias("name"), ident).filter(
        F.col("name").isNotNull() & ~F.col("name").isin("", "nan")
    )
    return _owners(clean, "name", ident).filter(F.col(ident) == F.col("_other")).drop("_other")


def ambiguous_name_count(names: DataFrame, name: str = "name", ident: str = "drug_idx") -> DataFrame:
    clean = names.select(norm_name(F.col(name)).alias("name"), ident).filter(
        F.col("name").isNotNull() & ~F.col("name").isin("", "nan")
    )
    return _owners(clean, "name", ident).agg(F.count_if(F.col(ident) != F.col("_other")).alias("ambiguous_names"))


def resolve_names_with_status(evidence: DataFrame, catalogue: DataFrame) -> DataFrame:
    """Exact-name resolution of evidence(norm_name, ...) by catalogue(norm_name, structure, chem_id).

    The structure is kept only when the name leads to one; the id only when there is also one id.
    """
    known = catalogue.groupBy("norm_name").agg(
        F.min("structure").alias("_s0"), F.max("structure").alias("_s1"),
        F.min("chem_id").alias("_i0"), F.max("chem_id").alias("_i1"),
    )
    single = F.col("_s0") == F.col("_s1")
    return (
        evidence.join(known, "norm_name", "left")
        .withColumn(
            "mapping_status",
            F.when(F.col("_s0").isNull(), "unmatched").when(single, "matched").otherwise("ambiguous"),
        )
        .withColumn("structure", F.when(single, F.col("_s0")))
        .withColumn("chem_id", F.when(single & (F.col("_i0") == F.col("_i1")), F.col("_i0")))
        .drop("_s0", "_s1", "_i0", "_i1")
    )


def structure_membership_status(evidence: DataFrame, universe: DataFrame) -> DataFrame:
    """Not resolved, not in the universe, or matched."""
    members = universe.select("structure").distinct().withColumn("_in", F.lit(True))
    return (
        evidence.join(members, "structure", "left")
        .withColumn(
            "membership_status",
            F.when(F.col("structure").isNull(), "structure_not_resolved")
            .when(F.col("_in").isNull(), "structure_not_in_universe").otherwise("matched"),
        )
        .drop("_in")
    )


def match_structures(drugs: DataFrame, structures: DataFrame, key: str = "ik") -> DataFrame:
    """All structures sharing a drug's skeleton key; null keys never match."""
    return drugs.filter(F.col(key).isNotNull()).join(structures.filter(F.col(key).isNotNull()), key)


def tiered_match(
    left: DataFrame, right: DataFrame, tiers: Sequence[tuple[str, str, str]], ident: str, out: str = "match_id"
) -> DataFrame:
    """The first tier (name, left key, right key) with a match wins, with its name in ``match_tier``.

    Each tier joins one row per key (the lowest id), so no tier multiplies rows.
    """
    found, hits = left, []
    for i, (_, left_key, right_key) in enumerate(tiers):
        one = right.filter(F.col(right_key).isNotNull()).groupBy(F.col(right_key).alias(f"_k{i}")).agg(
            F.min(ident).alias(f"_id{i}")
        )
        found = found.join(one, found[left_key] == F.col(f"_k{i}"), "left").drop(f"_k{i}")
        hits.append(f"_id{i}")
    tier = F.coalesce(*[F.when(F.col(h).isNotNull(), F.lit(t[0])) for h, t in zip(hits, tiers, strict=True)])
    return (
        found.withColumn(out, F.coalesce(*hits)).withColumn("match_tier", F.coalesce(tier, F.lit("unmatched"))).drop(*hits)
    )


def padded_id_key(c: Column) -> Column:
    """``CID000123`` and ``CID123`` are the same id; other forms stay as they are."""
    digits = F.regexp_extract(F.upper(c), r"^CID0*(\d+)$", 1)
    return F.when(digits != "", F.concat(F.lit("cid"), digits)).otherwise(F.lower(c))


def alias_table(nodes: DataFrame, ident: str, columns: Sequence[str], json_columns: Sequence[str] = ()) -> DataFrame:
    """alias -> node id over scalar columns and JSON arrays or objects, ambiguous aliases discarded."""
    plain = [F.array(F.col(c).cast("string")) for c in (ident, *columns)]
    nested = [
        F.coalesce(
            F.from_json(F.col(c), "array<string>"), F.map_values(F.from_json(F.col(c), "map<string,string>")),
            F.array().cast("array<string>"),
        )
        for c in json_columns
    ]
    aliases = nodes.select(F.col(ident).alias("node_id"), F.explode(F.concat(*plain, *nested)).alias("alias"))
    keyed = aliases.select("node_id", padded_id_key(F.trim("alias")).alias("alias")).filter(
        F.col("alias").isNotNull() & ~F.col("alias").isin("", "nan", "none", "null")
    )
    return _owners(keyed, "alias", "node_id").filter(F.col("node_id") == F.col("_other")).drop("_other")


def alias_endpoint_map(edges: DataFrame, aliases: DataFrame, a: str, b: str) -> DataFrame:
    """Both endpoints mapped to node ids (null where unknown) with ``map_status``: mapped, unmapped or self."""
    for side, out in ((a, "node_a"), (b, "node_b")):
        one = aliases.select(F.col("alias").alias("_key"), F.col("node_id").alias(out))
        edges = edges.withColumn("_key", padded_id_key(F.trim(side))).join(one, "_key", "left").drop("_key")
    unknown = F.col("node_a").isNull() | F.col("node_b").isNull()
    return edges.withColumn(
        "map_status",
        F.when(unknown, "unmapped").when(F.col("node_a") == F.col("node_b"), "self").otherwise("mapped"),
    )


def mapped_pairs(mapped: DataFrame) -> DataFrame:
    """Distinct unordered node pairs of the mapped rows."""
    rows = mapped.filter(F.col("map_status") == "mapped").select("node_a", "node_b")
    return canonical_pair(rows, "node_a", "node_b").distinct()


def alias_map_audit(mapped: DataFrame) -> DataFrame:
    return mapped.groupBy("map_status").agg(F.count(F.lit(1)).alias("edge_rows"))


def curated_bridge(interactions: DataFrame, names: DataFrame, pairs: DataFrame) -> DataFrame:
    """Curated rows(name_a, name_b, level) to pairs of ids: worst severity, record count, whether already a base pair."""
    lookup = unambiguous_name_map(names)
    rows = interactions.select(
        norm_name(F.col("name_a")).alias("na"), norm_name(F.col("name_b")).alias("nb"),
        F.lower(F.trim(F.coalesce("level", F.lit("unknown")))).alias("level"),
    )
    both = rows.join(lookup.select(F.col("name").alias("na"), F.col("drug_idx").alias("drug_a")), "na").join(
        lookup.select(F.col("name").alias("nb"), F.col("drug_idx").alias("drug_b")), "nb"
    ).filter(F.col("drug_a") != F.col("drug_b"))
    level = F.when(F.col("level").isin(*SEVERITIES), F.col("level")).otherwise("unknown")
    worst = canonical_pair(both.withColumn("level", level), "drug_a", "drug_b").groupBy("drug_a", "drug_b").agg(
        F.max(severity_rank(F.col("level"))).cast("int").alias("_rank"), F.count(F.lit(1)).alias("n_records")
    )
    base = canonical_pair(pairs.select("drug_a", "drug_b"), "drug_a", "drug_b").distinct().withColumn("_in", F.lit(True))
    return worst.join(base, ["drug_a", "drug_b"], "left").select(
        "drug_a", "drug_b",
        F.element_at(F.array(*map(F.lit, SEVERITIES)), F.col("_rank") + 1).alias("severity"),
        "n_records", F.col("_in").isNotNull().alias("in_base"),
    )


def curated_overlap(bridge: DataFrame) -> DataFrame:
    """Severity histogram of the mapped pairs, split by base membership."""
    return bridge.groupBy("severity").agg(
        F.count(F.lit(1)).alias("pairs"), F.count_if("in_base").alias("pairs_in_base"),
        F.sum("n_records").alias("records"),
    )


def pair_flags(pairs: DataFrame, curated: DataFrame, mentions: DataFrame) -> DataFrame:
    """Existence flags per pair on the symmetric key: any curated row, a moderate or major one, a label mention."""
    seen = canonical_pair(curated, "drug_a", "drug_b").groupBy("drug_a", "drug_b").agg(
        F.max(F.col("severity").isin("moderate", "major")).alias("_serious")
    )
    named = canonical_pair(mentions.select("drug_a", "drug_b"), "drug_a", "drug_b").distinct().withColumn("_m", F.lit(True))
    keys = ["drug_a", "drug_b"]
    return canonical_pair(pairs, *keys).join(seen, keys, "left").join(named, keys, "left").withColumns(
        {
            "curated_any": F.col("_serious").isNotNull(),
            "curated_moderate_major": F.coalesce("_serious", F.lit(False)),
            "label_mention": F.col("_m").isNotNull(),
        }
    ).drop("_serious", "_m")


def edges_from_names(raw: DataFrame, lookup: DataFrame, a: str, b: str, keep: Sequence[str]) -> DataFrame:
    """Both name columns through lookup(name, structure); unresolved or blank ones stay null for the caller's audit."""
    one = lookup.filter(F.trim("structure") != "").groupBy(norm_name(F.col("name")).alias("_n")).agg(
        F.min("structure").alias("structure")
    )
    out = raw
    for side, target in ((a, "source"), (b, "target")):
        out = out.withColumn("_n", norm_name(F.col(side))).join(one.withColumnRenamed("structure", target), "_n", "left")
        out = out.drop("_n")
    return out.select(*keep, a, b, "source", "target")


def edge_name_counts(edges: DataFrame) -> DataFrame:
    written = F.col("source").isNotNull() & F.col("target").isNotNull()
    return edges.agg(
        F.count_if(written).alias("rows_written"), F.count_if(~written).alias("rows_skipped")
    )


def unresolved_names(edges: DataFrame, a: str, b: str) -> DataFrame:
    sides = F.array(
        F.when(F.col("source").isNull(), norm_name(F.col(a))), F.when(F.col("target").isNull(), norm_name(F.col(b)))
    )
    return edges.select(F.explode(sides).alias("name")).filter(F.col("name").isNotNull()).distinct()


def enrich_with_priority(nodes: DataFrame, lookup: DataFrame, value: str) -> DataFrame:
    """By structure key, else by name, else the existing value; ``value_source`` tells which.

    lookup(key, name, value): the lowest value per key keeps each join one-to-one.
    """
    by_key = lookup.filter(F.col("key").isNotNull()).groupBy("key").agg(F.min("value").alias("_k"))
    by_name = lookup.filter(F.col("name").isNotNull()).groupBy(norm_name(F.col("name")).alias("_n")).agg(
        F.min("value").alias("_v")
    )
    return (
        nodes.withColumn("_n", norm_name(F.col("name"))).join(by_key, "key", "left").join(by_name, "_n", "left")
        .withColumn(
            "value_source",
            F.when(F.col("_k").isNotNull(), "key").when(F.col("_v").isNotNull(), "name")
            .when(F.col(value).isNotNull(), "existing").otherwise("none"),
        )
        .withColumn(value, F.coalesce("_k", "_v", value)).drop("_k", "_v", "_n")
    )


def ids_to_structures(pairs: DataFrame, catalogue: DataFrame, a: str, b: str, strict: bool = True) -> DataFrame:
    """Index-coded pairs to structures; an index without a catalogue row is an error, or dropped when not strict."""
    how = "left" if strict else "inner"
    out = pairs
    for side, target in ((a, "source"), (b, "target")):
        one = catalogue.select(F.col("drug_idx").alias(side), F.col("structure").alias(target))
        out = out.join(one, side, how)
    if not strict:
        return out

    def present(c: str) -> Column:
        return F.when(F.col(c).isNull(), F.raise_error(F.lit("dangling drug index")).cast("string")).otherwise(F.col(c))

    return out.withColumns({"source": present("source"), "target": present("target")})


def external_overlap(external: DataFrame, development: DataFrame, a: str, b: str) -> DataFrame:
    """External rows whose unordered pair occurs in any development split."""
    known = canonical_pair(development.select(a, b), a, b, ("_a", "_b")).select("_a", "_b").distinct()
    keyed = canonical_pair(external, a, b, ("_a", "_b"))
    return keyed.join(known, ["_a", "_b"], "left_semi").drop("_a", "_b")


def structure_overlap(corpus: DataFrame, universe: DataFrame) -> DataFrame:
    """Distinct corpus structures, distinct universe structures, and how many are in both."""
    c = corpus.select("structure").filter(F.col("structure").isNotNull()).distinct().withColumn("_c", F.lit(1))
    u = universe.select("structure").filter(F.col("structure").isNotNull()).distinct().withColumn("_u", F.lit(1))
    return c.join(u, "structure", "full").agg(
        F.count("_c").alias("corpus"), F.count("_u").alias("universe"),
        F.count_if(F.col("_c").isNotNull() & F.col("_u").isNotNull()).alias("shared"),
    )


def align_members(members: DataFrame, provenance: Sequence[str], expected: Sequence[str], score: str) -> DataFrame:
    """Rows of member tables (column ``member``) to one row per provenance with each member's score.

    A missing, duplicate or unexpected member on any provenance row fails the query.
    """
    per = members.groupBy(*provenance).agg(
        F.count(F.lit(1)).alias("_n"),
        *[F.max(F.when(F.col("member") == m, F.col(score))).alias(f"score_{m}") for m in expected],
        *[F.count_if(F.col("member") == m).alias(f"_n_{m}") for m in expected],
    )
    whole = F.col("_n") == len(expected)
    for m in expected:
        whole = whole & (F.col(f"_n_{m}") == 1)
    first = F.col(f"score_{expected[0]}")
    checked = F.when(whole, first).otherwise(F.raise_error(F.lit("member rows do not align")).cast("double"))
    return per.withColumn(f"score_{expected[0]}", checked).drop("_n", *[f"_n_{m}" for m in expected])


def sequence_assignment(nodes: DataFrame, catalogue: DataFrame, ident: str, columns: Sequence[str]) -> DataFrame:
    """The first token, in column then token order, that is an exact accession, then an exact gene, of a catalogue row.

    catalogue(accession, gene, sequence) may list a gene twice: the lowest accession answers for it.
    """
    def listed(place: int, column: str) -> Column:
        return F.transform(
            split_multi(F.col(column)),
            lambda x, i: F.struct(
                F.lit(place).alias("col"), i.alias("tok"), F.upper(x).alias("token"), F.lit(column).alias("source_column")
            ),
        )

    tokens = F.flatten(F.array(*[listed(k, c) for k, c in enumerate(columns)]))
    wanted = nodes.select(ident, F.explode(tokens).alias("t")).select(ident, "t.*")
    by_accession = catalogue.select(F.upper("accession").alias("token"), "accession", F.lit(0).alias("rank"))
    by_gene = (
        catalogue.filter(F.col("gene").isNotNull()).groupBy(F.upper("gene").alias("token"))
        .agg(F.min("accession").alias("accession")).withColumn("rank", F.lit(1))
    )
    hits = wanted.join(by_accession.unionByName(by_gene), "token")
    best = one_per(hits, [ident], [F.asc("rank"), F.asc("col"), F.asc("tok")]).select(
        ident, "accession", "source_column", F.when(F.col("rank") == 0, "accession").otherwise("gene").alias("match_kind")
    )
    return nodes.select(ident).join(best, ident, "left").withColumn("match_kind", F.coalesce("match_kind", F.lit("unmapped")))


def name_priority_resolution(names: DataFrame, answers: DataFrame) -> DataFrame:
    """names(drug_idx, name, priority) x answers(name, code): the first candidate with an answer."""
    one = answers.groupBy(norm_name(F.col("name")).alias("_n")).agg(F.min("code").alias("code"))
    hits = names.withColumn("_n", norm_name(F.col("name"))).join(one, "_n")
    best = one_per(hits, ["drug_idx"], [F.asc("priority"), F.asc("_n")]).select("drug_idx", "code", "name")
    return names.select("drug_idx").distinct().join(best, "drug_idx", "left")


def union_targets(first: DataFrame, second: DataFrame, names: tuple[str, str]) -> DataFrame:
    """Two target sources to one row per (drug, target): first non-null class in source order, joined sources."""
    both = first.withColumn("source", F.lit(names[0])).unionByName(
        second.withColumn("source", F.lit(names[1])), allowMissingColumns=True
    )
    rank = F.when(F.col("source") == names[0], 0).otherwise(1)
    return both.groupBy("drug_idx", "target").agg(
        F.min_by("target_class", F.when(F.col("target_class").isNotNull(), F.struct(rank.alias("r"), "target_class"))).alias("target_class"),
        F.concat_ws("+", F.sort_array(F.collect_set("source"))).alias("source"),
    )


def enrich_by_name_or_synonym(nodes: DataFrame, evidence: DataFrame) -> DataFrame:
    """Union of genes over the display name and every synonym; the existing list is kept where nothing matches.

    Lists are united once per combination of names that some drug has, not once per drug.
    """
    keys = F.array_compact(F.array_distinct(
        F.transform(F.concat(F.array("name"), F.coalesce("synonyms", F.array().cast("array<string>"))), norm_name)
    ))
    owners = nodes.select("drug_idx", keys.alias("_k")).groupBy("drug_idx").agg(
        F.sort_array(F.array_distinct(F.flatten(F.collect_list("_k")))).alias("_names")
    )
    genes = evidence.select(norm_name(F.col("drug_name")).alias("_n"), "gene").distinct().filter("_n IS NOT NULL")
    lists = genes.groupBy("_n").agg(F.collect_list("gene").alias("_g"))
    united = (
        owners.select("_names").distinct().withColumn("_n", F.explode("_names")).join(lists, "_n")
        .groupBy("_names").agg(F.sort_array(F.array_distinct(F.flatten(F.collect_list("_g")))).alias("_genes"))
    )
    return nodes.join(owners, "drug_idx", "left").join(durable(united), "_names", "left").withColumn(
        "enriched", F.col("_genes").isNotNull()
    ).withColumn("genes", F.coalesce("_genes", "genes")).drop("_genes", "_names")


def best_match(candidates: DataFrame, key: str, wanted: str, primary: str, synonyms: str, order: str) -> DataFrame:
    """Per key: a primary-name match first, then a synonym, then the first record."""
    target = norm_name(F.col(wanted))
    rank = (
        F.when(norm_name(F.col(primary)) == target, 0)
        .when(F.exists(F.coalesce(synonyms, F.array().cast("array<string>")), lambda s: norm_name(s) == target), 1)
        .otherwise(2)
    )
    kind = F.when(F.col("_rank") == 0, "primary").when(F.col("_rank") == 1, "synonym").otherwise("first_record")
    best = one_per(candidates.withColumn("_rank", rank), [key], [F.asc("_rank"), F.asc(order)])
    return best.withColumn("match_kind", kind).drop("_rank")


def local_then_missing(wanted: DataFrame, local: DataFrame, key: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(rows found locally, keys still missing, one-row coverage)."""
    keys = wanted.select(key).distinct()
    found = local.join(keys, key, "left_semi")
    missing = keys.join(local.select(key), key, "left_anti")
    marked = keys.join(local.select(key).distinct().withColumn("_hit", F.lit(1)), key, "left")
    coverage = marked.agg(
        F.count(F.lit(1)).alias("wanted"), F.count("_hit").alias("found"),
        (F.count("_hit") / F.count(F.lit(1))).alias("coverage"),
    )
    return found, missing, coverage


def attribute_labels(records: DataFrame, lookup: DataFrame) -> DataFrame:
    """records(record_id, substances, generics) to the one drug a single-ingredient label belongs to.

    More than one substance, or a combination in the generic name when no substance is given, excludes the label.
    """
    subs = F.array_distinct(F.transform(F.coalesce("substances", F.array().cast("array<string>")), norm_name))
    gens = F.transform(F.coalesce("generics", F.array().cast("array<string>")), norm_name)
    combined = F.exists(gens, lambda g: g.contains(",") | g.contains(" and ") | g.contains("/"))
    single = records.filter((F.size(subs) <= 1) & ~((F.size(subs) == 0) & combined))
    names = single.select("record_id", F.explode(F.array_distinct(F.concat(subs, gens))).alias("name"))
    hits = names.join(lookup, "name").groupBy("record_id").agg(
        F.min("drug_idx").alias("drug_idx"), F.max("drug_idx").alias("_other")
    )
    return hits.filter(F.col("drug_idx") == F.col("_other")).drop("_other")


def candidate_check(pairs: DataFrame, base: DataFrame, scope: DataFrame) -> DataFrame:
    """Given candidate pairs restricted to in-scope ids and not in the base."""
    keys = ["drug_a", "drug_b"]
    ids = scope.select("id").distinct()
    inside = canonical_pair(pairs, *keys).distinct()
    for side in keys:
        inside = inside.join(ids.withColumnRenamed("id", side), side, "left_semi")
    known = canonical_pair(base.select(*keys), *keys).distinct()
    return inside.filter(F.col("drug_a") != F.col("drug_b")).join(known, keys, "left_anti")


def require_unique(df: DataFrame, key: str) -> None:
    """Fails when a key repeats; the check itself is one aggregate with a bounded result."""
    repeated = df.groupBy(key).agg(F.count(F.lit(1)).alias("n")).filter("n > 1").limit(1).count()
    if repeated:
        raise ContractError(f"{key} repeats")

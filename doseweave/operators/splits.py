"""Leakage-aware splits by hash order, and their audits."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from doseweave.operators.clean import ContractError
from doseweave.operators.events import dedupe_pairs
from doseweave.plans.hashing import by_fraction, lowest, priority
from doseweave.plans.ordering import hash_bucket, positions, running_sums, score_bucket
from doseweave.session import durable

TRAIN, VALIDATION, TEST = "train", "val", "test"


def hash_order(df: DataFrame, keys: Sequence[str], seed: int, name: str = "priority") -> DataFrame:
    return df.withColumn(name, priority(seed, *[F.col(k) for k in keys]))


def priority_sample(df: DataFrame, key: str, excluded: DataFrame, n: int, seed: int) -> DataFrame:
    """The n lowest priorities among the distinct valid keys that are not excluded."""
    valid = df.select(key).filter(F.col(key).isNotNull() & (F.trim(F.col(key).cast("string")) != "")).distinct()
    free = valid.join(excluded.select(key).distinct(), key, "left_anti")
    return lowest(hash_order(free, [key], seed), "priority", n)


def priority_sample_counts(df: DataFrame, key: str, excluded: DataFrame) -> DataFrame:
    keys = df.select(key).distinct()
    hit = keys.join(excluded.select(key).distinct(), key, "left_semi").agg(F.count(F.lit(1)))
    return df.agg(F.count(F.lit(1)).alias("rows"), F.count_if(F.col(key).isNull()).alias("invalid_rows")).withColumns(
        {"distinct_keys": keys.filter(F.col(key).isNotNull()).agg(F.count(F.lit(1))).scalar(), "excluded_keys": hit.scalar()}
    )


def random_pair_split(pairs: DataFrame, keys: Sequence[str], frac_val: float = 0.1, frac_test: float = 0.2, seed: int = 0) -> DataFrame:
    return by_fraction(pairs, keys, seed, {TEST: frac_test, VALIDATION: frac_val}, TRAIN, "partition")


def transductive_split(
    pairs: DataFrame, keys: Sequence[str], frac_val: float = 0.1, frac_test: float = 0.2, seed: int = 0
) -> DataFrame:
    """Random split in which the fewest held-out pairs move to training so that training sees every endpoint.

    Taken in order (validation, then test; hash order inside), a pair moves if one of its endpoints is unseen so far.
    These are exactly the first held-out pairs of the endpoints that base training lacks; ``moved`` marks them.
    """
    base = random_pair_split(pairs, keys, frac_val, frac_test, seed)
    ends = base.withColumn("_drug", F.explode(F.array("drug_a", "drug_b")))
    seen = ends.filter(F.col("partition") == TRAIN).select("_drug").distinct()
    order = F.struct(F.col("partition") == TEST, priority(seed, *[F.col(k) for k in keys]))
    unseen = ends.filter(F.col("partition") != TRAIN).join(seen, "_drug", "left_anti")
    first = unseen.groupBy("_drug").agg(F.min_by(F.struct(*keys), order).alias("_pair")).select("_pair.*").distinct()
    marked = base.join(first.withColumn("moved", F.lit(True)), list(keys), "left")
    return marked.withColumn("moved", F.coalesce("moved", F.lit(False))).withColumn(
        "partition", F.when(F.col("moved"), TRAIN).otherwise(F.col("partition"))
    )


def cold_drug_roles(drugs: DataFrame, frac_val: float = 0.1, frac_test: float = 0.2, seed: int = 0) -> DataFrame:
    return by_fraction(drugs.select("drug"), ["drug"], seed, {TEST: frac_test, VALIDATION: frac_val}, TRAIN, "role")


def _fill_rules(groups: DataFrame, quota: int) -> list[tuple[str, str, int]]:
    """First-fit of whole groups in priority order as rules (after, up to, largest size).

    Among the groups small enough for the room left, the longest prefix that fits is taken at once; the room left
    is then below the size of the next group. Each step is one distributed running sum that returns one row.
    """
    rules, after, room = [], "", quota
    while room > 0:
        fits = groups.filter((F.col("size") <= room) & (F.col("priority") > after))
        run = running_sums(fits, "priority", ["size"], bucket=hash_bucket(F.col("priority")))
        taken = run.filter(F.col("run_size") <= room).agg(F.max("priority").alias("p"), F.max("run_size").alias("s")).head()
        if taken is None or taken["p"] is None:
            break
        rules.append((after, taken["p"], room))
        after, room = taken["p"], room - int(taken["s"])
    return rules


def _matches(rules: Sequence[tuple[str, str, int]]) -> Column:
    tests = [
        (F.col("priority") > lo) & (F.col("priority") <= hi) & (F.col("size") <= size) for lo, hi, size in rules
    ]
    return reduce(lambda x, y: x | y, tests, F.lit(False))


def quota_fill(groups: DataFrame, n_val: int, n_test: int, seed: int) -> DataFrame:
    """groups(group, size) in seeded order: to test if it fits the room left, else to validation, else to training.

    Exactly the sequential rule, without a sequential pass: the groups that test takes do not depend on
    validation, and validation sees the remaining groups in the same order.
    """
    ordered = durable(hash_order(groups.select("group", "size"), ["group"], seed))
    in_test = _matches(_fill_rules(ordered, n_test))
    in_val = _matches(_fill_rules(ordered.filter(~in_test), n_val))
    return ordered.withColumn("role", F.when(in_test, TEST).when(in_val, VALIDATION).otherwise(TRAIN)).drop("priority")


def group_roles(drugs: DataFrame, frac_val: float = 0.1, frac_test: float = 0.2, seed: int = 0) -> DataFrame:
    """drugs(drug, group): whole groups to test and validation by drug quota."""
    n = drugs.count()
    sizes = drugs.groupBy("group").agg(F.count(F.lit(1)).alias("size"))
    roles = quota_fill(sizes, round(n * frac_val), round(n * frac_test), seed)
    return drugs.join(roles.select("group", "role"), "group")


def group_roles_by_count(drugs: DataFrame, frac_val: float = 0.1, frac_test: float = 0.2, seed: int = 0) -> DataFrame:
    """A fraction of the groups, at least one each, whatever their sizes."""
    groups = drugs.select("group").distinct()
    n = groups.count()
    if n < 3:
        raise ContractError("at least three groups are required")
    n_test, n_val = max(1, round(n * frac_test)), max(1, round(n * frac_val))
    roles = by_fraction(groups, ["group"], seed, {TEST: n_test / n, VALIDATION: n_val / n}, TRAIN, "role")
    return drugs.join(roles, "group")


def with_roles(pairs: DataFrame, roles: DataFrame, value: str = "role") -> DataFrame:
    """Adds role_a and role_b by two equi-joins on the drug."""
    out = pairs
    for side, name in (("drug_a", f"{value}_a"), ("drug_b", f"{value}_b")):
        out = out.join(roles.select(F.col("drug").alias(side), F.col(value).alias(name)), side)
    return out


def pairs_from_roles(pairs: DataFrame, roles: DataFrame) -> DataFrame:
    """train, val_s1/s2 (both/one endpoint held for validation), test_s1/s2, or dropped."""
    a, b = F.col("role_a"), F.col("role_b")

    def both(r: str) -> Column:
        return (a == r) & (b == r)

    def one(r: str) -> Column:
        return ((a == r) & (b == TRAIN)) | ((a == TRAIN) & (b == r))

    part = (
        F.when(both(TRAIN), "train").when(one(VALIDATION), "val_s2").when(both(VALIDATION), "val_s1")
        .when(one(TEST), "test_s2").when(both(TEST), "test_s1").otherwise("dropped")
    )
    return with_roles(pairs, roles).withColumn("partition", part).drop("role_a", "role_b")


def group_disjoint_splits(pairs: DataFrame, roles: DataFrame, required: Sequence[str] = ()) -> DataFrame:
    """A pair keeps its role only when both endpoints share it; other pairs become ``cross_role``.

    Fails when a ``required`` partition has no pair.
    """
    same = F.col("role_a") == F.col("role_b")
    split = with_roles(pairs, roles).withColumn("partition", F.when(same, F.col("role_a")).otherwise("cross_role")).drop(
        "role_a", "role_b"
    )
    return require_partitions(split, required) if required else split


def require_partitions(split: DataFrame, names: Sequence[str]) -> DataFrame:
    """Fails when a named partition is empty; one small aggregate."""
    row = split.agg(*[F.count_if(F.col("partition") == n).alias(n) for n in names]).head()
    empty = [n for n in names if not row[n]]
    if empty:
        raise ContractError(f"empty partitions: {empty}")
    return split


FAMILIES = {"transductive": ("seen", "seen"), "s1_dev": ("s1_dev", "s1_dev"), "s1_test": ("s1_test", "s1_test"),
            "s2_dev": ("s1_dev", "seen"), "s2_test": ("s1_test", "seen")}


def family(role_a: Column, role_b: Column) -> Column:
    """The evaluation family of a pair of roles, null when the pair is in none."""
    out = F.lit(None).cast("string")
    for name, (x, y) in FAMILIES.items():
        out = F.when(((role_a == x) & (role_b == y)) | ((role_a == y) & (role_b == x)), name).otherwise(out)
    return out


def cold_start_groups(pairs: DataFrame, holdout: float = 0.15, seed: int = 42, attempts: int = 256) -> DataFrame:
    """drugs(drug, role): seen, s1_dev, s1_test, redrawn until each used family has an unreported pair.

    A draw is a hash order with the attempt in its seed; whether a family is full is a count, not an enumeration.
    """
    pairs = durable(pairs.select("drug_a", "drug_b").distinct())
    drugs = durable(pairs.select(F.explode(F.array("drug_a", "drug_b")).alias("drug")).distinct())
    n = drugs.count()
    if n < 6:
        raise ContractError("at least six distinct drugs are required")
    held = min(max(4, round(holdout * n)), n - 2)
    sizes = {"s1_dev": held // 2, "s1_test": held - held // 2, "seen": n - held}
    possible = {
        f: sizes[x] * (sizes[x] - 1) // 2 if x == y else sizes[x] * sizes[y] for f, (x, y) in FAMILIES.items()
    }
    for attempt in range(attempts):
        roles = by_fraction(
            drugs, ["drug"], f"{seed}:{attempt}", {"s1_dev": sizes["s1_dev"] / n, "s1_test": sizes["s1_test"] / n},
            "seen", "role",
        )
        tagged = with_roles(pairs, roles)
        used = {r["f"]: r["n"] for r in tagged.groupBy(family(F.col("role_a"), F.col("role_b")).alias("f")).agg(
            F.count(F.lit(1)).alias("n")).collect()}
        if all(used.get(f, 0) == 0 or used[f] < possible[f] for f in FAMILIES):
            return durable(roles)
    raise ContractError(f"in {attempts} draws some family of pairs never had an unreported pair left")


def cold_start_splits(
    pairs: DataFrame, roles: DataFrame, label: str = "label", validation: float = 0.10, seed: int = 42
) -> DataFrame:
    """Seven splits in a ``split`` column; seen pairs go 80/20, then the validation share, within each label."""
    unique = dedupe_pairs(pairs, "drug_a", "drug_b", label)
    tagged = durable(with_roles(unique, roles).withColumn("_f", family(F.col("role_a"), F.col("role_b"))))
    strata = [label]
    shares = {"transductive_test": 0.2, "validation": 0.8 * validation}
    seen = by_fraction(
        tagged.filter("_f = 'transductive'"), ["drug_a", "drug_b"], seed, shares, "transductive_train", "split", by=strata
    )
    rest = tagged.filter("_f <> 'transductive'").withColumn("split", F.col("_f"))
    return seen.unionByName(rest.select(*seen.columns)).drop("_f", "role_a", "role_b")


def partition_validation(rows: DataFrame, keys: Sequence[str], fraction: float, seed: int, label: str = "label") -> DataFrame:
    """Within each class: a share for post-hoc fitting, the rest for selection."""
    return by_fraction(rows, keys, seed, {"posthoc": fraction}, "selection", "validation_role", by=[label])


def posthoc_roles(rows: DataFrame, keys: Sequence[str], seed: int, label: str = "label") -> DataFrame:
    """Three disjoint roles per class in hash order, the remainder to the first ones (as NTILE(3)).

    A class with fewer than three rows cannot fill the roles; those rows serve in all of them (``reused``).
    """
    names = ("calibration", "threshold", "conformal")
    hashed = hash_order(rows, keys, seed, "_prio")
    ranked = positions(hashed, ["_prio"], hash_bucket(F.col("_prio")), by=[label], name="_pos")
    sizes = rows.groupBy(label).agg(F.count(F.lit(1)).alias("_n"))
    joined = ranked.join(sizes, label)
    first = F.ceil(F.col("_n") / 3)
    second = first + F.ceil((F.col("_n") - first) / 2)
    single = F.when(F.col("_pos") <= first, names[0]).when(F.col("_pos") <= second, names[1]).otherwise(names[2])
    many = F.array(*map(F.lit, names))
    return joined.withColumn("reused", F.col("_n") < 3).withColumn(
        "posthoc_role", F.explode(F.when(F.col("reused"), many).otherwise(F.array(single)))
    ).drop("_prio", "_pos", "_n")


def split_calibration(rows: DataFrame, keys: Sequence[str], fraction: float = 0.5, seed: int = 0, by: Sequence[str] = ()) -> DataFrame:
    return by_fraction(rows, keys, seed, {"platt_fit": fraction}, "conformal_cal", "half", by=by)


def group_folds(rows: DataFrame, group: str, k: int = 5, seed: int = 0) -> DataFrame:
    """Folds that share no group: groups dealt from large to small, forward and back.

    The rank of a group is the number of larger ones (a running count over the distinct sizes) plus its hash
    position among the equally large.
    """
    sizes = rows.groupBy(group).agg(F.count(F.lit(1)).alias("size"))
    classes = sizes.groupBy("size").agg(F.count(F.lit(1)).alias("n"))
    larger = running_sums(classes, "size", ["n"], descending=True, bucket=score_bucket(F.col("size").cast("double")))
    hashed = hash_order(sizes, [group], seed, "_prio")
    placed = positions(hashed, ["_prio"], hash_bucket(F.col("_prio")), by=["size"], name="_pos")
    ranked = placed.join(larger.select("size", (F.col("run_n") - F.col("n")).alias("_larger")), "size")
    rank = F.col("_larger") + F.col("_pos") - 1
    turn = rank % (2 * k)
    fold = F.when(turn < k, turn).otherwise(2 * k - 1 - turn)
    return rows.join(ranked.select(group, fold.cast("int").alias("fold")), group)


def permuted_control(features: DataFrame, drugs: DataFrame, seed: int) -> DataFrame:
    """features(drug, ...) moved from each drug to another by a seeded permutation of the drugs."""
    from doseweave.plans.ordering import with_key_bucket

    keyed = positions(with_key_bucket(drugs.select("drug"), "drug", "_cut"), ["drug"], F.col("_cut"), name="_pos").drop("_cut")
    mixed = positions(
        hash_order(drugs.select("drug"), ["drug"], seed, "_prio"), ["_prio"], hash_bucket(F.col("_prio")), name="_pos"
    )
    moves = keyed.join(mixed.select("_pos", F.col("drug").alias("_to")), "_pos").select("drug", "_to")
    return features.join(moves, "drug").drop("drug").withColumnRenamed("_to", "drug")


# Audits: one row per check.
def checks(row: DataFrame) -> DataFrame:
    """A one-row table of booleans as (check, passed)."""
    return row.unpivot([], row.columns, "check", "passed")


def assert_clean(audit: DataFrame) -> DataFrame:
    failed = [r["check"] for r in audit.filter(~F.col("passed")).collect()]
    if failed:
        raise ContractError(f"failed checks: {sorted(failed)}")
    return audit


def audit_pair_split(split: DataFrame, pairs: DataFrame, roles: DataFrame | None = None) -> DataFrame:
    """split(drug_a, drug_b, partition): each pair once, endpoint counts by regime, training drugs kept apart."""
    keys = ["drug_a", "drug_b"]
    counted = pairs.select(*keys).distinct().join(
        split.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")), keys, "full"
    )
    once = counted.agg(
        F.coalesce(F.bool_and(F.coalesce(F.col("n"), F.lit(0)) == 1), F.lit(True)).alias("every_pair_once"),
    )
    parts = [checks(once)]
    if roles is not None:
        tagged = with_roles(split, roles)
        unseen = (F.col("role_a") != TRAIN).cast("int") + (F.col("role_b") != TRAIN).cast("int")
        s1, s2, train = F.col("partition").endswith("s1"), F.col("partition").endswith("s2"), F.col("partition") == TRAIN

        def every(test: Column) -> Column:
            return F.coalesce(F.bool_and(test), F.lit(True))

        parts.append(
            checks(
                tagged.agg(
                    every(F.when(s1, unseen == 2)).alias("s1_has_two_unseen"),
                    every(F.when(s2, unseen == 1)).alias("s2_has_one_unseen"),
                    every(F.when(train, unseen == 0)).alias("train_drugs_disjoint"),
                    (F.count_if(train) > 0).alias("train_nonempty"),
                )
            )
        )
        if "group" in roles.columns:
            held = roles.groupBy("group").agg((F.min("role") == F.max("role")).alias("one_role"))
            parts.append(checks(held.agg(F.bool_and("one_role").alias("groups_disjoint"))))
    return reduce(DataFrame.unionByName, parts)


def audit_event_table(pairs: DataFrame, labels: DataFrame, drugs: DataFrame, events: DataFrame) -> DataFrame:
    """Counts and density with the order, range and uniqueness checks of an event table."""
    n = {name: df.agg(F.count(F.lit(1))).scalar() for name, df in (("d", drugs), ("e", events), ("l", labels))}
    per_label = labels.groupBy("pair_id", "event_idx").agg(F.count(F.lit(1)).alias("n"))
    unique = per_label.agg(F.coalesce(F.max("n") == 1, F.lit(True))).scalar()
    row = pairs.agg(
        F.count(F.lit(1)).alias("n_pairs"), F.bool_and(F.col("drug_a") < F.col("drug_b")).alias("ordered_no_loops"),
        F.min("drug_a").alias("_lo"), F.max("drug_b").alias("_hi"),
        (F.max("pair_id") == F.count(F.lit(1)) - 1).alias("dense_pair_ids"),
    )
    return row.withColumns({"n_drugs": n["d"], "n_events": n["e"], "n_labels": n["l"], "labels_unique": unique}).select(
        "n_pairs", "n_drugs", "n_events", "n_labels", "ordered_no_loops", "dense_pair_ids", "labels_unique",
        ((F.col("_lo") >= 0) & (F.col("_hi") < F.col("n_drugs"))).alias("drug_ids_in_range"),
        (F.col("n_labels") / (F.col("n_pairs") * F.col("n_events"))).alias("density"),
    )


def split_counts(splits: DataFrame, min_per_class: int, label: str = "label") -> DataFrame:
    """Rows, positives and negatives per split, and whether both classes reach the minimum."""
    return splits.groupBy("split").agg(
        F.count(F.lit(1)).alias("n_rows"), F.count_if(F.col(label) == 1).alias("positives"),
        F.count_if(F.col(label) == 0).alias("negatives"),
    ).withColumn("enough", F.least("positives", "negatives") >= min_per_class)


def verify_frozen_splits(splits: DataFrame, manifest: DataFrame, label: str = "label") -> DataFrame:
    """Per split: null or non-binary labels, repeated pairs, balance and agreement with manifest(split, expected_rows);
    plus ``cross_split_repeats`` for pairs in more than one split."""
    from doseweave.operators.clean import canonical_pair

    pairs = canonical_pair(splits, "drug_a", "drug_b")
    per_pair = pairs.groupBy("split", "drug_a", "drug_b").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col(label).isNull()).alias("nulls"),
        F.count_if(F.col(label).isNotNull() & ~F.col(label).isin(0, 1)).alias("odd"),
        F.count_if(F.col(label) == 1).alias("pos"), F.count_if(F.col(label) == 0).alias("neg"),
    )
    per_split = per_pair.groupBy("split").agg(
        F.sum("n").alias("n_rows"), F.sum("nulls").alias("null_labels"), F.sum("odd").alias("nonbinary_labels"),
        F.count_if(F.col("n") > 1).alias("repeated_pairs"), (F.sum("pos") == F.sum("neg")).alias("balanced"),
    )
    crossing = per_pair.groupBy("drug_a", "drug_b").agg(F.count(F.lit(1)).alias("k")).filter("k > 1").agg(F.count(F.lit(1)))
    return manifest.join(per_split, "split", "left").withColumns(
        {
            "rows_match": F.coalesce(F.col("n_rows"), F.lit(0)) == F.col("expected_rows"),
            "cross_split_repeats": crossing.scalar(),
        }
    )


def zero_fill_audit(features: DataFrame, known: DataFrame, drugs: DataFrame) -> DataFrame:
    """features(drug, block, item) against known(drug, block): cells of drugs that are not known, and coverage."""
    leaks = features.join(known.select("drug", "block").distinct(), ["drug", "block"], "left_anti").groupBy("block").agg(
        F.count(F.lit(1)).alias("leaked_cells")
    )
    n = drugs.agg(F.count_distinct("drug")).scalar()
    cover = known.select("drug", "block").distinct().groupBy("block").agg(F.count(F.lit(1)).alias("known_drugs"))
    return cover.join(leaks, "block", "left").withColumn("_n", n).select(
        "block", "known_drugs", F.coalesce("leaked_cells", F.lit(0)).alias("leaked_cells"),
        F.round(100.0 * F.col("known_drugs") / F.col("_n"), 4).alias("coverage_pct"),
    )


def comparability(runs: DataFrame, evidence: Sequence[str], seed: str = "seed", run: str = "experiment") -> DataFrame:
    """Per seed: whether each evidence column has one value and no run repeats."""
    per_run = runs.groupBy(seed, run).agg(
        F.count(F.lit(1)).alias("n"), *[F.min(e).alias(f"lo_{e}") for e in evidence], *[F.max(e).alias(f"hi_{e}") for e in evidence]
    )
    return per_run.groupBy(seed).agg(
        (F.max("n") == 1).alias("no_duplicates"),
        *[(F.min(f"lo_{e}") == F.max(f"hi_{e}")).alias(f"same_{e}") for e in evidence],
    )


def member_compatibility(members: DataFrame, evidence: Sequence[str]) -> DataFrame:
    """members(seed, evidence...): 3 to 5 members, distinct seeds, equal evidence."""
    same = [F.coalesce(F.min(e) == F.max(e), F.lit(False)).alias(f"same_{e}") for e in evidence]
    row = members.agg(
        F.count(F.lit(1)).between(3, 5).alias("three_to_five_members"),
        (F.count_distinct("seed") == F.count(F.lit(1))).alias("distinct_seeds"), *same,
    )
    return checks(row)

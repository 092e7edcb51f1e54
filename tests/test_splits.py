import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from doseweave.operators import negatives, splits
from doseweave.operators.clean import ContractError


def random_pairs(spark, n=60, m=400, seed=0):
    rng = np.random.default_rng(seed)
    rows = {tuple(sorted(map(int, rng.choice(n, 2, replace=False)))) for _ in range(m)}
    return spark.createDataFrame(sorted(rows), "drug_a long, drug_b long").withColumn("label", F.lit(1))


@pytest.mark.parametrize("seed", [0, 3, 11])
def test_quota_fill_equals_the_sequential_rule(spark, seed):
    rng = np.random.default_rng(seed)
    sizes = {f"g{i}": int(rng.integers(1, 12)) for i in range(80)} | {"hot": 150}
    total = sum(sizes.values())
    n_test, n_val = round(total * 0.2), round(total * 0.1)
    want, got_test, got_val = {}, 0, 0
    for g in sorted(sizes, key=lambda k: hashlib.sha256(f"{seed}\0{k}".encode()).hexdigest()):
        if got_test + sizes[g] <= n_test:
            want[g], got_test = "test", got_test + sizes[g]
        elif got_val + sizes[g] <= n_val:
            want[g], got_val = "val", got_val + sizes[g]
        else:
            want[g] = "train"
    groups = spark.createDataFrame(list(sizes.items()), "group string, size int")
    assert {r["group"]: r["role"] for r in splits.quota_fill(groups, n_val, n_test, seed).collect()} == want


def test_cold_split_is_clean_and_audit_sees_a_leak(spark):
    pairs = random_pairs(spark)
    drugs = pairs.select(F.explode(F.array("drug_a", "drug_b")).alias("drug")).distinct()
    roles = splits.cold_drug_roles(drugs, seed=1)
    split = splits.pairs_from_roles(pairs.select("drug_a", "drug_b"), roles)
    splits.assert_clean(splits.audit_pair_split(split, pairs, roles))
    leaked = split.withColumn("partition", F.when(F.col("partition") == "test_s2", "train").otherwise(F.col("partition")))
    with pytest.raises(ContractError):
        splits.assert_clean(splits.audit_pair_split(leaked, pairs, roles))


def test_transductive_endpoints_are_seen(spark):
    pairs = random_pairs(spark, 150, 300)
    out = splits.transductive_split(pairs.select("drug_a", "drug_b"), ["drug_a", "drug_b"], seed=2).toPandas()
    train = out[out.partition == "train"]
    seen = set(train.drug_a) | set(train.drug_b)
    held = out[out.partition != "train"]
    assert out.moved.any() and len(held) and set(held.drug_a) | set(held.drug_b) <= seen
    base = splits.random_pair_split(pairs.select("drug_a", "drug_b"), ["drug_a", "drug_b"], seed=2)
    rows = splits.hash_order(base, ["drug_a", "drug_b"], 2).toPandas()
    known = set(rows[rows.partition == "train"][["drug_a", "drug_b"]].to_numpy().ravel())
    one_by_one = set()
    for part in ("val", "test"):
        for row in rows[rows.partition == part].sort_values("priority").itertuples():
            if not {row.drug_a, row.drug_b} <= known:
                one_by_one.add((row.drug_a, row.drug_b))
                known |= {row.drug_a, row.drug_b}
    moved = out[out.moved]
    assert len(out) == len(rows) and set(zip(moved.drug_a, moved.drug_b)) == one_by_one


def test_posthoc_roles_reuse_rare_class(spark):
    rows = spark.createDataFrame([(i, int(i < 2)) for i in range(12)], "id long, label int")
    got = splits.posthoc_roles(rows, ["id"], 0).toPandas()
    rare = got[got.label == 1]
    assert len(rare) == 6 and rare.reused.all() and got[got.label == 0].groupby("posthoc_role").size().to_dict() == {"calibration": 4, "threshold": 3, "conformal": 3}


def test_group_folds_share_no_group_and_balance(spark):
    rows = spark.createDataFrame([(i, f"g{i % 37 if i % 3 else 0}") for i in range(600)], "id long, grp string")
    got = splits.group_folds(rows, "grp", 5).toPandas()
    assert got.groupby("grp").fold.nunique().max() == 1 and got.fold.nunique() == 5


@pytest.mark.parametrize("strategy", ["uniform", "degree_matched"])
def test_unreported_pairs_are_unique_and_unreported(spark, strategy):
    pairs = random_pairs(spark)
    sample = negatives.sample_unreported(pairs, 1.0, strategy, 7)
    got = [tuple(r) for r in sample.collect()]
    reported = {(r["drug_a"], r["drug_b"]) for r in pairs.collect()}
    assert len(got) == len(set(got)) == len(reported) and not set(got) & reported and all(a < b for a, b in got)
    again = negatives.sample_unreported(pairs.repartition(6), 1.0, strategy, 7)
    assert {tuple(r) for r in again.collect()} == set(got)


def test_shortage_is_an_error(spark):
    full = spark.createDataFrame([(a, b) for a in range(5) for b in range(a)], "drug_a long, drug_b long")
    with pytest.raises(ContractError):
        negatives.sample_unreported(full)


def test_degree_matched_pairs_are_all_drawn(spark, monkeypatch):
    """60 drugs that are all paired and 40 with one pair each: what is left among the 40 is rare in draws."""
    hub = [(a, b) for a in range(60) for b in range(a)] + [(a, 60 + a) for a in range(40)]
    pairs = spark.createDataFrame(hub, "drug_a long, drug_b long")
    got = [tuple(r) for r in negatives.sample_unreported(pairs, 1.0, "degree_matched", 7).collect()]
    assert len(set(got)) == len(got) == len(hub) and sum(a >= 60 for a, _ in got) < 60
    everything = negatives.sample_unreported(pairs, 3140 / len(hub), "degree_matched", 7)
    assert everything.distinct().count() == 3140
    monkeypatch.setattr(negatives, "DRAWS_PER_PAIR", 8)
    with pytest.raises(ContractError):
        negatives.sample_unreported(pairs, 1.0, "degree_matched", 7)


@pytest.mark.parametrize("strategy", ["uniform", "degree_matched"])
def test_split_negatives_keep_roles_apart(spark, strategy):
    pairs = random_pairs(spark, 60, 500)
    data = negatives.split_aware_dataset(pairs, strategy=strategy, seed=5)
    roles = splits.cold_start_groups(pairs, 0.15, 5)
    rows = splits.with_roles(data.rows, roles).withColumn("f", splits.family(F.col("role_a"), F.col("role_b"))).toPandas()
    assert not rows.duplicated(["drug_a", "drug_b"]).any()
    seen = rows.split.isin(["transductive_train", "validation", "transductive_test"])
    assert (rows.f[seen] == "transductive").all() and (rows.f[~seen] == rows.split[~seen]).all()
    audit = data.audit.toPandas().set_index("split")
    zeros = rows[rows.label == 0].groupby("split").size()
    assert (zeros == audit.sampled.loc[zeros.index]).all()


def test_pair_index_round_trip(spark):
    low, high = negatives.pair_from_index(F.col("id"))
    big = spark.range(10_000).select((F.col("id") * 7_777_777 + 3).alias("id")).unionByName(spark.range(5000))
    bad = big.select("id", low.alias("lo"), high.alias("hi")).filter("lo < 0 OR lo >= hi OR cast(hi * (hi - 1) / 2 as long) + lo <> id")
    assert bad.count() == 0


def test_a_required_partition_must_have_pairs(spark):
    pairs = spark.createDataFrame([(1, 2), (1, 3)], "drug_a long, drug_b long")
    roles = spark.createDataFrame([(1, "train"), (2, "train"), (3, "test")], "drug long, role string")
    assert splits.group_disjoint_splits(pairs, roles, ["train"]).count() == 2
    with pytest.raises(ContractError, match="test"):
        splits.group_disjoint_splits(pairs, roles, ["train", "test"])


@pytest.mark.parametrize("sides", [(7, None), (2, None), (5, 9), (1, 4), (1, None)])
def test_permutation_gives_each_pair_once_and_is_consistent(spark, sides):
    first = negatives.uniform_urn(spark.range(sides[0]).select(F.col("id").alias("drug")), 3)
    second = None if sides[1] is None else negatives.uniform_urn(spark.range(100, 100 + sides[1]).select(F.col("id").alias("drug")), 3)
    cells = sides[0] * (sides[1] or sides[0])
    whole = negatives.permuted_pairs(spark, first, second, 4 * cells, "s").collect()
    wanted = {(a, b) for a in range(sides[0]) for b in (range(100, 100 + sides[1]) if sides[1] else range(a + 1, sides[0]))}
    assert len(whole) == len(wanted) and {(r.drug_a, r.drug_b) for r in whole} == wanted
    half = negatives.permuted_pairs(spark, first, second, cells // 2, "s").collect()
    assert sorted(half) == sorted(r for r in whole if r["rank"] < cells // 2)


def test_uniform_pairs_are_the_same_rule_at_every_density(spark):
    urn = negatives.uniform_urn(spark.range(40).select(F.col("id").alias("drug")), 1)
    taken = spark.createDataFrame([(a, b) for a in range(20) for b in range(a + 1, 40)], "drug_a long, drug_b long")
    free_n = 40 * 39 // 2 - taken.count()
    order = [tuple(r)[:2] for r in negatives.permuted_pairs(spark, urn, None, 10**6, "u").join(taken, ["drug_a", "drug_b"], "left_anti").orderBy("rank").collect()]
    for n in (1, 50, free_n, free_n + 5):
        sample, found = negatives.uniform_pairs(spark, urn, None, taken, n, "u", taken.count())
        assert found == min(n, free_n)
        assert sorted(tuple(r)[:2] for r in sample.collect()) == sorted(order[:n])

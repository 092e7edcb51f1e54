"""What a plan makes and moves, where a first plan made or moved too much."""

from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from doseweave.operators import blocks, learning, ranking, replicates, resampling, similarity
from doseweave.plans import hashing


def counted(df, metric):
    """The metric of every node of the finished plan."""
    df.collect()
    found, open_nodes = [], [df._jdf.queryExecution().executedPlan()]
    while open_nodes:
        node = open_nodes.pop()
        kind = node.getClass().getSimpleName()
        if kind == "AdaptiveSparkPlanExec":
            open_nodes.append(node.executedPlan())
        elif kind.endswith("QueryStageExec"):
            open_nodes.append(node.plan())
        else:
            held = node.metrics().get(metric)
            if held.isDefined():
                found.append(held.get().value())
            children = node.children()
            open_nodes += [children.apply(i) for i in range(children.size())]
    return found


def test_targets_of_a_shared_structure_do_not_multiply(spark):
    matched = spark.range(300).select(F.col("id").alias("drug"), F.lit(1).alias("struct_id"))
    targets = spark.range(400).select(
        F.lit(1).alias("struct_id"), F.concat(F.lit("A"), F.col("id") % 3, F.lit("|B")).alias("accession"),
        F.concat(F.lit("c"), F.lpad(F.col("id").cast("string"), 3, "0")).alias("target_class"), F.lit("1").alias("moa"))
    out = blocks.build_targets(matched, targets, True)
    assert {(r.uniprot, r.target_class) for r in out.collect()} == {("A0", "c000"), ("A1", "c001"), ("A2", "c002"), ("B", "c000")}
    assert out.count() == 1200 and max(counted(out, "numOutputRows")) <= 1200


def test_profiles_of_a_shared_structure_do_not_multiply(spark):
    drugs = spark.range(300).select(F.col("id").alias("drug"), F.lit("s").alias("structure")).unionByName(
        spark.createDataFrame([(0, "t"), (300, "u"), (None, "s")], "drug long, structure string"))
    profiles = spark.range(400).select(F.lit("s").alias("structure"), F.to_json(F.array(F.concat(F.lit("G"), F.col("id") % 2))).alias("genes_list")).unionByName(
        spark.createDataFrame([("t", '["A"]'), ("u", '["nan"]')], "structure string, genes_list string"))
    out = blocks.gene_block(drugs, profiles)
    got = {r.drug: (r["items"], r.known) for r in out.collect()}
    assert len(got) == 302 and got[0] == (["A", "G0", "G1"], True) and got[1] == (["G0", "G1"], True)
    assert got[300] == ([], False) and got[None] == ([], False)
    assert max(counted(out, "numOutputRows")) <= 1000


def test_rows_of_a_stratified_cut_are_not_shuffled(spark):
    rows = spark.range(6000).select("id", F.when(F.col("id") % 10 < 9, 1).otherwise(0).alias("label"))
    out = hashing.by_fraction(rows, ["id"], 3, {"test": 0.2, "val": 0.1}, "train", "role", by=["label"])
    sizes = {(r.label, r.role): r["count"] for r in out.groupBy("label", "role").count().collect()}
    assert sizes == {(1, "test"): 1080, (1, "val"): 540, (1, "train"): 3780, (0, "test"): 120, (0, "val"): 60, (0, "train"): 420}
    assert sum(counted(out, "shuffleRecordsWritten")) < 600


def sampled(spark, n=400):
    rows = [(i, i % 3 if i % 50 else None, (i * 37 % 100) / 100, int(i * 7919 % 11 < 4), float(i % 4)) for i in range(n)]
    return spark.createDataFrame(rows, "pair long, grp int, score double, label int, reliability double")


def test_replicates_equal_exploded_weights(spark):
    rows = sampled(spark)
    drawn = resampling.bootstrap_weights(rows, ["pair", "grp"], 20, 3)
    want = {(r.grp, r.replicate): (r.n_pos, r.n_neg, r.auroc) for r in ranking.auroc(drawn, "label", "score", ["grp", "replicate"], F.col("weight")).collect() if r.grp is not None}
    out = replicates.replicate_auroc(rows, "label", "score", ["grp"], replicates.hash_key(["pair", "grp"]), replicates.poisson(20, 3))
    got = {(r.grp, r.replicate): (r.n_pos, r.n_neg, r.auroc) for r in out.collect()}
    assert got == want and len(got) == 60
    # A row stays one row, and what is shuffled doesn't grow with the replicates.
    assert max(counted(out, "numOutputRows")) <= 2 * rows.count()
    means = replicates.replicate_means(rows, "score", ["grp"], replicates.hash_key(["pair", "grp"]), replicates.poisson(20, 3), "m")
    plain = drawn.groupBy("grp", "replicate").agg((F.sum(F.col("weight") * F.col("score")) / F.sum("weight")).alias("m"))
    assert {(r.grp, r.replicate): round(r.m, 9) for r in means.collect()} == {(r.grp, r.replicate): round(r.m, 9) for r in plain.collect()}


def test_gain_of_replicates_is_that_of_exploded_pairs(spark):
    rows = sampled(spark)
    cells = rows.select("pair", (F.col("pair") % 2).alias("event"), "label", "score")
    got = resampling.abstention_gain(cells, rows.select("pair", "reliability"), "pair", "event", "label", "score", 0.6, 8).head()
    values = {r.pair: r for r in rows.collect()}
    weights = {}
    for r in resampling.bootstrap_weights(rows.select("pair"), ["pair"], 8, 0).collect():
        weights.setdefault(r.replicate, {})[r.pair] = r.weight

    def gain(tag, w):
        n, left, kept = sum(w.values()), None, {}
        left = max(1, round(n * 0.6))
        for value in (3.0, 2.0, 1.0, 0.0):
            tied = {p: c for p, c in w.items() if values[p].reliability == value}
            size = sum(tied.values())
            share = min(1.0, max(0.0, left / size))
            kept |= {p: c for p, c in tied.items() if int(sha256(f"0:tie\0{tag}\0{p}".encode()).hexdigest()[:8], 16) / 2**32 < share}
            left -= size

        def macro(held):
            areas = []
            for event in (0, 1):
                own = [(values[p].score, values[p].label, c) for p, c in held.items() if p % 2 == event]
                pos, neg = [x for x in own if x[1]], [x for x in own if not x[1]]
                wins = sum(a[2] * b[2] * ((a[0] > b[0]) + (a[0] == b[0]) / 2) for a in pos for b in neg)
                areas.append(wins / (sum(a[2] for a in pos) * sum(b[2] for b in neg)))
            return sum(areas) / 2

        return macro(kept) - macro(w)

    assert abs(got.gain - gain(1, dict.fromkeys(values, 1))) < 1e-9 and got.n_boot == 8
    boot = np.array([gain(r, w) for r, w in weights.items()])
    assert abs(got.ci_low - np.quantile(boot, 0.025)) < 1e-9 and abs(got.ci_high - np.quantile(boot, 0.975)) < 1e-9


def test_a_fit_reads_rows_as_numbers(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(300, 6)) * (rng.random((300, 6)) < 0.7)
    rows = [(np.flatnonzero(r).tolist(), r[r != 0].tolist(), [0] if rng.random() < 0.4 else []) for r in x]
    df = spark.createDataFrame(rows, "indices array<int>, values array<double>, ones array<int>")
    (packed,) = learning._pack([pa.RecordBatch.from_pydict(
        {"i": pa.array([r[0] for r in rows], pa.list_(pa.int32())), "v": pa.array([r[1] for r in rows], pa.list_(pa.float64())), "o": pa.array([r[2] for r in rows], pa.list_(pa.int32()))})])
    sizes, at = learning._unpacked(packed.column(0).slice(7, 50), np.int32)
    assert sizes.tolist() == [len(r[0]) for r in rows[7:57]] and at.tolist() == [i for r in rows[7:57] for i in r[0]]
    coefficients = rng.normal(size=(2, 7))
    for width in (6, 60):
        wide = np.zeros((2, width + 1))
        wide[:, :6], wide[:, -1] = coefficients[:, :6], coefficients[:, -1]
        held = learning._Rows(*learning._flat(pa.array([r[0] for r in rows])), np.concatenate([r[1] for r in rows]), width)
        assert (held.dense is None) == (width == 60)
        assert np.allclose(held.product(wide), x @ coefficients[:, :6].T + coefficients[:, -1])
        assert np.allclose(held.gathered(held.product(wide))[:, :6], held.product(wide).T @ x)
    assert learning.fit_heads(df, 1, 6, [1.0]).converged.all()


def test_threshold_join_ships_numbers(spark):
    rng = np.random.default_rng(2)
    rows = [(i, sorted({int(x) for x in rng.integers(0, 60, 12)})) for i in range(200)]
    df = spark.createDataFrame([*rows, (200, None), (201, [])], "id long, items array<int>")
    out = similarity.tanimoto_pairs(df, df, 0.3)
    want = {(i, j) for i, x in rows for j, y in rows if len({*x} & {*y}) >= 0.3 * len({*x} | {*y})}
    assert {(r.left_id, r.right_id) for r in out.collect()} == want
    assert max(counted(out, "shuffleBytesWritten")) < 600_000

"""Sampling, splitting and unreported-pair queries. Every seeded choice is a SHA-256 order, so SQL can repeat it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from doseweave.catalog.pairs import feature_rows
from doseweave.catalog.registry import Tables, query
from doseweave.operators import clean, negatives, splits
from doseweave.session import durable

PAIRS = ["drug_a", "drug_b"]


def part_pairs(t: Tables) -> DataFrame:
    """Distinct unordered part pairs read off each line, labelled by the line's finish."""
    rows = t.lineitem.select(
        F.col("l_partkey").alias("drug_a"), (F.col("l_suppkey") * 20 + F.col("l_linenumber")).alias("drug_b"),
        (F.col("l_linestatus") == "F").cast("int").alias("label"),
    )
    return clean.canonical_pair(rows, *PAIRS).filter("drug_a <> drug_b").groupBy(*PAIRS).agg(F.max("label").alias("label"))


PART_PAIRS_SQL = """
WITH RECURSIVE pp AS (SELECT least(l_partkey, l_suppkey * 20 + l_linenumber) AS drug_a, greatest(l_partkey, l_suppkey * 20 + l_linenumber) AS drug_b,
  max((l_linestatus = 'F')::INTEGER) AS label FROM lineitem WHERE l_partkey <> l_suppkey * 20 + l_linenumber GROUP BY 1, 2),
drugs AS (SELECT drug_a AS drug FROM pp UNION SELECT drug_b FROM pp)
"""


def sha(seed: str, *keys: str) -> str:
    return f"sha256('{seed}'" + "".join(f" || chr(0) || {k}" for k in keys) + ")"


def cut_sql(source: str, keys: list[str], seed: str, shares: list[tuple[str, float]], rest: str, out: str, by: str = "") -> str:
    """CASE over the hash rank by cumulative rounded shares."""
    over = f"PARTITION BY {by} " if by else ""
    rank = f"row_number() OVER ({over}ORDER BY {sha(seed, *keys)})"
    n = f"count(*) OVER ({over.strip()})"
    edges, cases = [], []
    for name, share in shares:
        edges.append(f"round_even({n} * {share}::DOUBLE, 0)")
        cases.append(f"WHEN {rank} <= {' + '.join(edges)} THEN '{name}'")
    return f"SELECT *, CASE {' '.join(cases)} ELSE '{rest}' END AS {out} FROM {source}"


@query(f"SELECT o_orderkey, {sha('7', 'o_orderkey')} AS priority FROM orders")
def hash_order_priorities(t: Tables) -> DataFrame:
    return splits.hash_order(t.orders.select("o_orderkey"), ["o_orderkey"], 7)


@query(
    f"""WITH k AS (SELECT DISTINCT o_custkey FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING'))
SELECT o_custkey, {sha('11', 'o_custkey')} AS priority FROM k ORDER BY priority LIMIT 300"""
)
def priority_sample(t: Tables) -> DataFrame:
    excluded = t.customer.filter("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("o_custkey"))
    return splits.priority_sample(t.orders, "o_custkey", excluded, 300, 11)


@query(
    """SELECT count(*) AS rows, 0::BIGINT AS invalid_rows, count(DISTINCT o_custkey) AS distinct_keys,
  count(DISTINCT CASE WHEN o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING') THEN o_custkey END) AS excluded_keys FROM orders"""
)
def priority_sample_counts(t: Tables) -> DataFrame:
    excluded = t.customer.filter("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("o_custkey"))
    return splits.priority_sample_counts(t.orders, "o_custkey", excluded)


@query(f"SELECT o_orderkey FROM orders ORDER BY {sha('5', 'o_orderkey')} LIMIT 2500")
def seeded_row_cap(t: Tables) -> DataFrame:
    return clean.seeded_cap(t.orders.select("o_orderkey"), ["o_orderkey"], 2500, 5)


RANDOM_SQL = PART_PAIRS_SQL + f""", rnd AS ({cut_sql('pp', ['drug_a', 'drug_b'], '3', [('test', 0.2), ('val', 0.1)], 'train', 'partition')})
"""


@query(RANDOM_SQL + "SELECT drug_a, drug_b, partition FROM rnd")
def random_pair_partition(t: Tables) -> DataFrame:
    return splits.random_pair_split(part_pairs(t).select(*PAIRS), PAIRS, seed=3)


@query(
    RANDOM_SQL + """, seen AS (SELECT drug_a AS d FROM rnd WHERE partition = 'train' UNION SELECT drug_b FROM rnd WHERE partition = 'train'),
ends AS (SELECT *, unnest([drug_a, drug_b]) AS d FROM rnd WHERE partition <> 'train'),
fst AS (SELECT DISTINCT drug_a, drug_b FROM (SELECT *, row_number() OVER (PARTITION BY d ORDER BY partition = 'test', """ + sha("3", *PAIRS) + """) AS i
  FROM ends WHERE d NOT IN (SELECT d FROM seen)) WHERE i = 1)
SELECT drug_a, drug_b, CASE WHEN f.drug_a IS NULL THEN partition ELSE 'train' END AS partition, f.drug_a IS NOT NULL AS moved
FROM rnd LEFT JOIN fst f USING (drug_a, drug_b)"""
)
def transductive_partition(t: Tables) -> DataFrame:
    return splits.transductive_split(part_pairs(t).select(*PAIRS), PAIRS, seed=3)


ROLES_SQL = PART_PAIRS_SQL + f""", roles AS ({cut_sql('drugs', ['drug'], '9', [('test', 0.2), ('val', 0.1)], 'train', 'role')}),
tag AS (SELECT pp.*, x.role AS ra, y.role AS rb FROM pp JOIN roles x ON drug_a = x.drug JOIN roles y ON drug_b = y.drug),
sp AS (SELECT *, CASE WHEN ra = 'train' AND rb = 'train' THEN 'train' WHEN ra = 'val' AND rb = 'val' THEN 'val_s1' WHEN ra = 'test' AND rb = 'test' THEN 'test_s1'
  WHEN 'test' IN (ra, rb) AND 'val' IN (ra, rb) THEN 'dropped' WHEN 'val' IN (ra, rb) THEN 'val_s2' ELSE 'test_s2' END AS partition FROM tag)
"""


def cold_roles(t: Tables) -> tuple[DataFrame, DataFrame]:
    pairs = part_pairs(t)
    drugs = pairs.select(F.explode(F.array(*PAIRS)).alias("drug")).distinct()
    return pairs, splits.cold_drug_roles(drugs, seed=9)


@query(ROLES_SQL + "SELECT drug, role FROM roles")
def cold_drug_roles(t: Tables) -> DataFrame:
    return cold_roles(t)[1]


@query(ROLES_SQL + "SELECT drug_a, drug_b, partition FROM sp")
def cold_drug_partition(t: Tables) -> DataFrame:
    pairs, roles = cold_roles(t)
    return splits.pairs_from_roles(pairs.select(*PAIRS), roles)


@query(
    ROLES_SQL + """SELECT c AS "check", p AS passed FROM (VALUES ('every_pair_once', TRUE), ('s1_has_two_unseen', TRUE), ('s2_has_one_unseen', TRUE),
  ('train_drugs_disjoint', TRUE), ('train_nonempty', TRUE)) v(c, p)"""
)
def cold_drug_audit(t: Tables) -> DataFrame:
    pairs, roles = cold_roles(t)
    return splits.audit_pair_split(splits.pairs_from_roles(pairs.select(*PAIRS), roles), pairs, roles)


GROUPS_SQL = PART_PAIRS_SQL + """, gd AS (SELECT p_partkey AS drug, p_brand || '/' || p_type AS grp FROM part)
"""

FILL_SQL = GROUPS_SQL + f""", gs AS (SELECT grp, count(*) AS size, {sha('4', 'grp')} AS pr FROM gd GROUP BY grp),
o AS (SELECT *, row_number() OVER (ORDER BY pr) AS i, (SELECT round_even(count(*) * 0.2, 0) FROM gd) AS qt, (SELECT round_even(count(*) * 0.1, 0) FROM gd) AS qv FROM gs),
f AS (SELECT 0::BIGINT AS i, 0::BIGINT AS gt, 0::BIGINT AS gv, ''::VARCHAR AS grp, ''::VARCHAR AS role
  UNION ALL SELECT o.i, CASE WHEN f.gt + size <= qt THEN f.gt + size ELSE f.gt END, CASE WHEN f.gt + size > qt AND f.gv + size <= qv THEN f.gv + size ELSE f.gv END, o.grp,
  CASE WHEN f.gt + size <= qt THEN 'test' WHEN f.gv + size <= qv THEN 'val' ELSE 'train' END FROM f JOIN o ON o.i = f.i + 1)
"""


def structure_groups(t: Tables) -> DataFrame:
    return t.part.select(F.col("p_partkey").alias("drug"), F.concat_ws("/", "p_brand", "p_type").alias("group"))


@query(FILL_SQL + "SELECT drug, grp AS \"group\", role FROM gd JOIN f USING (grp)")
def group_quota_roles(t: Tables) -> DataFrame:
    return splits.group_roles(structure_groups(t), seed=4)


COUNT_ROLES_SQL = GROUPS_SQL + f""", g AS (SELECT DISTINCT grp FROM gd), gr AS ({cut_sql('g', ['grp'], '6', [('test', 0.2), ('val', 0.1)], 'train', 'role')}),
dr AS (SELECT drug, grp, role FROM gd JOIN gr USING (grp))
"""


@query(COUNT_ROLES_SQL + "SELECT drug, grp AS \"group\", role FROM dr")
def group_count_roles(t: Tables) -> DataFrame:
    return splits.group_roles_by_count(structure_groups(t), seed=6)


@query(
    COUNT_ROLES_SQL + """SELECT drug_a, drug_b, CASE WHEN x.role = y.role THEN x.role ELSE 'cross_role' END AS partition
FROM pp JOIN dr x ON drug_a = x.drug JOIN dr y ON drug_b = y.drug"""
)
def group_disjoint_partition(t: Tables) -> DataFrame:
    roles = splits.group_roles_by_count(structure_groups(t), seed=6)
    return splits.group_disjoint_splits(part_pairs(t).select(*PAIRS), roles, ["train"])


@query(
    COUNT_ROLES_SQL + """, m AS (SELECT DISTINCT CASE WHEN x.role = y.role THEN x.role ELSE 'cross_role' END AS p, unnest([x.grp, y.grp]) AS k
  FROM pp JOIN dr x ON drug_a = x.drug JOIN dr y ON drug_b = y.drug)
SELECT a.p AS partition_a, b.p AS partition_b, count(*) AS shared FROM m a JOIN m b ON a.k = b.k AND a.p < b.p GROUP BY 1, 2"""
)
def group_partition_overlaps(t: Tables) -> DataFrame:
    from doseweave.operators.profiles import overlap_counts

    roles = splits.group_roles_by_count(structure_groups(t), seed=6)
    split = splits.with_roles(splits.group_disjoint_splits(part_pairs(t).select(*PAIRS), roles), roles, "group")
    members = split.select("partition", F.explode(F.array("group_a", "group_b")).alias("key"))
    return overlap_counts(members)


START_SQL = PART_PAIRS_SQL + f""", nn AS (SELECT count(*) AS n, greatest(4, round_even(count(*) * 0.15, 0))::BIGINT AS held FROM drugs),
rk AS (SELECT drug, row_number() OVER (ORDER BY {sha('42:0', 'drug')}) AS r FROM drugs),
roles AS (SELECT drug, CASE WHEN r <= held // 2 THEN 's1_dev' WHEN r <= held THEN 's1_test' ELSE 'seen' END AS role FROM rk, nn),
tag AS (SELECT pp.*, list_sort([x.role, y.role]) AS rr FROM pp JOIN roles x ON drug_a = x.drug JOIN roles y ON drug_b = y.drug),
fam AS (SELECT *, CASE rr WHEN ['seen', 'seen'] THEN 'transductive' WHEN ['s1_dev', 's1_dev'] THEN 's1_dev' WHEN ['s1_test', 's1_test'] THEN 's1_test'
  WHEN ['s1_dev', 'seen'] THEN 's2_dev' WHEN ['s1_test', 'seen'] THEN 's2_test' END AS fam FROM tag),
seen AS ({cut_sql("(SELECT * FROM fam WHERE fam = 'transductive')", ['drug_a', 'drug_b'], '42', [('transductive_test', 0.2), ('validation', 0.08)], 'transductive_train', 'split', by='label')}),
spl AS (SELECT drug_a, drug_b, label, split FROM seen UNION ALL SELECT drug_a, drug_b, label, fam FROM fam WHERE fam NOT IN ('transductive'))
"""


@query(START_SQL + "SELECT drug, role FROM roles")
def cold_start_roles(t: Tables) -> DataFrame:
    return splits.cold_start_groups(durable(part_pairs(t)), 0.15, 42)


def start_splits(t: Tables) -> tuple[DataFrame, DataFrame]:
    pairs = durable(part_pairs(t))
    roles = splits.cold_start_groups(pairs, 0.15, 42)
    return splits.cold_start_splits(pairs, roles, "label", 0.10, 42), roles


@query(START_SQL + "SELECT * FROM spl")
def cold_start_partition(t: Tables) -> DataFrame:
    return start_splits(t)[0]


@query(START_SQL + "SELECT split, count(*) AS n_rows, count(*) FILTER (WHERE label = 1) AS positives, count(*) FILTER (WHERE label = 0) AS negatives, least(count(*) FILTER (WHERE label = 1), count(*) FILTER (WHERE label = 0)) >= 400 AS enough FROM spl GROUP BY 1")
def cold_start_counts(t: Tables) -> DataFrame:
    return splits.split_counts(start_splits(t)[0], 400)


@query(
    START_SQL + """SELECT m.split, expected_rows, n_rows, null_labels, nonbinary_labels, repeated_pairs, balanced, n_rows = expected_rows AS rows_match, 0::BIGINT AS cross_split_repeats
FROM (VALUES ('s1_dev', 100::BIGINT), ('validation', 5::BIGINT)) m(split, expected_rows) JOIN
 (SELECT split, count(*) AS n_rows, 0::BIGINT AS null_labels, 0::BIGINT AS nonbinary_labels, 0::BIGINT AS repeated_pairs, sum(label) * 2 = count(*) AS balanced FROM spl GROUP BY 1) s ON m.split = s.split"""
)
def frozen_split_verification(t: Tables) -> DataFrame:
    manifest = t.region.filter("r_regionkey < 2").select(
        F.when(F.col("r_regionkey") == 0, "s1_dev").otherwise("validation").alias("split"),
        F.when(F.col("r_regionkey") == 0, 100).otherwise(5).cast("long").alias("expected_rows"),
    )
    return splits.verify_frozen_splits(start_splits(t)[0], manifest)


def draw_sql(urn: str, n: str, size: str, seed: str) -> str:
    """First draws of distinct pairs from an urn(slot, drug), kept below the n-th free draw."""
    number = "('0x' || substr({}, 1, 15))::BIGINT"
    return f"""dr AS (SELECT i, {number.format(f"sha256('{seed}:a' || chr(0) || i)")} % {size} AS sa, {number.format(f"sha256('{seed}:b' || chr(0) || i)")} % {size} AS sb
  FROM (SELECT unnest(generate_series(0::BIGINT, 2 * {n} + 999)) AS i)),
dd AS (SELECT least(x.drug, y.drug) AS drug_a, greatest(x.drug, y.drug) AS drug_b, min(i) AS i FROM dr JOIN {urn} x ON sa = x.slot JOIN {urn} y ON sb = y.slot WHERE x.drug <> y.drug GROUP BY 1, 2),
fr AS (SELECT * FROM dd ANTI JOIN pp USING (drug_a, drug_b))
SELECT drug_a, drug_b FROM fr ORDER BY i LIMIT (SELECT {n})"""


def permuted_sql(n: str, seed: str) -> str:
    """The first n pairs outside pp(drug_a, drug_b) in the permuted order of all pairs of nb(drug, i)."""
    steps = "c0 AS MATERIALIZED (SELECT k, k // b AS l, k % b AS r, a, b, t FROM sz, range(m) x(k)),\n"
    for turn in range(negatives.ROUNDS):
        moved, by, side = ("l", "r", "a") if turn % 2 == 0 else ("r", "l", "b")
        step = f"({moved} + ('0x' || substr({sha(f'{seed}:mix{turn}', by)}, 1, 15))::BIGINT % {side}) % {side} AS {moved}"
        steps += f"c{turn + 1} AS MATERIALIZED (SELECT k, {step}, {by}, a, b, t FROM c{turn}),\n"
    return f"""tt AS (SELECT count(*) * (count(*) - 1) // 2 AS t FROM nb),
ta AS (SELECT t, ceil(sqrt(t))::BIGINT AS a, {n} AS n, (SELECT count(*) FROM pp) AS f FROM tt),
sz AS (SELECT t, a, (t + a - 1) // a AS b, least(a * ((t + a - 1) // a), n + f + a * ((t + a - 1) // a) - t) AS m FROM ta),
{steps}cx AS (SELECT k, l * b + r AS x, floor((1 + sqrt(1 + 8 * (l * b + r))) / 2)::BIGINT AS g FROM c{negatives.ROUNDS} WHERE l * b + r < t),
ch AS (SELECT k, x, CASE WHEN g * (g - 1) // 2 > x THEN g - 1 WHEN (g + 1) * g // 2 <= x THEN g + 1 ELSE g END AS h FROM cx),
dd AS (SELECT k, least(p.drug, q.drug) AS drug_a, greatest(p.drug, q.drug) AS drug_b FROM ch JOIN nb p ON p.i = x - h * (h - 1) // 2 JOIN nb q ON q.i = h)
SELECT drug_a, drug_b FROM dd ANTI JOIN pp USING (drug_a, drug_b) ORDER BY k LIMIT (SELECT {n})"""


@query(
    PART_PAIRS_SQL + f""", nb AS (SELECT drug, row_number() OVER (ORDER BY {sha('42:urn', 'drug')}) - 1 AS i FROM drugs),
""" + permuted_sql("(SELECT count(*) FROM pp)", "42")
)
def unreported_pairs_uniform(t: Tables) -> DataFrame:
    """As many unreported part pairs as reported ones, drawn from a thin pair space."""
    return negatives.sample_unreported(part_pairs(t), 1.0, "uniform", 42)


@query(
    PART_PAIRS_SQL + f""", en AS (SELECT drug_a AS drug, drug_a, drug_b, 'a' AS side FROM pp UNION ALL SELECT drug_b, drug_a, drug_b, 'b' FROM pp),
urn AS (SELECT drug, row_number() OVER (ORDER BY {sha('42:slots', 'drug_a', 'drug_b', 'side')}) - 1 AS slot FROM en),
""" + draw_sql("urn", "(SELECT count(*) FROM pp)", "(SELECT count(*) FROM urn)", "42")
)
def unreported_pairs_degree_matched(t: Tables) -> DataFrame:
    return negatives.sample_unreported(part_pairs(t), 1.0, "degree_matched", 42)


@query(
    f"""WITH pp AS (SELECT DISTINCT least(c_nationkey, o_orderpriority[1:1]::BIGINT * 5) AS drug_a, greatest(c_nationkey, o_orderpriority[1:1]::BIGINT * 5) AS drug_b
  FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_nationkey <> o_orderpriority[1:1]::BIGINT * 5),
drugs AS (SELECT drug_a AS drug FROM pp UNION SELECT drug_b FROM pp),
nb AS (SELECT drug, row_number() OVER (ORDER BY {sha('8:urn', 'drug')}) - 1 AS i FROM drugs),
""" + permuted_sql("(SELECT round_even(count(*) * 0.5, 0)::BIGINT FROM pp)", "8")
)
def unreported_pairs_dense(t: Tables) -> DataFrame:
    """The request is a large part of the few possible nation pairs; the rule is that of a thin request."""
    rows = t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey")).select(
        F.col("c_nationkey").cast("long").alias("drug_a"), (F.substring("o_orderpriority", 1, 1).cast("long") * 5).alias("drug_b")
    )
    return negatives.sample_unreported(clean.canonical_pair(rows, *PAIRS).filter("drug_a <> drug_b").distinct(), 0.5, "uniform", 8)


UNLABELLED_SPLIT_SQL = START_SQL.replace("max((l_linestatus = 'F')::INTEGER) AS label", "1 AS label")


@query(
    UNLABELLED_SPLIT_SQL + "SELECT split, count(*) AS positives, count(*) AS requested, count(*) AS sampled, FALSE AS saturated FROM spl GROUP BY 1"
)
def split_negative_audit(t: Tables) -> DataFrame:
    return negatives.split_aware_dataset(part_pairs(t)).audit


@query(
    UNLABELLED_SPLIT_SQL + """, n AS (SELECT split, count(*) AS n FROM spl GROUP BY 1)
SELECT split, label, n AS n_rows, 0::BIGINT AS wrong_role, 0::BIGINT AS reported_negatives FROM n, (VALUES (0), (1)) v(label)"""
)
def split_negative_integrity(t: Tables) -> DataFrame:
    """Degree-matched negatives: rows per split and label, with role and leakage violations counted."""
    pairs = durable(part_pairs(t))
    data = negatives.split_aware_dataset(pairs, strategy="degree_matched")
    roles = splits.cold_start_groups(pairs.withColumn("label", F.lit(1)), 0.15, 42)
    tagged = splits.with_roles(data.rows, roles)
    fam = splits.family(F.col("role_a"), F.col("role_b"))
    want = F.when(F.col("split").isin("transductive_train", "validation", "transductive_test"), "transductive").otherwise(F.col("split"))
    known = pairs.select(*PAIRS).withColumn("_known", F.lit(1))
    return tagged.withColumn("_wrong", fam != want).join(known, PAIRS, "left").groupBy("split", "label").agg(
        F.count(F.lit(1)).alias("n_rows"), F.count_if("_wrong").alias("wrong_role"),
        F.count_if((F.col("label") == 0) & F.col("_known").isNotNull()).alias("reported_negatives"),
    )


@query()
def group_splits_with_unreported(t: Tables) -> DataFrame:
    """Rows per role and label of a group-disjoint study with one unreported pair per reported one."""
    out = negatives.group_splits_with_negatives(part_pairs(t).select(*PAIRS), structure_groups(t).join(
        part_pairs(t).select(F.explode(F.array(*PAIRS)).alias("drug")).distinct(), "drug", "left_semi"))
    return out.groupBy("partition", "label").agg(F.count(F.lit(1)).alias("n_rows"))


LABELLED_SQL = "WITH d AS (SELECT doc_id, quality, toxic FROM labels)\n"


@query(f"SELECT doc_id, quality, validation_role FROM ({cut_sql('labels', ['doc_id'], '21', [('posthoc', 0.4)], 'selection', 'validation_role', by='quality')})")
def validation_partition(t: Tables) -> DataFrame:
    return splits.partition_validation(t.labels.select("doc_id", "quality"), ["doc_id"], 0.4, 21, "quality")


@query(
    f"SELECT doc_id, quality, ['calibration', 'threshold', 'conformal'][ntile(3) OVER (PARTITION BY quality ORDER BY {sha('22', 'doc_id')})] AS posthoc_role, FALSE AS reused FROM labels"
)
def posthoc_roles(t: Tables) -> DataFrame:
    return splits.posthoc_roles(t.labels.select("doc_id", "quality"), ["doc_id"], 22, "quality")


@query(f"SELECT doc_id, half FROM ({cut_sql('labels', ['doc_id'], '0', [('platt_fit', 0.5)], 'conformal_cal', 'half')})")
def calibration_halves(t: Tables) -> DataFrame:
    return splits.split_calibration(t.labels.select("doc_id"), ["doc_id"])


@query(
    f"""WITH g AS (SELECT p_brand || '/' || p_type AS grp, count(*) AS n FROM part GROUP BY 1),
r AS (SELECT grp, row_number() OVER (ORDER BY n DESC, {sha('2', 'grp')}) - 1 AS i FROM g)
SELECT p_partkey AS drug, CASE WHEN i % 10 < 5 THEN i % 10 ELSE 9 - i % 10 END::INTEGER AS fold FROM part JOIN r ON grp = p_brand || '/' || p_type"""
)
def group_folds(t: Tables) -> DataFrame:
    return splits.group_folds(structure_groups(t), "group", 5, 2).select("drug", "fold")


@query(
    f"""WITH k AS (SELECT s_suppkey AS drug, row_number() OVER (ORDER BY s_suppkey) AS i FROM supplier),
m AS (SELECT s_suppkey AS d2, row_number() OVER (ORDER BY {sha('13', 's_suppkey')}) AS i FROM supplier),
f AS (SELECT DISTINCT l_suppkey AS drug, l_linenumber AS item FROM lineitem)
SELECT d2 AS drug, item FROM f JOIN k USING (drug) JOIN m USING (i)"""
)
def permuted_feature_control(t: Tables) -> DataFrame:
    features = t.lineitem.select(F.col("l_suppkey").alias("drug"), F.col("l_linenumber").alias("item")).distinct()
    return splits.permuted_control(features, t.supplier.select(F.col("s_suppkey").alias("drug")), 13)


@query(
    """WITH f AS (SELECT DISTINCT l_suppkey AS drug, 'target' AS block, 'T' || (l_partkey // 10) AS item FROM lineitem WHERE l_returnflag = 'R'
  UNION SELECT DISTINCT l_suppkey, 'class', 'C' || (l_quantity::INTEGER * 10 + l_linenumber) FROM lineitem WHERE l_returnflag = 'A'),
k AS (SELECT DISTINCT drug, block FROM f WHERE drug % 7 <> 3)
SELECT block, (SELECT count(*) FROM k WHERE k.block = f.block) AS known_drugs, count(*) FILTER (WHERE drug % 7 = 3) AS leaked_cells,
  round(100.0 * (SELECT count(*) FROM k WHERE k.block = f.block)::DOUBLE / (SELECT count(*) FROM supplier), 4) AS coverage_pct FROM f GROUP BY 1"""
)
def zero_fill_audit(t: Tables) -> DataFrame:
    features = feature_rows(t)
    known = features.filter("drug % 7 <> 3").select("drug", "block")
    return splits.zero_fill_audit(features, known, t.supplier.select(F.col("s_suppkey").alias("drug")))


@query(
    """SELECT o_custkey AS seed, max(n) = 1 AS no_duplicates, min(lo) = max(hi) AS same_o_orderstatus FROM
  (SELECT o_custkey, o_orderpriority, count(*) AS n, min(o_orderstatus) AS lo, max(o_orderstatus) AS hi FROM orders GROUP BY 1, 2) GROUP BY 1"""
)
def run_comparability(t: Tables) -> DataFrame:
    runs = t.orders.withColumnsRenamed({"o_custkey": "seed", "o_orderpriority": "experiment"})
    return splits.comparability(runs, ["o_orderstatus"])


@query(
    """WITH m AS (SELECT o_orderpriority AS seed, min(o_orderstatus) AS family, count(*) AS size FROM orders GROUP BY 1)
SELECT unnest(['three_to_five_members', 'distinct_seeds', 'same_family', 'same_size']) AS "check", unnest([count(*) BETWEEN 3 AND 5, count(DISTINCT seed) = count(*), min(family) = max(family), min(size) = max(size)]) AS passed FROM m"""
)
def member_compatibility(t: Tables) -> DataFrame:
    members = t.orders.groupBy(F.col("o_orderpriority").alias("seed")).agg(F.min("o_orderstatus").alias("family"), F.count(F.lit(1)).alias("size"))
    return splits.member_compatibility(members, ["family", "size"])

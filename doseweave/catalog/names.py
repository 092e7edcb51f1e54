"""Name, structure and text queries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from doseweave.catalog.registry import Tables, query
from doseweave.functions import numeric, text
from doseweave.operators import clean, comparison, identity


def sized_name(prefix: str = "p_"):
    return F.concat_ws(" ", F.col("p_name"), F.col("p_size").cast("string"))


def part_names(t: Tables) -> DataFrame:
    return t.part.select(F.col("p_partkey").alias("drug_idx"), sized_name().alias("name"))


NAMES_SQL = """
WITH nm AS (SELECT p_partkey AS drug_idx, lower(p_name || ' ' || p_size) AS name FROM part),
uniq AS (SELECT name, min(drug_idx) AS drug_idx FROM nm GROUP BY 1 HAVING count(DISTINCT drug_idx) = 1)
"""


@query(NAMES_SQL + "SELECT name, drug_idx FROM uniq")
def unambiguous_names(t: Tables) -> DataFrame:
    return identity.unambiguous_name_map(part_names(t))


@query(
    NAMES_SQL + "SELECT count(DISTINCT name) - (SELECT count(*) FROM uniq) AS ambiguous_names FROM nm"
)
def ambiguous_names(t: Tables) -> DataFrame:
    return identity.ambiguous_name_count(part_names(t))


EVIDENCE_SQL = """
WITH ev AS (SELECT l_orderkey, l_linenumber, lower(p_name || ' ' || l_quantity::INTEGER) AS norm_name
            FROM lineitem JOIN part ON l_partkey = p_partkey),
cat AS (SELECT lower(p_name || ' ' || p_size) AS norm_name, min(p_brand) AS s0, max(p_brand) AS s1,
        min(p_partkey) AS i0, max(p_partkey) AS i1 FROM part GROUP BY 1),
res AS (SELECT l_orderkey, l_linenumber, ev.norm_name,
  CASE WHEN s0 IS NULL THEN 'unmatched' WHEN s0 = s1 THEN 'matched' ELSE 'ambiguous' END AS mapping_status,
  CASE WHEN s0 = s1 THEN s0 END AS structure, CASE WHEN s0 = s1 AND i0 = i1 THEN i0 END AS chem_id
  FROM ev LEFT JOIN cat USING (norm_name))
"""


def resolved_evidence(t: Tables) -> DataFrame:
    evidence = t.lineitem.join(t.part, F.col("l_partkey") == F.col("p_partkey")).select(
        "l_orderkey", "l_linenumber",
        F.lower(F.concat_ws(" ", "p_name", F.col("l_quantity").cast("int").cast("string"))).alias("norm_name"),
    )
    catalogue = t.part.select(
        F.lower(sized_name()).alias("norm_name"), F.col("p_brand").alias("structure"), F.col("p_partkey").alias("chem_id")
    )
    return identity.resolve_names_with_status(evidence, catalogue)


@query(EVIDENCE_SQL + "SELECT * FROM res")
def evidence_name_resolution(t: Tables) -> DataFrame:
    return resolved_evidence(t)


@query(
    EVIDENCE_SQL + """, uni AS (SELECT DISTINCT p_brand FROM part WHERE p_retailprice > 910 AND p_brand > 'Brand#14')
SELECT CASE WHEN structure IS NULL THEN 'structure_not_resolved'
  WHEN structure NOT IN (SELECT p_brand FROM uni) THEN 'structure_not_in_universe' ELSE 'matched' END AS membership_status,
  count(*) AS n FROM res GROUP BY 1"""
)
def structure_membership(t: Tables) -> DataFrame:
    universe = t.part.filter("p_retailprice > 910 AND p_brand > 'Brand#14'").select(F.col("p_brand").alias("structure"))
    marked = identity.structure_membership_status(resolved_evidence(t), universe)
    return marked.groupBy("membership_status").agg(F.count(F.lit(1)).alias("n"))


@query(
    """SELECT s_suppkey, c_custkey FROM supplier JOIN customer
  ON s_nationkey = c_nationkey AND floor(s_acctbal / 100)::INTEGER = floor(c_acctbal / 100)::INTEGER"""
)
def structures_by_skeleton(t: Tables) -> DataFrame:
    def key(nation: str, balance: str):
        return F.concat_ws(":", F.col(nation), F.floor(F.col(balance) / 100))

    drugs = t.supplier.select("s_suppkey", key("s_nationkey", "s_acctbal").alias("ik"))
    structures = t.customer.select("c_custkey", key("c_nationkey", "c_acctbal").alias("ik"))
    return identity.match_structures(drugs, structures).drop("ik")


@query(
    """WITH r AS (SELECT p_partkey, p_name || (p_size + 1) AS exact, p_type || (p_size + 7) AS parent, p_brand || (p_size + 13) AS skeleton FROM part),
e AS (SELECT exact, min(p_partkey) AS id FROM r GROUP BY 1), p AS (SELECT parent, min(p_partkey) AS id FROM r GROUP BY 1),
s AS (SELECT skeleton, min(p_partkey) AS id FROM r GROUP BY 1)
SELECT p_partkey, coalesce(e.id, p.id, s.id) AS match_id,
  CASE WHEN e.id IS NOT NULL THEN 'exact' WHEN p.id IS NOT NULL THEN 'parent' WHEN s.id IS NOT NULL THEN 'skeleton'
       ELSE 'unmatched' END AS match_tier
FROM part l LEFT JOIN e ON l.p_name || l.p_size = e.exact LEFT JOIN p ON l.p_type || l.p_size = p.parent
LEFT JOIN s ON l.p_brand || l.p_size = s.skeleton"""
)
def tiered_structure_match(t: Tables) -> DataFrame:
    def keys(name: str, steps: tuple[int, int, int]) -> list[Column]:
        columns = zip(("exact", "parent", "skeleton"), ("p_name", "p_type", "p_brand"), steps, strict=True)
        return [F.concat(column, (F.col("p_size") + step).cast("string")).alias(name + tier) for tier, column, step in columns]

    keyed = t.part.select("p_partkey", *keys("", (0, 0, 0)))
    right = t.part.select(F.col("p_partkey").alias("rid"), *keys("r_", (1, 7, 13)))
    tiers = [("exact", "exact", "r_exact"), ("parent", "parent", "r_parent"), ("skeleton", "skeleton", "r_skeleton")]
    return identity.tiered_match(keyed, right, tiers, "rid").select("p_partkey", "match_id", "match_tier")


ALIAS_SQL = """
WITH al AS (SELECT 'n' || s_suppkey AS node_id, unnest(['n' || s_suppkey, lower(s_name), 'cid' || s_suppkey,
  'k' || (s_acctbal::BIGINT // 50)]) AS alias FROM supplier),
one AS (SELECT alias, min(node_id) AS node_id FROM al GROUP BY 1 HAVING count(DISTINCT node_id) = 1),
ed AS (SELECT l_orderkey, l_linenumber,
  CASE WHEN l_linenumber <= 3 THEN 'cid' || l_suppkey ELSE 'k' || (l_partkey // 10) END AS a,
  CASE WHEN l_linenumber % 2 = 0 THEN 'cid' || (l_partkey % 97) ELSE 'n' || (l_quantity::BIGINT) END AS b FROM lineitem),
mp AS (SELECT l_orderkey, l_linenumber, x.node_id AS node_a, y.node_id AS node_b,
  CASE WHEN x.node_id IS NULL OR y.node_id IS NULL THEN 'unmapped' WHEN x.node_id = y.node_id THEN 'self' ELSE 'mapped' END
  AS map_status FROM ed LEFT JOIN one x ON a = x.alias LEFT JOIN one y ON b = y.alias)
"""


def alias_mapped(t: Tables) -> DataFrame:
    nodes = t.supplier.select(
        F.concat(F.lit("n"), "s_suppkey").alias("node"), F.col("s_name").alias("title"),
        F.to_json(
            F.array(
                F.concat(F.lit("CID000"), "s_suppkey"),
                F.concat(F.lit("K"), F.floor(F.bround("s_acctbal").cast("long") / 50).cast("string")),
            )
        ).alias("source_ids"),
    )
    aliases = identity.alias_table(nodes, "node", ["title"], ["source_ids"])
    edges = t.lineitem.select(
        "l_orderkey", "l_linenumber",
        F.when(F.col("l_linenumber") <= 3, F.concat(F.lit("CID00"), "l_suppkey"))
        .otherwise(F.concat(F.lit("k"), F.floor(F.col("l_partkey") / 10))).alias("a"),
        F.when(F.col("l_linenumber") % 2 == 0, F.concat(F.lit("cid"), F.col("l_partkey") % 97))
        .otherwise(F.concat(F.lit("N"), F.col("l_quantity").cast("long"))).alias("b"),
    )
    return identity.alias_endpoint_map(edges, aliases, "a", "b")


@query(ALIAS_SQL + "SELECT l_orderkey, l_linenumber, node_a, node_b, map_status FROM mp")
def alias_endpoints(t: Tables) -> DataFrame:
    return alias_mapped(t).select("l_orderkey", "l_linenumber", "node_a", "node_b", "map_status")


@query(ALIAS_SQL + "SELECT map_status, count(*) AS edge_rows FROM mp GROUP BY 1")
def alias_endpoint_audit(t: Tables) -> DataFrame:
    return identity.alias_map_audit(alias_mapped(t))


@query(
    ALIAS_SQL + "SELECT DISTINCT least(node_a, node_b) AS node_a, greatest(node_a, node_b) AS node_b FROM mp "
    "WHERE map_status = 'mapped'"
)
def alias_mapped_pairs(t: Tables) -> DataFrame:
    return identity.mapped_pairs(alias_mapped(t))


CURATED_SQL = """
WITH nm AS (SELECT s_suppkey AS id, lower(s_name) AS name FROM supplier UNION ALL
            SELECT s_suppkey + 1, lower(s_name) FROM supplier WHERE s_nationkey = 4),
uniq AS (SELECT name, min(id) AS id FROM nm GROUP BY 1 HAVING count(DISTINCT id) = 1),
raw AS (SELECT x.s_name AS na, y.s_name AS nb, CASE l_linenumber WHEN 1 THEN 'Major' WHEN 2 THEN ' moderate'
  WHEN 3 THEN 'MINOR' WHEN 4 THEN NULL ELSE 'Unknown' END AS lv
  FROM lineitem l JOIN supplier x ON l.l_suppkey = x.s_suppkey JOIN supplier y ON l.l_partkey // 20 = y.s_suppkey
  WHERE l_returnflag = 'R' AND l_linestatus = 'F'),
both_ AS (SELECT a.id AS ia, b.id AS ib, CASE lower(trim(coalesce(lv, 'unknown'))) WHEN 'major' THEN 3 WHEN 'moderate' THEN 2
  WHEN 'minor' THEN 1 ELSE 0 END AS rk FROM raw JOIN uniq a ON lower(na) = a.name JOIN uniq b ON lower(nb) = b.name
  WHERE a.id <> b.id),
basep AS (SELECT DISTINCT least(l_suppkey, l_partkey // 20) AS a, greatest(l_suppkey, l_partkey // 20) AS b FROM lineitem
  WHERE l_returnflag = 'A'),
br AS (SELECT least(ia, ib) AS drug_a, greatest(ia, ib) AS drug_b, max(rk) AS rk, count(*) AS n_records FROM both_ GROUP BY 1, 2),
bridge AS (SELECT drug_a, drug_b, ['unknown', 'minor', 'moderate', 'major'][rk + 1] AS severity, n_records,
  b.a IS NOT NULL AS in_base FROM br LEFT JOIN basep b ON drug_a = a AND drug_b = b)
"""


def curated(t: Tables) -> tuple[DataFrame, DataFrame]:
    names = t.supplier.select(F.col("s_suppkey").alias("drug_idx"), F.col("s_name").alias("name")).unionByName(
        t.supplier.filter("s_nationkey = 4").select((F.col("s_suppkey") + 1).alias("drug_idx"), F.col("s_name").alias("name"))
    )
    level = (
        F.when(F.col("l_linenumber") == 1, "Major").when(F.col("l_linenumber") == 2, " moderate")
        .when(F.col("l_linenumber") == 3, "MINOR").when(F.col("l_linenumber") == 4, F.lit(None)).otherwise("Unknown")
    )
    first, second = t.supplier.select("s_suppkey", "s_name"), t.supplier.select("s_suppkey", "s_name")
    rows = (
        t.lineitem.filter("l_returnflag = 'R' AND l_linestatus = 'F'")
        .select("l_suppkey", F.floor(F.col("l_partkey") / 20).alias("other"), level.alias("level"))
        .join(first.select(F.col("s_suppkey").alias("l_suppkey"), F.col("s_name").alias("name_a")), "l_suppkey")
        .join(second.select(F.col("s_suppkey").alias("other"), F.col("s_name").alias("name_b")), "other")
    )
    pairs = t.lineitem.filter("l_returnflag = 'A'").select(
        F.col("l_suppkey").alias("drug_a"), F.floor(F.col("l_partkey") / 20).alias("drug_b")
    )
    return identity.curated_bridge(rows, names, pairs), pairs


@query(CURATED_SQL + "SELECT * FROM bridge")
def curated_pair_bridge(t: Tables) -> DataFrame:
    return curated(t)[0]


@query(
    CURATED_SQL + "SELECT severity, count(*) AS pairs, count(*) FILTER (WHERE in_base) AS pairs_in_base, "
    "sum(n_records)::BIGINT AS records FROM bridge GROUP BY 1"
)
def curated_severity_overlap(t: Tables) -> DataFrame:
    return identity.curated_overlap(curated(t)[0])


@query(
    CURATED_SQL + """, mn AS (SELECT DISTINCT least(l_suppkey, l_quantity::BIGINT) AS a, greatest(l_suppkey, l_quantity::BIGINT) AS b
  FROM lineitem WHERE l_tax > 0.07)
SELECT basep.a AS drug_a, basep.b AS drug_b, r.rk IS NOT NULL AS curated_any, coalesce(r.rk >= 2, FALSE) AS curated_moderate_major,
  mn.a IS NOT NULL AS label_mention FROM basep LEFT JOIN br r ON r.drug_a = basep.a AND r.drug_b = basep.b
  LEFT JOIN mn ON mn.a = basep.a AND mn.b = basep.b WHERE basep.a <> basep.b"""
)
def pair_evidence_flags(t: Tables) -> DataFrame:
    bridge, pairs = curated(t)
    base = clean.canonical_pair(pairs, "drug_a", "drug_b").distinct().filter("drug_a <> drug_b")
    mentions = t.lineitem.filter("l_tax > 0.07").select(
        F.col("l_suppkey").alias("drug_a"), F.col("l_quantity").cast("long").alias("drug_b")
    )
    return identity.pair_flags(base, bridge, mentions)


@query(
    CURATED_SQL + """, cand AS (SELECT DISTINCT least(l_suppkey, l_quantity::BIGINT) AS drug_a, greatest(l_suppkey, l_quantity::BIGINT) AS drug_b
  FROM lineitem), sc AS (SELECT drug_a AS id FROM bridge UNION SELECT drug_b FROM bridge)
SELECT drug_a, drug_b FROM cand WHERE drug_a <> drug_b AND drug_a IN (SELECT id FROM sc) AND drug_b IN (SELECT id FROM sc)
AND NOT EXISTS (SELECT 1 FROM basep WHERE a = drug_a AND b = drug_b)"""
)
def unreported_candidates(t: Tables) -> DataFrame:
    bridge, pairs = curated(t)
    scope = bridge.select(F.explode(F.array("drug_a", "drug_b")).alias("id"))
    proposed = t.lineitem.select(F.col("l_suppkey").alias("drug_a"), F.col("l_quantity").cast("long").alias("drug_b"))
    return identity.candidate_check(proposed, pairs, scope)


RAW_EDGE_SQL = """
WITH lk AS (SELECT lower(s_name) AS n, min('X' || s_nationkey) AS st FROM supplier WHERE s_nationkey <> 7 GROUP BY 1),
ed AS (SELECT l_orderkey, l_linenumber, 'Supplier#' || lpad(l_suppkey::VARCHAR, 9, '0') AS name_a,
  'Supplier#' || lpad(l_quantity::BIGINT::VARCHAR, 9, '0') AS name_b FROM lineitem),
mp AS (SELECT l_orderkey, l_linenumber, name_a, name_b, x.st AS source, y.st AS target
  FROM ed LEFT JOIN lk x ON lower(name_a) = x.n LEFT JOIN lk y ON lower(name_b) = y.n)
"""


def named_edges(t: Tables) -> DataFrame:
    lookup = t.supplier.filter("s_nationkey <> 7").select(
        F.col("s_name").alias("name"), F.concat(F.lit("X"), "s_nationkey").alias("structure")
    )
    raw = t.lineitem.select(
        "l_orderkey", "l_linenumber",
        F.concat(F.lit("Supplier#"), F.lpad(F.col("l_suppkey").cast("string"), 9, "0")).alias("name_a"),
        F.concat(F.lit("Supplier#"), F.lpad(F.col("l_quantity").cast("int").cast("string"), 9, "0")).alias("name_b"),
    )
    return identity.edges_from_names(raw, lookup, "name_a", "name_b", ["l_orderkey", "l_linenumber"])


@query(
    RAW_EDGE_SQL + "SELECT count(*) FILTER (WHERE source IS NOT NULL AND target IS NOT NULL) AS rows_written, "
    "count(*) FILTER (WHERE source IS NULL OR target IS NULL) AS rows_skipped FROM mp"
)
def edges_from_names_counts(t: Tables) -> DataFrame:
    return identity.edge_name_counts(named_edges(t))


@query(
    RAW_EDGE_SQL + "SELECT lower(name_a) AS name FROM mp WHERE source IS NULL UNION "
    "SELECT lower(name_b) FROM mp WHERE target IS NULL"
)
def edges_unresolved_names(t: Tables) -> DataFrame:
    return identity.unresolved_names(named_edges(t), "name_a", "name_b")


@query(RAW_EDGE_SQL + "SELECT * FROM mp WHERE source IS NOT NULL AND target IS NOT NULL")
def edges_written(t: Tables) -> DataFrame:
    return named_edges(t).filter("source IS NOT NULL AND target IS NOT NULL")


@query(
    """WITH n AS (SELECT c_custkey, c_nationkey AS key, lower(c_name) AS name, CASE WHEN c_acctbal > 0 THEN c_acctbal END AS value FROM customer),
k AS (SELECT s_nationkey AS key, min(s_acctbal) AS v FROM supplier WHERE s_nationkey < 12 GROUP BY 1),
m AS (SELECT replace(lower(s_name), 'supplier', 'customer') AS name, min(s_acctbal) AS v FROM supplier GROUP BY 1)
SELECT c_custkey, coalesce(k.v, m.v, value) AS value, CASE WHEN k.v IS NOT NULL THEN 'key' WHEN m.v IS NOT NULL THEN 'name'
  WHEN value IS NOT NULL THEN 'existing' ELSE 'none' END AS value_source
FROM n LEFT JOIN k USING (key) LEFT JOIN m USING (name)"""
)
def enrich_key_then_name(t: Tables) -> DataFrame:
    nodes = t.customer.select(
        "c_custkey", F.col("c_nationkey").alias("key"), F.col("c_name").alias("name"),
        F.when(F.col("c_acctbal") > 0, F.col("c_acctbal")).alias("value"),
    )
    lookup = t.supplier.select(
        F.when(F.col("s_nationkey") < 12, F.col("s_nationkey")).alias("key"),
        F.regexp_replace("s_name", "Supplier", "Customer").alias("name"), F.col("s_acctbal").alias("value"),
    )
    return identity.enrich_with_priority(nodes, lookup, "value").select("c_custkey", "value", "value_source")


@query(
    """SELECT l_orderkey, l_linenumber, a.s_name AS source, b.s_name AS target FROM lineitem
  JOIN supplier a ON l_suppkey = a.s_suppkey JOIN supplier b ON l_quantity::BIGINT = b.s_suppkey"""
)
def index_pairs_to_structures(t: Tables) -> DataFrame:
    catalogue = t.supplier.select(F.col("s_suppkey").alias("drug_idx"), F.col("s_name").alias("structure"))
    pairs = t.lineitem.select(
        "l_orderkey", "l_linenumber", F.col("l_suppkey").alias("ia"), F.col("l_quantity").cast("long").alias("ib")
    )
    return identity.ids_to_structures(pairs, catalogue, "ia", "ib", strict=False).drop("ia", "ib")


@query(
    """WITH dev AS (SELECT DISTINCT least(l_suppkey, l_partkey // 20) AS a, greatest(l_suppkey, l_partkey // 20) AS b
  FROM lineitem WHERE l_returnflag = 'R')
SELECT o_orderkey FROM orders WHERE EXISTS (SELECT 1 FROM dev WHERE a = least(o_custkey % 90, o_orderkey % 100)
  AND b = greatest(o_custkey % 90, o_orderkey % 100))"""
)
def external_pair_overlap(t: Tables) -> DataFrame:
    external = t.orders.select(
        "o_orderkey", (F.col("o_custkey") % 90).alias("a"), (F.col("o_orderkey") % 100).alias("b")
    )
    development = t.lineitem.filter("l_returnflag = 'R'").select(
        F.col("l_suppkey").alias("a"), F.floor(F.col("l_partkey") / 20).alias("b")
    )
    return identity.external_overlap(external, development, "a", "b").select("o_orderkey")


@query(
    """SELECT (SELECT count(DISTINCT p_brand || p_type || p_size) FROM part) AS corpus,
  (SELECT count(DISTINCT p_brand || p_type || l_quantity::INTEGER) FROM lineitem JOIN part ON l_partkey = p_partkey) AS universe,
  (SELECT count(*) FROM (SELECT p_brand || p_type || p_size FROM part INTERSECT
   SELECT p_brand || p_type || l_quantity::INTEGER FROM lineitem JOIN part ON l_partkey = p_partkey)) AS shared"""
)
def structure_corpus_overlap(t: Tables) -> DataFrame:
    corpus = t.part.select(F.concat("p_brand", "p_type", F.col("p_size").cast("string")).alias("structure"))
    universe = t.lineitem.join(t.part, F.col("l_partkey") == F.col("p_partkey")).select(
        F.concat("p_brand", "p_type", F.col("l_quantity").cast("int").cast("string")).alias("structure")
    )
    return identity.structure_overlap(corpus, universe)


@query(
    """WITH tk AS (SELECT p_partkey, 0 AS col, 'first' AS source_column, upper(p_brand) AS token FROM part UNION ALL
  SELECT p_partkey, 1, 'second', upper(split_part(p_name, ' ', 1)) FROM part UNION ALL
  SELECT p_partkey, 2, 'second', upper(split_part(p_name, ' ', 2)) FROM part),
cat AS (SELECT upper('BRAND#' || (s_suppkey % 9)) AS gene, 'ACC' || s_suppkey AS accession FROM supplier UNION ALL
  SELECT 'RING', 'HOT' UNION ALL SELECT 'BLUE', 'PLATE'),
hit AS (SELECT p_partkey, col, source_column, accession, 0 AS rk FROM tk JOIN cat ON token = upper(accession) UNION ALL
  SELECT p_partkey, col, source_column, a, 1 FROM tk JOIN (SELECT gene, min(accession) AS a FROM cat GROUP BY 1) ON token = gene),
best AS (SELECT * FROM hit QUALIFY row_number() OVER (PARTITION BY p_partkey ORDER BY rk, col) = 1)
SELECT p_partkey, accession, source_column, CASE WHEN rk = 0 THEN 'accession' WHEN rk = 1 THEN 'gene' ELSE 'unmapped' END AS match_kind
FROM part LEFT JOIN best USING (p_partkey)"""
)
def sequence_targets(t: Tables) -> DataFrame:
    nodes = t.part.select("p_partkey", F.col("p_brand").alias("first"), F.regexp_replace("p_name", " ", ";").alias("second"))
    catalogue = t.supplier.select(
        F.concat(F.lit("Brand#"), F.col("s_suppkey") % 9).alias("gene"), F.concat(F.lit("ACC"), "s_suppkey").alias("accession")
    ).unionByName(t.region.filter("r_regionkey = 0").select(F.lit("ring").alias("gene"), F.lit("HOT").alias("accession"))).unionByName(
        t.region.filter("r_regionkey = 1").select(F.lit("Blue").alias("gene"), F.lit("PLATE").alias("accession"))
    )
    return identity.sequence_assignment(nodes, catalogue, "p_partkey", ["first", "second"])


@query(
    """WITH nm AS (SELECT c_custkey, lower(c_name) AS name, 1 AS p FROM customer UNION ALL
  SELECT c_custkey, lower(c_mktsegment || ' ' || c_nationkey), 2 FROM customer UNION ALL
  SELECT c_custkey, 'nation ' || c_nationkey, 3 FROM customer),
an AS (SELECT lower('Customer#' || lpad((s_suppkey * 3)::VARCHAR, 9, '0')) AS name, 'A' || s_suppkey AS code FROM supplier UNION ALL
  SELECT 'building ' || s_nationkey, 'B' || s_suppkey FROM supplier UNION ALL SELECT 'nation ' || s_nationkey, 'C' || s_suppkey FROM supplier WHERE s_suppkey < 20),
one AS (SELECT name, min(code) AS code FROM an GROUP BY 1),
best AS (SELECT c_custkey, code, nm.name FROM nm JOIN one USING (name) QUALIFY row_number() OVER (PARTITION BY c_custkey ORDER BY p) = 1)
SELECT c_custkey AS drug_idx, code, name FROM customer LEFT JOIN best USING (c_custkey)"""
)
def name_priority_codes(t: Tables) -> DataFrame:
    options = F.array(
        F.struct(F.lower("c_name").alias("name"), F.lit(1).alias("priority")),
        F.struct(F.lower(F.concat_ws(" ", "c_mktsegment", F.col("c_nationkey").cast("string"))).alias("name"), F.lit(2).alias("priority")),
        F.struct(F.concat(F.lit("nation "), "c_nationkey").alias("name"), F.lit(3).alias("priority")),
    )
    names = t.customer.select(F.col("c_custkey").alias("drug_idx"), F.explode(options).alias("o")).select("drug_idx", "o.*")
    replies = F.array(
        F.struct(F.concat(F.lit("Customer#"), F.lpad((F.col("s_suppkey") * 3).cast("string"), 9, "0")).alias("name"), F.concat(F.lit("A"), "s_suppkey").alias("code")),
        F.struct(F.concat(F.lit("Building "), "s_nationkey").alias("name"), F.concat(F.lit("B"), "s_suppkey").alias("code")),
        F.when(F.col("s_suppkey") < 20, F.struct(F.concat(F.lit("nation "), "s_nationkey").alias("name"), F.concat(F.lit("C"), "s_suppkey").alias("code"))),
    )
    answers = t.supplier.select(F.explode(F.array_compact(replies)).alias("r")).select("r.*")
    return identity.name_priority_resolution(names, answers)


@query(
    """WITH u AS (SELECT DISTINCT l_suppkey AS drug_idx, l_partkey // 25 AS target, NULL AS cls, 'first' AS source FROM lineitem WHERE l_returnflag = 'R'
  UNION ALL SELECT DISTINCT l_suppkey, l_partkey // 25, CASE WHEN l_partkey // 25 % 3 > 0 THEN 'class' || (l_partkey // 25 % 3) END, 'second' FROM lineitem WHERE l_returnflag = 'A')
SELECT drug_idx, target, max(cls) AS target_class, string_agg(DISTINCT source, '+' ORDER BY source) AS source FROM u GROUP BY 1, 2"""
)
def union_target_sources(t: Tables) -> DataFrame:
    target = F.floor(F.col("l_partkey") / 25)
    first = t.lineitem.filter("l_returnflag = 'R'").select(F.col("l_suppkey").alias("drug_idx"), target.alias("target"))
    second = t.lineitem.filter("l_returnflag = 'A'").select(
        F.col("l_suppkey").alias("drug_idx"), target.alias("target"),
        F.when(target % 3 > 0, F.concat(F.lit("class"), target % 3)).alias("target_class"),
    )
    return identity.union_targets(first, second, ("first", "second"))


@query(
    """WITH ev AS (SELECT DISTINCT lower(p_name) AS n, p_brand AS gene FROM part),
nd AS (SELECT p_partkey AS drug_idx, unnest([lower(p_name), lower('hot ' || split_part(p_name, ' ', 2))]) AS n FROM part),
f AS (SELECT drug_idx, string_agg(DISTINCT gene, ',' ORDER BY gene) AS genes FROM nd JOIN ev USING (n) GROUP BY 1)
SELECT p_partkey AS drug_idx, coalesce(f.genes, p_type) AS genes, f.genes IS NOT NULL AS enriched
FROM part LEFT JOIN f ON p_partkey = drug_idx"""
)
def genes_by_name_or_synonym(t: Tables) -> DataFrame:
    nodes = t.part.select(
        F.col("p_partkey").alias("drug_idx"), F.col("p_name").alias("name"),
        F.array(F.concat(F.lit("Hot "), F.split_part("p_name", F.lit(" "), F.lit(2)))).alias("synonyms"), F.array("p_type").alias("genes"),
    )
    evidence = t.part.select(F.col("p_name").alias("drug_name"), F.col("p_brand").alias("gene"))
    found = identity.enrich_by_name_or_synonym(nodes, evidence)
    return found.select("drug_idx", F.concat_ws(",", "genes").alias("genes"), "enriched")


@query(
    """WITH c AS (SELECT o_custkey, o_orderkey, o_orderpriority, '3-MEDIUM' AS wanted,
  CASE WHEN o_orderpriority = '3-MEDIUM' THEN 0 WHEN o_orderstatus = 'P' THEN 1 ELSE 2 END AS rk FROM orders)
SELECT o_custkey, o_orderkey, CASE rk WHEN 0 THEN 'primary' WHEN 1 THEN 'synonym' ELSE 'first_record' END AS match_kind
FROM c QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY rk, o_orderkey) = 1"""
)
def best_catalogue_match(t: Tables) -> DataFrame:
    rows = t.orders.select(
        "o_custkey", "o_orderkey", F.col("o_orderpriority").alias("primary_name"), F.lit("3-medium").alias("wanted"),
        F.array(F.when(F.col("o_orderstatus") == "P", "3-MEDIUM").otherwise("none")).alias("synonyms"),
    )
    best = identity.best_match(rows, "o_custkey", "wanted", "primary_name", "synonyms", "o_orderkey")
    return best.select("o_custkey", "o_orderkey", "match_kind")


@query(
    """WITH w AS (SELECT DISTINCT l_partkey AS k FROM lineitem),
l AS (SELECT DISTINCT p_partkey AS k FROM part WHERE p_size > 10)
SELECT count(*) AS wanted, count(l.k) AS found, round(count(l.k)::DOUBLE / count(*), 9) AS coverage FROM w LEFT JOIN l USING (k)"""
)
def local_sequence_coverage(t: Tables) -> DataFrame:
    wanted = t.lineitem.select(F.col("l_partkey").alias("k"))
    _, _, coverage = identity.local_then_missing(wanted, t.part.filter("p_size > 10").select(F.col("p_partkey").alias("k")), "k")
    return coverage.withColumn("coverage", F.round("coverage", 9))


@query(
    """WITH m AS (SELECT o_orderkey, o_totalprice / 1000000 AS s FROM orders)
SELECT o_orderkey, round(((s + s * 0.5 + (s + 0.25)) / 3), 9) AS mean_score,
  round(sqrt(((s - (s * 2.5 + 0.25) / 3) ** 2 + (s * 0.5 - (s * 2.5 + 0.25) / 3) ** 2 + (s + 0.25 - (s * 2.5 + 0.25) / 3) ** 2) / 3), 9) AS std_score,
  3::BIGINT AS n_members FROM m"""
)
def ensemble_mean_spread(t: Tables) -> DataFrame:
    base = F.col("o_totalprice") / 1000000
    scores = F.array(
        F.struct(F.lit("m1").alias("member"), base.alias("score")),
        F.struct(F.lit("m2").alias("member"), (base * 0.5).alias("score")),
        F.struct(F.lit("m3").alias("member"), (base + 0.25).alias("score")),
    )
    members = t.orders.select("o_orderkey", F.explode(scores).alias("m")).select("o_orderkey", "m.*")
    aligned = identity.align_members(members, ["o_orderkey"], ["m1", "m2", "m3"], "score")
    out = comparison.ensemble_mean_std(aligned, ["score_m1", "score_m2", "score_m3"])
    return out.select(
        "o_orderkey", F.round("mean_score", 9).alias("mean_score"), F.round("std_score", 9).alias("std_score"), "n_members"
    )


# Text functions.
@query(
    "SELECT c_custkey, nullif(trim(regexp_replace(lower(c_name || ' (' || c_mktsegment || ')'), '[^a-z0-9_]+', ' ', 'g')), '') AS name_key FROM customer"
)
def drug_name_keys(t: Tables) -> DataFrame:
    named = t.customer.select("c_custkey", F.concat("c_name", F.lit(" ("), "c_mktsegment", F.lit(")")).alias("name"))
    return text.with_norm_drug_name(named, "name", "name_key").select("c_custkey", "name_key")


@query(
    "SELECT doc_id, lower(trim(regexp_replace(replace(source || '  ' || lang, chr(9), ' '), '\\s+', ' ', 'g'))) AS name FROM documents"
)
def plain_name_keys(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", text.norm_name(F.concat("source", F.lit("  "), "lang")).alias("name"))


@query(
    """SELECT p_partkey, string_agg(DISTINCT g, ',' ORDER BY g) AS genes FROM
  (SELECT p_partkey, unnest(string_split(p_name || ' ' || p_type || ' ' || p_brand || ' ' || p_type, ' ')) AS g FROM part) GROUP BY 1"""
)
def gene_lists(t: Tables) -> DataFrame:
    """Three encodings of the same list: JSON, quoted literal and delimited, chosen by size."""
    items = F.concat_ws(" ", "p_name", "p_type", "p_brand", "p_type")
    parts = F.split(items, " ")
    encoded = (
        F.when(F.col("p_size") % 3 == 0, F.to_json(parts))
        .when(F.col("p_size") % 3 == 1, F.concat(F.lit("['"), F.concat_ws("', '", parts), F.lit("']")))
        .otherwise(F.concat_ws(";", parts))
    )
    return t.part.select("p_partkey", F.concat_ws(",", text.parse_gene_list(encoded)).alias("genes"))


@query(
    """SELECT p_partkey, d AS drug_name, g AS gene_symbol FROM (SELECT p_partkey, unnest(string_split(p_name, ' ')) AS d, p_brand, p_type FROM part),
  LATERAL (SELECT unnest([p_brand, p_type]) AS g)"""
)
def pathway_drug_gene_rows(t: Tables) -> DataFrame:
    cells = t.part.select(
        "p_partkey", F.regexp_replace("p_name", " ", " ; ").alias("Drugs"), F.concat_ws("|", "p_brand", "p_type", F.lit("")).alias("Genes")
    )
    return text.explode_drugs_genes(cells, "Drugs", "Genes", ["p_partkey"])


@query(
    """SELECT DISTINCT p_brand AS drug_name, unnest([upper(split_part(p_name, ' ', 1)), p_type]) AS gene_symbol FROM part"""
)
def pathway_file_genes(t: Tables) -> DataFrame:
    rows = t.part.select(
        F.concat(F.lit("/data/PA12-"), F.translate("p_brand", "#", "_"), F.lit(".tsv")).alias("file"),
        F.upper(F.split_part("p_name", F.lit(" "), F.lit(1))).alias("c1"), F.concat_ws(",", "p_type", F.lit("lower")).alias("c2"),
    )
    named = rows.withColumn("drug_name", F.translate(text.drug_from_filename(F.col("file")), " ", "#"))
    return text.gene_cells(named, ["c1", "c2"], ["drug_name"])


@query(
    """SELECT p_partkey, lv FROM (SELECT p_partkey, 'B' || lpad((p_size)::VARCHAR, 2, '0') || 'AC' || lpad((p_partkey % 100)::VARCHAR, 2, '0') AS c FROM part),
  LATERAL (SELECT unnest([c[1:1], c[1:3], c[1:4], c[1:5]]) AS lv)"""
)
def code_levels(t: Tables) -> DataFrame:
    code = F.concat(F.lit("b"), F.lpad(F.col("p_size").cast("string"), 2, "0"), F.lit("ac"), F.lpad((F.col("p_partkey") % 100).cast("string"), 2, "0"))
    return t.part.select("p_partkey", F.explode(text.atc_levels(code)).alias("lv"))


@query("SELECT event_id, json_extract_string(props, '$.k') AS codes FROM events WHERE length(json_extract_string(props, '$.k')) = 2")
def json_codes(t: Tables) -> DataFrame:
    found = t.events.select("event_id", F.concat_ws("|", text.find_codes_in_json(F.col("props"), "k", "^[0-9]{2}$")).alias("codes"))
    return found.filter("codes <> ''")


@query(
    "SELECT DISTINCT o_custkey, c AS code FROM (SELECT o_custkey, unnest([o_orderpriority, o_orderstatus]) AS c FROM orders)"
)
def long_codes(t: Tables) -> DataFrame:
    rows = t.orders.select("o_custkey", F.concat_ws("|", "o_orderpriority", F.lit(""), "o_orderstatus").alias("codes"))
    return text.explode_codes(rows, "o_custkey", "codes", "code")


LABEL_TEXT_SQL = "regexp_replace(regexp_replace(regexp_replace(text, '\\b[Tt]he\\b', 'CYP 3A4', 'g'), '\\band\\b', 'inhibits', 'g'), '\\bof\\b', 'induced', 'g')"


def label_text():
    c = F.regexp_replace("text", r"\b[Tt]he\b", "CYP 3A4")
    return F.regexp_replace(F.regexp_replace(c, r"\band\b", "inhibits"), r"\bof\b", "induced")


@query(
    f"""WITH d AS (SELECT doc_id, {LABEL_TEXT_SQL} AS x FROM documents)
SELECT doc_id, regexp_matches(x, '(?s)CYP 3A4.{{0,93}}inhibit|inhibit.{{0,93}}CYP 3A4')::INTEGER AS inhibitor,
  regexp_matches(x, '(?s)CYP 3A4.{{0,95}}induc|induc.{{0,95}}CYP 3A4')::INTEGER AS inducer FROM d"""
)
def enzyme_role_flags(t: Tables) -> DataFrame:
    docs = t.documents.select("doc_id", label_text().alias("x"))
    return docs.select(
        "doc_id", text.cyp_flag(F.col("x"), "3A4", "inhibitor").alias("inhibitor"),
        text.cyp_flag(F.col("x"), "3A4", "inducer").alias("inducer"),
    )


@query(
    """WITH w AS (SELECT DISTINCT lower(unnest(regexp_split_to_array(text, '[^\\p{L}\\p{N}\\p{M}_]+'))) AS name FROM benchmark),
lex AS (SELECT name, min(length(name)) OVER () AS z FROM w WHERE length(name) >= 5),
tok AS (SELECT doc_id, lower(unnest(regexp_split_to_array(text, '[^\\p{L}\\p{N}\\p{M}_]+'))) AS name FROM documents)
SELECT doc_id, name, count(*) AS n_mentions FROM tok JOIN lex USING (name) GROUP BY 1, 2"""
)
def label_mentions(t: Tables) -> DataFrame:
    words = t.benchmark.select(F.explode(F.split("text", r"(?U)[^\w]+")).alias("name")).select(F.lower("name").alias("name"))
    lexicon = words.distinct().filter("length(name) >= 5").withColumn("name_id", F.xxhash64("name"))
    found = text.find_mentions(t.documents.select("doc_id", "text"), "doc_id", "text", lexicon)
    return found.join(lexicon, "name_id").select("doc_id", "name", "n_mentions")


@query(
    """WITH r AS (SELECT p_partkey AS record_id, CASE WHEN p_size % 4 = 0 THEN [lower(p_name || ' ' || p_size), lower(p_type)]
  WHEN p_size % 4 = 1 THEN [lower(p_name || ' ' || p_size)] ELSE [] END AS subs,
  CASE WHEN p_size % 4 = 3 THEN lower(p_name || ' and ' || p_size) ELSE lower(p_name || ' ' || p_size) END AS gen FROM part),
""" + NAMES_SQL.strip().removeprefix("WITH") + """,
ok AS (SELECT * FROM r WHERE len(subs) <= 1 AND NOT (len(subs) = 0 AND contains(gen, ' and '))),
c AS (SELECT record_id, unnest(list_distinct(list_append(subs, gen))) AS name FROM ok)
SELECT record_id, min(drug_idx) AS drug_idx FROM c JOIN uniq USING (name) GROUP BY 1 HAVING count(DISTINCT drug_idx) = 1"""
)
def label_attribution(t: Tables) -> DataFrame:
    kind = F.col("p_size") % 4
    none = F.array().cast("array<string>")
    records = t.part.select(
        F.col("p_partkey").alias("record_id"),
        F.when(kind == 0, F.array(sized_name(), F.col("p_type"))).when(kind == 1, F.array(sized_name())).otherwise(none).alias("substances"),
        F.array(F.when(kind == 3, F.concat_ws(" and ", "p_name", F.col("p_size").cast("string"))).otherwise(sized_name())).alias("generics"),
    )
    return identity.attribute_labels(records, identity.unambiguous_name_map(part_names(t)))


@query(
    """SELECT p_partkey, nullif(regexp_replace(upper(p_name || p_type), '[^ACDEFGHIKLMNPQRSTVWY]', '', 'g'), '') AS sequence FROM part"""
)
def cleaned_sequences(t: Tables) -> DataFrame:
    return t.part.select("p_partkey", text.clean_sequence(F.concat("p_name", "p_type")).alias("sequence"))


@query(
    """SELECT DISTINCT p_partkey, s AS symbol FROM part
  JOIN (VALUES ('ring', 'RNG1'), ('HOT', 'HTR2'), ('late', 'PLT3'), ('t p', 'TWO4'), ('-', 'HYP5')) AS a(k, s) ON contains(lower(p_name || '-' || p_size), lower(k))"""
)
def target_symbols(t: Tables) -> DataFrame:
    aliases = t.region.select(
        F.get(F.array(*map(F.lit, ["ring", "HOT", "late", "t p", "-"])), F.col("r_regionkey")).alias("pattern"),
        F.get(F.array(*map(F.lit, ["RNG1", "HTR2", "PLT3", "TWO4", "HYP5"])), F.col("r_regionkey")).alias("symbol"),
    ).dropna()
    named = t.part.select("p_partkey", F.concat_ws("-", "p_name", F.col("p_size").cast("string")).alias("name"))
    return text.target_aliases(named, "name", aliases).select("p_partkey", "symbol")


@query("SELECT p_partkey, (contains(x, '=') OR contains(x, '#')) AS is_structure FROM (SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN p_brand ELSE p_name END AS x FROM part)")
def structure_like_names(t: Tables) -> DataFrame:
    name = F.when(F.col("p_size") % 2 == 0, F.col("p_brand")).otherwise(F.col("p_name"))
    return t.part.select("p_partkey", clean.looks_like_structure(name).alias("is_structure"))


@query(
    """SELECT DISTINCT tok AS token, 'gene' AS kind FROM (SELECT upper(unnest(string_split(p_name || ' ' || p_type || ' ' || replace(p_brand, '#', ''), ' '))) AS tok FROM part)
  WHERE regexp_full_match(tok, '[A-Z][A-Z0-9-]{1,14}') AND NOT regexp_full_match(tok, '[A-Z][0-9]+[A-Z]')"""
)
def target_token_list(t: Tables) -> DataFrame:
    nodes = t.part.select(F.regexp_replace("p_name", " ", ", ").alias("c1"), F.concat_ws("|", "p_type", F.translate("p_brand", "#", "")).alias("c2"))
    return clean.target_tokens(nodes, ["c1", "c2"])


@query("SELECT reason, count(*) AS n FROM (SELECT coalesce(nullif(concat_ws('|', CASE WHEN l_tax > 0.05 THEN 'tax' END, CASE WHEN l_discount > 0.05 THEN 'discount' END), ''), 'none') AS reason FROM lineitem) GROUP BY 1")
def reason_strings(t: Tables) -> DataFrame:
    reason = numeric.reason_string({"tax": F.col("l_tax") > 0.05, "discount": F.col("l_discount") > 0.05})
    return t.lineitem.select(reason.alias("reason")).groupBy("reason").agg(F.count(F.lit(1)).alias("n"))

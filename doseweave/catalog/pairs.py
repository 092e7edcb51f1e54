"""Pair-event, profile and set queries over line items.

Supplier pairs: a line joins its supplier with the supplier whose number is the part's block of twenty. Part
pairs: a line joins its part with a part numbered by its supplier and line. Both are read off one row, so no
order, however large, is ever joined with itself.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from doseweave.catalog.registry import Tables, query
from doseweave.functions import numeric
from doseweave.operators import clean, events, profiles
from doseweave.plans.hashing import priority

#: A drug is known in training if its hash lies in the first seven tenths, whatever the number of drugs.
KNOWN_EDGE = "b333"
KNOWN_SQL = f"(sha256('21' || chr(0) || {{}}) < '{KNOWN_EDGE}')"

EDGES_SQL = """
WITH raw AS (SELECT 'S' || l_suppkey AS source, 'S' || (l_partkey // 20) AS target,
  CASE WHEN l_linenumber = 7 AND l_tax = 0 THEN NULL ELSE l_returnflag || l_linestatus END AS ev FROM lineitem),
facts AS (SELECT DISTINCT least(source, target) AS a, greatest(source, target) AS b, ev FROM raw WHERE ev IS NOT NULL AND source <> target),
drugs AS (SELECT d, row_number() OVER (ORDER BY d) - 1 AS i FROM (SELECT a AS d FROM facts UNION SELECT b FROM facts)),
evs AS (SELECT ev, count(*) AS n_pairs, row_number() OVER (ORDER BY ev) - 1 AS event_idx FROM facts GROUP BY ev),
coded AS (SELECT x.i AS drug_a, y.i AS drug_b, event_idx FROM facts JOIN drugs x ON a = x.d JOIN drugs y ON b = y.d JOIN evs USING (ev)),
prs AS (SELECT drug_a, drug_b, row_number() OVER (ORDER BY drug_a, drug_b) - 1 AS pair_id FROM (SELECT DISTINCT drug_a, drug_b FROM coded)),
labels_ AS (SELECT pair_id, event_idx FROM coded JOIN prs USING (drug_a, drug_b)),
""" + "train AS (SELECT pair_id FROM prs WHERE " + KNOWN_SQL.format("drug_a") + " AND " + KNOWN_SQL.format("drug_b") + ")\n"


def supplier_edges(t: Tables) -> DataFrame:
    event = F.when(~((F.col("l_linenumber") == 7) & (F.col("l_tax") == 0)), F.concat("l_returnflag", "l_linestatus"))
    return t.lineitem.select(
        F.concat(F.lit("S"), "l_suppkey").alias("source"),
        F.concat(F.lit("S"), F.floor(F.col("l_partkey") / 20)).alias("target"), event.alias("interaction_type"),
    )


def supplier_table(t: Tables) -> events.EventTable:
    return events.event_table(supplier_edges(t))


def known(drug: str) -> Column:
    return priority(21, F.col(drug)) < KNOWN_EDGE


def known_pairs(table: events.EventTable) -> DataFrame:
    return table.pairs.filter(known("drug_a") & known("drug_b"))


def train_pairs(table: events.EventTable) -> DataFrame:
    return known_pairs(table).select("pair_id")


@query(EDGES_SQL + "SELECT pair_id, drug_a, drug_b FROM prs")
def event_table_pairs(t: Tables) -> DataFrame:
    return supplier_table(t).pairs


@query(EDGES_SQL + "SELECT pair_id, event_idx FROM labels_")
def event_table_labels(t: Tables) -> DataFrame:
    return supplier_table(t).labels


@query(EDGES_SQL + "SELECT ev AS event, n_pairs, event_idx FROM evs")
def event_table_events(t: Tables) -> DataFrame:
    return supplier_table(t).events


@query(EDGES_SQL + "SELECT d AS smiles, i AS drug_idx FROM drugs")
def event_table_drugs(t: Tables) -> DataFrame:
    return supplier_table(t).drugs


@query(
    EDGES_SQL + """SELECT count(*) AS n_rows, count(*) FILTER (WHERE ev IS NULL) AS n_missing,
  count(*) FILTER (WHERE ev IS NOT NULL AND source = target) AS n_self, (SELECT count(*) FROM facts) AS n_labels,
  (SELECT count(*) FROM prs) AS n_pairs,
  count(*) FILTER (WHERE ev IS NOT NULL AND source <> target) - (SELECT count(*) FROM facts) AS n_duplicates FROM raw"""
)
def event_table_accounting(t: Tables) -> DataFrame:
    return events.event_table_report(supplier_edges(t))


@query(
    EDGES_SQL + """SELECT (SELECT count(*) FROM prs) AS n_pairs, (SELECT count(*) FROM drugs) AS n_drugs, (SELECT count(*) FROM evs) AS n_events,
  (SELECT count(*) FROM labels_) AS n_labels, TRUE AS ordered_no_loops, TRUE AS dense_pair_ids, TRUE AS labels_unique, TRUE AS drug_ids_in_range,
  round((SELECT count(*) FROM labels_)::DOUBLE / ((SELECT count(*) FROM prs) * (SELECT count(*) FROM evs)), 9) AS density"""
)
def event_table_audit(t: Tables) -> DataFrame:
    from doseweave.operators.splits import audit_event_table

    table = supplier_table(t)
    return audit_event_table(table.pairs, table.labels, table.drugs, table.events).withColumn("density", F.round("density", 9))


@query(EDGES_SQL + "SELECT a AS source, b AS target, ev AS interaction_type FROM facts")
def unified_pair_edges(t: Tables) -> DataFrame:
    return events.unified_edges(supplier_edges(t))


@query(EDGES_SQL + "SELECT count(*) AS n_rows, count(*) FILTER (WHERE ev IS NULL) AS n_missing, count(*) FILTER (WHERE ev IS NOT NULL AND source = target) AS n_self FROM raw")
def edge_drop_counts(t: Tables) -> DataFrame:
    return clean.edge_drop_counts(supplier_edges(t), "source", "target", "interaction_type")


VOCAB_SQL = EDGES_SQL + """, pos AS (SELECT event_idx, count(*) AS train_pos FROM labels_ SEMI JOIN train USING (pair_id) GROUP BY 1),
vocab AS (SELECT event_idx, train_pos, (SELECT count(*) FROM train) - train_pos AS train_neg FROM pos WHERE train_pos >= 20 AND (SELECT count(*) FROM train) - train_pos >= 1),
head AS (SELECT *, row_number() OVER (ORDER BY event_idx) - 1 AS head_idx FROM vocab)
"""


@query(VOCAB_SQL + "SELECT head_idx, event_idx, train_pos, train_neg, round(least(train_neg / greatest(train_pos, 1), 0.5), 9)::DOUBLE AS pos_weight FROM head")
def frozen_vocabulary(t: Tables) -> DataFrame:
    table = supplier_table(t)
    vocabulary = events.freeze_vocabulary(table.labels, train_pairs(table), min_pos=20)
    return events.pos_weights(vocabulary, clip=0.5).withColumn("pos_weight", F.round("pos_weight", 9))


#: Pairs an event needs in the full table for a place in the vocabulary.
FULL_SUPPORT = 30


@query(
    EDGES_SQL + f""", pos AS (SELECT event_idx, count(*) AS train_pos FROM labels_ SEMI JOIN train USING (pair_id) GROUP BY 1),
least_ AS (SELECT ceil({FULL_SUPPORT} * (SELECT count(*) FROM train) / (SELECT count(*) FROM prs)) AS m)
SELECT event_idx, train_pos, (SELECT m FROM least_)::BIGINT AS min_pairs FROM pos WHERE train_pos >= (SELECT m FROM least_) AND train_pos < (SELECT count(*) FROM train)"""
)
def scaled_vocabulary(t: Tables) -> DataFrame:
    """The vocabulary under the full table's support rule, scaled to the part of its pairs that train."""
    table = supplier_table(t)
    train = train_pairs(table)
    least = events.scaled_min_pairs(FULL_SUPPORT, train.count(), table.pairs.count())
    return events.freeze_vocabulary(table.labels, train, least).select("event_idx", "train_pos", F.lit(least).cast("long").alias("min_pairs"))


PARTS_SQL = VOCAB_SQL + f""", seen AS (SELECT pair_id, {KNOWN_SQL.format('drug_a')} AS x, {KNOWN_SQL.format('drug_b')} AS y FROM prs),
parts AS (SELECT pair_id, CASE WHEN x AND y THEN 'train' WHEN NOT x AND NOT y THEN 's1' ELSE 's2' END AS part FROM seen)
"""


def partition() -> Column:
    a, b = known("drug_a"), known("drug_b")
    return F.when(a & b, "train").when(~a & ~b, "s1").otherwise("s2")


def partitions(table: events.EventTable) -> DataFrame:
    return table.pairs.select("pair_id", partition().alias("partition"))


@query(
    PARTS_SQL + "SELECT event_idx, "
    + ", ".join(
        f"count(*) FILTER (WHERE part = '{p}') AS pos_{p}, count(*) FILTER (WHERE part = '{p}') >= 5 AND "
        f"(SELECT count(*) FROM parts WHERE part = '{p}') - count(*) FILTER (WHERE part = '{p}') >= 5 AS evaluable_{p}"
        for p in ("train", "s1", "s2")
    )
    + " FROM head JOIN labels_ USING (event_idx) JOIN parts USING (pair_id) GROUP BY 1"
)
def event_partition_support(t: Tables) -> DataFrame:
    table = supplier_table(t)
    vocabulary = events.freeze_vocabulary(table.labels, train_pairs(table), min_pos=20)
    return events.event_support(table.labels, vocabulary, partitions(table), ["train", "s1", "s2"])


@query(VOCAB_SQL + "SELECT pair_id, event_idx, (EXISTS (SELECT 1 FROM labels_ l WHERE l.pair_id = prs.pair_id AND l.event_idx = head.event_idx))::INTEGER AS label FROM prs, head")
def pair_event_grid(t: Tables) -> DataFrame:
    table = supplier_table(t)
    vocabulary = events.freeze_vocabulary(table.labels, train_pairs(table), min_pos=20)
    return events.label_grid(table.pairs, vocabulary, table.labels)


@query(VOCAB_SQL + "SELECT event_idx, round((train_pos + 1)::DOUBLE / ((SELECT count(*) FROM train) + 2), 9) AS prior FROM head")
def event_frequency_prior(t: Tables) -> DataFrame:
    table = supplier_table(t)
    vocabulary = events.freeze_vocabulary(table.labels, train_pairs(table), min_pos=20)
    return events.frequency_prior(table.labels, train_pairs(table), vocabulary).withColumn("prior", F.round("prior", 9))


DEDUPE_SQL = "SELECT DISTINCT least(l_suppkey, l_partkey // 20) AS a, greatest(l_suppkey, l_partkey // 20) AS b, (least(l_suppkey, l_partkey // 20) % 2)::INTEGER AS label FROM lineitem"


@query(DEDUPE_SQL)
def deduplicated_pairs(t: Tables) -> DataFrame:
    a, b = F.col("l_suppkey"), F.floor(F.col("l_partkey") / 20)
    rows = t.lineitem.select(a.alias("a"), b.alias("b"), (F.least(a, b) % 2).cast("int").alias("label"))
    return events.dedupe_pairs(rows, "a", "b", "label")


@query(
    """SELECT least(l_suppkey, l_partkey // 20) AS a, greatest(l_suppkey, l_partkey // 20) AS b, min(l_returnflag) AS first_label, max(l_returnflag) AS last_label
  FROM lineitem GROUP BY 1, 2 HAVING min(l_returnflag) <> max(l_returnflag) ORDER BY 1, 2 LIMIT 5"""
)
def conflicting_pair_labels(t: Tables) -> DataFrame:
    rows = t.lineitem.select(F.col("l_suppkey").alias("a"), F.floor(F.col("l_partkey") / 20).alias("b"), "l_returnflag")
    return events.label_conflicts(rows, "a", "b", "l_returnflag")


@query("SELECT 'ev' || l_quantity::INTEGER AS interaction_type, count(*) AS n FROM lineitem GROUP BY 1 ORDER BY n DESC, 1 LIMIT 20")
def top_side_effects(t: Tables) -> DataFrame:
    rows = t.lineitem.select(F.concat(F.lit("ev"), F.col("l_quantity").cast("int")).alias("interaction_type"))
    return events.top_k_items(rows, "interaction_type", 20)


@query("SELECT item, count(*) AS n FROM (SELECT unnest(string_split(p_name || ' ' || p_type, ' ')) AS item FROM part) GROUP BY 1 ORDER BY n DESC, item LIMIT 10")
def top_item_vocabulary(t: Tables) -> DataFrame:
    lists = t.part.select(F.split(F.concat_ws(" ", "p_name", "p_type"), " ").alias("items"))
    return events.top_k_vocabulary(lists, "items", 10)


@query(
    EDGES_SQL + """, top AS (SELECT ev, row_number() OVER (ORDER BY count(*) DESC, ev) AS r FROM raw WHERE ev IS NOT NULL AND source <> target GROUP BY ev ORDER BY r LIMIT 3)
SELECT p.a AS source, p.b AS target, string_agg(CASE WHEN EXISTS (SELECT 1 FROM facts f WHERE f.a = p.a AND f.b = p.b AND f.ev = top.ev) THEN '1' ELSE '0' END, '' ORDER BY r) AS bits
FROM (SELECT DISTINCT a, b FROM facts) p, top GROUP BY 1, 2"""
)
def multitask_label_vectors(t: Tables) -> DataFrame:
    out = events.multitask_labels(supplier_edges(t), 3)
    return out.select("source", "target", F.array_join(F.transform("labels", lambda x: x.cast("string")), "").alias("bits"))


@query(EDGES_SQL + "SELECT d AS drug, count(*) AS degree FROM (SELECT drug_a AS d FROM prs JOIN train USING (pair_id) UNION ALL SELECT drug_b FROM prs JOIN train USING (pair_id)) GROUP BY 1")
def training_degree(t: Tables) -> DataFrame:
    table = supplier_table(t)
    return events.degree(known_pairs(table))


@query(
    EDGES_SQL + """, dg AS (SELECT d, count(*) AS n FROM (SELECT drug_a AS d FROM prs JOIN train USING (pair_id) UNION ALL SELECT drug_b FROM prs JOIN train USING (pair_id)) GROUP BY 1)
SELECT pair_id, round(ln(1 + coalesce(x.n, 0)) + ln(1 + coalesce(y.n, 0)), 9) AS popularity FROM prs LEFT JOIN dg x ON drug_a = x.d LEFT JOIN dg y ON drug_b = y.d"""
)
def pair_popularity(t: Tables) -> DataFrame:
    table = supplier_table(t)
    scored = events.popularity_score(table.pairs, known_pairs(table))
    return scored.select("pair_id", F.round("popularity", 9).alias("popularity"))


# Cleaning over pairs.
@query(
    """WITH ids AS (SELECT s_suppkey AS id FROM supplier WHERE s_acctbal < 1500), p AS (SELECT l_suppkey AS a, l_partkey // 20 AS b FROM lineitem)
SELECT DISTINCT least(a, b) AS a, greatest(a, b) AS b FROM p WHERE a IN (SELECT id FROM ids) OR b IN (SELECT id FROM ids)"""
)
def reviewed_pair_exclusions(t: Tables) -> DataFrame:
    ids = t.supplier.filter("s_acctbal < 1500").select(F.col("s_suppkey").alias("id"))
    pairs = t.lineitem.select(F.col("l_suppkey").alias("a"), F.floor(F.col("l_partkey") / 20).alias("b"))
    return clean.exclude_pairs_by_endpoint(pairs, ids, "a", "b")[1]


@query(
    """WITH ids AS (SELECT c_custkey AS id FROM customer WHERE c_acctbal < -900), p AS (SELECT l_suppkey AS a, l_partkey // 20 AS b FROM lineitem)
SELECT id FROM ids WHERE id NOT IN (SELECT a FROM p) AND id NOT IN (SELECT b FROM p)"""
)
def reviewed_ids_unknown(t: Tables) -> DataFrame:
    ids = t.customer.filter("c_acctbal < -900").select(F.col("c_custkey").alias("id"))
    pairs = t.lineitem.select(F.col("l_suppkey").alias("a"), F.floor(F.col("l_partkey") / 20).alias("b"))
    return clean.unknown_ids(ids, pairs, "a", "b")


REASON_SQL = """
WITH rs AS (SELECT s_suppkey AS v, min(CASE WHEN s_acctbal < 0 THEN 'invalid_structure' ELSE 'too_large' END) AS reason FROM supplier WHERE s_acctbal < 0 OR s_acctbal > 9000 GROUP BY 1),
mk AS (SELECT l_suppkey AS a, l_partkey // 20 AS b, x.reason AS ra, y.reason AS rb FROM lineitem LEFT JOIN rs x ON l_suppkey = x.v LEFT JOIN rs y ON l_partkey // 20 = y.v)
"""


def marked_pairs(t: Tables) -> DataFrame:
    reasons = t.supplier.filter("s_acctbal < 0 OR s_acctbal > 9000").select(
        F.col("s_suppkey").alias("value"), F.when(F.col("s_acctbal") < 0, "invalid_structure").otherwise("too_large").alias("reason")
    )
    pairs = t.lineitem.select(F.col("l_suppkey").alias("a"), F.floor(F.col("l_partkey") / 20).alias("b"))
    return clean.partition_compatible(pairs, reasons, "a", "b")


@query(REASON_SQL + "SELECT coalesce(ra, 'graph_compatible') AS status_a, coalesce(rb, 'graph_compatible') AS status_b, ra IS NULL AND rb IS NULL AS compatible, count(*) AS n FROM mk GROUP BY ALL")
def compatible_pair_statuses(t: Tables) -> DataFrame:
    return marked_pairs(t).groupBy("status_a", "status_b", "compatible").agg(F.count(F.lit(1)).alias("n"))


@query(
    REASON_SQL + """, sd AS (SELECT a AS v, ra AS reason, 'source' AS side FROM mk WHERE ra IS NOT NULL UNION ALL SELECT b, rb, 'target' FROM mk WHERE rb IS NOT NULL)
SELECT v AS value, reason, count(*) AS occurrences, string_agg(DISTINCT side, '|' ORDER BY side) AS sides_observed, 'pending_review' AS review_status FROM sd GROUP BY 1, 2"""
)
def structure_curation_queue(t: Tables) -> DataFrame:
    return clean.curation_queue(marked_pairs(t), "a", "b")


@query("SELECT label, count(*) AS n FROM (SELECT CASE WHEN l_returnflag = 'R' THEN 1 WHEN l_returnflag = 'A' THEN 0 END AS label FROM lineitem) GROUP BY 1")
def parsed_binary_labels(t: Tables) -> DataFrame:
    text = F.when(F.col("l_returnflag") == "R", " Yes ").when(F.col("l_returnflag") == "A", "0.0").otherwise("maybe")
    return t.lineitem.select(clean.parse_binary_label(text).alias("label")).groupBy("label").agg(F.count(F.lit(1)).alias("n"))


@query(
    """WITH g AS (SELECT l_suppkey AS key, count(*) FILTER (WHERE l_returnflag = 'R') AS k, count(*) AS n FROM lineitem GROUP BY 1),
v AS (SELECT key, CASE WHEN key = 5 THEN n + 1 ELSE k END AS k, n, CASE WHEN key = 9 THEN 0.5 ELSE (CASE WHEN key = 5 THEN n + 1 ELSE k END)::DOUBLE / n END AS f FROM g UNION ALL SELECT 3, 1, 1, 1.0)
SELECT count(*) FILTER (WHERE k < 0 OR k > n) AS bad_range, count(*) FILTER (WHERE n <= 0) AS bad_total, count(*) FILTER (WHERE abs(k::DOUBLE / n - f) > 1e-10) AS bad_fraction,
  (SELECT count(*) FROM (SELECT key FROM v GROUP BY 1 HAVING count(*) > 1)) AS duplicate_keys FROM v"""
)
def label_count_violations(t: Tables) -> DataFrame:
    counts = t.lineitem.groupBy(F.col("l_suppkey").alias("key")).agg(
        F.count_if(F.col("l_returnflag") == "R").alias("k"), F.count(F.lit(1)).alias("n")
    ).withColumn("k", F.when(F.col("key") == 5, F.col("n") + 1).otherwise(F.col("k")))
    rows = counts.withColumn("f", F.when(F.col("key") == 9, 0.5).otherwise(F.col("k") / F.col("n")))
    extra = t.region.filter("r_regionkey = 0").select(
        F.lit(3).cast("long").alias("key"), F.lit(1).cast("long").alias("k"), F.lit(1).cast("long").alias("n"), F.lit(1.0).alias("f")
    )
    return clean.count_violations(rows.unionByName(extra), "key", "k", "n", "f")


@query(
    """SELECT 'empty_id' AS rule, 0::BIGINT AS violations UNION ALL SELECT 'duplicate_id', 0 UNION ALL
SELECT 'bad_inchikey', count(*) FROM supplier UNION ALL SELECT 'negative_reports', count(*) FROM supplier WHERE s_acctbal < 0 UNION ALL
SELECT 'self_loop', count(*) FROM lineitem WHERE l_suppkey = l_partkey // 20 UNION ALL SELECT 'bad_confidence', 0 UNION ALL
SELECT 'bad_split_group', count(*) FROM lineitem WHERE l_returnflag = 'N' UNION ALL
SELECT 'dangling_endpoint', count(*) FROM (SELECT l_suppkey AS x FROM lineitem UNION SELECT l_partkey // 20 FROM lineitem) WHERE x NOT IN (SELECT s_suppkey FROM supplier)"""
)
def catalogue_violations(t: Tables) -> DataFrame:
    nodes = t.supplier.select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("inchikey"), F.col("s_acctbal").alias("n_reports"))
    group = F.when(F.col("l_returnflag") == "A", "train").when(F.col("l_returnflag") == "R", "test").otherwise("other")
    edges = t.lineitem.select(
        F.col("l_suppkey").alias("a"), F.floor(F.col("l_partkey") / 20).alias("b"), F.col("l_discount").alias("confidence"), group.alias("split_group")
    )
    return clean.catalogue_violations(nodes, edges)


@query(
    """WITH e AS (SELECT CASE WHEN p_size % 3 = 0 THEN 'Chemical' WHEN p_size % 3 = 1 THEN 'Gene' ELSE 'Disease' END AS t1, p_name AS n1,
  CASE WHEN p_size % 5 < 2 THEN 'gene ' ELSE 'Chemical' END AS t2, p_brand AS n2 FROM part)
SELECT DISTINCT CASE WHEN t1 = 'Chemical' THEN n1 ELSE n2 END AS drug_name, CASE WHEN t1 = 'Chemical' THEN n2 ELSE n1 END AS gene FROM e
WHERE (t1 = 'Chemical' AND t2 = 'gene ') OR (t1 = 'Gene' AND t2 = 'Chemical')"""
)
def oriented_relations(t: Tables) -> DataFrame:
    rows = t.part.select(
        F.when(F.col("p_size") % 3 == 0, "Chemical").when(F.col("p_size") % 3 == 1, "Gene").otherwise("Disease").alias("entity1_type"),
        F.col("p_name").alias("entity1_name"),
        F.when(F.col("p_size") % 5 < 2, "gene ").otherwise("Chemical").alias("entity2_type"), F.col("p_brand").alias("entity2_name"),
    )
    return clean.orient_relations(rows)


# Profiles.
@query(
    """SELECT p_brand AS structure, string_agg(DISTINCT p_type, ',' ORDER BY p_type) AS genes, count(DISTINCT p_type) AS n_genes, count(*) AS evidence_rows
  FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1"""
)
def gene_profiles(t: Tables) -> DataFrame:
    evidence = t.lineitem.join(t.part, F.col("l_partkey") == F.col("p_partkey")).select(
        F.col("p_brand").alias("structure"), F.col("p_type").alias("gene")
    )
    return profiles.gene_profiles(evidence).withColumn("genes", F.concat_ws(",", "genes"))


@query(
    """SELECT p_brand AS key, string_agg(DISTINCT p_size::VARCHAR, ',' ORDER BY p_size::VARCHAR) AS ids, string_agg(DISTINCT p_type, ',' ORDER BY p_type) AS targets,
  round(avg(p_retailprice), 3) AS mean_value FROM part GROUP BY 1"""
)
def structure_profiles(t: Tables) -> DataFrame:
    records = t.part.select(
        F.col("p_brand").alias("key"), F.col("p_size").cast("string").alias("record_id"), F.col("p_type").alias("target"),
        F.col("p_retailprice").alias("value"),
    )
    return profiles.structure_profile(records).withColumns({"ids": F.concat_ws(",", "ids"), "targets": F.concat_ws(",", "targets")})


@query(
    """WITH e AS (SELECT l_suppkey AS drug, 'T' || (l_partkey % 17) AS target, arg_max(l_extendedprice, l_orderkey * 100000 + l_partkey) AS v FROM lineitem GROUP BY 1, 2)
SELECT drug, string_agg(target || '=' || v::VARCHAR, ',' ORDER BY target) AS profile FROM e GROUP BY 1"""
)
def affinity_profiles(t: Tables) -> DataFrame:
    edges = t.lineitem.select(
        F.col("l_suppkey").alias("drug"), F.concat(F.lit("T"), F.col("l_partkey") % 17).alias("target"),
        F.col("l_extendedprice").alias("value"), (F.col("l_orderkey") * 100000 + F.col("l_partkey")).alias("seq"),
    )
    out = profiles.affinity_profile(edges, "seq")
    entry = F.transform(F.map_entries("affinities"), lambda e: F.concat_ws("=", e["key"], e["value"].cast("string")))
    return out.select("drug", F.concat_ws(",", entry).alias("profile"))


EXPR_SQL = """
WITH pr AS (SELECT l_returnflag AS disease, 'G' || (l_partkey // 10) AS gene, l_partkey AS probe, CASE WHEN count(*) > 1 THEN stddev_pop(l_quantity) ELSE abs(max(l_quantity)) END AS s
  FROM lineitem GROUP BY 1, 2, 3),
gn AS (SELECT disease, gene, max(s) AS score FROM pr GROUP BY 1, 2),
sig AS (SELECT disease, gene, score / max(score) OVER (PARTITION BY disease) AS score FROM gn QUALIFY row_number() OVER (PARTITION BY disease ORDER BY score DESC, gene) <= 40)
"""


def expression_signatures(t: Tables) -> DataFrame:
    rows = t.lineitem.select(
        F.col("l_returnflag").alias("disease"), F.concat(F.lit("G"), F.floor(F.col("l_partkey") / 10)).alias("gene"),
        F.col("l_partkey").alias("probe"), F.col("l_quantity").alias("value"),
    )
    return profiles.gene_scores(rows, ["disease"], top=40)


@query(EXPR_SQL + "SELECT disease, gene, round(score, 6) AS score FROM sig")
def expression_gene_scores(t: Tables) -> DataFrame:
    return expression_signatures(t).withColumn("score", F.round("score", 6))


@query(
    EXPR_SQL + """, dg AS (SELECT DISTINCT l_suppkey AS drug, 'G' || (l_partkey // 10) AS gene FROM lineitem)
SELECT drug, disease, round(avg(score), 4) AS overlap FROM dg JOIN sig USING (gene) GROUP BY 1, 2"""
)
def disease_signature_overlap(t: Tables) -> DataFrame:
    genes = t.lineitem.select(
        F.col("l_suppkey").alias("drug"), F.concat(F.lit("G"), F.floor(F.col("l_partkey") / 10)).alias("gene")
    )
    return profiles.signature_overlap(genes, expression_signatures(t))


@query(
    """WITH tg AS (SELECT l_suppkey AS drug, l_partkey AS vec_id, max(CASE WHEN l_returnflag = 'R' THEN 2.0 ELSE 1.0 END)::DOUBLE AS w FROM lineitem GROUP BY 1, 2),
x AS (SELECT drug, w, unnest(embedding)::DOUBLE AS v, generate_subscripts(embedding, 1) AS i FROM tg JOIN embeddings USING (vec_id)),
m AS (SELECT drug, i, sum(w * v) / sum(w) AS v FROM x GROUP BY 1, 2)
SELECT drug, round(sum(v * i), 6) AS checksum, count(*)::INTEGER AS dims FROM m GROUP BY 1"""
)
def weighted_target_vectors(t: Tables) -> DataFrame:
    targets = t.lineitem.groupBy(F.col("l_suppkey").alias("drug"), F.col("l_partkey").alias("target")).agg(
        F.max(F.when(F.col("l_returnflag") == "R", 2.0).otherwise(1.0)).alias("weight")
    )
    vectors = t.embeddings.select(F.col("vec_id").alias("target"), F.col("embedding").alias("vector"))
    out = profiles.weighted_mean_vector(targets, vectors).filter("is_known")
    place = F.transform("vector", lambda v, i: v * (i + 1))
    return out.select("drug", F.round(numeric.total(place), 6).alias("checksum"), F.size("vector").alias("dims"))


FEATURE_SQL = """
WITH f AS (SELECT DISTINCT l_suppkey AS drug, 'target' AS block, 'T' || (l_partkey // 10) AS item FROM lineitem WHERE l_returnflag = 'R'
  UNION SELECT DISTINCT l_suppkey, 'class', 'C' || (l_quantity::INTEGER * 10 + l_linenumber) FROM lineitem WHERE l_returnflag = 'A')
"""


def feature_rows(t: Tables) -> DataFrame:
    target = t.lineitem.filter("l_returnflag = 'R'").select(
        F.col("l_suppkey").alias("drug"), F.lit("target").alias("block"), F.concat(F.lit("T"), F.floor(F.col("l_partkey") / 10)).alias("item")
    )
    cls = t.lineitem.filter("l_returnflag = 'A'").select(
        F.col("l_suppkey").alias("drug"), F.lit("class").alias("block"), F.concat(F.lit("C"), (F.col("l_quantity").cast("int") * 10 + F.col("l_linenumber")).cast("string")).alias("item")
    )
    return target.unionByName(cls).distinct()


def catalogue_drugs(t: Tables) -> DataFrame:
    return t.supplier.select(F.col("s_suppkey").alias("drug"))


@query(
    FEATURE_SQL + """SELECT block, count(DISTINCT item) AS dimensions, count(*) AS nonzero_cells, count(DISTINCT drug) AS known_drugs,
  round(100.0 * count(DISTINCT drug)::DOUBLE / (SELECT count(*) FROM supplier), 4) AS coverage_pct FROM f GROUP BY 1 UNION ALL
SELECT 'any', NULL, NULL, count(DISTINCT drug), round(100.0 * count(DISTINCT drug)::DOUBLE / (SELECT count(*) FROM supplier), 4) FROM f"""
)
def feature_coverage(t: Tables) -> DataFrame:
    return profiles.coverage_report(feature_rows(t), catalogue_drugs(t))


@query(
    FEATURE_SQL + """, c AS (SELECT block, drug, item, sha256(drug || chr(0) || item) AS h FROM f),
b AS (SELECT block, substr(h, 1, 2) AS k, sha256(string_agg(h, chr(10) ORDER BY h)) AS h FROM c GROUP BY 1, 2),
s AS (SELECT block, sha256(string_agg(h, chr(10) ORDER BY h)) AS set_sha256 FROM b GROUP BY 1)
SELECT block, count(DISTINCT item) AS dimensions, count(*) AS nonzero_cells, (SELECT count(*) FROM supplier) - count(DISTINCT drug) AS drugs_without, any_value(set_sha256) AS set_sha256
FROM f JOIN s USING (block) GROUP BY 1"""
)
def feature_block_audit(t: Tables) -> DataFrame:
    return profiles.feature_audit(feature_rows(t), catalogue_drugs(t))


@query(
    """WITH r AS (SELECT conv_id AS d, turn, text, sum(length(text) + 1) OVER (PARTITION BY conv_id ORDER BY turn) - length(text) - 1 AS before FROM conversations),
k AS (SELECT d, ' ' || string_agg(text, ' ' ORDER BY turn) AS text FROM r WHERE before < 300 GROUP BY 1)
SELECT d AS drug_idx, (SELECT count(*) FROM conversations c WHERE c.conv_id = d) AS n_labels, md5(text) AS digest, length(text)::INTEGER AS text_chars FROM k"""
)
def label_text_rollup(t: Tables) -> DataFrame:
    records = t.conversations.select(F.col("turn").alias("record_id"), F.col("conv_id").alias("drug_idx"), "text")
    out = profiles.label_rollup(records, 300)
    return out.select("drug_idx", "n_labels", F.md5("text").alias("digest"), "text_chars")


@query(
    """SELECT DISTINCT trim(p_name) AS drug_name, lower(p_name) AS norm_name, p_brand AS structure, p_size::VARCHAR AS chem_id, TRUE AS mapping_ready FROM part"""
)
def drug_catalogue(t: Tables) -> DataFrame:
    raw = t.part.select(F.concat(F.lit(" "), "p_name").alias("Name"), F.col("p_brand").alias("SMILES"), "p_size")
    pick = clean.resolve_column
    return profiles.drug_catalogue(raw, pick(raw, ["chemical_name", "name"]), pick(raw, ["canonical_smiles", "smiles"]), pick(raw, ["p_size"]))


@query(
    """SELECT 'returned' AS source, TRUE AS present, count(*) AS rows, count(DISTINCT CASE WHEN l_suppkey IN (SELECT s_suppkey FROM supplier WHERE s_nationkey < 10) THEN l_suppkey END) AS matched_drugs, count(DISTINCT l_partkey) AS targets FROM lineitem WHERE l_returnflag = 'R'
UNION ALL SELECT 'absent', FALSE, 0, 0, 0"""
)
def evidence_source_coverage(t: Tables) -> DataFrame:
    returned = t.lineitem.filter("l_returnflag = 'R'").select(F.col("l_suppkey").alias("drug"), F.col("l_partkey").alias("target"))
    universe = t.supplier.filter("s_nationkey < 10").select(F.col("s_suppkey").alias("drug"))
    return profiles.source_coverage({"returned": returned, "absent": None}, universe)


# Sets.
@query(
    """WITH u AS (SELECT l_suppkey AS drug, l_partkey % 50 AS gene, 'relation' AS src FROM lineitem WHERE l_returnflag = 'R' UNION SELECT l_suppkey, l_partkey % 50, 'pathway' FROM lineitem WHERE l_returnflag = 'A')
SELECT src, count(*) AS n FROM u GROUP BY 1"""
)
def union_distinct_evidence(t: Tables) -> DataFrame:
    def rows(flag: str, src: str) -> DataFrame:
        return t.lineitem.filter(F.col("l_returnflag") == flag).select(
            F.col("l_suppkey").alias("drug"), (F.col("l_partkey") % 50).alias("gene"), F.lit(src).alias("src")
        )

    both = profiles.union_distinct_evidence(rows("R", "relation"), rows("A", "pathway"))
    return both.groupBy("src").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT 'S' || l_suppkey AS drug FROM lineitem UNION SELECT 'S' || (l_partkey // 20) FROM lineitem")
def all_pair_drugs(t: Tables) -> DataFrame:
    return profiles.all_drugs(supplier_edges(t), "source", "target")


@query(
    """WITH m AS (SELECT DISTINCT l_returnflag || l_linestatus AS p, l_orderkey AS k FROM lineitem)
SELECT x.p AS partition_a, y.p AS partition_b, count(*) AS shared FROM m x JOIN m y ON x.k = y.k AND x.p < y.p GROUP BY 1, 2"""
)
def partition_overlaps(t: Tables) -> DataFrame:
    members = t.lineitem.select(F.concat("l_returnflag", "l_linestatus").alias("partition"), F.col("l_orderkey").alias("key"))
    return profiles.overlap_counts(members)


@query("SELECT l_suppkey AS drug FROM lineitem WHERE l_returnflag <> 'N' UNION SELECT l_partkey // 20 FROM lineitem WHERE l_returnflag <> 'N'")
def non_train_structures(t: Tables) -> DataFrame:
    splits = t.lineitem.select(
        F.col("l_suppkey").alias("a"), F.floor(F.col("l_partkey") / 20).alias("b"),
        F.when(F.col("l_returnflag") == "N", "transductive_train").otherwise("s2_test").alias("split"),
    )
    return profiles.non_train_structures(splits, "a", "b")


@query("SELECT count(*) AS n FROM (SELECT DISTINCT l_suppkey, l_partkey, l_returnflag, l_linestatus, l_linenumber, l_tax FROM lineitem)")
def interaction_dedupe(t: Tables) -> DataFrame:
    fields = ["l_suppkey", "l_partkey", "l_returnflag", "l_linestatus", "l_linenumber", "l_tax"]
    return profiles.interaction_dedupe(t.lineitem.select(*fields), fields).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT o_custkey, o_orderpriority, o_orderkey FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey, o_orderpriority ORDER BY o_orderkey DESC) = 1")
def latest_runs(t: Tables) -> DataFrame:
    runs = t.orders.select("o_custkey", "o_orderpriority", "o_orderkey")
    return profiles.latest_run_dedupe(runs, ["o_custkey", "o_orderpriority"], "o_orderkey")


@query("SELECT p_partkey AS drug_idx, name, min(p)::INTEGER AS priority FROM (SELECT p_partkey, lower(p_name) AS name, 1 AS p FROM part UNION ALL SELECT p_partkey, lower(p_type), 2 FROM part) GROUP BY 1, 2")
def candidate_names(t: Tables) -> DataFrame:
    first = t.part.select(F.col("p_partkey").alias("drug_idx"), F.col("p_name").alias("name"))
    second = t.part.select(F.col("p_partkey").alias("drug_idx"), F.col("p_type").alias("name"))
    return profiles.candidate_names((first, 1), (second, 2))


@query(
    """WITH p AS (SELECT CASE WHEN x.s_acctbal > 5000 THEN 1 ELSE 0 END + CASE WHEN y.s_acctbal > 5000 THEN 1 ELSE 0 END AS n, l_quantity FROM lineitem JOIN supplier x ON l_suppkey = x.s_suppkey JOIN supplier y ON l_partkey // 20 = y.s_suppkey)
SELECT ['zero', 'one', 'both'][n + 1] AS tier, count(*) AS n, round(avg(l_quantity), 9) AS mean_quantity FROM p GROUP BY 1"""
)
def profile_coverage_tiers(t: Tables) -> DataFrame:
    known = t.supplier.filter("s_acctbal > 5000").select(F.col("s_suppkey").alias("drug"))
    pairs = t.lineitem.select(F.col("l_suppkey").alias("a"), F.floor(F.col("l_partkey") / 20).alias("b"), "l_quantity")
    tiers = profiles.coverage_tiers(pairs, known, "a", "b")
    return tiers.groupBy("tier").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("l_quantity"), 9).alias("mean_quantity"))


@query(
    """SELECT cohort, count(*) AS n FROM (SELECT unnest(['all', CASE WHEN l_tax > 0.04 THEN 'taxed' END, CASE WHEN l_discount > 0.04 THEN 'discounted' END,
  CASE WHEN l_tax > 0.04 AND l_discount > 0.04 THEN 'both' END]) AS cohort FROM lineitem) WHERE cohort IS NOT NULL GROUP BY 1"""
)
def overlapping_subcohorts(t: Tables) -> DataFrame:
    taxed, cut = F.col("l_tax") > 0.04, F.col("l_discount") > 0.04
    named = {"all": F.lit(True), "taxed": taxed, "discounted": cut, "both": taxed & cut}
    return profiles.subcohorts(t.lineitem, named).groupBy("cohort").agg(F.count(F.lit(1)).alias("n"))


@query(
    """WITH f AS (SELECT l_suppkey AS drug, 'cells' AS s, sha256(l_orderkey::VARCHAR) AS h FROM lineitem),
d AS (SELECT DISTINCT drug, h FROM f), b AS (SELECT drug, substr(h, 1, 2) AS k, sha256(string_agg(h, chr(10) ORDER BY h)) AS h, count(*) AS n FROM d GROUP BY 1, 2)
SELECT drug, sha256(string_agg(h, chr(10) ORDER BY h)) AS set_sha256, sum(n)::BIGINT AS n FROM b GROUP BY 1"""
)
def identity_set_hashes(t: Tables) -> DataFrame:
    rows = t.lineitem.select(F.col("l_suppkey").alias("drug"), F.col("l_orderkey").alias("key"))
    return numeric.set_hash(rows, "key", ["drug"])


@query("SELECT l_shipdate::DATE AS ship_day, count(*) AS n FROM lineitem GROUP BY 1", name="distinct_value_mapping")
def distinct_value_mapping(t: Tables) -> DataFrame:
    """Each distinct ship date is formatted and parsed once, then joined back to its lines."""
    mapped = clean.map_distinct(t.lineitem.select("l_shipdate"), "l_shipdate", "ship_day", lambda c: F.to_date(F.date_format(c, "yyyy-MM-dd")))
    return mapped.groupBy("ship_day").agg(F.count(F.lit(1)).alias("n"))


@query(
    """SELECT doc_id, source, toxic AS label, round(n_chars / 40000.0, 6) AS raw_score, round(least(1, n_chars / 20000.0), 6) AS calibrated_score, 0.2::DOUBLE AS threshold,
  (least(1, n_chars / 20000.0) >= 0.2)::INTEGER AS predicted_label, round(abs(least(1, n_chars / 20000.0) - 0.2), 6) AS margin FROM documents JOIN labels USING (doc_id)"""
)
def prediction_rows(t: Tables) -> DataFrame:
    """Provenance, label, scores and margin of each labelled document."""
    rows = t.documents.join(t.labels, "doc_id").select(
        "doc_id", "source", F.col("toxic").alias("label"), (F.col("n_chars") / 40000.0).alias("raw_score"),
        F.least(F.lit(1.0), F.col("n_chars") / 20000.0).alias("calibrated_score"))
    out = clean.prediction_table(rows, 0.2, ["doc_id", "source"])
    return out.withColumns({c: F.round(c, 6) for c in ("raw_score", "calibrated_score", "margin")})

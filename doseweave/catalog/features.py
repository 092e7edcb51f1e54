"""Feature, regimen and learning queries."""

from __future__ import annotations

from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from doseweave.catalog.evaluation import rounded
from doseweave.catalog.pairs import VOCAB_SQL, partition, supplier_table, train_pairs
from doseweave.catalog.registry import Tables, query
from doseweave.functions import numeric
from doseweave.operators import blocks, events, learning, metrics, ranking


def drugs(t: Tables) -> DataFrame:
    return t.supplier.select(F.col("s_suppkey").alias("drug"))


def target_rows(t: Tables) -> DataFrame:
    return t.lineitem.select(
        F.col("l_suppkey").alias("drug"), F.concat(F.lit("T"), F.floor(F.col("l_partkey") / 10)).alias("uniprot"),
        F.when(F.col("l_returnflag") == "R", "Homo sapiens").otherwise("Mus musculus").alias("organism"),
        F.concat(F.lit("class"), (F.col("l_quantity").cast("int") * 10 + F.col("l_linenumber")).cast("string")).alias("target_class"),
    )


BLOCK_SQL = """WITH it AS (SELECT DISTINCT l_suppkey AS drug, {item} AS item FROM lineitem {where})
SELECT s_suppkey AS drug, coalesce(string_agg(item, ',' ORDER BY item), '') AS items, count(item) > 0 AS known FROM supplier LEFT JOIN it ON drug = s_suppkey GROUP BY 1"""


def flat(block: DataFrame) -> DataFrame:
    return block.select("drug", F.concat_ws(",", "items").alias("items"), "known")


@query(BLOCK_SQL.format(item="'T' || (l_partkey // 10)", where="WHERE l_returnflag = 'R'"))
def target_block(t: Tables) -> DataFrame:
    return flat(blocks.target_block(drugs(t), target_rows(t), human_only=True))


@query(BLOCK_SQL.format(item="'class' || (l_quantity::INTEGER * 10 + l_linenumber)", where=""))
def class_block(t: Tables) -> DataFrame:
    return flat(blocks.class_block(drugs(t), target_rows(t)))


@query(
    """WITH c AS (SELECT l_suppkey AS drug, 'B' || lpad((l_quantity::INTEGER)::VARCHAR, 2, '0') || 'AC0' || l_linenumber AS code FROM lineitem),
it AS (SELECT DISTINCT drug, unnest([code[1:1], code[1:3], code[1:4], code[1:5]]) AS item FROM c)
SELECT s_suppkey AS drug, coalesce(string_agg(item, ',' ORDER BY item), '') AS items, count(item) > 0 AS known FROM supplier LEFT JOIN it ON drug = s_suppkey GROUP BY 1"""
)
def code_block(t: Tables) -> DataFrame:
    code = F.concat(F.lit("b"), F.lpad(F.col("l_quantity").cast("int").cast("string"), 2, "0"), F.lit("AC0"), F.col("l_linenumber"))
    rows = t.lineitem.select(F.col("l_suppkey").alias("drug"), code.alias("atc_code"))
    return flat(blocks.atc_block(drugs(t), rows))


@query(
    """WITH f AS (SELECT l_suppkey AS drug, (max(l_tax) >= 0.08)::INTEGER AS a, (max(l_discount) >= 0.1)::INTEGER AS b, count(*) - 590 AS chars FROM lineitem GROUP BY 1)
SELECT s_suppkey AS drug, coalesce(a || ',' || b, '0,0') AS flags, coalesce(chars > 0, FALSE) AS known FROM supplier LEFT JOIN f ON drug = s_suppkey"""
)
def enzyme_block(t: Tables) -> DataFrame:
    base = t.lineitem.groupBy(F.col("l_suppkey").alias("drug")).agg(
        (F.max("l_tax") >= 0.08).cast("int").alias("cyp1A2_substrate"), (F.max("l_discount") >= 0.1).cast("int").alias("cyp3A4_inducer"),
        (F.count(F.lit(1)) - 590).alias("pk_text_chars"))
    rows = base.withColumns({c: F.lit(0) for c in blocks.CYP_COLUMNS if c not in base.columns})
    out = blocks.cyp_block(drugs(t), rows)
    first, last = F.element_at("flags", 1).cast("string"), F.element_at("flags", 24).cast("string")
    return out.select("drug", F.concat_ws(",", first, last).alias("flags"), "known")


GENES_SQL = """WITH pf AS (SELECT p_brand || p_type AS structure, p_size AS sz, [p_name, 'G' || p_size] AS genes FROM part),
dr AS (SELECT p_partkey AS drug, p_brand || p_type AS structure FROM part)
"""


def gene_inputs(t: Tables) -> tuple[DataFrame, DataFrame]:
    key = F.concat("p_brand", "p_type")
    profiles = t.part.select(
        key.alias("structure"), F.to_json(F.array(F.col("p_name"), F.concat(F.lit("G"), "p_size"))).alias("genes_list"))
    return t.part.select(F.col("p_partkey").alias("drug"), key.alias("structure")), profiles


@query(
    GENES_SQL + """, it AS (SELECT DISTINCT drug, unnest(genes) AS item FROM dr JOIN pf USING (structure))
SELECT dr.drug, coalesce(string_agg(item, ',' ORDER BY item), '') AS items, count(item) > 0 AS known FROM dr LEFT JOIN it USING (drug) GROUP BY 1"""
)
def gene_block(t: Tables) -> DataFrame:
    return flat(blocks.gene_block(*gene_inputs(t)))


@query(GENES_SQL + "SELECT count(*) AS profiles, count(*) FILTER (WHERE structure NOT IN (SELECT structure FROM dr)) AS unmatched_profiles FROM pf")
def gene_profiles_unmatched(t: Tables) -> DataFrame:
    return blocks.unmatched_profiles(*gene_inputs(t))


@query(
    """WITH m AS (SELECT s_suppkey AS drug, s_nationkey AS struct_id FROM supplier), tg AS (SELECT DISTINCT c_nationkey AS struct_id, c_mktsegment AS cls, unnest(['A' || (c_custkey % 50), 'B' || (c_custkey % 30)]) AS uniprot FROM customer WHERE c_acctbal > 0)
SELECT drug, uniprot, min(cls) AS target_class FROM m JOIN tg USING (struct_id) GROUP BY 1, 2"""
)
def accession_targets(t: Tables) -> DataFrame:
    matched = t.supplier.select(F.col("s_suppkey").alias("drug"), F.col("s_nationkey").alias("struct_id"))
    targets = t.customer.select(
        F.col("c_nationkey").alias("struct_id"), F.concat(F.lit("A"), F.col("c_custkey") % 50, F.lit("|B"), F.col("c_custkey") % 30).alias("accession"),
        F.col("c_mktsegment").alias("target_class"), F.when(F.col("c_acctbal") > 0, "1.0").otherwise("0").alias("moa"))
    return blocks.build_targets(matched, targets, moa_only=True).select("drug", "uniprot", "target_class")


@query("SELECT p_brand AS drug, p_partkey AS struct_id, p_name AS inn, p_type AS cas_rn FROM part QUALIFY row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) = 1")
def structure_name_bridge(t: Tables) -> DataFrame:
    rows = t.part.select(F.col("p_brand").alias("drug"), F.col("p_partkey").alias("struct_id"), F.col("p_name").alias("INN"), F.col("p_type").alias("CAS_RN"))
    return blocks.name_bridge(rows)


MATRIX_SQL = """WITH tg AS (SELECT DISTINCT l_suppkey AS drug, 'T' || (l_partkey // 10) AS item FROM lineitem WHERE l_returnflag = 'R'),
cl AS (SELECT DISTINCT l_suppkey AS drug, 'class' || (l_quantity::INTEGER * 10 + l_linenumber) AS item FROM lineitem), tv AS (SELECT DISTINCT item FROM tg), cv AS (SELECT DISTINCT item FROM cl)
"""


def matrix_blocks(t: Tables) -> dict[str, DataFrame]:
    return {"target": blocks.target_block(drugs(t), target_rows(t), human_only=True), "class": blocks.class_block(drugs(t), target_rows(t))}


@query(
    MATRIX_SQL + """, x AS (SELECT s_suppkey AS drug, (SELECT string_agg(CASE WHEN EXISTS (SELECT 1 FROM tg WHERE tg.drug = s_suppkey AND tg.item = tv.item) THEN '1' ELSE '0' END, '' ORDER BY tv.item) FROM tv) AS a,
  (SELECT string_agg(CASE WHEN EXISTS (SELECT 1 FROM cl WHERE cl.drug = s_suppkey AND cl.item = cv.item) THEN '1' ELSE '0' END, '' ORDER BY cv.item) FROM cv) AS b FROM supplier)
SELECT drug, a || CASE WHEN contains(a, '1') THEN '1' ELSE '0' END || b || CASE WHEN contains(b, '1') THEN '1' ELSE '0' END AS features FROM x"""
)
def feature_matrix(t: Tables) -> DataFrame:
    out = blocks.feature_matrix(drugs(t), matrix_blocks(t))
    return out.select("drug", F.array_join(F.col("features").cast("array<string>"), "").alias("features"))


@query(MATRIX_SQL + "SELECT 'target' AS block, 0 AS start, (SELECT count(*) FROM tv)::INTEGER + 1 AS stop UNION ALL SELECT 'class', (SELECT count(*) FROM tv)::INTEGER + 1, ((SELECT count(*) FROM tv) + 1 + (SELECT count(*) FROM cv) + 1)::INTEGER")
def feature_layout(t: Tables) -> DataFrame:
    return blocks.feature_layout(matrix_blocks(t))


@query("SELECT label, round(list_sum([max(embedding[1]), max(embedding[2]), max(embedding[3])])::DOUBLE, 4) AS top3, round(max(embedding[64])::DOUBLE, 4) AS last FROM embeddings GROUP BY 1")
def max_merged_profiles(t: Tables) -> DataFrame:
    out = blocks.max_merge_profiles(t.embeddings, "label", "embedding")
    top = numeric.total(F.slice("embedding", 1, 3))
    return out.select("label", F.round(top, 4).alias("top3"), F.round(F.element_at("embedding", 64).cast("double"), 4).alias("last"))


@query("SELECT l_linenumber, round(sum(CASE WHEN l_returnflag <> 'R' THEN l_tax ELSE 0 END), 6) AS a, round(sum(CASE WHEN l_returnflag = 'R' THEN l_discount ELSE 0 END), 6) AS b FROM lineitem GROUP BY 1")
def masked_branches(t: Tables) -> DataFrame:
    rows = t.lineitem.select("l_linenumber", F.col("l_tax").alias("a"), F.col("l_discount").alias("b"),
                             (F.col("l_returnflag") != "R").cast("int").alias("ma"), (F.col("l_returnflag") == "R").cast("int").alias("mb"))
    out = blocks.masked_branches(rows, {"a": "ma", "b": "mb"})
    return rounded(out.groupBy("l_linenumber").agg(F.sum("a").alias("a"), F.sum("b").alias("b")))


@query(
    """WITH nd AS (SELECT 'S' || l_suppkey AS drug FROM lineitem UNION SELECT 'S' || (l_partkey // 20) FROM lineitem), sv AS (SELECT 'S' || s_suppkey AS drug, s_acctbal AS v FROM supplier WHERE s_nationkey < 12)
SELECT drug, v AS severity_score, v IS NOT NULL AS has_severity, drug IN (SELECT 'S' || s_suppkey FROM supplier WHERE s_acctbal > 3000) AS has_genes, drug IN (SELECT 'S' || s_suppkey FROM supplier WHERE s_acctbal < 8000) AS has_targets FROM nd LEFT JOIN sv USING (drug)"""
)
def node_catalogue(t: Tables) -> DataFrame:
    name = F.concat(F.lit("S"), "s_suppkey").alias("drug")
    edges = t.lineitem.select(F.concat(F.lit("S"), "l_suppkey").alias("source"), F.concat(F.lit("S"), F.floor(F.col("l_partkey") / 20)).alias("target"))
    out = blocks.node_catalogue(
        edges, t.supplier.filter("s_acctbal > 3000").select(name, F.array("s_name").alias("genes")),
        t.supplier.filter("s_nationkey < 12").select(name, F.col("s_acctbal").alias("severity_score")),
        t.supplier.filter("s_acctbal < 8000").select(name, F.array("s_name").alias("targets")))
    return out.select("drug", "severity_score", "has_severity", "has_genes", "has_targets")


PROFILE_SQL = """WITH pf AS (SELECT s_suppkey AS drug, (s_suppkey % 10) / 10.0::DOUBLE AS c3a4, (s_suppkey % 7) / 7.0::DOUBLE AS c2d6, s_nationkey / 100.0::DOUBLE AS fr, s_acctbal / 2000 AS logp, s_nationkey = 3 AS nti, s_nationkey <> 24 AS ok, (s_acctbal < 0)::INTEGER AS herg FROM supplier),
mb AS (SELECT l_orderkey AS regimen, l_suppkey AS drug FROM lineitem), rp AS (SELECT DISTINCT l_orderkey AS regimen, l_suppkey AS a, l_partkey // 20 AS b FROM lineitem WHERE l_suppkey <> l_partkey // 20),
sc AS (SELECT regimen, a, b, CASE WHEN least(x.c3a4, y.c3a4) > 0.25 THEN least(x.c3a4, y.c3a4) ELSE 0 END + CASE WHEN least(x.c2d6, y.c2d6) > 0.25 THEN least(x.c2d6, y.c2d6) ELSE 0 END AS ov,
  concat_ws('|', CASE WHEN least(x.c3a4, y.c3a4) > 0.25 THEN 'CYP3A4' END, CASE WHEN least(x.c2d6, y.c2d6) > 0.25 THEN 'CYP2D6' END) AS en,
  CASE WHEN least(x.fr, y.fr) < 0.05 AND greatest(x.logp, y.logp) > 3 THEN round(0.75::DOUBLE * (1 - least(x.fr, y.fr)), 3) ELSE 0 END AS dp, x.nti OR y.nti AS nti FROM rp JOIN pf x ON a = x.drug JOIN pf y ON b = y.drug),
al AS (SELECT regimen, a AS drug_a, b AS drug_b, en AS colliding_enzymes, dp AS displacement_risk, least(1, ov + dp) AS pair_risk, (en <> '' AND least(1, ov + dp) > 0.5) OR dp > 0.4 OR (nti AND least(1, ov + dp) > 0.3) AS severe FROM sc)
"""


def regimen_inputs(t: Tables) -> tuple[DataFrame, DataFrame, DataFrame]:
    """An order is a regimen, its suppliers the drugs; each line names one interacting pair of it."""
    profiles = t.supplier.select(
        F.col("s_suppkey").alias("drug"),
        F.create_map(F.lit("CYP3A4"), (F.col("s_suppkey") % 10) / 10.0, F.lit("CYP2D6"), (F.col("s_suppkey") % 7) / 7.0).alias("cyp"),
        (F.col("s_nationkey") / 100.0).alias("free"), (F.col("s_acctbal") / 2000).alias("logp"), (F.col("s_nationkey") == 3).alias("nti"),
        (F.col("s_nationkey") != 24).alias("guardrail_ok"), (F.col("s_acctbal") < 0).cast("int").alias("herg_alerts"), F.lit(0).alias("hepato_alerts"))
    members = t.lineitem.select(F.col("l_orderkey").alias("regimen"), F.col("l_suppkey").alias("drug"))
    pairs = t.lineitem.select(F.col("l_orderkey").alias("regimen"), F.col("l_suppkey").alias("drug_a"), F.floor(F.col("l_partkey") / 20).alias("drug_b")).filter("drug_a <> drug_b").distinct()
    return members, profiles, pairs


@query(PROFILE_SQL + "SELECT regimen, drug_a, drug_b, colliding_enzymes, round(displacement_risk, 6) AS displacement_risk, round(pair_risk, 6) AS pair_risk, severe FROM al")
def regimen_pair_alerts(t: Tables) -> DataFrame:
    members, profiles, pairs = regimen_inputs(t)
    return rounded(blocks.regimen_pairs(pairs, profiles))


@query(
    PROFILE_SQL + """, ld AS (SELECT regimen, count(*) AS n, round(sum(c3a4), 9) AS a, round(sum(c2d6), 9) AS b, sum(herg) AS herg, count(*) FILTER (WHERE nti) AS nti, bool_and(ok) AS ok FROM mb JOIN pf USING (drug) GROUP BY 1),
pa AS (SELECT regimen, max(pair_risk) AS m, count(*) FILTER (WHERE severe) AS s FROM al GROUP BY 1),
v AS (SELECT ld.*, coalesce(m, 0) AS m, coalesce(s, 0) AS s, CASE WHEN a >= b THEN a ELSE b END AS tl, CASE WHEN a >= b THEN 'CYP3A4' ELSE 'CYP2D6' END AS te FROM ld LEFT JOIN pa USING (regimen))
SELECT regimen, n AS n_drugs, te AS top_enzyme, round(tl, 6) AS top_load, herg::BIGINT AS herg_alerts, 0::BIGINT AS hepato_alerts, nti AS nti_drugs, round(m, 3) AS max_pair_risk, s AS severe_pairs,
  CASE WHEN NOT ok THEN 'ABSTAIN_CANNOT_EVALUATE' WHEN NOT (s > 0 OR tl >= 1.2 + 0.3 * (n - 2) OR herg >= 2) AND m < 0.35 THEN 'NO_STRONG_STRUCTURAL_SIGNAL' WHEN s > 0 OR tl >= 1.2 + 0.3 * (n - 2) OR herg >= 2 THEN 'HIGH_PRIORITY_RESEARCH_SIGNAL' ELSE 'MODERATE_PRIORITY_RESEARCH_SIGNAL' END AS verdict FROM v"""
)
def regimen_verdicts(t: Tables) -> DataFrame:
    members, profiles, pairs = regimen_inputs(t)
    return rounded(blocks.regimen_rollup(members, profiles, blocks.regimen_pairs(pairs, profiles)))


@query(
    PROFILE_SQL + """, o AS (SELECT regimen, a, b, greatest(0, x.c3a4 - 0.6) * greatest(0, y.c3a4 - 0.6) AS e1, greatest(0, x.c2d6 - 0.6) * greatest(0, y.c2d6 - 0.6) AS e2, (1 - x.fr) * (1 - y.fr) AS dr FROM rp JOIN pf x ON a = x.drug JOIN pf y ON b = y.drug)
SELECT regimen, a AS drug_a, b AS drug_b, round(greatest(0, least(1, (e1 + e2) / 0.18)), 6) AS cyp_overlap, round(dr, 6) AS displacement_risk, round(greatest(0, least(1, 0.65 * greatest(0, least(1, (e1 + e2) / 0.18)) + 0.35 * dr)), 6) AS collision_index,
  CASE WHEN e1 > e2 THEN 'CYP3A4' ELSE 'CYP2D6' END AS dominant_enzyme FROM o"""
)
def liability_collisions(t: Tables) -> DataFrame:
    _, profiles, pairs = regimen_inputs(t)
    out = pairs
    for side in ("a", "b"):
        out = out.join(profiles.select(F.col("drug").alias(f"drug_{side}"), F.col("cyp").alias(f"c{side}"), F.col("free").alias(f"f{side}")), f"drug_{side}")
    return rounded(blocks.collision(out, "ca", "cb", "fa", "fb").drop("ca", "cb", "fa", "fb"))


@query(
    """SELECT vec_id, round(list_sum(list_transform(generate_series(1, 64), lambda i: (x[i] + y[i]) * i))::DOUBLE, 4) AS sums, round(list_sum(list_transform(generate_series(1, 64), lambda i: abs(x[i] - y[i])))::DOUBLE, 4) AS gaps FROM
  (SELECT e.vec_id, list_transform(e.embedding, lambda v: v::DOUBLE) AS x, list_transform(f.embedding, lambda v: v::DOUBLE) AS y FROM embeddings e JOIN embeddings f ON f.vec_id = e.label)"""
)
def symmetric_pair_features(t: Tables) -> DataFrame:
    def wide(name: str):
        return F.transform("embedding", lambda v: v.cast("double")).alias(name)

    joined = t.embeddings.select("vec_id", "label", wide("x")).join(t.embeddings.select(F.col("vec_id").cast("int").alias("label"), wide("y")), "label")
    both = joined.withColumn("f", numeric.pair_features(F.col("x"), F.col("y")))
    sums = numeric.total(F.transform(F.slice("f", 1, 64), lambda v, i: v * (i + 1)))
    return both.select(
        "vec_id", F.round(sums, 4).alias("sums"), F.round(numeric.total(F.slice("f", 65, 64)), 4).alias("gaps"))


@query("SELECT p_partkey, (p_brand = 'Brand#1')::INTEGER || ((p_type = 'PROMO')::INTEGER || '') || (p_type = 'SMALL')::INTEGER AS bits FROM part")
def item_multi_hot(t: Tables) -> DataFrame:
    vocab = F.array(*map(F.lit, ["Brand#1", "PROMO", "SMALL"]))
    bits = numeric.multi_hot(F.array("p_brand", "p_type"), vocab)
    return t.part.select("p_partkey", F.array_join(F.transform(bits, lambda b: b.cast("string")), "").alias("bits"))


# Learning: model outputs are not SQL; each query reports the quality of its predictions.
def supplier_features(t: Tables) -> DataFrame:
    return t.lineitem.groupBy(F.col("l_suppkey").alias("drug")).agg(
        F.array(*[F.avg((F.col("l_partkey") % 16 == i).cast("double")) for i in range(16)]).alias("features"))


def event_pairs(t: Tables) -> tuple[events.EventTable, learning.FeatureTable | DataFrame, DataFrame]:
    table = supplier_table(t)
    names = table.drugs.select("drug_idx", F.substring("smiles", 2, 20).cast("long").alias("drug"))
    feats = learning.feature_table(supplier_features(t).join(names, "drug").select(F.col("drug_idx").alias("drug"), "features"))
    return table, feats, learning.pair_rows(table.pairs.withColumn("partition", partition()), feats)


#: Three symmetric features per supplier feature.
PAIR_WIDTH = 48


@query(VOCAB_SQL + "SELECT (SELECT count(*) FROM train) AS n, (SELECT count(*) FROM labels_ SEMI JOIN train USING (pair_id) WHERE event_idx = 0) AS positives, round((SELECT count(*) FROM labels_ SEMI JOIN train USING (pair_id) WHERE event_idx = 0)::DOUBLE / (SELECT count(*) FROM train), 3) AS mean_score, TRUE AS converged")
def pair_logistic_balance(t: Tables) -> DataFrame:
    """At the optimum the training scores of a model with a free intercept add up to the positives."""
    scored, model = labelled_pairs(t)
    train = scored.filter("partition = 'train'")
    return train.agg(F.count(F.lit(1)).alias("n"), F.sum("label").cast("long").alias("positives"), F.round(F.avg("score"), 3).alias("mean_score")).withColumn(
        "converged", F.lit(bool(model.converged.all())))


def labelled_pairs(t: Tables):
    table, feats, rows = event_pairs(t)
    ones = table.labels.filter("event_idx = 0").select("pair_id", F.lit(1).alias("label")).distinct()
    labelled = rows.join(ones, "pair_id", "left").withColumn("label", F.coalesce("label", F.lit(0)))
    return learning.pair_logistic(labelled, PAIR_WIDTH, features=feats, keep=["partition", "label"])


@query()
def pair_logistic_auroc(t: Tables) -> DataFrame:
    """A pair classifier for one event, trained on seen pairs and ranked per partition."""
    return rounded(ranking.auroc(labelled_pairs(t)[0], "label", "score", ["partition"]), 3)


@query(
    VOCAB_SQL + "SELECT event_idx, (SELECT count(*) FROM prs) AS n, train_pos, 0.5::DOUBLE AS weighted_score FROM head"
)
def event_logistic_scores(t: Tables) -> DataFrame:
    """All events of the vocabulary. A positive weighs negatives / positives, so at the optimum the weighted mean score is a half."""
    table, feats, rows = event_pairs(t)
    vocabulary = events.pos_weights(events.freeze_vocabulary(table.labels, train_pairs(table), min_pos=20))
    prior = events.frequency_prior(table.labels, train_pairs(table), vocabulary)
    seen = learning.event_logistic(rows, table.labels, vocabulary, prior, PAIR_WIDTH, features=feats, keep=["partition"], label="positive")
    seen = seen.join(vocabulary.select("event_idx", "pos_weight"), "event_idx")
    train, positive = F.col("partition") == "train", F.col("positive")
    weight = F.when(train, F.when(positive, F.col("pos_weight")).otherwise(1.0))
    return seen.groupBy("event_idx").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(train & positive).alias("train_pos"),
        F.round(F.sum(weight * F.col("score")) / F.sum(weight), 3).alias("weighted_score"))


@query()
def severity_forest_errors(t: Tables) -> DataFrame:
    features = array_to_vector(F.transform("embedding", lambda v: v.cast("double")))
    rows = t.embeddings.select(F.col("vec_id").alias("id"), F.pmod("vec_id", F.lit(40)).alias("group"), features.alias("features"), (F.col("label") / 10.0).alias("target"))
    out = learning.severity_forest(rows, "group", "target")
    return rounded(metrics.regression_metrics(out, "target", "prediction"), 3)

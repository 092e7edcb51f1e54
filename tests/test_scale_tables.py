"""Tables that are numbered, united, spread out or drawn with less moved between tasks; the rows are the same."""

import pandas as pd
import pytest
from pyspark.sql import functions as F

from doseweave.operators import blocks, events, identity, negatives, similarity
from doseweave.plans import ordering
from tests.test_scale import counted
from tests.test_similarity_text import brute, sets


def test_rows_and_distinct_keys_are_numbered_together(spark):
    rows = spark.range(600).select((F.col("id") % 7).alias("a"), (F.col("id") % 11).alias("b"), "id")
    bucket = F.floor((F.col("a") * 11 + F.col("b")) / 5)
    got = ordering.dense_positions(rows, ["a", "b"], bucket, ["a", "b", "id"], "at", "first").collect()
    keys = sorted({(r.a, r.b) for r in got})
    assert len(got) == 600 and all(keys[r["at"] - 1] == (r.a, r.b) for r in got)
    assert sorted((r.a, r.b) for r in got if r["first"]) == keys


def test_event_table_of_pairs_with_several_events(spark):
    facts = {(f"d{i % 13:02}", f"d{(i * 7 + 3) % 17:02}", f"e{i % 5}") for i in range(400)}
    table = events.event_table(spark.createDataFrame(sorted(facts) * 2, "source string, target string, interaction_type string"))
    want = {(min(a, b), max(a, b), e) for a, b, e in facts if a != b}
    names = {r.drug_idx: r.smiles for r in table.drugs.collect()}
    kinds = {r.event_idx: r.event for r in table.events.collect()}
    pairs = {r.pair_id: (names[r.drug_a], names[r.drug_b]) for r in table.pairs.collect()}
    assert [pairs[i] for i in range(len(pairs))] == sorted({w[:2] for w in want}) and table.pairs.count() == len(pairs)
    assert sorted((*pairs[r.pair_id], kinds[r.event_idx]) for r in table.labels.collect()) == sorted(want)


def test_cells_of_a_grid_are_not_shuffled(spark):
    pairs = spark.range(500).select(F.col("id").alias("pair_id"))
    vocabulary = spark.range(40).select(F.col("id").alias("event_idx"))
    labels = spark.range(700).select((F.col("id") % 400).alias("pair_id"), (F.col("id") % 50).alias("event_idx"))
    out = events.label_grid(pairs, vocabulary, labels.unionByName(labels))
    ones = {(i % 400, i % 50) for i in range(700)}
    got = {(r.pair_id, r.event_idx): r.label for r in out.collect()}
    assert len(got) == 20_000 and out.count() == 20_000 and all(y == (k in ones) for k, y in got.items())
    assert sum(counted(out, "shuffleRecordsWritten")) < 5000


def test_genes_of_a_shared_name_do_not_multiply(spark):
    nodes = spark.range(300).select(
        F.col("id").alias("drug_idx"), F.lit("Shared").alias("name"), F.array(F.lit("Other")).alias("synonyms"), F.array(F.lit("own")).alias("genes")
    ).unionByName(spark.createDataFrame([(300, "none", None, ["own"]), (None, "shared", None, ["own"]), (301, None, ["other"], None)],
                                        "drug_idx long, name string, synonyms array<string>, genes array<string>"))
    evidence = spark.range(400).select(F.lit("shared").alias("drug_name"), F.concat(F.lit("G"), F.col("id")).alias("gene")).unionByName(
        spark.createDataFrame([("OTHER", "G0"), ("other", "A"), (None, "B")], "drug_name string, gene string"))
    out = identity.enrich_by_name_or_synonym(nodes, evidence)
    got = {r.drug_idx: (r.genes, r.enriched) for r in out.collect()}
    every = sorted({"A", *[f"G{i}" for i in range(400)]})
    assert out.columns == ["drug_idx", "name", "synonyms", "genes", "enriched"]
    assert got[0] == (every, True) and got[299] == got[0] and got[301] == (["A", "G0"], True)
    assert got[300] == (["own"], False) and got[None] == (["own"], False) and len(got) == 303
    assert max(counted(out, "numOutputRows")) <= 2000


def test_a_matrix_is_spread_out_in_tasks_of_bounded_size(spark, monkeypatch):
    monkeypatch.setattr(blocks, "MATRIX_CELLS", 200)
    drugs = spark.range(60).select(F.col("id").alias("drug"))
    items = spark.range(120).select((F.col("id") % 50).alias("drug"), F.concat(F.lit("i"), F.lpad((F.col("id") % 30).cast("string"), 2, "0")).alias("item"))
    out = blocks.feature_matrix(drugs, {"x": blocks.item_block(drugs, items)})
    want = {d: [0] * 31 for d in range(60)}
    for i in range(120):
        want[i % 50][i % 30] = want[i % 50][30] = 1
    assert {r.drug: r.features for r in out.collect()} == want
    assert out.rdd.getNumPartitions() == 9


def test_a_thin_request_draws_little_more_than_it_wants(spark, monkeypatch):
    pairs = spark.range(4000).select((F.col("id") * 2).alias("drug_a"), (F.col("id") * 2 + 1).alias("drug_b"))
    counts, real = [], negatives._draws
    monkeypatch.setattr(negatives, "_draws", lambda s, a, b, n, seed: counts.append(n) or real(s, a, b, n, seed))
    short = {tuple(r) for r in negatives.sample_unreported(pairs, 1.0, "degree_matched", 3).collect()}
    monkeypatch.setattr(negatives, "THIN", 1 << 40)
    assert short == {tuple(r) for r in negatives.sample_unreported(pairs, 1.0, "degree_matched", 3).collect()}
    assert len(short) == 4000 and counts == [5250, 9000]


@pytest.mark.parametrize("items", [150, 10_000])
def test_nearest_in_shards_by_items(spark, monkeypatch, items):
    monkeypatch.setattr(similarity, "REFERENCE_ITEMS", items)
    monkeypatch.setattr(similarity, "QUERY_ITEMS", 100)
    rows = sets(70, 9, 4)
    df = spark.createDataFrame(rows, "id long, items array<int>")
    got = similarity.nearest(df, df, 2, exclude_self=True).toPandas()
    for i, x in rows:
        want = sorted((-brute(x, y), j) for j, y in rows if j != i)[:2]
        mine = got[got.id == i].sort_values("rank")
        assert [(round(-s, 9), j) for s, j in want] == [(round(s, 9), j) for s, j in zip(mine.similarity, mine.neighbour, strict=True)]


def test_items_are_numbered_without_gaps(spark):
    df = spark.createDataFrame([(i, x) for i, (_, x) in enumerate(sets(50, 2, 3))], "id long, items array<int>")
    numbers = similarity._numbers(df.filter("id < 20"), df.filter("id >= 20")).orderBy("number").toPandas()
    assert numbers.number.dtype == "int32" and numbers.number.tolist() == list(range(len(numbers)))
    assert numbers.f.is_monotonic_increasing and set(numbers["item"]) == {i for _, x in sets(50, 2, 3) for i in x}


def test_overlaps_hold_a_bounded_matrix(monkeypatch):
    monkeypatch.setattr(similarity, "MEMBERSHIP", 60)
    items = pd.Series([x for _, x in sets(30, 3, 2)] + [[]])
    want = [[len(set(x) & set(y)) for y in items] for x in items]
    rows, codes = similarity._cells(items)
    assert similarity._overlaps(items, items).tolist() == want
    assert similarity._overlaps(items, items, (rows, codes, pd.unique(codes))).tolist() == want


def test_only_reported_analog_pairs_join(spark, monkeypatch):
    """Pairs of analogs beyond the third are not made for the audit, and labels of 0 don't travel."""
    rows = [(i, [i, i + 1, i + 2]) for i in range(12)]
    drugs = spark.createDataFrame(rows, "id long, items array<int>")
    pairs = [(a, b) for a in range(12) for b in range(a + 1, 12)]
    train = spark.createDataFrame([(a, b, float((a + b) % 2)) for a, b in pairs], "drug_a long, drug_b long, label double")
    written, real = [], similarity.durable
    monkeypatch.setattr(similarity, "durable", lambda df: written.append(real(df)) or written[-1])
    audit = similarity.memory_audit(train.select("drug_a", "drug_b"), train, drugs, 5)
    near = {i: sorted((-brute(x, y), j) for j, y in rows)[:3] for i, x in rows}
    want = {(a, b, c, d, float((c + d) % 2) if c != d else 0.0) for a, b in pairs for _, c in near[a] for _, d in near[b]}
    assert {(r.drug_a, r.drug_b, r.analog_a, r.analog_b, r.observed_interaction) for r in audit.collect()} == want
    assert audit.count() == len(pairs) * 9 and max(counted(audit, "numOutputRows")) <= len(pairs) * 9
    labels = [t for t in written if "label" in t.columns]
    assert len(labels) == 1 and {r.label for r in labels[0].collect()} == {1.0}

import pytest
from pyspark.errors import PySparkException

from doseweave.operators import clean, events, identity, reports, splits


def drug_outc(spark):
    drug = spark.createDataFrame([(1, "DrugA"), (1, "DrugB"), (2, "druga "), (3, None)], "primaryid int, drugname string")
    outc = spark.createDataFrame([(1, "OT"), (1, "OT"), (2, "DE"), (2, "HO")], "primaryid int, outc_cod string")
    return drug, outc


def test_report_severity_without_fan_out(spark):
    rows = {r["drugname"]: r for r in reports.drug_severity(*drug_outc(spark), min_reports=1).collect()}
    assert rows["DRUGA"]["n_reports"] == 2 and rows["DRUGA"]["toxicity_score"] == 0.5
    assert rows["DRUGB"]["n_reports"] == 1 and rows["DRUGB"]["toxicity_score"] == 0.0


def test_missing_outcome_policies(spark):
    drug = spark.createDataFrame([(1, "x"), (2, "x"), (3, "x")], "primaryid int, drugname string")
    outc = spark.createDataFrame([(1, "DE")], "primaryid int, outc_cod string")
    one = reports.drug_severity(drug, outc, 1, "exclude").head()
    assert (one["n_reports"], one["toxicity_score"]) == (1, 1.0)
    assert reports.drug_severity(drug, outc, 1, "non_severe").head()["n_reports"] == 3
    with pytest.raises(clean.ContractError):
        reports.drug_severity(drug, outc, 1, "guess")


def test_latest_case_version_treats_text_as_lowest(spark):
    rows = [("1", "c", "x", "20250101", "2025q1"), ("2", "c", "2", "bad", "2025q2"), ("3", "c", "2", "20250301", "2025q1")]
    demo = spark.createDataFrame(rows, "primaryid string, caseid string, caseversion string, fda_dt string, quarter string")
    assert reports.latest_case_version(demo).head()["primaryid"] == "3"


def toy(spark):
    rows = [("A", "B", "e1"), ("B", "A", "e1"), ("A", "B", "e1"), ("A", "B", "e2"), ("A", "C", "e1"), ("B", "C", "e1"), ("B", "D", "e2"),
            ("C", "D", "e1"), ("D", "C", "e2"), ("A", "A", "e1"), ("A", None, "e1")]
    return spark.createDataFrame(rows, "source string, target string, interaction_type string")


def test_event_table_toy(spark):
    edges = toy(spark)
    table = events.event_table(edges)
    assert [r["smiles"] for r in table.drugs.orderBy("drug_idx").collect()] == ["A", "B", "C", "D"]
    assert [(r["drug_a"], r["drug_b"]) for r in table.pairs.orderBy("pair_id").collect()] == [(0, 1), (0, 2), (1, 2), (1, 3), (2, 3)]
    report = events.event_table_report(edges).head()
    assert (report["n_missing"], report["n_self"], report["n_duplicates"]) == (1, 1, 2)
    audit = splits.audit_event_table(table.pairs, table.labels, table.drugs, table.events).head()
    assert audit["ordered_no_loops"] and audit["dense_pair_ids"] and audit["labels_unique"]
    shuffled = events.event_table(edges.repartition(5))
    assert shuffled.labels.exceptAll(table.labels).count() == 0


def test_pair_errors(spark):
    bad = spark.createDataFrame([("A", "")], "a string, b string")
    with pytest.raises(PySparkException):
        clean.canonical_pair(bad, "a", "b").collect()
    clash = spark.createDataFrame([("A", "B", 1), ("B", "A", 0)], "a string, b string, y int")
    with pytest.raises(PySparkException):
        events.dedupe_pairs(clash, "a", "b", "y").collect()


def test_ambiguous_names_do_not_resolve(spark):
    names = spark.createDataFrame([(1, "Alpha"), (2, "SharedName"), (3, " sharedname "), (1, "alpha")], "drug_idx int, name string")
    assert [tuple(r) for r in identity.unambiguous_name_map(names).collect()] == [("alpha", 1)]
    assert identity.ambiguous_name_count(names).head()[0] == 1


def test_curated_bridge(spark):
    names = spark.createDataFrame([(0, "a"), (1, "b"), (2, "c")], "drug_idx int, name string")
    inter = spark.createDataFrame([("A", "B", "Minor"), ("b", "a", "MAJOR"), ("a", "c", None), ("a", "zzz", "Major")], "name_a string, name_b string, level string")
    pairs = spark.createDataFrame([(1, 0)], "drug_a int, drug_b int")
    got = {(r["drug_a"], r["drug_b"]): (r["severity"], r["n_records"], r["in_base"]) for r in identity.curated_bridge(inter, names, pairs).collect()}
    assert got == {(0, 1): ("major", 2, True), (0, 2): ("unknown", 1, False)}


def test_members_must_align(spark):
    rows = spark.createDataFrame([("m1", 1, 0.6), ("m2", 1, 0.8), ("m1", 2, 0.2)], "member string, k int, s double")
    with pytest.raises(PySparkException):
        identity.align_members(rows, ["k"], ["m1", "m2"], "s").collect()


def test_popularity(spark):
    import math

    pairs = spark.createDataFrame([(2, 3), (3, 3)], "drug_a int, drug_b int")
    train = spark.createDataFrame([(0, 1), (0, 2)], "drug_a int, drug_b int")
    got = {(r["drug_a"], r["drug_b"]): r["popularity"] for r in events.popularity_score(pairs, train).collect()}
    assert abs(got[(2, 3)] - math.log(2)) < 1e-12 and got[(3, 3)] == 0.0

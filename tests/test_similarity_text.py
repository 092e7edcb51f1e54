import re

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from doseweave.functions import text
from doseweave.operators import similarity


def sets(n=120, seed=0, copies=40):
    rng = np.random.default_rng(seed)
    rows = [(i, sorted(int(x) for x in rng.choice(60, rng.integers(3, 20), replace=False))) for i in range(n)]
    return rows + [(n + i, rows[0][1]) for i in range(copies)]


def brute(a, b):
    union = len(set(a) | set(b))
    return len(set(a) & set(b)) / union if union else 0.0


@pytest.mark.parametrize("exclude", [False, True])
def test_nearest_equals_brute_force_over_blocks(spark, monkeypatch, exclude):
    monkeypatch.setattr(similarity, "QUERY_BLOCK", 16)
    monkeypatch.setattr(similarity, "REFERENCE_BLOCK", 32)
    rows = sets()
    df = spark.createDataFrame(rows, "id long, items array<int>")
    ref = [r for r in rows if r[0] % 2]
    got = similarity.nearest(df, df.filter("id % 2 = 1"), 3, exclude_self=exclude).toPandas()
    for i, items in rows:
        want = sorted(((-brute(items, x), j) for j, x in ref if not (exclude and j == i)))[:3]
        mine = got[got.id == i].sort_values("rank")
        assert [(round(-s, 9), j) for s, j in want] == [(round(s, 9), j) for s, j in zip(mine.similarity, mine.neighbour, strict=True)]


@pytest.mark.parametrize("threshold", [0.15, 0.5, 1.0])
def test_threshold_join_equals_brute_force(spark, threshold):
    rows = sets(80, 2, 10)
    df = spark.createDataFrame(rows, "id long, items array<int>")
    got = {(r["left_id"], r["right_id"]) for r in similarity.tanimoto_pairs(df, df, threshold).collect()}
    assert got == {(i, j) for i, x in rows for j, y in rows if brute(x, y) >= threshold}


def test_own_label_is_hidden(spark):
    drugs = spark.createDataFrame([(0, [1, 2]), (1, [3, 4]), (2, [1, 2, 5])], "id long, items array<int>")
    train = spark.createDataFrame([(0, 1, 1.0)], "drug_a long, drug_b long, label double")
    query = train.select("drug_a", "drug_b")
    shown = similarity.neighbor_memory(query, train, drugs, 1).head()
    hidden = similarity.neighbor_memory(query, train, drugs, 1, exclude_query=True).head()
    assert shown["max_support"] == 1.0 and hidden["max_support"] == 0.0 and hidden["query_pair_excluded"]


def test_imputation_provenance(spark):
    rows = [(1, [1, 2, 3], 5.0), (2, [1, 2, 3, 4], None), (3, [50], None)]
    df = spark.createDataFrame(rows, "id long, items array<int>, value double")
    got = similarity.fallback_mean(similarity.nearest_impute(df, "value", 0.7), "value")
    assert {r["id"]: (r["value"], r["provenance"]) for r in got.collect()} == {1: (5.0, "observed"), 2: (5.0, "imputed_analog"), 3: (5.0, "fallback_mean")}


def test_transfer_needs_exactly_one_known(spark):
    vectors = spark.createDataFrame([(i, [(i + 1) / 10, 0.1]) for i in range(4)], "id long, items array<double>")
    train = spark.createDataFrame([(0, 1, 1.0)], "drug_a long, drug_b long, label double")
    query = spark.createDataFrame([(0, 1), (0, 3), (2, 3)], "drug_a long, drug_b long")
    got = {(r["drug_a"], r["drug_b"]): (r["transfer_score"], r["transfer_applies"]) for r in similarity.s2_transfer(query, train, vectors).collect()}
    assert got == {(0, 1): (0.5, 0.0), (0, 3): (1.0, 1.0), (2, 3): (0.5, 0.0)}


def test_mentions_equal_the_longest_first_regex(spark):
    names = {"calcium": 1, "calcium chloride": 2, "étoile noire": 3, "warfarin": 4, "chloride tablets": 5}
    docs = [
        (1, "Calcium chloride and calcium, not recalcium; WARFARIN.\nwarfarin"), (2, "chloride tablets with calcium chloride tablets"),
        (3, "L'Étoile Noire: étoile  noire étoile noire"), (4, "nothing here"),
    ]
    rx = re.compile(r"\b(" + "|".join(re.escape(n) for n in sorted(names, key=len, reverse=True)) + r")\b", re.I)
    want = {}
    for d, t in docs:
        for m in rx.finditer(t):
            key = (d, names[m.group(1).lower()])
            count, snip = want.get(key, (0, t[max(0, m.start() - 9): m.end() + 9].replace("\n", " ")))
            want[key] = (count + 1, snip)
    df = spark.createDataFrame(docs, "doc long, body string")
    lex = spark.createDataFrame(list(names.items()), "name string, name_id long")
    got = {(r["doc"], r["name_id"]): (r["n_mentions"], r["snippet"]) for r in text.find_mentions(df, "doc", "body", lex, 5, 9).collect()}
    assert got == want


def test_enzyme_window_equals_brute_force(spark):
    pad = "x" * 97
    texts = [f"CYP3A4 {pad[:92]} inhibits", f"CYP3A4 {pad} inhibits", f"inhibitor {pad[:85]} cyp-3a4", "CYP 2D6 inhibits; CYP3A4",
             f"inhibits {pad} CYP3A4 a CYP3A4", "no enzyme inhibits"]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    got = [r["f"] for r in df.select("i", text.cyp_flag(F.col("t"), "3A4", "inhibitor").alias("f")).orderBy("i").collect()]
    want = [int(any(re.search("inhibit", t[max(0, m.start() - 100): m.end() + 100], re.I) for m in re.finditer(r"CYP\s*-?\s*3A4", t, re.I))) for t in texts]
    assert got == want


def test_unicode_names_and_gene_lists(spark):
    df = spark.createDataFrame([("Ａspirin  (100 mg)",), ("Étoile-Ⅱ",), ("--",), ("Plain Name",), (None,)], "n string")
    got = {r["n"]: r["k"] for r in text.with_norm_drug_name(df, "n", "k").collect()}
    assert got == {"Ａspirin  (100 mg)": "aspirin 100 mg", "Étoile-Ⅱ": "étoile ii", "--": None, "Plain Name": "plain name", None: None}
    genes = spark.createDataFrame([('["B", "A", "A"]',), ("['X Y', 'B']",), ("c; b|a",), ("nan",), ("[]",), (None,)], "g string")
    assert [r[0] for r in genes.select(text.parse_gene_list(F.col("g"))).collect()] == [["A", "B"], ["B", "X Y"], ["a", "b", "c"], [], [], []]


def test_overlaps_in_pieces_of_items(monkeypatch):
    monkeypatch.setattr(similarity, "ITEM_COLUMNS", 7)
    items = pd.Series([x for _, x in sets(30, 3, 2)] + [[]])
    got = similarity._overlaps(items, items)
    assert got.tolist() == [[len(set(x) & set(y)) for y in items] for x in items]
    assert similarity._overlaps(items, pd.Series([[], []])).tolist() == [[0, 0]] * len(items)


@pytest.mark.parametrize("threshold", [0.2, 0.6])
def test_threshold_join_of_two_tables(spark, threshold):
    left, right = sets(60, 4, 5), [*sets(50, 5, 5), (999, [])]
    frames = [spark.createDataFrame(rows, "id long, items array<int>") for rows in (left, right)]
    got = {(r["left_id"], r["right_id"]): r["similarity"] for r in similarity.tanimoto_pairs(*frames, threshold).collect()}
    want = {(i, j): brute(x, y) for i, x in left for j, y in right if brute(x, y) >= threshold}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-12 for k in want)


def test_weighted_imputation_is_gated_on_the_best_match(spark):
    rows = [(1, [1, 2, 3], 6.0, 4), (2, [1, 2, 9], 2.0, 2), (3, [1, 2, 3, 4], None, None), (4, [1, 8, 7, 6], None, None)]
    df = spark.createDataFrame(rows, "id long, items array<int>, value double, n long")
    got = {r["id"]: r for r in similarity.knn_weighted_impute(df, "value", "n", 0.7, 2).collect()}
    assert abs(got[3]["value"] - (0.75 * 6 + 0.4 * 2) / 1.15) < 1e-12 and got[3]["n"] == 3
    assert got[4]["value"] is None and got[4]["provenance"] == "unprofiled"


@pytest.mark.parametrize("shard", [10_000, 12])
def test_nearest_pairs_equal_brute_force(spark, monkeypatch, shard):
    """In one shard and in many."""
    monkeypatch.setattr(similarity, "REFERENCE_BLOCK", shard)
    monkeypatch.setattr(similarity, "PAIR_BLOCK", 40)
    drugs = dict(sets(40, 7, 3))
    rng = np.random.default_rng(5)
    draw = lambda n: sorted({tuple(sorted(int(x) for x in rng.choice(43, 2, replace=False))) for _ in range(n)})
    asked, known = draw(150), draw(60)
    drugs |= {90: [], 91: []}
    known += [(0, 90)]
    asked += [(90, 91), (1, 91)]
    frames = [spark.createDataFrame([(a, b, f"{a}-{b}") for a, b in pairs], "drug_a long, drug_b long, id string") for pairs in (asked, known)]
    table = spark.createDataFrame(list(drugs.items()), "id long, items array<int>")
    got = {r["id"]: r["similarity"] for r in similarity.nearest_pairs(*frames, table).collect()}
    want = {f"{a}-{b}": max(brute([*drugs[a], *drugs[b]], [*drugs[c], *drugs[d]]) for c, d in known) for a, b in asked}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-12 for k in want)

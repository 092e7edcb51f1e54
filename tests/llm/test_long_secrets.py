"""Secret scan of very long runs against a plain count, and mixtures of tables with clashing columns."""

import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from doseweave.llm import mixing, secrets

LETTERS = secrets.ALPHABET


def plain_windows(text, bound, window=secrets.WINDOW):
    """First start and last end by counting every window anew."""
    starts = [
        i for i in range(len(text) - window + 1)
        if -sum(n / window * math.log2(n / window) for n in Counter(text[i : i + window]).values()) >= bound
    ]
    return (starts[0], starts[-1] + window) if starts else (-1, -1)


@pytest.mark.parametrize("bound", [2.5, 3.3, 3.85, 4.4])
def test_kept_counts_agree_with_counting_anew(spark, bound):
    r = random.Random(5)
    texts = ["".join(r.choice(LETTERS[: r.choice([2, 9, 16, 67])]) for _ in range(r.choice([20, 21, 60, 300]))) for _ in range(40)]
    texts += [LETTERS, "a" * 50, "a" * 30 + LETTERS[:25] + "a" * 30]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    got = {r.doc_id: (r.w["first"], r.w["last"]) for r in df.select("doc_id", secrets.high_entropy(F.col("text"), F.lit(bound)).alias("w")).collect()}
    assert got == {i: plain_windows(t, bound) for i, t in enumerate(texts)}


def test_long_runs_and_many_matches(spark):
    r = random.Random(6)
    key = "".join(r.choice(LETTERS[:64]) for _ in range(200_000))
    path = "/" + "Ab" * 50_000 + "/" + "x_" * 30_000 + "x"
    many = " ".join(f"{n:024x}" for n in range(3000))
    df = spark.createDataFrame([(0, key), (1, path), (2, many), (3, None), (4, "")], "doc_id int, text string")
    found = {r.doc_id: r for r in secrets.found_secrets(df).select("doc_id", "base_spans", "spans").collect()}
    assert [(s.s, s.e) for s in found[0].spans if s.kind == 5][0][1] > 199_000
    assert found[1].spans == found[3].spans == found[4].spans == []
    assert [(s.s, s.e) for s in found[2].base_spans] == [(25 * n, 25 * n + 24) for n in range(3000)]


def test_mixture_keeps_clashing_columns(spark):
    df = spark.createDataFrame(
        [(i, "w " * 5, "s", f"x{i}", -i, i, 7) for i in range(20)], "doc_id long, text string, source string, _x string, size int, target int, _prio int"
    )
    out = mixing.mixture(df)
    assert out.columns == df.columns and out.count() > 20
    assert out.filter("size <> -doc_id OR target <> doc_id OR _prio <> 7 OR _x <> concat('x', doc_id)").count() == 0

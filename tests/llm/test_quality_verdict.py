"""Documents that the base rule lets through and only the method's limits reject."""

from doseweave.llm import quality


def words(start, n):
    return [f"w{i}" for i in range(start, start + n)]


def test_each_limit_rejects_alone(spark):
    paragraph, phrases = words(10_000, 120), [words(20_000 + 10 * i, 6) for i in range(40)]
    texts = [
        words(0, 3000),
        paragraph + words(0, 2760) + paragraph,
        [w for p in phrases for w in [*p, "x" + p[0]]] + words(0, 2240) + [w for p in phrases for w in [*p, "y" + p[0]]],
        words(0, 3000) + words(10_000, 90) + ["z"] + words(10_000, 90),
    ]
    df = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id int, text string")
    got = {r.doc_id: r for r in quality.judged(df).collect()}
    assert not any(r.base_failed for r in got.values())
    assert [got[i].kept for i in range(4)] == [True, False, False, True]
    assert got[1].longest_repeat == 120 and got[1].covered < quality.MOST_COVERED
    assert got[2].longest_repeat == 6 and got[2].covered > quality.MOST_COVERED

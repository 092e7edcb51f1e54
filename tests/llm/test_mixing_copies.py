import duckdb
import pytest

from doseweave.llm import mixing
from doseweave.llm.catalog import MIX_SQL


@pytest.mark.parametrize(
    "rows",
    [
        # 50 copies of one row in a source whose target goes through them, beside a large one
        [(1, "a b c", "x")] * 50 + [(i, "w " * 7, "y") for i in range(100, 160)],
        # a long document over the line of one source must not keep out a short one of a later source
        [(i, "w " * 5, "a") for i in range(9)] + [(50, "w " * 400, "a"), (60, "v " * 30, "b"), (61, "v", "b"), (62, "v v", None)],
        [(1, "a", "x"), (1, "a", "x"), (1, "a", None), (1, "a", None), (1, "a", None), (None, None, "z"), (None, "", "z"), (None, "q q", "z"), (None, "q q", "z")],
    ],
)
def test_mix_of_repeated_rows_and_long_documents(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    documents = docs.toPandas()
    expected = duckdb.connect()
    expected.register("frame", documents)
    expected.execute("CREATE TABLE documents AS SELECT doc_id::BIGINT AS doc_id, text::VARCHAR AS text, source::VARCHAR AS source FROM frame")
    want = sorted(expected.execute(MIX_SQL).fetchall(), key=repr)
    got = [tuple(r) for r in mixing.mix_sizes(docs).select("doc_id", "size", "source_size", "target", "taken").collect()]
    assert sorted(got, key=repr) == want
    assert sum(r[4] for r in got) <= 1.5 * sum(r[1] for r in got)
    assert mixing.mixture(docs).count() == sum(r["rounds"] for r in mixing.mixed(docs).collect())


def test_equal_rows_are_cut_one_by_one(spark):
    docs = spark.createDataFrame([(1, "a b c", "x")] * 50 + [(i, "w " * 7, "y") for i in range(100, 160)], "doc_id long, text string, source string")
    got = mixing.mix_sizes(docs).filter("source = 'x'").collect()
    taken, target = sum(r.taken for r in got), got[0].target
    assert abs(taken - target) <= 3

"""The pipeline on hard rows and on an empty table, and its stages against what they promise."""

import random

import pytest

import corpus_pipeline
from doseweave.llm import decontamination

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, rejected boolean, n_words long, component_id long, size long"


def prose(seed, n):
    draw = random.Random(seed)
    return " ".join("".join(draw.choice(["an", "the", "lo", "mer", "ti", "sha"]) for _ in range(draw.randint(1, 3))) for _ in range(n))


@pytest.fixture(scope="module")
def bench():
    return [(1, prose(1, 40)), (2, "zz yy xx"), (3, None), (4, "")]


@pytest.fixture(scope="module")
def rows():
    base = [(i, prose(10 + i, 80 + i), "en", f"src{i % 3}") for i in range(40)]
    base += [(100 + i, base[0][1] + " tail", "en", "src0") for i in range(5)] + [base[3]]
    base += [(200, prose(1, 40), "en", "src1"), (201, prose(99, 60), None, None), (202, prose(98, 60), "en", None)]
    base += [(300, None, None, None), (301, "", "en", "src1"), (302, " \n", "en", None), (303, "123 !!", "en", "src2"), (304, prose(97, 20000), "en", "src2"), (None, prose(96, 70), "en", "src0")]
    return [(*r, 0, True, 7, 8, 9) for r in base]


def folder(spark, path, rows, bench):
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(bench, "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return str(path)


def test_each_stage_keeps_its_promise(spark, tmp_path, rows, bench):
    place = folder(spark, tmp_path, rows, bench)
    docs = spark.read.parquet(f"{place}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, docs, place)
        assert after.columns == docs.columns, name
        docs = spark.createDataFrame(after.collect(), after.schema)
        ids = [r.doc_id for r in docs.collect()]
        if name == "language ID":
            assert not {300, 301, 302, 303} & set(ids) and {0, 200, 304, None} <= set(ids)
        if name == "near duplicates":
            assert len({0, 100, 101, 102, 103, 104} & set(ids)) == 1
        if name == "benchmark decontamination":
            assert 200 not in ids and 304 in ids
            words = [len(decontamination.words_of(r.text.encode())) for r in docs.collect()]
            assert all(words)


def test_whole_run(spark, tmp_path, rows, bench):
    place = folder(spark, tmp_path / "full", rows, bench)
    out = corpus_pipeline.run(spark, place).collect()
    assert {"doc_id", "start", "n_tokens", "ids_crc32"} <= set(out[0].asDict())
    total = 0
    for r in sorted(out, key=lambda r: r.start):
        assert r.start == total
        total += r.n_tokens


def test_nothing_in_nothing_out(spark, tmp_path):
    place = folder(spark, tmp_path / "empty", [], [])
    assert corpus_pipeline.run(spark, place).count() == 0

import json

from doseweave.sources import bulk_json, readers

TEXTS = ["plain", 'a "quoted" }', "{[", "]}", "\\", "\\\\", '\\"', "}{\n\t", "", "é ] } 日", '"results": [{', ","]


def _labels(n):
    for i in range(n):
        text = TEXTS[i % len(TEXTS)]
        yield {"drug_interactions": [text, str(i)], "openfda": {"generic_name": [text], "deep": [{"x": [{}, {"y": text}]}]}, text or "k": {"z": []}}


def test_one_document_is_read_by_many_tasks(spark, tmp_path):
    labels = list(_labels(200))
    document = {"meta": {"terms": 'see "results": [{', "results": {"skip": 0, "limit": 1}, "ids": [1, 2]}, "results": labels}
    for indent in (None, 1):
        path = tmp_path / f"bulk{indent}.json"
        path.write_text(json.dumps(document, indent=indent, ensure_ascii=False))
        before = spark.conf.get("spark.sql.files.maxPartitionBytes")
        spark.conf.set("spark.sql.files.maxPartitionBytes", "701")
        try:
            assert spark.read.option("lineSep", "}").text(str(path)).rdd.getNumPartitions() > 20
            rows = bulk_json.record_texts(spark, str(path)).orderBy("record_number").collect()
        finally:
            spark.conf.set("spark.sql.files.maxPartitionBytes", before)
        assert [json.loads(r["record"]) for r in rows] == labels
        assert [r["record_number"] for r in rows] == list(range(200))


def test_files_with_several_or_no_records(spark, tmp_path):
    first, second = list(_labels(5)), list(_labels(3))
    empty = json.dumps({"meta": {}, "results": []})
    (tmp_path / "a.json").write_text(json.dumps({"results": first}) + "\n" + empty + "\n" + json.dumps({"meta": {"x": 1}, "results": second}, indent=2) + "\n")
    (tmp_path / "b.json").write_text(empty)
    (tmp_path / "c.json").write_text("")
    got = readers.read_label_documents(spark, str(tmp_path)).collect()
    assert sorted(r["drug_interactions"] for r in got) == sorted(x["drug_interactions"] for x in first + second)
    assert all(r["openfda"]["generic_name"] == r["drug_interactions"][:1] for r in got)


def test_a_file_that_breaks_off_gives_its_whole_records(spark, tmp_path):
    text = json.dumps({"results": list(_labels(9))})
    (tmp_path / "cut.json").write_text(text[: len(text) - 60])
    assert bulk_json.record_texts(spark, str(tmp_path)).count() == 8


def test_records_are_cut_in_place_and_not_moved(spark, tmp_path, monkeypatch):
    labels = list(_labels(8000))
    (tmp_path / "big.json").write_text(json.dumps({"results": labels}, indent=1))
    written = []
    durable = bulk_json.durable
    monkeypatch.setattr(bulk_json, "durable", lambda df, **options: written.append(durable(df, **options)) or written[-1])
    rows = bulk_json.record_texts(spark, str(tmp_path)).orderBy("record_number").collect()
    assert [json.loads(r["record"]) for r in rows] == labels
    counts = [t.count() for t in written]
    assert max(counts) > 4 and sum(counts) < len(labels) / 10

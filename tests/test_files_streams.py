
from doseweave.operators import profiles
from doseweave.sources import readers, writers
from doseweave.streaming import change_log, incremental


def test_delimited_reports(spark, tmp_path):
    folder = tmp_path / "ascii"
    folder.mkdir()
    (folder / "DEMO25Q1.txt").write_bytes("primaryid$caseid$name\n1$ 7 $Caf\xe9\n2$$\n".encode("latin-1"))
    (folder / "DELETE25Q1.txt").write_text(" 7 \n\n8\n")
    found = readers.find_report_files(spark, str(tmp_path))
    assert len(found["DEMO"]) == 1 and len(found["DELETE"]) == 1
    rows = readers.read_delimited_reports(spark, found["DEMO"], "DEMO", ["primaryid", "caseid", "name"]).orderBy("primaryid").collect()
    assert [tuple(r) for r in rows] == [("1", " 7 ", "Café", "2025q1"), ("2", "", "", "2025q1")]
    assert sorted(r[0] for r in readers.read_deleted_ids(spark, found["DELETE"]).collect()) == ["7", "8"]


def test_replace_matching_and_mixed_columns(spark, tmp_path):
    path = str(tmp_path / "results")
    writers.append_results(spark.createDataFrame([("a", None, 1.0), ("b", 1, 2.0)], "run string, seed int, x double"), path)
    writers.replace_matching(spark.createDataFrame([("a", None, 9.0)], "run string, seed int, y double"), path, ["run", "seed"])
    got = sorted((r["run"], r["x"], r["y"]) for r in writers.read_results(spark, path).collect())
    assert got == [("a", None, 9.0), ("b", 2.0, None)]


def test_row_cap_per_file(spark, tmp_path):
    (tmp_path / "a.CSV").write_text("x,y\n" + "\n".join(f"{i},{i}" for i in range(5)))
    (tmp_path / "b.tsv").write_text("x\tz\n1\t2\n")
    got = readers.read_folder_union(spark, str(tmp_path), row_cap=2)
    assert sorted(got.groupBy("source_file").count().toPandas()["count"]) == [1, 2] and "z" in got.columns
    assert sorted(r["x"] for r in got.filter("y IS NOT NULL").collect()) == ["0", "1"]


def test_label_rollup_stops_at_the_cap(spark):
    rows = spark.createDataFrame([(i, 1, "abcd") for i in range(50)] + [(99, 2, "zz")], "record_id long, drug_idx long, text string")
    got = {r["drug_idx"]: (r["n_labels"], r["text"]) for r in profiles.label_rollup(rows, 12).collect()}
    assert got == {1: (50, " abcd abcd abcd"), 2: (1, " zz")}


def test_stream_dedup_across_files_and_replayed_versions(spark, tmp_path):
    source, out, state = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "state")
    columns = "caseid string, canonical_smiles string, caseversion string, fda_dt string, quarter string, primaryid string"

    def arrive(rows):
        spark.createDataFrame(rows, columns).coalesce(1).write.mode("append").parquet(str(source))

    def run():
        stream = incremental.read_stream(spark, str(source), spark.createDataFrame([], columns).schema)
        incremental.run_available(incremental.case_dedup(stream), incremental.parquet_sink(out), str(tmp_path / "c1"))
        incremental.run_available(stream, incremental.latest_version_sink(state), str(tmp_path / "c2"))

    arrive([("1", "X", "1", "1", "q1", "p1"), ("1", "X", "2", "1", "q1", "p2"), ("2", "Y", "1", "1", "q1", "p3")])
    run()
    arrive([("1", "X", "3", "1", "q2", "p4"), ("2", "Z", "0", "1", "q2", "p5")])
    run()
    kept = sorted((r["caseid"], r["canonical_smiles"]) for r in spark.read.parquet(out).collect())
    assert kept == [("1", "X"), ("2", "Y"), ("2", "Z")]
    assert {r["caseid"]: r["primaryid"] for r in incremental.latest_versions(spark, state, spark.createDataFrame([], columns).schema).collect()} == {"1": "p4", "2": "p3"}
    incremental.latest_version_sink(state)(spark.read.parquet(str(source)).select(*[c.split()[0] for c in columns.split(", ")]), 9)
    assert {r["caseid"]: r["primaryid"] for r in incremental.latest_versions(spark, state, spark.createDataFrame([], columns).schema).collect()} == {"1": "p4", "2": "p3"}


def test_log_survives_late_rows_replays_and_compaction(spark, tmp_path):
    columns = "caseid string, canonical_smiles string, caseversion string, fda_dt string, quarter string, primaryid string"
    schema = spark.createDataFrame([], columns).schema
    path = str(tmp_path / "log")
    write = incremental.latest_version_sink(path)
    read = lambda: {r["caseid"]: r["primaryid"] for r in incremental.latest_versions(spark, path, schema).collect()}
    batch = lambda *rows: spark.createDataFrame([(c, "X", v, "1", "q1", p) for c, v, p in rows], columns)
    assert read() == {} and incremental.compact_versions(spark, path, schema) == -1
    write(batch(("1", "2", "a"), ("1", "3", "b"), ("2", "1", "c")), 0)
    assert read() == {"1": "b", "2": "c"}
    assert incremental.compact_versions(spark, path, schema) == 0
    write(batch(("1", "1", "late"), ("2", "9", "d")), 1)
    write(batch(("1", "1", "late"), ("2", "9", "d")), 1)
    assert read() == {"1": "b", "2": "d"}
    # a batch and a base that broke off have no _SUCCESS and don't count
    for broken in ("batch=2", "base=7"):
        (tmp_path / "log" / broken).mkdir()
    assert read() == {"1": "b", "2": "d"}
    assert incremental.compact_versions(spark, path, schema) == 1 and read() == {"1": "b", "2": "d"}
    write(batch(("3", None, "e"), ("2", "10", "f")), 2)
    assert read() == {"1": "b", "2": "f", "3": "e"}


def test_update_mode_counts_add_up_over_batches(spark, tmp_path):
    source, path = tmp_path / "in", str(tmp_path / "counts")
    source.mkdir()
    stream = incremental.read_stream(spark, str(source), spark.createDataFrame([], "k string, serious int").schema)
    counts = incremental.running_counts(stream, "k", "serious")
    for rows in ([("a", 1), ("b", 0)], [("a", 0), (None, 1)], [("c", 1)]):
        spark.createDataFrame(rows, "k string, serious int").coalesce(1).write.mode("append").parquet(str(source))
        incremental.run_available(counts, change_log.log_sink(path), str(tmp_path / "ckpt"), "update")
    changed = [spark.read.parquet(f"{path}/batch={n}").count() for n in range(3)]
    got = {r["k"]: (r["n_reports"], r["serious_outcome_reports"]) for r in incremental.current_counts(spark, path, counts.schema, "k").collect()}
    assert changed == [2, 2, 1] and got == {"a": (2, 1), "b": (1, 0), "c": (1, 1), None: (1, 1)}


def test_entry_and_contract(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    queries, sql = entry.queries(), entry.oracle_sql()
    assert set(sql) <= set(queries) and len(queries) > 200
    plan = queries["case_latest_versions"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan
    read = queries["drug_severity_signals"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "l_extendedprice" not in read


def test_line_counts_keep_folders_apart(spark, tmp_path):
    for folder in ("a", "b"):
        (tmp_path / folder).mkdir()
        (tmp_path / folder / "part.csv").write_text("1\n2\n")
    expected = spark.createDataFrame([("part.csv",), ("absent.csv",)], "name string")
    rows = writers.line_counts(spark, str(tmp_path), expected).collect()
    assert sorted((r["name"], r["lines"], r["present"]) for r in rows) == [("absent.csv", 0, False), ("part.csv", 2, True), ("part.csv", 2, True)]

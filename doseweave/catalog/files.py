"""Source, sink and streaming queries: Spark writes a table in the source's format and the reader reads it back."""

from __future__ import annotations

from uuid import uuid4

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from doseweave.catalog.pairs import supplier_edges, supplier_table
from doseweave.catalog.registry import Tables, query
from doseweave.catalog.reports import CASES_SQL, case_tables
from doseweave.session import checkpoint_dir
from doseweave.sources import readers, writers
from doseweave.streaming import incremental
from doseweave.streaming.change_log import log_sink


def scratch(t: Tables, name: str) -> str:
    """A new folder below the session's shared checkpoint folder."""
    return f"{checkpoint_dir(t.spark)}/files-{uuid4().hex}/{name}"


@query(
    """SELECT interaction_type, count(*) AS n, count(source) AS sources FROM (SELECT 'S' || l_suppkey AS source, CASE WHEN l_linenumber = 7 AND l_tax = 0 THEN NULL ELSE l_returnflag || l_linestatus END AS interaction_type FROM lineitem) GROUP BY 1"""
)
def edge_file(t: Tables) -> DataFrame:
    path = scratch(t, "edges")
    supplier_edges(t).withColumn("note", F.lit("unused")).write.csv(path, header=True)
    return readers.read_edges(t.spark, path).groupBy("interaction_type").agg(F.count(F.lit(1)).alias("n"), F.count("source").alias("sources"))


@query(CASES_SQL + "SELECT quarter, count(*) AS n, count(DISTINCT caseid) AS cases, max(caseversion) AS top_version FROM demo GROUP BY 1")
def delimited_reports(t: Tables) -> DataFrame:
    """Case rows written as one $-separated latin-1 text folder per quarter."""
    base = scratch(t, "faers")
    demo = case_tables(t)["demo"]
    for q in [r["quarter"] for r in demo.select("quarter").distinct().collect()]:
        part = demo.filter(F.col("quarter") == q).drop("quarter")
        part.write.option("sep", "$").option("encoding", "ISO-8859-1").option("quote", "").csv(f"{base}/{q}", header=True)
    rows = t.spark.read.option("sep", "$").option("header", True).csv(f"{base}/*").select(
        "*", F.regexp_extract(F.col("_metadata.file_path"), r"/(\d{4}q\d)/", 1).alias("quarter"))
    direct = readers.read_delimited_reports(t.spark, f"{base}/*", "DEMO", ["PRIMARYID", "caseid", "caseversion"]).drop("quarter")
    counted = rows.groupBy("quarter").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("caseid").alias("cases"), F.max("caseversion").alias("top_version"))
    same = direct.agg(F.count(F.lit(1))).scalar()
    total = rows.agg(F.count(F.lit(1))).scalar()
    return counted.withColumns({"_a": same, "_b": total}).filter("_a = _b").drop("_a", "_b")


@query(CASES_SQL + "SELECT count(*) AS ids, count(DISTINCT caseid) AS cases FROM deleted")
def deleted_id_file(t: Tables) -> DataFrame:
    path = scratch(t, "delete")
    case_tables(t)["deleted"].select(F.concat(F.lit("  "), "caseid").alias("v")).unionByName(t.region.select(F.lit(" ").alias("v"))).write.text(path)
    return readers.read_deleted_ids(t.spark, path).agg(F.count(F.lit(1)).alias("ids"), F.count_distinct("caseid").alias("cases"))


@query("SELECT p_type, count(*) AS n FROM part GROUP BY 1")
def molecule_table(t: Tables) -> DataFrame:
    path = scratch(t, "molecules")
    t.part.write.csv(path, sep="\t", header=True)
    return readers.read_molecule_table(t.spark, path, ["p_partkey", "p_type"]).groupBy("p_type").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT count(*) AS rows, count(DISTINCT s_name) AS distinct_accession, count(DISTINCT s_nationkey) AS distinct_target_id FROM supplier")
def target_map_file(t: Tables) -> DataFrame:
    path = scratch(t, "targets")
    lines = t.supplier.select(F.concat_ws("\t", "s_name", F.col("s_nationkey").cast("string"), F.lit("x"), F.lit("y")).alias("v"))
    lines.unionByName(t.nation.select(F.concat(F.lit("# "), "n_name").alias("v"))).write.text(path)
    return readers.target_map_counts(readers.read_target_map(t.spark, path))


@query(
    "SELECT level, count(*) AS n, count(DISTINCT name_a) AS names FROM (SELECT lower(c_name) AS name_a, CASE WHEN c_acctbal < 0 THEN 'unknown' ELSE lower(c_mktsegment) END AS level FROM customer) GROUP BY 1"
)
def interaction_exports(t: Tables) -> DataFrame:
    """Two exports with different headers and separators, read as one."""
    base = scratch(t, "letters")
    level = F.when(F.col("c_acctbal") >= 0, F.col("c_mktsegment"))
    first = t.customer.filter("c_custkey % 2 = 0").select(F.col("c_name").alias("Drug_A"), F.col("c_mktsegment").alias("Drug_B"), level.alias("Level"))
    second = t.customer.filter("c_custkey % 2 = 1").select(level.alias("Severity"), F.col("c_name").alias("drug1 name"), F.col("c_mktsegment").alias("drug2 name"))
    first.write.csv(f"{base}/a", header=True)
    second.write.csv(f"{base}/b", sep="\t", header=True)
    out = readers.read_interactions_norm(t.spark, base)
    return out.groupBy("level").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("name_a").alias("names"))


@query("SELECT count(*) AS labels, count(DISTINCT l_linenumber) AS substances, sum(length(l_returnflag))::BIGINT AS chars FROM lineitem")
def label_documents(t: Tables) -> DataFrame:
    path = scratch(t, "labels")
    label = F.struct(
        F.struct(F.array(F.col("l_linenumber").cast("string")).alias("substance_name"), F.array(F.lit("g")).alias("generic_name")).alias("openfda"),
        F.array("l_returnflag").alias("drug_interactions"), F.lit("skipped").alias("other"))
    t.lineitem.groupBy("l_orderkey", "l_partkey").agg(F.collect_list(label).alias("results")).select("results").write.json(path)
    out = readers.read_label_documents(t.spark, path, one_per_file=False)
    return out.agg(F.count(F.lit(1)).alias("labels"), F.count_distinct(F.get("openfda.substance_name", F.lit(0))).alias("substances"),
                   F.sum(F.length(F.get("drug_interactions", F.lit(0)))).alias("chars"))


@query(
    """SELECT l_returnflag || l_linenumber || '} ],"' AS text, count(*) AS labels, min(l_linestatus || l_orderkey) AS first_name, max(l_linestatus || l_orderkey) AS last_name
FROM lineitem GROUP BY 1"""
)
def bulk_label_documents(t: Tables) -> DataFrame:
    """Bulk documents that are longer than a line, with braces, brackets and quotes in their texts."""
    path = scratch(t, "bulk")
    documents = t.lineitem.groupBy("l_suppkey").agg(F.collect_list(F.struct("l_linestatus", "l_orderkey", "l_returnflag", "l_linenumber")).alias("rows"))
    results = F.transform("rows", lambda r: F.struct(
        F.struct(F.array(F.concat(r["l_linestatus"], r["l_orderkey"])).alias("substance_name")).alias("openfda"),
        F.array(F.concat(r["l_returnflag"], r["l_linenumber"], F.lit('} ],"'))).alias("drug_interactions"), F.lit('\\"{[').alias("other")))
    meta = F.struct(F.lit("terms [{").alias("terms"), F.struct(F.lit(1).alias("limit")).alias("results")).alias("meta")
    documents.select(F.to_json(F.struct(meta, results.alias("results")), {"pretty": "true"}).alias("value")).write.text(path)
    out = readers.read_label_documents(t.spark, path)
    name = F.get("openfda.substance_name", F.lit(0))
    return out.groupBy(F.get("drug_interactions", F.lit(0)).alias("text")).agg(
        F.count(F.lit(1)).alias("labels"), F.min(name).alias("first_name"), F.max(name).alias("last_name"))


@query("SELECT count(*) AS n, count(*) FILTER (WHERE p_size >= 25) AS genes, count(*) FILTER (WHERE p_size < 25) AS pmids FROM part")
def pathway_tables(t: Tables) -> DataFrame:
    base = scratch(t, "pathways")
    t.part.filter("p_size >= 25").select(F.col("p_name").alias("Drugs"), F.col("p_brand").alias("Genes")).write.csv(f"{base}/x/1", sep="\t", header=True)
    t.part.filter("p_size < 25").select(F.col("p_name").alias("Drugs"), F.col("p_type").alias("PMIDs")).write.csv(f"{base}/x/2", sep="\t", header=True)
    _as_suffix(t, f"{base}/x", ".csv", ".tsv")
    out = readers.read_pathway_tables(t.spark, base)
    return out.agg(F.count(F.lit(1)).alias("n"), F.count("Genes").alias("genes"), F.count("PMIDs").alias("pmids"))


def _as_suffix(t: Tables, folder: str, old: str, new: str) -> None:
    """Gives the files Spark wrote the extension a source would have."""
    jvm = t.spark._jvm.org.apache.hadoop.fs
    for row in readers.list_files(t.spark, folder, f"*{old}").collect():
        path = jvm.Path(row["path"])
        fs = path.getFileSystem(t.spark._jsc.hadoopConfiguration())
        fs.rename(path, jvm.Path(row["path"][: -len(old)] + new))


@query("SELECT kind, count(*) AS n FROM (SELECT unnest(['csv', 'tsv', 'gz', 'xml']) AS kind, s_suppkey FROM supplier) GROUP BY 1")
def folder_union(t: Tables) -> DataFrame:
    base = scratch(t, "folder")
    rows = t.supplier.select("s_suppkey", "s_name")
    rows.withColumn("kind", F.lit("csv")).write.csv(f"{base}/1", header=True)
    rows.withColumn("kind", F.lit("tsv")).write.csv(f"{base}/2", header=True, sep="\t")
    rows.withColumn("kind", F.lit("gz")).write.csv(f"{base}/3", header=True, compression="gzip")
    rows.withColumn("kind", F.lit("xml")).write.option("rowTag", "row").option("rootTag", "rows").mode("overwrite").format("xml").save(f"{base}/4")
    return readers.read_folder_union(t.spark, base).groupBy("kind").agg(F.count(F.lit(1)).alias("n"))


@query(
    """WITH g AS (SELECT 'G' || (l_partkey // 10) AS gene, l_partkey AS probe, l_linenumber AS s, max(l_quantity) AS v FROM lineitem GROUP BY ALL)
SELECT gene, count(*) AS n_values, count(DISTINCT probe) AS probes, round(sum(v), 6) AS total FROM g GROUP BY 1"""
)
def expression_matrix(t: Tables) -> DataFrame:
    path = scratch(t, "expression")
    wide = t.lineitem.groupBy("l_partkey").pivot("l_linenumber", list(range(1, 8))).agg(F.max("l_quantity"))
    cells = [F.coalesce(F.col(str(i)).cast("string"), F.lit("")) for i in range(1, 8)]
    body = wide.select(F.lit(1).alias("o"), F.concat_ws("\t", F.col("l_partkey").cast("string"), F.concat(F.lit("G"), F.floor(F.col("l_partkey") / 10)), *cells).alias("v"))
    head = t.region.filter("r_regionkey = 0").select(F.lit(0).alias("o"), F.explode(F.array(
        F.lit("!series_matrix_table_begin"), F.lit("# comment"), F.lit("ID_REF\tGene\t" + "\t".join(f"S{i}" for i in range(1, 8))))).alias("v"))
    body.unionByName(head).coalesce(1).select("v").write.text(path)
    out = readers.read_expression_matrix(t.spark, path)
    return out.groupBy("gene").agg(F.count(F.lit(1)).alias("n_values"), F.count_distinct("probe").alias("probes"), F.round(F.sum("value"), 6).alias("total"))


@query("SELECT 'P' || s_suppkey AS accession, 'E_' || s_suppkey AS entry, 'Nation ' || s_nationkey AS organism, length(repeat('ACD', (s_suppkey % 40)::INTEGER + 1))::INTEGER AS length FROM supplier")
def fasta_records(t: Tables) -> DataFrame:
    path = scratch(t, "fasta")
    seq = F.expr("repeat('ACD', int(s_suppkey % 40) + 1)")
    head = F.concat(F.lit(">sp|P"), "s_suppkey", F.lit("|E_"), "s_suppkey", F.lit(" name OS=Nation "), "s_nationkey", F.lit(" OX=1\n"))
    t.supplier.select(F.concat(head, F.regexp_replace(seq, "(.{10})", "$1\n")).alias("v")).write.text(path)
    return readers.read_fasta(t.spark, path).drop("sequence")


@query("SELECT 'N' || lpad(n_nationkey::VARCHAR, 3, '0') AS structure_id, 1.5::DOUBLE + n_regionkey AS resolution, 'L' || n_regionkey || 'X' AS ligands, n_name AS molecules FROM nation")
def structure_headers(t: Tables) -> DataFrame:
    base = scratch(t, "structures")
    ident = F.concat(F.lit("N"), F.lpad(F.col("n_nationkey").cast("string"), 3, "0"))
    lines = F.concat_ws("\n", F.concat(F.rpad(F.lit("HEADER    TRANSFERASE"), 62, " "), ident), F.concat(F.lit("REMARK   2 RESOLUTION.    "), (1.5 + F.col("n_regionkey")).cast("string"), F.lit(" ANGSTROMS.")),
                        F.concat(F.lit("HET    L"), F.col("n_regionkey").cast("string"), F.lit("X  A 301")), F.concat(F.lit("COMPND   2 MOLECULE: "), "n_name", F.lit(";")))
    t.nation.select("n_nationkey", lines.alias("value")).repartition(25, "n_nationkey").write.partitionBy("n_nationkey").text(base)
    out = readers.read_structure_headers(t.spark, base)
    return out.select("structure_id", "resolution", F.concat_ws(",", "ligands").alias("ligands"), F.concat_ws(",", "molecules").alias("molecules"))


@query("SELECT a.s_name AS source, b.s_name AS target, count(*) AS n FROM lineitem JOIN supplier a ON l_suppkey = a.s_suppkey JOIN supplier b ON l_partkey // 20 = b.s_suppkey GROUP BY 1, 2")
def parquet_pairs(t: Tables) -> DataFrame:
    base = scratch(t, "prepared")
    t.lineitem.select(F.col("l_suppkey").alias("drug_a"), F.floor(F.col("l_partkey") / 20).alias("drug_b")).write.parquet(f"{base}/pairs")
    t.supplier.select(F.col("s_suppkey").alias("drug_idx"), F.col("s_name").alias("structure")).write.parquet(f"{base}/drugs")
    return readers.read_parquet_pairs(t.spark, f"{base}/pairs", f"{base}/drugs").groupBy("source", "target").agg(F.count(F.lit(1)).alias("n"))


@query(
    """WITH f AS (SELECT DISTINCT least('S' || l_suppkey, 'S' || (l_partkey // 20)) AS a, greatest('S' || l_suppkey, 'S' || (l_partkey // 20)) AS b, l_returnflag || l_linestatus AS e FROM lineitem
  WHERE l_suppkey <> l_partkey // 20 AND NOT (l_linenumber = 7 AND l_tax = 0))
SELECT (SELECT count(*) FROM (SELECT DISTINCT a, b FROM f)) AS n_pairs, (SELECT count(*) FROM (SELECT a FROM f UNION SELECT b FROM f)) AS n_drugs, (SELECT count(DISTINCT e) FROM f) AS n_events, (SELECT count(*) FROM f) AS n_labels"""
)
def stored_event_table(t: Tables) -> DataFrame:
    return writers.write_event_table(supplier_table(t), scratch(t, "table")).select("n_pairs", "n_drugs", "n_events", "n_labels")


@query("SELECT s_suppkey AS id, '[\"' || s_name || '\"]' AS names, '{\"nation\":' || s_nationkey || '}' AS attrs FROM supplier")
def exported_catalogue(t: Tables) -> DataFrame:
    path = scratch(t, "catalogue")
    nodes = t.supplier.select(F.col("s_suppkey").alias("id"), F.array("s_name").alias("names"), F.struct(F.col("s_nationkey").alias("nation")).alias("attrs"))
    writers.export_catalogue(nodes, t.nation, path)
    return t.spark.read.csv(f"{path}/nodes", header=True, escape='"', schema="id long, names string, attrs string")


@query(
    """SELECT features, count(*) AS n, count(extra) AS extras FROM (SELECT l_returnflag AS features, NULL AS extra FROM lineitem WHERE l_returnflag <> 'R' UNION ALL SELECT 'R', 1 FROM orders) GROUP BY 1"""
)
def replaced_results(t: Tables) -> DataFrame:
    """Appended runs, then one run replaced by rows with another column."""
    path = scratch(t, "results")
    writers.append_results(t.lineitem.select(F.col("l_returnflag").alias("features"), "l_tax"), path)
    writers.replace_matching(t.orders.select(F.lit("R").alias("features"), F.lit(1).alias("extra")), path, ["features"])
    return writers.read_results(t.spark, path).groupBy("features").agg(F.count(F.lit(1)).alias("n"), F.count("extra").alias("extras"))


@query("SELECT sum(n)::BIGINT AS lines, count(*) AS letters, 1::BIGINT AS missing FROM (SELECT s_nationkey, count(*) AS n FROM supplier GROUP BY 1)")
def file_line_counts(t: Tables) -> DataFrame:
    base = scratch(t, "lines")
    t.supplier.repartition(1, "s_nationkey").write.partitionBy("s_nationkey").csv(base)
    names = readers.list_files(t.spark, base, "*.csv").select("path", "name").distinct()
    expected = names.select("name").unionByName(t.region.filter("r_regionkey = 0").select(F.lit("absent.csv").alias("name"))).distinct()
    counts = writers.line_counts(t.spark, base, expected)
    return counts.agg(F.sum("lines").alias("lines"), F.count_if("present").alias("letters"), F.count_if(~F.col("present")).alias("missing"))


@query(
    """SELECT sha256(string_agg(s_suppkey || '|' || s_name, chr(10) ORDER BY s_suppkey) || chr(10)) AS sha256, 'present' AS status FROM supplier GROUP BY s_nationkey
UNION ALL SELECT NULL, '(missing)'"""
)
def file_inventory(t: Tables) -> DataFrame:
    """Presence and content hash of one text file per nation and of one that was never written."""
    base = scratch(t, "inventory")
    lines = t.supplier.select("s_nationkey", "s_suppkey", F.concat_ws("|", "s_suppkey", "s_name").alias("value"))
    ordered = lines.repartition("s_nationkey").sortWithinPartitions("s_nationkey", "s_suppkey")
    ordered.select("s_nationkey", "value").write.partitionBy("s_nationkey").text(base)
    written = readers.list_files(t.spark, base, "*.txt").select("name")
    expected = written.unionByName(t.region.filter("r_regionkey = 0").select(F.lit("absent.txt").alias("name")))
    return writers.inventory(t.spark, base, expected).filter("name LIKE '%.txt'").select("sha256", "status")


# Streaming: the events file arrives as a stream and every query runs until it is consumed.
def event_stream(t: Tables) -> DataFrame:
    return incremental.read_stream(t.spark, t.folder, t.events.schema, "events.parquet")


@query("SELECT DISTINCT event_id // 3 AS caseid, user_id AS canonical_smiles FROM events")
def streamed_case_dedup(t: Tables) -> DataFrame:
    out = scratch(t, "dedup")
    rows = event_stream(t).select(F.floor(F.col("event_id") / 3).alias("caseid"), F.col("user_id").alias("canonical_smiles"), F.col("ts").cast("timestamp"))
    incremental.run_available(incremental.case_dedup(rows, time="ts"), incremental.parquet_sink(out), scratch(t, "ckpt"))
    return t.spark.read.parquet(out).select("caseid", "canonical_smiles")


@query("SELECT user_id, count(*) AS n_reports, count(*) FILTER (WHERE value > 90) AS serious_outcome_reports FROM events GROUP BY 1")
def streamed_counts(t: Tables) -> DataFrame:
    out = scratch(t, "counts")
    rows = event_stream(t).select("user_id", (F.col("value") > 90).cast("int").alias("serious"))
    counts = incremental.running_counts(rows, "user_id", "serious")
    incremental.run_available(counts, log_sink(out), scratch(t, "ckpt"), "update")
    return incremental.current_counts(t.spark, out, counts.schema, "user_id")


@query("SELECT (event_id // 3)::VARCHAR AS caseid, max(event_id)::VARCHAR AS primaryid FROM events GROUP BY 1")
def streamed_latest_versions(t: Tables) -> DataFrame:
    out = scratch(t, "latest")
    rows = event_stream(t).select(
        F.floor(F.col("event_id") / 3).cast("string").alias("caseid"), (F.col("event_id") % 3).cast("string").alias("caseversion"),
        F.date_format("ts", "yyyyMMdd").alias("fda_dt"), F.lit("2024q1").alias("quarter"), F.col("event_id").cast("string").alias("primaryid"))
    incremental.run_available(rows, incremental.latest_version_sink(out), scratch(t, "ckpt"))
    return incremental.latest_versions(t.spark, out, rows.schema).select("caseid", "primaryid")


@query(
    """WITH lk AS (SELECT 'user ' || s_suppkey AS n, 'X' || s_nationkey AS st FROM supplier WHERE s_nationkey <> 7)
SELECT event_id, x.st AS source, y.st AS target FROM events JOIN lk x ON x.n = 'user ' || user_id JOIN lk y ON y.n = 'user ' || (event_id % 100)"""
)
def streamed_edges(t: Tables) -> DataFrame:
    out = scratch(t, "edges")
    rows = event_stream(t).select("event_id", F.concat(F.lit("User "), "user_id").alias("a"), F.concat(F.lit("user  "), F.col("event_id") % 100).alias("b"))
    lookup = t.supplier.filter("s_nationkey <> 7").select(F.concat(F.lit("user "), "s_suppkey").alias("name"), F.concat(F.lit("X"), "s_nationkey").alias("structure"))
    incremental.run_available(incremental.map_edges(rows, lookup, "a", "b", ["event_id"]), incremental.parquet_sink(out), scratch(t, "ckpt"))
    return t.spark.read.parquet(out).select("event_id", "source", "target")

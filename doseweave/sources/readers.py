"""File readers: declared columns, all-string where the source is text, file of origin kept."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from doseweave.functions.text import norm_name
from doseweave.operators.clean import ContractError, require_columns, resolve_column
from doseweave.plans.ordering import positions
from doseweave.session import durable
from doseweave.sources.bulk_json import record_texts


def file_name() -> Column:
    return F.col("_metadata.file_name")


def read_edges(spark: SparkSession, path: str) -> DataFrame:
    """The three projected string columns of an edge file; other columns are never parsed."""
    df = spark.read.csv(path, header=True)
    return require_columns(df, ["source", "target", "interaction_type"], "edges").select("source", "target", "interaction_type")


def list_files(spark: SparkSession, base: str, pattern: str = "*") -> DataFrame:
    """(path, name, bytes) below a folder; contents are not read."""
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(base)
    return listed.select("path", F.regexp_extract("path", r"([^/]+)$", 1).alias("name"), F.col("length").alias("bytes"))


def find_report_files(spark: SparkSession, base: str) -> dict[str, list[str]]:
    """Paths of the DRUG, OUTC, DEMO and DELETE text files in nested folders."""
    rows = list_files(spark, base, "*.[tT][xX][tT]").select("path", F.upper("name").alias("name")).collect()
    return {t: sorted(r["path"] for r in rows if r["name"].startswith(t)) for t in ("DRUG", "OUTC", "DEMO", "DELETE")}


def read_delimited_reports(spark: SparkSession, path: str | list[str], table: str, columns: Sequence[str]) -> DataFrame:
    """A $-separated latin-1 table as strings, blanks kept, with the quarter of its file; one file per quarter."""
    raw = (
        spark.read.option("sep", "$").option("header", True).option("encoding", "ISO-8859-1").option("emptyValue", "")
        .option("nullValue", "\u0001").option("quote", "").csv(path)
    )
    chosen = []
    for name in columns:
        found = resolve_column(raw, [name])
        if found is None:
            raise ContractError(f"{table} is missing required columns: {[name]}")
        chosen.append(F.coalesce(F.col(f"`{found}`"), F.lit("")).alias(name))
    year_quarter = F.regexp_extract(F.upper(file_name()), r"(\d{2,4})Q(\d)", 1)
    quarter = F.concat(F.when(F.length(year_quarter) == 2, F.concat(F.lit("20"), year_quarter)).otherwise(year_quarter), F.lit("q"),
                       F.regexp_extract(F.upper(file_name()), r"(\d{2,4})Q(\d)", 2))
    return raw.select(*chosen, quarter.alias("quarter"))


def require_one_file_per_quarter(paths: Sequence[str]) -> None:
    import re

    quarters = [m.group(0).upper() for p in paths if (m := re.search(r"\d{2,4}[qQ]\d(?=[^/]*$)", p))]
    if len(quarters) != len(set(quarters)):
        raise ContractError("more than one file for a quarter")


def read_deleted_ids(spark: SparkSession, path: str | list[str]) -> DataFrame:
    return spark.read.text(path).select(F.trim("value").alias("caseid")).filter("caseid <> ''")


def read_molecule_table(spark: SparkSession, path: str, required: Sequence[str]) -> DataFrame:
    return require_columns(spark.read.csv(path, sep="\t", header=True), required, "molecules")


def read_target_map(spark: SparkSession, path: str, names: Sequence[str] = ("accession", "target_id", "target_name", "target_type")) -> DataFrame:
    """Headerless tab text with # comments; rows without the first two keys are dropped."""
    schema = ", ".join(f"{n} string" for n in names)
    rows = spark.read.csv(path, sep="\t", comment="#", header=False, schema=schema)
    return rows.filter((F.trim(F.col(names[0])) != "") & (F.trim(F.col(names[1])) != ""))


def target_map_counts(mapping: DataFrame) -> DataFrame:
    keys = mapping.columns[:2]
    return mapping.agg(F.count(F.lit(1)).alias("rows"), *[F.count_distinct(k).alias(f"distinct_{k}") for k in keys])


def _by_header(spark: SparkSession, paths: Sequence[str]) -> list[tuple[str, tuple[str, ...], list[str]]]:
    """Files grouped by (separator, header), so each distinct header is one scan. Only first lines are read here."""
    groups: dict[tuple[str, tuple[str, ...]], list[str]] = {}
    for path in sorted(paths):
        first = spark.read.text(path).limit(1).head()
        if first is None:
            continue
        line = first["value"].lstrip("﻿")
        sep = "\t" if line.count("\t") > line.count(",") else ","
        groups.setdefault((sep, tuple(c.strip().strip('"') for c in line.split(sep))), []).append(path)
    return [(sep, header, files) for (sep, header), files in groups.items()]


def with_source_row(df: DataFrame) -> DataFrame:
    """1-based row number per source file. Rows are numbered inside each scan partition and the counts of earlier
    partitions added, so one large file is never ordered in one task."""
    fixed = durable(df.withColumn("_mid", F.monotonically_increasing_id()))
    ranked = positions(fixed, ["_mid"], F.shiftright("_mid", 33), by=["source_file"], name="source_row")
    return ranked.drop("_mid")


# Header spellings of the curated interaction exports.
INTERACTION_ALIASES = {
    "name_a": ("drug1_name", "drug_a_name", "drugname1", "drug_name_1", "drug1", "drug_a", "drug_a_drug_name"),
    "name_b": ("drug2_name", "drug_b_name", "drugname2", "drug_name_2", "drug2", "drug_b", "drug_b_drug_name"),
    "level": ("severity", "level", "risk_level", "interaction_level", "severity_level", "risk"),
    "description": ("description", "interaction_description", "mechanism", "effect", "interaction"),
}


def read_interactions(spark: SparkSession, folder: str) -> DataFrame:
    """Union of the per-letter exports, CSV or tab text, with alias-resolved columns, source file and row."""
    paths = [r["path"] for r in list_files(spark, folder, "*.[ctCT][sS][vV]").collect()]
    parts = []
    for sep, _, files in _by_header(spark, paths):
        raw = spark.read.csv(files, sep=sep, header=True)
        spelled = {c.strip().lower().replace(" ", "_"): c for c in raw.columns}
        columns = []
        for out, names in INTERACTION_ALIASES.items():
            found = next((spelled[n] for n in names if n in spelled), None)
            columns.append((F.col(f"`{found}`") if found else F.lit(None)).cast("string").alias(out))
        parts.append(raw.select(*columns, file_name().alias("source_file")))
    if not parts:
        raise ContractError(f"no interaction export in {folder}")
    return with_source_row(reduce(DataFrame.unionByName, parts))


def read_interactions_norm(spark: SparkSession, folder: str) -> DataFrame:
    """The same with normalised names and levels; a missing level is ``unknown``."""
    level = F.lower(F.trim(F.coalesce("level", F.lit("unknown"))))
    return read_interactions(spark, folder).select(
        norm_name(F.col("name_a")).alias("name_a"), norm_name(F.col("name_b")).alias("name_b"),
        F.coalesce(F.nullif(level, F.lit("")), F.lit("unknown")).alias("level"), "source_file", "source_row",
    )


LABEL_SCHEMA = """openfda struct<substance_name: array<string>, generic_name: array<string>>,
  drug_interactions array<string>, clinical_pharmacology array<string>, pharmacokinetics array<string>, mechanism_of_action array<string>"""


def read_label_documents(spark: SparkSession, path: str, one_per_file: bool = True) -> DataFrame:
    """One row per label of bulk JSON files; only the kept keys are parsed.

    A bulk file is one JSON document; it is cut into records by byte range, so one file is read by many tasks. With
    ``one_per_file`` off each line is a document.
    """
    if one_per_file:
        return record_texts(spark, path).select(F.from_json("record", LABEL_SCHEMA).alias("r")).select("r.*")
    docs = spark.read.schema(f"results array<struct<{LABEL_SCHEMA}>>").json(path)
    return docs.select(F.explode("results").alias("r")).select("r.*")


def read_pathway_tables(spark: SparkSession, folder: str) -> DataFrame:
    """Recursive tab tables with differing columns; files that cannot be read are skipped."""
    paths = [r["path"] for r in list_files(spark, folder, "*.[tT][sS][vV]").collect()]
    parts = [
        spark.read.option("ignoreCorruptFiles", True).csv(files, sep="\t", header=True).withColumn("source_file", file_name())
        for _, _, files in _by_header(spark, paths)
    ]
    if not parts:
        raise ContractError(f"no pathway table in {folder}")
    return reduce(lambda x, y: x.unionByName(y, allowMissingColumns=True), parts)


def read_folder_union(spark: SparkSession, folder: str, row_cap: int | None = None, xml_row_tag: str = "row") -> DataFrame:
    """csv, tsv, gzip and xml files of any letter case as one table of strings with its source file.

    Malformed lines are dropped. ``row_cap`` keeps the first rows of each file.
    """
    rows = list_files(spark, folder).select("path", F.lower("name").alias("name")).collect()
    text = [r["path"] for r in rows if r["name"].removesuffix(".gz").endswith((".csv", ".tsv", ".txt"))]
    xml = [r["path"] for r in rows if r["name"].endswith(".xml")]
    parts = [
        spark.read.option("mode", "DROPMALFORMED").csv(files, sep=sep, header=True, schema=", ".join(f"`{c}` string" for c in header))
        .withColumn("source_file", file_name())
        for sep, header, files in _by_header(spark, text)
    ]
    if xml:
        flat = spark.read.option("rowTag", xml_row_tag).option("mode", "DROPMALFORMED").xml(",".join(xml))
        parts.append(flat.select(*[F.col(c).cast("string").alias(c) for c in flat.columns], file_name().alias("source_file")))
    if not parts:
        raise ContractError(f"no readable table in {folder}")
    union = reduce(lambda x, y: x.unionByName(y, allowMissingColumns=True), parts)
    if row_cap is None:
        return union
    return with_source_row(union).filter(F.col("source_row") <= row_cap).drop("source_row")


GENE_HEADERS = ("gene", "gene_symbol", "symbol", "gene symbol", "identifier", "id_ref", "gene_id")


def read_expression_matrix(spark: SparkSession, path: str) -> DataFrame:
    """(source_file, gene, probe, sample, value): metadata lines, markers and comments skipped, header found by name."""
    lines = spark.read.text(path).select("value", file_name().alias("source_file")).filter(
        (F.trim("value") != "") & ~F.col("value").rlike("^[!^#]")
    )
    sep = F.when(F.col("value").contains("\t"), "\t").otherwise(",")
    cells = lines.select("source_file", F.transform(F.split("value", F.when(sep == "\t", "\t").otherwise(",")), lambda c: F.trim(F.regexp_replace(c, '^"|"$', ""))).alias("c"))
    lowered = F.transform("c", lambda c: F.lower(c))
    is_header = F.arrays_overlap(lowered, F.array(*map(F.lit, GENE_HEADERS))) & F.forall(F.slice("c", 2, 1), lambda c: c.try_cast("double").isNull())
    headers = cells.filter(is_header).groupBy("source_file").agg(F.min("c").alias("h"))
    place = F.array_max(F.transform(F.array(*map(F.lit, GENE_HEADERS[:4])), lambda g: F.array_position(F.transform("h", lambda x: F.lower(x)), g)))
    rows = cells.filter(~is_header).join(headers, "source_file").withColumn("_g", F.greatest(F.lit(1), place).cast("int"))
    named = rows.withColumns({"gene": F.get("c", F.col("_g") - 1), "probe": F.get("c", F.lit(0))})
    values = named.select("source_file", "gene", "probe", F.posexplode("c").alias("pos", "text"), F.col("h"))
    return values.withColumn("value", F.col("text").try_cast("double")).filter(
        (F.col("pos") > 0) & F.col("value").isNotNull() & (F.trim("gene") != "")
    ).select("source_file", "gene", "probe", F.get("h", F.col("pos")).alias("sample"), "value")


def read_fasta(spark: SparkSession, path: str) -> DataFrame:
    """accession, entry, organism, length, sequence of ``>db|accession|entry text OS=organism OX=...`` records."""
    records = spark.read.option("lineSep", "\n>").text(path).select(F.regexp_replace("value", "^>", "").alias("r")).filter("trim(r) <> ''")
    head, body = F.split_part("r", F.lit("\n"), F.lit(1)), F.regexp_extract("r", r"(?s)^[^\n]*\n(.*)$", 1)
    cut = records.select(head.alias("h"), F.upper(F.regexp_replace(body, r"\s+", "")).alias("sequence"))
    first = F.split_part("h", F.lit(" "), F.lit(1))
    return cut.select(
        F.coalesce(F.nullif(F.split_part(first, F.lit("|"), F.lit(2)), F.lit("")), first).alias("accession"),
        F.split_part(first, F.lit("|"), F.lit(3)).alias("entry"),
        F.trim(F.regexp_extract("h", r"OS=(.*?)(\sOX=|\sGN=|$)", 1)).alias("organism"), F.length("sequence").alias("length"), "sequence",
    )


def read_structure_headers(spark: SparkSession, path: str) -> DataFrame:
    """Per structure file: id, resolution, ligand codes and molecule names of its fixed-text header records."""
    lines = spark.read.option("recursiveFileLookup", True).text(path).select(
        "value", F.col("_metadata.file_path").alias("source_file")
    )
    resolution = F.regexp_extract("value", r"^REMARK\s+2\s+RESOLUTION\.\s+([0-9.]+)", 1).try_cast("double")
    ligand = F.when(F.col("value").rlike("^HET "), F.trim(F.substring("value", 8, 3)))
    molecule = F.when(F.col("value").rlike(r"^COMPND.*MOLECULE:"), F.trim(F.regexp_replace(F.regexp_extract("value", r"MOLECULE:\s*([^;]*)", 1), r"\s+", " ")))
    header = F.when(F.col("value").rlike("^HEADER"), F.trim(F.substring("value", 63, 4)))
    return lines.groupBy("source_file").agg(
        F.max(header).alias("structure_id"), F.min(resolution).alias("resolution"), F.sort_array(F.collect_set(ligand)).alias("ligands"),
        F.sort_array(F.collect_set(molecule)).alias("molecules"),
    )


def read_parquet_pairs(spark: SparkSession, pairs: str, catalogue: str) -> DataFrame:
    """Prepared index-coded pairs with their structures; a repeated index or a dangling endpoint is an error."""
    from doseweave.operators.identity import ids_to_structures, require_unique

    drugs = spark.read.parquet(catalogue)
    require_columns(drugs, ["drug_idx", "structure"], "catalogue")
    require_unique(drugs, "drug_idx")
    return ids_to_structures(spark.read.parquet(pairs), drugs, "drug_a", "drug_b")

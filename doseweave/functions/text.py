"""Names, codes, gene lists and label text as column expressions."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from doseweave.operators.clean import one_per

# Enzyme isoforms, the words that mark a role, and the code and symbol patterns.
ISOFORMS = ("1A2", "2B6", "2C8", "2C9", "2C19", "2D6", "2E1", "3A4")
ROLE_WORDS = {
    "substrate": "metaboli[sz]|substrate|oxidi[sz]|biotransform|catalyz|catalys",
    "inhibitor": "inhibit",
    "inducer": "induc",
}
ATC_PATTERN = "^[A-Z][0-9]{2}[A-Z]{2}[0-9]{2}$"
ATC_PREFIX_PATTERN = "^[A-Z][0-9]{2}"
GENE_CELL_PATTERN = "^[A-Z][A-Z0-9]{1,9}$"
RESIDUES = "ACDEFGHIKLMNPQRSTVWY"


def norm_name(c: Column) -> Column:
    return F.regexp_replace(F.lower(F.trim(c)), r"\s+", " ")


@F.pandas_udf(T.StringType())
def _unicode_key(names: pd.Series) -> pd.Series:
    folded = names.map(lambda s: unicodedata.normalize("NFKC", s).casefold(), na_action="ignore")
    return folded.str.replace(r"[^\w]+", " ", regex=True).str.strip()


def with_norm_drug_name(df: DataFrame, column: str, out: str) -> DataFrame:
    """Compatibility-normalised, case-folded words of a name; empty becomes null.

    ASCII names need only built-ins; Python sees each distinct other name once.
    """
    ascii_only = F.col(column).rlike(r"^[\x00-\x7F]*$")
    odd = df.select(column).filter(~ascii_only).distinct().withColumn("_key", _unicode_key(F.col(column)))
    plain = F.trim(F.regexp_replace(F.lower(F.col(column)), r"[^A-Za-z0-9_]+", " "))
    key = F.when(ascii_only, plain).otherwise(F.col("_key"))
    return df.join(odd, column, "left").withColumn(out, F.nullif(key, F.lit(""))).drop("_key")


def split_multi(c: Column) -> Column:
    parts = F.transform(F.split(F.coalesce(c, F.lit("")), r"[,;|]"), lambda x: F.trim(x))
    return F.filter(parts, lambda x: x != "")


def split_accessions(c: Column) -> Column:
    parts = F.split(F.trim(F.coalesce(c, F.lit(""))), r"[|,;\s]+")
    return F.filter(parts, lambda x: (x != "") & (F.lower(x) != "nan"))


def parse_gene_list(c: Column) -> Column:
    """Sorted distinct genes of a JSON list, a quoted literal list or delimited text."""
    text = F.trim(c)
    as_json = F.from_json(text, "array<string>")
    literal = F.regexp_replace(F.regexp_replace(text, r"^[\[{(]+|[\]})]+$", ""), r"['\"]", "")
    quoted = text.rlike(r"^[\[({].*['\"]")
    listed = F.when(quoted, F.split(literal, r",")).otherwise(F.split(literal, r"[,;|\s]+"))
    blank = text.isNull() | text.isin("", "[]", "{}", "nan", "None")
    items = F.when(blank, F.array().cast("array<string>")).otherwise(F.coalesce(as_json, listed))
    trimmed = F.filter(F.transform(items, lambda x: F.trim(x)), lambda x: x.isNotNull() & (x != ""))
    return F.array_sort(F.array_distinct(trimmed))


def explode_drugs_genes(df: DataFrame, drugs: str, genes: str, keep: list[str]) -> DataFrame:
    """One row per drug and gene named in two multi-value cells of the same row."""
    return df.select(*keep, F.explode(split_multi(F.col(drugs))).alias("drug_name"), genes).select(
        *keep, "drug_name", F.explode(split_multi(F.col(genes))).alias("gene_symbol")
    )


def drug_from_filename(c: Column) -> Column:
    """Drug name held in a pathway file name: directory, accession prefix and extension removed."""
    base = F.regexp_replace(F.regexp_replace(c, r"^.*/", ""), r"\.[A-Za-z0-9]+$", "")
    return F.trim(F.regexp_replace(F.regexp_replace(base, r"^PA\d+[-_]?", ""), r"[_-]+", " "))


def gene_cells(df: DataFrame, columns: list[str], keep: list[str]) -> DataFrame:
    """Distinct gene-like tokens of any of the columns."""
    cells = F.flatten(F.array(*[split_multi(F.col(c).cast("string")) for c in columns]))
    genes = F.array_distinct(F.filter(cells, lambda x: x.rlike(GENE_CELL_PATTERN)))
    return df.select(*keep, F.explode(genes).alias("gene_symbol")).distinct()


def atc_levels(c: Column) -> Column:
    code = F.upper(F.trim(c))
    levels = F.filter(
        F.transform(F.array(*map(F.lit, (1, 3, 4, 5))), lambda n: F.when(F.length(code) >= n, code.substr(F.lit(1), n))),
        lambda x: x.isNotNull(),
    )
    return F.when(code.rlike(ATC_PREFIX_PATTERN), levels).otherwise(F.array().cast("array<string>"))


def find_codes_in_json(c: Column, key: str, pattern: str) -> Column:
    """Sorted distinct values of a key anywhere in a JSON text that match a pattern."""
    found = F.regexp_extract_all(c, F.lit(f'"{key}"\\s*:\\s*"?([^",}}\\]]*)"?'), F.lit(1))
    clean = F.transform(found, lambda x: F.upper(F.trim(x)))
    return F.array_sort(F.array_distinct(F.filter(clean, lambda x: x.rlike(pattern))))


def explode_codes(df: DataFrame, key: str, codes: str, out: str) -> DataFrame:
    """Pipe-joined codes to distinct (key, code) rows."""
    rows = df.select(key, F.explode(F.split(F.coalesce(F.col(codes), F.lit("")), r"\|")).alias(out))
    return rows.filter(F.trim(out) != "").distinct()


def cyp_flag(text: Column, isoform: str, role: str, window: int = 100) -> Column:
    """1 if a role word stands within ``window`` characters of a mention of the isoform.

    The text is cut at the mentions of this isoform: a role word near any mention is near one of the two that
    bound its piece, so only the edges of each piece are searched.
    """
    pieces = F.split(text, rf"(?i)CYP\s*-?\s*{isoform}")
    last = F.size(pieces) - 1

    def near(piece: Column, i: Column) -> Column:
        after = (i > 0) & F.substring(piece, 1, window).rlike(f"(?i){ROLE_WORDS[role]}")
        before = (i < last) & F.right(piece, F.lit(window)).rlike(f"(?i){ROLE_WORDS[role]}")
        return F.when(after | before, i)

    return F.exists(F.transform(pieces, near), lambda hit: hit.isNotNull()).cast("int")


def cyp_flags(text: Column, window: int = 100) -> list[Column]:
    return [cyp_flag(text, iso, role, window).alias(f"cyp{iso}_{role}") for iso in ISOFORMS for role in ROLE_WORDS]


def clean_sequence(c: Column) -> Column:
    """Upper-case standard residues only; null when none is left."""
    return F.nullif(F.regexp_replace(F.upper(c), f"[^{RESIDUES}]", ""), F.lit(""))


def target_aliases(df: DataFrame, text: str, aliases: DataFrame) -> DataFrame:
    """(row columns, symbol) for each alias(pattern, symbol) contained anywhere in the text, in any letter case.

    A pattern may hold spaces and hyphens and stand inside a word. Its first three letters (all of a shorter one) are
    the key of an equi-join with the distinct pieces of that length of the text; containment is confirmed after.
    """
    lowered = F.lower(text)

    def grams(n: int):
        last = F.length("_text") - (n - 1)
        at = F.when(last > 0, F.sequence(F.lit(1), F.greatest(last, F.lit(1)))).otherwise(F.array().cast("array<int>"))
        return F.transform(at, lambda i: F.substr("_text", i, F.lit(n)))

    pieces = df.withColumn("_text", lowered).withColumn("_gram", F.explode(F.array_distinct(F.concat(*[grams(n) for n in (1, 2, 3)]))))
    keyed = aliases.select(F.lower("pattern").alias("_pattern"), "symbol").withColumn("_gram", F.substring("_pattern", 1, 3))
    hits = pieces.join(keyed.filter(F.length("_pattern") > 0), "_gram").filter(F.contains("_text", "_pattern"))
    return hits.drop("_gram", "_text", "_pattern").distinct()


WORD_EDGES = r"(?U)(?<=\w)(?=\W)|(?<=\W)(?=\w)"


def find_mentions(docs: DataFrame, doc: str, text: str, names: DataFrame, min_length: int = 5, snippet: int = 90) -> DataFrame:
    """Mentions of names(name, name_id) in each text: counts per (document, id) and the first snippet.

    Leftmost, longest name first, word-bounded, without overlaps, and not the document's own id when the documents
    carry ``own_id``. Each text becomes alternating words and separators; a word joins the names that start with
    it, and only the next few pieces travel with it, never the text.
    """
    lexicon = (
        names.filter((F.length("name") >= min_length) & F.col("name").rlike(r"(?U)^\w") & F.col("name").rlike(r"(?U)\w$"))
        .withColumn("_parts", F.split("name", WORD_EDGES))
        .select("name", "name_id", F.element_at("_parts", 1).alias("_word"), F.size("_parts").alias("_n"))
    )
    longest = F.coalesce(lexicon.agg(F.max("_n")).scalar(), F.lit(1))
    own = ["own_id"] if "own_id" in docs.columns else []
    pieces = docs.select(doc, *own, F.split(F.lower(text), WORD_EDGES).alias("_p")).withColumn("_max", longest)
    # Words and separators alternate, so the first piece tells where all the words are.
    first = F.when(F.get("_p", F.lit(0)).rlike(r"(?U)^\w"), 0).otherwise(1)
    places = F.when(F.size("_p") > first, F.sequence(first, F.size("_p") - 1, F.lit(2)))
    ahead = F.transform(
        places,
        lambda i: F.struct(F.get("_p", i).alias("word"), F.slice("_p", i + 1, F.col("_max")).alias("next"), i.alias("at")),
    )
    starts = pieces.select(doc, *own, F.explode(ahead).alias("s"))
    hits = (
        starts.select(doc, *own, F.col("s.word").alias("_word"), F.col("s.next").alias("_next"), F.col("s.at").alias("_at"))
        .join(lexicon, "_word")
        .filter(F.concat_ws("", F.slice("_next", F.lit(1), F.col("_n"))) == F.col("name"))
    )
    leftmost = one_per(hits, [doc, "_at"], [F.desc("_n")])
    spans = leftmost.groupBy(doc, *own).agg(
        F.sort_array(F.collect_list(F.struct(F.col("_at").alias("at"), (F.col("_at") + F.col("_n")).alias("end"), "name_id", "name"))).alias("_s")
    )
    span_type = "struct<end:int,kept:array<struct<at:int,end:int,name_id:bigint,name:string>>>"
    nothing = F.from_json(F.lit('{"end":-1,"kept":[]}'), span_type)
    span = F.transform("_s", lambda s: F.struct(
        s["at"].cast("int").alias("at"), s["end"].cast("int").alias("end"), s["name_id"].cast("long").alias("name_id"),
        s["name"].alias("name"),
    ))

    def keep(done: Column, s: Column) -> Column:
        longer = F.struct(s["end"].alias("end"), F.concat(done["kept"], F.array(s)).alias("kept"))
        return F.when(s["at"] >= done["end"], longer).otherwise(done)

    kept = F.aggregate(span, nothing, keep)
    found = spans.select(doc, *own, F.explode(kept.getField("kept")).alias("s")).select(doc, *own, "s.*")
    if own:
        found = found.filter(F.col("name_id") != F.col("own_id"))
    counted = found.groupBy(doc, "name_id").agg(
        F.count(F.lit(1)).alias("n_mentions"), F.min(F.struct("at", "name")).alias("_first")
    )
    placed = counted.join(docs.select(doc, F.col(text).alias("_text")), doc)
    offset = F.length(
        F.concat_ws("", F.slice(F.split(F.lower("_text"), WORD_EDGES), F.lit(1), F.col("_first.at")))
    )
    start = F.greatest(F.lit(0), offset - snippet)
    width = offset - start + F.length("_first.name") + snippet
    return placed.select(
        doc, "name_id", "n_mentions",
        F.regexp_replace(F.col("_text").substr(start + 1, width), "\n", " ").alias("snippet"),
    )

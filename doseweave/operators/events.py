"""Undirected pair-event tables, vocabularies and supports."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from doseweave.operators.clean import ContractError, canonical_pair, usable_edges
from doseweave.plans.ordering import dense_ids, dense_positions
from doseweave.session import durable


PAIR_BUCKETS = 65536


@dataclass(frozen=True)
class EventTable:
    """drugs(drug_idx, smiles), events(event_idx, event, n_pairs), pairs(pair_id, drug_a, drug_b), labels(pair_id,
    event_idx): only the ones are stored; an absent label means unreported, not safe."""

    drugs: DataFrame
    events: DataFrame
    pairs: DataFrame
    labels: DataFrame


def unified_edges(edges: DataFrame, a: str = "source", b: str = "target", event: str = "interaction_type") -> DataFrame:
    """Distinct (min, max, type) without self loops."""
    return canonical_pair(usable_edges(edges, a, b, event).select(a, b, event), a, b).distinct()


def event_table(edges: DataFrame, a: str = "source", b: str = "target", event: str = "interaction_type") -> EventTable:
    """Canonical pairs x events with dense ids in sorted order; duplicates collapse to one.

    Numbering reads its input more than once, so each numbered table is made durable before the next uses it.
    """
    facts = durable(
        unified_edges(edges, a, b, event).select(F.col(a).alias("a"), F.col(b).alias("b"), F.col(event).alias("event"))
    )
    ends = facts.select(F.explode(F.array("a", "b")).alias("smiles")).distinct()
    drugs = durable(dense_ids(ends, "smiles", "drug_idx"))
    events = durable(dense_ids(facts.groupBy("event").agg(F.count(F.lit(1)).alias("n_pairs")), "event", "event_idx"))
    n = drugs.agg(F.count(F.lit(1))).scalar()
    coded = (
        facts.join(drugs.select(F.col("smiles").alias("a"), F.col("drug_idx").alias("drug_a")), "a")
        .join(drugs.select(F.col("smiles").alias("b"), F.col("drug_idx").alias("drug_b")), "b")
        .join(events.select("event", "event_idx"), "event")
        .select("drug_a", "drug_b", "event_idx").withColumn("_n", n)
    )
    # A drug is in fewer distinct pairs than there are drugs, so ranges of the pair grid are buckets of bounded size.
    cut = F.floor((F.col("drug_a") * F.col("_n") + F.col("drug_b")) * PAIR_BUCKETS / (F.col("_n") * F.col("_n")))
    numbered = dense_positions(coded, ["drug_a", "drug_b"], cut, ["drug_a", "drug_b", "event_idx"], "pair_id", "_first").withColumn("pair_id", F.col("pair_id") - 1)
    return EventTable(
        drugs, events, numbered.filter("_first").select("pair_id", "drug_a", "drug_b"), numbered.select("pair_id", "event_idx")
    )


def event_table_report(edges: DataFrame, a: str = "source", b: str = "target", event: str = "interaction_type") -> DataFrame:
    """Row accounting of an event-table build in one pass plus two distinct counts."""
    missing = F.col(a).isNull() | F.col(b).isNull() | F.col(event).isNull()
    rows = edges.agg(
        F.count(F.lit(1)).alias("n_rows"), F.count_if(missing).alias("n_missing"),
        F.count_if(~missing & (F.col(a) == F.col(b))).alias("n_self"),
    )
    facts = unified_edges(edges, a, b, event)
    kept = facts.agg(F.count(F.lit(1)).alias("n_labels"))
    pairs = facts.select(a, b).distinct().agg(F.count(F.lit(1)))
    return rows.withColumns({"n_labels": kept.scalar(), "n_pairs": pairs.scalar()}).withColumn(
        "n_duplicates", F.col("n_rows") - F.col("n_missing") - F.col("n_self") - F.col("n_labels")
    )


def dedupe_pairs(df: DataFrame, a: str, b: str, label: str) -> DataFrame:
    """One row per unordered pair; conflicting labels (null included) fail the query."""
    text = F.coalesce(F.col(label).cast("string"), F.lit("<null>"))
    per = canonical_pair(df, a, b).groupBy(a, b).agg(
        F.max(label).alias(label), F.min(text).alias("_lo"), F.max(text).alias("_hi")
    )
    clash = F.concat(F.lit("conflicting labels for pair "), F.col(a).cast("string"), F.lit(", "), F.col(b).cast("string"))
    kind = per.schema[label].dataType
    checked = F.when(F.col("_lo") != F.col("_hi"), F.raise_error(clash).cast(kind)).otherwise(F.col(label))
    return per.withColumn(label, checked).drop("_lo", "_hi")


def label_conflicts(df: DataFrame, a: str, b: str, label: str, examples: int = 5) -> DataFrame:
    """The first pairs whose rows carry different labels."""
    text = F.coalesce(F.col(label).cast("string"), F.lit("<null>"))
    per = canonical_pair(df, a, b).groupBy(a, b).agg(F.min(text).alias("first_label"), F.max(text).alias("last_label"))
    return per.filter("first_label <> last_label").orderBy(a, b).limit(examples)


def scaled_min_pairs(min_pairs_full: int, n_train: int, n_total: int) -> int:
    """The full table's support rule at the training fraction, rounded up."""
    return -(-min_pairs_full * n_train // max(n_total, 1))


def freeze_vocabulary(labels: DataFrame, train: DataFrame, min_pos: int, min_neg: int = 1) -> DataFrame:
    """Events with enough training positives and negatives, numbered by event id."""
    n_train = train.agg(F.count(F.lit(1))).scalar()
    counts = labels.join(train.select("pair_id"), "pair_id", "left_semi").groupBy("event_idx").agg(
        F.count(F.lit(1)).alias("train_pos")
    )
    kept = (
        counts.withColumn("_n", n_train).withColumn("train_neg", F.col("_n") - F.col("train_pos")).drop("_n")
        .filter((F.col("train_pos") >= min_pos) & (F.col("train_neg") >= min_neg))
    )
    return dense_ids(durable(kept), "event_idx", "head_idx")


def pos_weights(vocabulary: DataFrame, clip: float | None = None) -> DataFrame:
    weight: Column = F.col("train_neg") / F.greatest(F.col("train_pos"), F.lit(1))
    return vocabulary.withColumn("pos_weight", F.least(weight, F.lit(float(clip))) if clip else weight)


def event_support(
    labels: DataFrame, vocabulary: DataFrame, partitions: DataFrame, names: Sequence[str], min_pos: int = 5
) -> DataFrame:
    """Positives per event x partition and whether both classes reach ``min_pos`` there; zero where unseen."""
    sizes = partitions.agg(F.struct(*[F.count_if(F.col("partition") == n).alias(n) for n in names])).scalar()
    counts = labels.join(partitions, "pair_id").groupBy("event_idx").agg(
        *[F.count_if(F.col("partition") == n).alias(f"pos_{n}") for n in names]
    )
    out = vocabulary.select("event_idx").join(counts, "event_idx", "left").withColumn("_sizes", sizes)
    for n in names:
        pos = F.coalesce(F.col(f"pos_{n}"), F.lit(0))
        out = out.withColumn(f"pos_{n}", pos).withColumn(
            f"evaluable_{n}", (F.col(f"pos_{n}") >= min_pos) & (F.col(f"_sizes.{n}") - F.col(f"pos_{n}") >= min_pos)
        )
    return out.drop("_sizes")


def top_k_items(items: DataFrame, item: str, k: int) -> DataFrame:
    """The k most frequent items; ties go to the lower name."""
    return items.groupBy(item).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), F.asc(item)).limit(k)


def top_k_vocabulary(lists: DataFrame, column: str, k: int = 50) -> DataFrame:
    exploded = lists.select(F.explode(column).alias("item")).filter(F.col("item").isNotNull() & (F.col("item") != ""))
    return top_k_items(exploded, "item", k)


def multitask_labels(edges: DataFrame, k: int, a: str = "source", b: str = "target", event: str = "interaction_type") -> DataFrame:
    """Per unordered pair a 0/1 vector over the k most frequent events, in vocabulary order."""
    top = top_k_items(usable_edges(edges, a, b, event), event, k)
    vocabulary = top.agg(
        F.transform(F.sort_array(F.collect_list(F.struct((-F.col("n")).alias("r"), F.col(event).alias("e")))), lambda s: s["e"])
    ).scalar()
    facts = unified_edges(edges, a, b, event)
    per = facts.join(top.select(event).withColumn("_top", F.lit(1)), event, "left").groupBy(a, b).agg(
        F.collect_set(F.when(F.col("_top").isNotNull(), F.col(event))).alias("_present")
    )
    return per.withColumn("_vocab", vocabulary).select(
        a, b, F.transform("_vocab", lambda v: F.array_contains("_present", v).cast("int")).alias("labels")
    )


def label_grid(pairs: DataFrame, vocabulary: DataFrame, labels: DataFrame) -> DataFrame:
    """Every pair x vocabulary event, 0 where not reported. The frozen vocabulary travels as one small array.

    A pair meets its events before it is spread over the vocabulary, so cells are never shuffled.
    """
    heads = vocabulary.agg(F.sort_array(F.collect_list("event_idx"))).scalar()
    held = labels.withColumn("_heads", heads).filter(F.array_contains("_heads", F.col("event_idx"))).groupBy("pair_id").agg(
        F.collect_set("event_idx").alias("_held")
    )
    cells = pairs.select("pair_id").join(held, "pair_id", "left").withColumn("_heads", heads).select(
        "pair_id", "_held", F.explode("_heads").alias("event_idx")
    )
    one = F.coalesce(F.array_contains("_held", F.col("event_idx")), F.lit(False))
    return cells.select("pair_id", "event_idx", one.cast("int").alias("label"))


def degree(pairs: DataFrame, a: str = "drug_a", b: str = "drug_b") -> DataFrame:
    return pairs.select(F.explode(F.array(a, b)).alias("drug")).groupBy("drug").agg(F.count(F.lit(1)).alias("degree"))


def popularity_score(pairs: DataFrame, train: DataFrame, a: str = "drug_a", b: str = "drug_b") -> DataFrame:
    """ln(1 + degree) summed over the endpoints; an unseen endpoint adds nothing."""
    deg = degree(train, a, b)
    out = pairs
    for side, name in ((a, "_da"), (b, "_db")):
        out = out.join(deg.select(F.col("drug").alias(side), F.col("degree").alias(name)), side, "left")
    return out.withColumn(
        "popularity", F.log1p(F.coalesce("_da", F.lit(0))) + F.log1p(F.coalesce("_db", F.lit(0)))
    ).drop("_da", "_db")


def frequency_prior(labels: DataFrame, train: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """(positives + 1) / (pairs + 2) per event."""
    n = train.agg(F.count(F.lit(1))).scalar()
    pos = labels.join(train.select("pair_id"), "pair_id", "left_semi").groupBy("event_idx").agg(F.count(F.lit(1)).alias("_p"))
    return vocabulary.select("event_idx").join(pos, "event_idx", "left").withColumn("_n", n).select(
        "event_idx", ((F.coalesce("_p", F.lit(0)) + 1) / (F.col("_n") + 2)).alias("prior")
    )


def require_minimum(df: DataFrame, n: int, what: str) -> None:
    if df.limit(n).count() < n:
        raise ContractError(f"at least {n} {what} are required")

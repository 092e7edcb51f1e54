"""Exact positions, running totals and order statistics without a one-task window.

A window over a whole table, or over a group that holds a third of it, sorts all of those rows in one task.
Everything here first cuts the order into *buckets*: a deterministic, order-preserving function of the value
itself. Rows are ordered inside (group, bucket) only, and the totals of the buckets before it come from a small
table with one row per (group, bucket). Buckets need no sampling, so a recomputed task always sees the same cut.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from doseweave.session import durable

HASH_DIGITS = 4
STEPS_PER_OCTAVE = 256
SPLITTERS = 1024


def hash_bucket(priority: Column) -> Column:
    """Bucket of a hexadecimal hash text: its first digits, 65,536 even buckets."""
    return F.substring(priority, 1, HASH_DIGITS)


def score_bucket(value: Column) -> Column:
    """Bucket of a double: 256 steps per power of two on either side of zero, so narrow score ranges still split."""
    magnitude = F.lit(1 << 20) + F.floor(F.log2(F.abs(value)) * STEPS_PER_OCTAVE)
    return F.when(value == 0, F.lit(0)).otherwise(F.signum(value) * magnitude).cast("int")


def _lower_bound(sorted_values: Column, value: Column) -> Column:
    """How many of the sorted values are not above ``value``: a binary search in ten steps."""
    steps = F.array(*[F.lit(SPLITTERS >> k) for k in range(SPLITTERS.bit_length())])

    def advance(done: Column, step: Column) -> Column:
        fits = (done + step <= F.size(sorted_values)) & (F.get(sorted_values, done + step - 1) <= value)
        return F.when(fits, done + step).otherwise(done)

    return F.aggregate(steps, F.lit(0), advance)


def with_key_bucket(df: DataFrame, key: str, name: str = "_bucket") -> DataFrame:
    """Bucket of any orderable key: its place among the 1,024 keys with the lowest hash.

    The lowest hashes of the distinct keys are an unbiased sample that does not depend on partitioning; the scalar
    subquery holds at most 1,024 values.
    """
    sample = df.select(F.col(key).alias("k")).distinct().orderBy(F.xxhash64("k"), "k").limit(SPLITTERS)
    cuts = sample.agg(F.sort_array(F.collect_list("k")).alias("cuts"))
    return (
        df.withColumn("_cuts", cuts.scalar())
        .withColumn(name, _lower_bound(F.col("_cuts"), F.col(key)))
        .drop("_cuts")
    )


def _before(sizes: DataFrame, names: Sequence[str], by: Sequence[str], descending: bool = False) -> DataFrame:
    """Totals of all earlier buckets of the same group."""
    order = F.col("_bucket").desc() if descending else F.col("_bucket")
    earlier = Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return sizes.select(
        *by, "_bucket", *[(F.sum(n).over(earlier) - F.col(n)).alias(f"_before_{n}") for n in names]
    )


def positions(
    df: DataFrame, order: Sequence[Column | str], bucket: Column, by: Sequence[str] = (), name: str = "position"
) -> DataFrame:
    """1-based position of each row in its group's order; ``order`` must start with the bucketed value."""
    tagged = df.withColumn("_bucket", bucket)
    sizes = tagged.groupBy(*by, "_bucket").agg(F.count(F.lit(1)).alias("n"))
    inside = tagged.withColumn(
        "_inside", F.row_number().over(Window.partitionBy(*by, "_bucket").orderBy(*order))
    )
    return (
        inside.join(_before(sizes, ["n"], by), [*by, "_bucket"])
        .withColumn(name, F.col("_before_n") + F.col("_inside"))
        .drop("_bucket", "_inside", "_before_n")
    )


def written_positions(
    df: DataFrame, order: Sequence[Column | str], bucket: Column, keep: Sequence[str], name: str = "position"
) -> DataFrame:
    """``keep`` columns and the 1-based position of each row, written once: rows and their order are worked out in one pass."""
    tagged = df.withColumn("_bucket", bucket)
    inside = F.row_number().over(Window.partitionBy("_bucket").orderBy(*order)).alias("_inside")
    return _placed(durable(tagged.select("_bucket", inside, *keep)), name)


def dense_positions(
    df: DataFrame, keys: Sequence[str], bucket: Column, keep: Sequence[str], name: str, first: str
) -> DataFrame:
    """``keep`` columns and the 1-based position of a row's keys among the distinct ones; ``first`` marks one row of each.

    One shuffle numbers rows and keys alike, written once. ``bucket`` is a function of the keys that rises with them.
    """
    window = Window.partitionBy("_bucket").orderBy(*keys)
    opens = F.row_number().over(window) == 1
    for key in keys:
        opens = opens | ~F.lag(key).over(window).eqNullSafe(F.col(key))
    tagged = df.select(bucket.alias("_bucket"), *dict.fromkeys([*keys, *keep]))
    ranked = tagged.select("_bucket", F.dense_rank().over(window).alias("_inside"), *keep, opens.alias(first))
    return _placed(durable(ranked), name)


def _placed(ranked: DataFrame, name: str) -> DataFrame:
    """Positions over all buckets; their totals are a written table, which the planner sees to be small."""
    before = durable(_before(ranked.groupBy("_bucket").agg(F.max("_inside").cast("long").alias("n")), ["n"], []))
    return ranked.join(before, "_bucket").withColumn(name, F.col("_before_n") + F.col("_inside")).drop("_bucket", "_inside", "_before_n")


def dense_ids(df: DataFrame, key: str, name: str) -> DataFrame:
    """0-based ids in sorted key order for a table with unique keys."""
    numbered = positions(with_key_bucket(df, key, "_cut"), [key], F.col("_cut"), name=name)
    return numbered.withColumn(name, F.col(name) - 1).drop("_cut")


def running_sums(
    df: DataFrame, value: str, sums: Sequence[str], by: Sequence[str] = (), descending: bool = False,
    bucket: Column | None = None,
) -> DataFrame:
    """Adds ``run_<name>``: the inclusive running sum of each named column in value order (values are distinct)."""
    tagged = df.withColumn("_bucket", score_bucket(F.col(value)) if bucket is None else bucket)
    sizes = tagged.groupBy(*by, "_bucket").agg(*[F.sum(n).alias(n) for n in sums])
    order = F.col(value).desc() if descending else F.col(value)
    inside = (
        Window.partitionBy(*by, "_bucket").orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    run = tagged.select("*", *[F.sum(n).over(inside).alias(f"_in_{n}") for n in sums])
    joined = run.join(_before(sizes, sums, by, descending), [*by, "_bucket"])
    return joined.select(
        *df.columns, *[(F.col(f"_before_{n}") + F.col(f"_in_{n}")).alias(f"run_{n}") for n in sums]
    )


def kth_values(
    df: DataFrame, value: str, targets: dict[str, Callable[[Column], Column]], by: Sequence[str] = (),
    bucket: Column | None = None, unique: bool = False,
) -> DataFrame:
    """Per group the exact k-th smallest value for each target rank (a function of the group size ``n``).

    Equal values collapse before the shuffle; values known to be ``unique`` skip that and are never shuffled at all:
    only bucket counts are, and then the rows of the few buckets that hold a wanted rank. These buckets are a written
    table, so that the planner knows how few they are. A rank outside 1..n gives null.
    """
    tagged = df.select(*by, F.col(value).alias("_v")).withColumn(
        "_bucket", score_bucket(F.col("_v")) if bucket is None else bucket
    )
    if unique:
        counts = tagged.withColumn("c", F.lit(1).cast("long"))
    else:
        counts = tagged.groupBy(*by, "_bucket", "_v").agg(F.count(F.lit(1)).alias("c"))
    sizes = tagged.groupBy(*by, "_bucket").agg(F.count(F.lit(1)).alias("_size"))
    if unique:
        sizes = durable(sizes)
    group = Window.partitionBy(*by)
    earlier = group.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ranks = F.array(*[rank(F.col("n")).cast("long") for rank in targets.values()])
    ladder = sizes.select(
        "*", F.sum("_size").over(group).alias("n"), (F.sum("_size").over(earlier) - F.col("_size")).alias("_before")
    ).withColumn("_ranks", ranks)
    holds = F.exists("_ranks", lambda k: k.between(F.col("_before") + 1, F.col("_before") + F.col("_size")))
    held = durable(ladder.filter(holds)) if unique else ladder.filter(holds)
    upto = Window.partitionBy(*by, "_bucket").orderBy("_v").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ranked = (
        counts.join(held, [*by, "_bucket"])
        .withColumn("_last", F.col("_before") + F.sum("c").over(upto))
    )
    first = F.col("_last") - F.col("c") + 1
    picked = [
        F.max(F.when(F.get("_ranks", F.lit(i)).between(first, F.col("_last")), F.col("_v"))).alias(t)
        for i, t in enumerate(targets)
    ]
    totals = sizes.groupBy(*by).agg(F.sum("_size").alias("n"))
    found = ranked.groupBy(*by).agg(*picked)
    if by:
        return totals.join(found, list(by), "left")
    row = found.agg(F.struct(*[F.max(t).alias(t) for t in targets])).scalar()
    return totals.withColumn("_row", row).select("n", *[F.col("_row").getField(t).alias(t) for t in targets])


def quantiles(df: DataFrame, value: str, probs: dict[str, float], by: Sequence[str] = ()) -> DataFrame:
    """Exact linearly interpolated quantiles (the NumPy default) of a group of any size."""
    targets: dict[str, Callable[[Column], Column]] = {}
    for name, q in probs.items():
        targets[f"{name}__lo"] = lambda n, q=q: F.floor((n - 1) * F.lit(float(q))) + 1
        targets[f"{name}__hi"] = lambda n, q=q: F.ceil((n - 1) * F.lit(float(q))) + 1
    found = kth_values(df, value, targets, by)

    def blend(name: str, q: float) -> Column:
        part = (F.col("n") - 1) * F.lit(float(q)) - F.floor((F.col("n") - 1) * F.lit(float(q)))
        low, high = F.col(f"{name}__lo"), F.col(f"{name}__hi")
        return (low + (high - low) * part).alias(name)

    return found.select(*by, "n", *[blend(name, q) for name, q in probs.items()])

"""Seeded choices by hash order: independent of partitioning, repeatable after a lost executor, checkable in SQL."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from doseweave.plans.ordering import hash_bucket, kth_values
from doseweave.session import durable


def priority(seed: int | str, *keys: Column) -> Column:
    """SHA-256 hex text of ``seed NUL key [NUL key ...]``."""
    return F.sha2(F.concat_ws("\u0000", F.lit(str(seed)), *[k.cast("string") for k in keys]), 256)


def uniform_integer(hex_text: Column, upper: Column) -> Column:
    """An integer in [0, upper) from the first 15 hexadecimal digits."""
    return F.pmod(F.conv(F.substring(hex_text, 1, 15), 16, 10).cast("long"), upper)


def unit_interval(hex_text: Column) -> Column:
    """A number in (0, 1) from the first 12 hexadecimal digits."""
    return (F.conv(F.substring(hex_text, 1, 12), 16, 10).cast("long") + 0.5) / F.lit(float(1 << 48))


def lowest(df: DataFrame, prio: str, n: int) -> DataFrame:
    """The n rows with the lowest unique priority, however large n is: a filter below the exact n-th priority."""
    cut = kth_values(df, prio, {"cut": lambda _: F.lit(n)}, bucket=hash_bucket(F.col("_v")), unique=True)
    edge = cut.select(F.when(F.col("n") <= n, F.lit("g")).otherwise(F.col("cut")))
    return df.filter(F.col(prio) <= F.coalesce(edge.scalar(), F.lit("g"))) if n > 0 else df.limit(0)


def by_fraction(
    df: DataFrame, keys: Sequence[str], seed: int | str, shares: dict[str, float], rest: str, name: str,
    by: Sequence[str] = (),
) -> DataFrame:
    """Names each row by cumulative shares of the hash order, in the order given; the remainder is ``rest``.

    Only the cut priorities are looked up, so the rows themselves are not reordered. They are a written table, which
    the planner sees to be small: joined by shuffle, a group would be one task. Counts are rounded half to even per share.
    """
    hashed = df.withColumn("_prio", priority(seed, *[F.col(k) for k in keys]))

    def upto(index: int):
        fractions = list(shares.values())[: index + 1]
        return lambda n: sum((F.bround(n * F.lit(f)) for f in fractions[1:]), F.bround(n * F.lit(fractions[0])))

    cuts = kth_values(
        hashed, "_prio", {f"_cut{i}": upto(i) for i in range(len(shares))}, by, bucket=hash_bucket(F.col("_v")), unique=True
    ).drop("n")
    if by:
        hashed = hashed.join(durable(cuts), list(by))
        edges = [F.col(f"_cut{i}") for i in range(len(shares))]
    else:
        hashed = hashed.withColumn("_row", cuts.select(F.struct("*")).scalar())
        edges = [F.col("_row").getField(f"_cut{i}") for i in range(len(shares))]
    role = F.lit(None).cast("string")
    for label, edge in reversed(list(zip(shares, edges, strict=True))):
        role = F.when(F.col("_prio") <= edge, F.lit(label)).otherwise(role)
    return hashed.withColumn(name, F.coalesce(role, F.lit(rest))).drop(
        "_prio", "_row", *[f"_cut{i}" for i in range(len(shares))]
    )

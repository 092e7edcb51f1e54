"""Scalar, array and map expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LOGIT_CLIP = 1e-6
EXPONENT_CLIP = 35.0


def clip(c: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), c))


def logit(p: Column) -> Column:
    q = clip(p.cast("double"), LOGIT_CLIP, 1 - LOGIT_CLIP)
    return F.ln(q / (1 - q))


def sigmoid(z: Column) -> Column:
    return 1.0 / (1.0 + F.exp(-clip(z, -EXPONENT_CLIP, EXPONENT_CLIP)))


def bernoulli_entropy(p: Column) -> Column:
    q = clip(p.cast("double"), 1e-12, 1 - 1e-12)
    return -(q * F.ln(q)) - (1 - q) * F.ln(1 - q)


def jaccard(a: Column, b: Column) -> Column:
    """Set overlap of two arrays; two empty sets agree fully."""
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(a, b)) / union)


def multi_hot(items: Column, vocabulary: Column) -> Column:
    return F.transform(vocabulary, lambda v: F.array_contains(items, v).cast("int"))


def pair_features(a: Column, b: Column, mode: str = "symmetric") -> Column:
    """Symmetric [a+b, |a-b|, a*b] or the plain concatenation of two vectors."""
    if mode == "concat":
        return F.concat(a, b)
    return F.concat(
        F.zip_with(a, b, lambda x, y: x + y), F.zip_with(a, b, lambda x, y: F.abs(x - y)),
        F.zip_with(a, b, lambda x, y: x * y),
    )


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y), F.lit(0.0), lambda s, x: s + x)


def total(a: Column) -> Column:
    return F.aggregate(F.transform(a, lambda x: x.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    return dot(a, b) / (F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)) + F.lit(1e-9))


def vector_tanimoto(a: Column, b: Column) -> Column:
    both = dot(a, b)
    size_a, size_b = (total(F.transform(v, lambda x: F.abs(x))) for v in (a, b))
    return clip(both / (size_a + size_b - both + F.lit(1e-6)), 0.0, 1.0)


def cyp_overlap(a: Column, b: Column, free_a: Column, free_b: Column) -> dict[str, Column]:
    """Shared liability above 0.6 per enzyme of two name -> value maps, displacement and their 0.65/0.35 blend."""

    def above(v: Column) -> Column:
        return F.greatest(F.lit(0.0), F.coalesce(v, F.lit(0.0)) - 0.6)

    parts = F.map_zip_with(a, b, lambda _, x, y: above(x) * above(y))
    overlap = clip(total(F.map_values(parts)) / 0.18, 0.0, 1.0)
    displacement = (1.0 - free_a) * (1.0 - free_b)
    top = F.array_sort(
        F.map_entries(parts),
        lambda x, y: F.when(x.value > y.value, -1).when(x.value < y.value, 1).when(x.key < y.key, -1).otherwise(1),
    )
    return {
        "cyp_overlap": overlap,
        "displacement_risk": displacement,
        "collision_index": clip(0.65 * overlap + 0.35 * displacement, 0.0, 1.0),
        "dominant_enzyme": F.element_at(top, 1).getField("key"),
    }


def reason_string(flags: dict[str, Column]) -> Column:
    """Ordered names of the set flags joined by a bar, ``none`` when no flag is set."""
    joined = F.concat_ws("|", *[F.when(flag, F.lit(name)) for name, flag in flags.items()])
    return F.coalesce(F.nullif(joined, F.lit("")), F.lit("none"))


def set_hash(df: DataFrame, value: str, by: Sequence[str] = (), digits: int = 2) -> DataFrame:
    """SHA-256 of a set of texts, as the hash of sorted per-bucket hashes, so no task sees the whole set.

    The bucket is the start of each value's own hash: 256 buckets keep the final list small at any size.
    """
    values = df.select(*by, F.col(value).cast("string").alias("v")).distinct()
    hashed = values.withColumn("h", F.sha2("v", 256)).withColumn("bucket", F.substring("h", 1, digits))
    inner = hashed.groupBy(*by, "bucket").agg(
        F.sha2(F.concat_ws("\n", F.sort_array(F.collect_list("h"))), 256).alias("h"), F.count(F.lit(1)).alias("n")
    )
    return inner.groupBy(*by).agg(
        F.sha2(F.concat_ws("\n", F.sort_array(F.collect_list("h"))), 256).alias("set_sha256"), F.sum("n").alias("n")
    )

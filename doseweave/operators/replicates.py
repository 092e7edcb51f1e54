"""Metrics of many weighted replicates of the same rows at once.

A row stays one row, whatever the number of replicates: its weights are an array, and tasks add arrays. Rows of equal
group, score and class are added before anything is shuffled.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from hashlib import sha256
from math import exp, factorial

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from doseweave.plans.ordering import score_bucket

PER_HASH = 8
# Upper 32-bit edges of Poisson(1): a draw's weight is how many edges it reaches.
POISSON_EDGES = tuple(int(sum(exp(-1) / factorial(i) for i in range(k + 1)) * 2**32) for k in range(10))
#: Sums that a task holds before it passes them on.
HELD_CELLS = 1 << 22

#: Weights (rows x replicates) of a column.
Weigher = Callable[[pa.Array], np.ndarray]


def hash_key(keys: Sequence[str]) -> Column:
    """What follows seed and block in the text that ``priority`` hashes."""
    return F.concat_ws("\u0000", F.lit(""), *[F.col(k).cast("string") for k in keys])


def poisson(replicates: int, seed: int) -> Weigher:
    """The weights of ``bootstrap_weights``, in the order of its replicates, from hash keys."""
    starts = [f"{seed}\0{block}".encode() for block in range(-(-replicates // PER_HASH))]

    def weigh(keys: pa.Array) -> np.ndarray:
        coded = keys.dictionary_encode()
        texts = [k.encode() for k in coded.dictionary.to_pylist()]
        u = np.frombuffer(b"".join(sha256(start + k).digest() for k in texts for start in starts), ">u4").reshape(len(texts), -1)
        edges = np.array(POISSON_EDGES, np.uint64)
        return np.searchsorted(edges, u[:, :replicates], "right").astype(np.int16)[coded.indices.to_numpy()]

    return weigh


def listed(weights: pa.Array) -> np.ndarray:
    """Weights that are arrays of one length."""
    return weights.flatten().to_numpy(zero_copy_only=False).reshape(len(weights), -1)


def _lists(values: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(np.arange(0, values.size + 1, max(values.shape[1], 1), dtype=np.int32), pa.array(values.ravel()))


def _added(keys: pd.DataFrame, values: np.ndarray) -> tuple[pd.DataFrame, np.ndarray]:
    """Rows of equal keys added up."""
    place = keys.groupby(list(keys.columns), sort=False, dropna=False).ngroup().to_numpy()
    order = np.argsort(place, kind="stable")
    first = np.flatnonzero(np.r_[True, np.diff(place[order]) > 0])
    return keys.iloc[order[first]].reset_index(drop=True), np.add.reduceat(values[order], first, axis=0, dtype=values.dtype if values.dtype == float else np.int64)


def _sums(batches: Iterator[pa.RecordBatch], weigh: Weigher) -> Iterator[pa.RecordBatch]:
    """Weights added per key; the weights' source is the last column."""
    parts: list[tuple[pd.DataFrame, np.ndarray]] = []
    names: list[str] = []
    types: list[pa.DataType] = []

    def out(part: tuple[pd.DataFrame, np.ndarray]) -> pa.RecordBatch:
        keys = [pa.array(part[0][c], kind, from_pandas=True) for c, kind in zip(names, types, strict=True)]
        return pa.RecordBatch.from_arrays([*keys, _lists(part[1])], names=[*names, "sums"])

    def merged() -> tuple[pd.DataFrame, np.ndarray]:
        return _added(pd.concat([p[0] for p in parts], ignore_index=True), np.concatenate([p[1] for p in parts]))

    for batch in batches:
        if not len(batch):
            continue
        names, types = batch.schema.names[:-1], batch.schema.types[:-1]
        keys = pa.Table.from_batches([batch]).select(names).to_pandas(integer_object_nulls=True)
        parts.append(_added(keys, weigh(batch.column(len(names)))))
        if sum(p[1].size for p in parts) > HELD_CELLS:
            parts = [merged()]
            if parts[0][1].size > HELD_CELLS // 2:
                yield out(parts[0])
                parts = []
    if parts:
        yield out(merged())


def weight_sums(rows: DataFrame, keys: Sequence[str], source: Column, weigh: Weigher) -> DataFrame:
    """keys..., sums: the added weights per key, an array with a place per replicate; a key has several rows to add."""
    types = dict(rows.dtypes)
    schema = ", ".join([*[f"`{k}` {types[k]}" for k in keys], "sums array<bigint>"])
    return rows.select(*keys, source.alias("_source")).mapInArrow(lambda batches: _sums(batches, weigh), schema)


def _steps(bucket: pa.Table) -> pa.Table:
    """Per bucket of scores: weights of both classes and the wins of positives over negatives in it, ties a half."""
    sums = listed(bucket.column("sums").combine_chunks()).astype(float)
    score, yes = bucket.column("score").to_numpy(), bucket.column("positive").to_numpy()
    found, place = np.unique(score, return_inverse=True)
    pos, neg = np.zeros((len(found), sums.shape[1])), np.zeros((len(found), sums.shape[1]))
    np.add.at(pos, place[yes], sums[yes])
    np.add.at(neg, place[~yes], sums[~yes])
    wins = (pos * (np.cumsum(neg, axis=0) - neg / 2)).sum(axis=0)
    kept = bucket.slice(0, 1).drop_columns(["score", "positive", "sums"])
    for name, value in (("pos", pos.sum(axis=0)), ("neg", neg.sum(axis=0)), ("wins", wins)):
        kept = kept.append_column(name, _lists(value[None, :]))
    return kept


def _ranked(group: pa.Table) -> pa.Table:
    group = group.sort_by("_bucket")
    pos, neg, wins = (listed(group.column(c).combine_chunks()) for c in ("pos", "neg", "wins"))
    n_pos, n_neg = pos.sum(axis=0), neg.sum(axis=0)
    won = (wins + pos * (np.cumsum(neg, axis=0) - neg)).sum(axis=0)
    drawn = np.flatnonzero(n_pos + n_neg > 0)
    both = n_pos * n_neg
    area = np.divide(won, both, out=np.zeros_like(won), where=both > 0)
    kept = group.drop_columns(["_bucket", "pos", "neg", "wins"]).take(np.zeros(len(drawn), np.int64))
    for name, value in (("replicate", pa.array((drawn + 1).astype(np.int32))), ("n_pos", pa.array(n_pos[drawn])), ("n_neg", pa.array(n_neg[drawn])),
                        ("auroc", pa.array(area[drawn], mask=both[drawn] == 0))):
        kept = kept.append_column(name, value)
    return kept


def replicate_auroc(rows: DataFrame, label: str, score: str, by: Sequence[str], source: Column, weigh: Weigher) -> DataFrame:
    """by..., replicate (from 1), n_pos, n_neg, auroc: what ``ranking.auroc`` gives for every replicate's weights.

    A bucket of scores is one group, then a group's buckets are; a replicate in which a group has no weight has no row.
    """
    marked = rows.select(
        *by, F.col(score).cast("double").alias("score"), F.coalesce(F.col(label) == 1, F.lit(False)).alias("positive"), source.alias("_source"),
    ).filter("score IS NOT NULL").dropna(subset=list(by)).withColumn("_all", F.lit(0))
    keys = [*by, "_all"]
    types = dict(marked.dtypes)
    named = "".join(f"`{k}` {types[k]}, " for k in keys)
    sums = weight_sums(marked, [*keys, "score", "positive"], F.col("_source"), weigh).withColumn("_bucket", score_bucket(F.col("score")))
    steps = sums.select(*keys, "_bucket", "score", "positive", "sums").groupBy(*keys, "_bucket").applyInArrow(
        _steps, named + "_bucket int, pos array<double>, neg array<double>, wins array<double>")
    return steps.groupBy(*keys).applyInArrow(_ranked, named + "replicate int, n_pos double, n_neg double, auroc double").drop("_all")


def replicate_means(rows: DataFrame, value: str, by: Sequence[str], source: Column, weigh: Weigher, name: str) -> DataFrame:
    """by..., replicate, the weighted mean of a value; null values only count in the weights."""
    types = dict(rows.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not len(batch):
                continue
            w = weigh(batch.column(len(by) + 1)).astype(float)
            x = batch.column(len(by)).to_numpy(zero_copy_only=False).astype(float)
            keys = pa.Table.from_batches([batch]).select(list(by)).to_pandas(integer_object_nulls=True)
            found, sums = _added(keys, np.concatenate([w, w * np.where(np.isnan(x), 0.0, x)[:, None]], axis=1))
            n = w.shape[1]
            columns = [pa.array(found[c].repeat(n), batch.schema.field(c).type, from_pandas=True) for c in by]
            yield pa.RecordBatch.from_arrays(
                [*columns, pa.array(np.tile(np.arange(1, n + 1, dtype=np.int32), len(found))), pa.array(sums[:, :n].ravel()), pa.array(sums[:, n:].ravel())],
                names=[*by, "replicate", "w", "wx"])

    schema = "".join(f"`{k}` {types[k]}, " for k in by) + "replicate int, w double, wx double"
    parts = rows.select(*by, F.col(value).cast("double"), source.alias("_source")).mapInArrow(run, schema)
    return parts.groupBy(*by, "replicate").agg(F.sum("w").alias("w"), F.sum("wx").alias("wx")).filter("w > 0").select(*by, "replicate", (F.col("wx") / F.col("w")).alias(name))

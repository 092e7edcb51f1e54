"""Data-parallel learners: logistic heads fitted together, and the severity forest."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.ml.regression import RandomForestRegressor
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from doseweave.functions.numeric import pair_features
from doseweave.operators.splits import group_folds
from doseweave.session import durable

#: Past steps that shape the next one; largest gradient of a head that has converged; cells (heads times coefficients) of a fit.
MEMORY, TOLERANCE, MODEL_CELLS = 10, 1e-6, 1 << 22
#: Values of a feature table up to which every task holds it.
FEATURE_CELLS = 1 << 24
#: Tasks of a forest's pass up to which it reads the partitions of a shuffle as they are.
FOREST_TASKS = 32


def bit_pair_features(bits_a: Column, bits_b: Column, size: int) -> tuple[Column, Column]:
    """Sparse symmetric features of two sets of on-bit positions: (indices, values). Bits of both come first, then bits of one."""
    both = F.transform(F.array_intersect(bits_a, bits_b), lambda i: i.cast("int"))
    one = F.transform(F.array_except(F.array_union(bits_a, bits_b), F.array_intersect(bits_a, bits_b)), lambda i: (i + size).cast("int"))
    indices = F.concat(both, one)
    return indices, F.transform(indices, lambda _: F.lit(1.0))


def dense_pair_features(a: Column, b: Column, mode: str = "symmetric") -> tuple[Column, Column]:
    """The nonzero symmetric features of two arrays of numbers: (indices, values)."""
    made = F.transform(pair_features(a, b, mode), lambda x, i: F.struct(i.cast("int").alias("i"), x.cast("double").alias("x")))
    kept = F.filter(made, lambda f: f["x"] != 0)
    return F.transform(kept, lambda f: f["i"]), F.transform(kept, lambda f: f["x"])


@dataclass(frozen=True)
class FeatureTable:
    """Dense features by drug that every task holds: rows(drug, at), and ``values`` in the order of the sorted ``at``, missing ones as 0."""

    rows: DataFrame
    mode: str
    shared: Broadcast

    def cells(self, a: pa.Array, b: pa.Array) -> np.ndarray:
        """The pair features of the rows that have these numbers, as ``dense_pair_features`` makes them."""
        at, values, missing = self.shared.value
        i, j = (np.searchsorted(at, x.to_numpy(zero_copy_only=False)) for x in (a, b))
        x, y = values[i], values[j]
        if self.mode == "concat":
            return np.hstack([x, y])
        out = np.hstack([x + y, np.abs(x - y), x * y])
        if missing is not None:
            out[np.tile(missing[i] | missing[j], 3)] = 0.0
        return out


def feature_table(features: DataFrame, mode: str = "symmetric") -> FeatureTable | DataFrame:
    """features(drug, features) as a table that every task holds, so that a pair is written as two numbers and not as its features.

    Features that aren't doubles of one length, or are more than ``FEATURE_CELLS``, come back as they are.
    """
    if dict(features.dtypes)["features"] != "array<double>":
        return features
    written = durable(features.select("drug", "features").withColumn("at", F.monotonically_increasing_id()))
    size = written.agg(F.count(F.lit(1)).alias("n"), F.count("features").alias("full"), F.min(F.size("features")).alias("least"), F.max(F.size("features")).alias("most")).head()
    if not size.n or size.full < size.n or size.least != size.most or not 0 < size.n * size.most <= FEATURE_CELLS:
        return written.drop("at")
    held = written.select("at", "features").toArrow().combine_chunks()
    at, lists = (held.column(i).combine_chunks() for i in (0, 1))
    order = np.argsort(at.to_numpy())
    flat = lists.flatten()
    missing = flat.is_null().to_numpy(zero_copy_only=False).reshape(size.n, -1)[order] if flat.null_count else None
    values = flat.fill_null(0.0).to_numpy().reshape(size.n, -1)[order]
    return FeatureTable(written.select("drug", "at"), mode, features.sparkSession.sparkContext.broadcast((at.to_numpy()[order], values, missing)))


def pair_rows(pairs: DataFrame, features: DataFrame | FeatureTable, mode: str = "symmetric", bits: int | None = None) -> DataFrame:
    """pairs(drug_a, drug_b, ...) x features(drug, features) with sparse ``indices`` and ``values``; with ``bits``, features are
    on-bit positions below it. With a feature table, its numbers ``at_a`` and ``at_b`` stand for them."""
    out = pairs
    if isinstance(features, FeatureTable):
        for side in ("a", "b"):
            out = out.join(features.rows.select(F.col("drug").alias(f"drug_{side}"), F.col("at").alias(f"at_{side}")), f"drug_{side}")
        return out
    for side in ("a", "b"):
        out = out.join(features.select(F.col("drug").alias(f"drug_{side}"), F.col("features").alias(f"_f{side}")), f"drug_{side}")
    a, b = F.col("_fa"), F.col("_fb")
    indices, values = dense_pair_features(a, b, mode) if bits is None else bit_pair_features(a, b, bits)
    return out.withColumns({"indices": indices, "values": values}).drop("_fa", "_fb")


@dataclass
class Heads:
    """One logistic model per head: rows of coefficients, the intercept last; largest gradient; whether it has converged."""

    coefficients: np.ndarray
    gradient: np.ndarray
    converged: np.ndarray

    def log_odds(self, indices: pa.Array, values: pa.Array, features: FeatureTable | None = None) -> np.ndarray:
        if features:
            return _Rows.of(features.cells(indices, values), self.coefficients.shape[1] - 1).product(self.coefficients)
        return _Rows(*_flat(indices), _flat(values)[1], self.coefficients.shape[1] - 1).product(self.coefficients)


#: Share of nonzero cells from which rows are multiplied as a dense matrix.
DENSE_SHARE = 0.25


def _flat(lists: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Lengths of lists, and their values one after the other."""
    return lists.value_lengths().to_numpy(zero_copy_only=False), lists.flatten().to_numpy(zero_copy_only=False)


def _packed(lists: pa.Array, kind: type) -> pa.Array:
    """Lists as binary values: a table of these is read without a step per number."""
    sizes, flat = _flat(lists)
    ends = np.r_[0, np.cumsum(sizes)].astype(np.int32) * np.dtype(kind).itemsize
    return pa.Array.from_buffers(pa.binary(), len(lists), [None, pa.py_buffer(ends.astype(np.int32).tobytes()), pa.py_buffer(flat.astype(kind).tobytes())])


def _unpacked(packed: pa.Array, kind: type) -> tuple[np.ndarray, np.ndarray]:
    _, ends, data = packed.buffers()
    ends = np.frombuffer(ends, np.int32)[packed.offset : packed.offset + len(packed) + 1]
    size = np.dtype(kind).itemsize
    flat = np.frombuffer(data, kind, (ends[-1] - ends[0]) // size, ends[0]) if ends[-1] > ends[0] else np.zeros(0, kind)
    return np.diff(ends) // size, flat


class _Rows:
    """Rows of a batch: a matrix where enough cells are set, else a list of cells."""

    def __init__(self, sizes: np.ndarray, at: np.ndarray, x: np.ndarray, width: int):
        self.n, self.width, self.at, self.x = len(sizes), width, at, x
        if len(at) and not 0 <= at.min() <= at.max() < width:
            raise ValueError(f"a feature is not one of {width}")
        self.row = np.repeat(np.arange(self.n), sizes)
        self.dense = None
        if len(x) and len(x) >= DENSE_SHARE * self.n * width:
            self.dense = np.bincount(self.row * width + at, x, self.n * width).reshape(self.n, width)

    @classmethod
    def of(cls, dense: np.ndarray, width: int) -> _Rows:
        if dense.shape[1] > width:
            raise ValueError(f"a feature is not one of {width}")
        rows = cls(np.zeros(len(dense), np.int64), np.zeros(0, np.int64), np.zeros(0), width)
        rows.dense = dense if dense.shape[1] == width else np.pad(dense, ((0, 0), (0, width - dense.shape[1])))
        return rows

    def product(self, coefficients: np.ndarray) -> np.ndarray:
        """Log odds (rows x heads)."""
        if self.dense is not None:
            return self.dense @ coefficients[:, :-1].T + coefficients[:, -1]
        out = np.tile(coefficients[:, -1], (self.n, 1))
        if len(self.x):
            for head in range(len(coefficients)):
                out[:, head] += np.bincount(self.row, self.x * coefficients[head, self.at], self.n)
        return out

    def gathered(self, error: np.ndarray) -> np.ndarray:
        """Sums by head and coefficient of the rows' values times their errors."""
        if self.dense is not None:
            return error.T @ self.dense
        out = np.zeros((error.shape[1], self.width))
        if len(self.x):
            for head in range(len(out)):
                out[head] = np.bincount(self.at, self.x * error[self.row, head], self.width)
        return out


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        columns = [_packed(batch.column(i), kind) for i, kind in enumerate((np.int32, np.float64, np.int32))]
        yield pa.RecordBatch.from_arrays(columns, names=["indices", "values", "ones"])


def _pack_numbers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), _packed(batch.column(2), np.int32)], names=["at_a", "at_b", "ones"])


def _slopes(batches: Iterator[pa.RecordBatch], coefficients: np.ndarray, weights: np.ndarray, features: FeatureTable | None = None) -> Iterator[pa.RecordBatch]:
    """Loss and gradient of all heads over a task's rows, as (cell, value); a head's last two cells are its loss and weight."""
    heads, width = coefficients.shape
    total = np.zeros((heads, width + 2))
    for batch in batches:
        if not len(batch):
            continue
        if features:
            rows = _Rows.of(features.cells(batch.column(0), batch.column(1)), width - 1)
        else:
            rows = _Rows(*_unpacked(batch.column(0), np.int32), _unpacked(batch.column(1), np.float64)[1], width - 1)
        z = rows.product(coefficients)
        sizes, ones = _unpacked(batch.column(2), np.int32)
        y = np.zeros_like(z)
        y[np.repeat(np.arange(len(batch)), sizes), ones] = 1.0
        w = np.where(y == 1, weights[None, :], 1.0)
        # One exponential serves both the probability and the loss.
        small = np.exp(-np.abs(z))
        error = w * (np.where(z >= 0, 1.0, small) / (1 + small) - y)
        total[:, : width - 1] += rows.gathered(error)
        total[:, width - 1] += error.sum(axis=0)
        total[:, width] += (w * (np.maximum(z, 0) + np.log1p(small) - y * z)).sum(axis=0)
        total[:, width + 1] += w.sum(axis=0)
    cells = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(cells), pa.array(total.ravel()[cells])], names=["cell", "value"])


def fit_heads(
    rows: DataFrame, heads: int, width: int, weights: Sequence[float], reg: float = 1e-3, steps: int = 100, features: FeatureTable | None = None
) -> Heads:
    """Logistic models of all heads at once: rows(indices, values, ones), ``ones`` being the heads whose label is 1; with a feature
    table, rows(at_a, at_b, ones).

    Minimises each head's weighted mean loss plus ``reg`` / 2 times its squared coefficients (not the intercept), a row of label 1
    weighing ``weights[head]``, by limited-memory quasi-Newton steps. A step is one pass over the rows: every head has its own
    step length, halved where the loss didn't fall enough. Stops when all heads have converged, or after ``steps``; which have is
    returned. Only sums by coefficient leave the tasks, so a fit is bounded by heads x width, which must not pass ``MODEL_CELLS``.
    """
    if heads * (width + 1) > MODEL_CELLS:
        raise ValueError(f"{heads} heads of {width} coefficients are more than a fit holds.")
    if features:
        table = durable(rows.select("at_a", "at_b", F.col("ones").cast("array<int>").alias("ones")).mapInArrow(_pack_numbers, "at_a long, at_b long, ones binary"))
        features = replace(features, rows=None)
    else:
        typed = rows.select(*[F.col(c).cast(f"array<{kind}>").alias(c) for c, kind in (("indices", "int"), ("values", "double"), ("ones", "int"))])
        table = durable(typed.mapInArrow(_pack, "indices binary, values binary, ones binary"))
    weight = np.asarray(weights, float)

    def evaluate(beta: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        sums = table.mapInArrow(lambda batches: _slopes(batches, beta, weight, features), "cell long, value double").groupBy("cell").agg(F.sum("value").alias("value"))
        total = np.zeros(heads * (width + 3))
        for r in sums.collect():
            total[r.cell] = r.value
        total = total.reshape(heads, width + 3)
        mass = np.maximum(total[:, -1:], 1e-300)
        penalised = beta * (np.arange(width + 1) < width)
        return total[:, -2] / mass[:, 0] + 0.5 * reg * (penalised**2).sum(axis=1), total[:, :-2] / mass + reg * penalised

    beta = np.zeros((heads, width + 1))
    loss, slope = evaluate(beta)
    past: list[tuple[np.ndarray, np.ndarray]] = []
    length = np.ones(heads)
    direction = -slope
    for _ in range(steps):
        done = np.abs(slope).max(axis=1) <= TOLERANCE
        if done.all():
            break
        trial = beta + np.where(done, 0.0, length)[:, None] * direction
        new_loss, new_slope = evaluate(trial)
        fell = new_loss <= loss + 1e-4 * length * (slope * direction).sum(axis=1) + 1e-15
        accepted = fell & ~done
        moved = np.where(accepted[:, None], trial - beta, 0.0)
        turned = np.where(accepted[:, None], new_slope - slope, 0.0)
        past = [*past, (moved, turned)][-MEMORY:]
        beta, loss, slope = np.where(accepted[:, None], trial, beta), np.where(accepted, new_loss, loss), np.where(accepted[:, None], new_slope, slope)
        fresh = _direction(slope, past)
        direction = np.where(accepted[:, None], fresh, direction)
        length = np.where(accepted, 1.0, length / 2)
    size = np.abs(slope).max(axis=1)
    return Heads(beta, size, size <= TOLERANCE)


def _direction(slope: np.ndarray, past: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """The two-loop recursion for all heads; a pair of changes without positive curvature is left out for its head."""
    q, kept = slope.copy(), []
    for moved, turned in reversed(past):
        curve = (moved * turned).sum(axis=1)
        use = curve > 1e-18
        rate = np.where(use, (moved * q).sum(axis=1) / np.where(use, curve, 1.0), 0.0)
        q -= rate[:, None] * turned
        kept.append((moved, turned, curve, use, rate))
    scale, found = np.ones(len(slope)), np.zeros(len(slope), bool)
    for _, turned, curve, use, _ in kept:
        fresh = use & ~found
        scale = np.where(fresh, curve / np.maximum((turned**2).sum(axis=1), 1e-300), scale)
        found |= use
    q *= scale[:, None]
    for moved, turned, curve, use, rate in reversed(kept):
        back = np.where(use, (turned * q).sum(axis=1) / np.where(use, curve, 1.0), 0.0)
        q += np.where(use, rate - back, 0.0)[:, None] * moved
    return -q


def head_scores(
    rows: DataFrame, model: Heads, names: Sequence[int], keep: Sequence[str], name: str = "event_idx", features: FeatureTable | None = None,
    ones: str | None = None, label: str = "label",
) -> DataFrame:
    """``keep`` columns, the head's name and its probability: one row per row and head; with ``ones``, also whether the head is one of these."""
    shared = rows.sparkSession.sparkContext.broadcast(model)
    labels = np.asarray(list(names), np.int64)
    made = ["at_a", "at_b"] if features else ["indices", "values"]
    held = replace(features, rows=None) if features else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            score = 1 / (1 + np.exp(-np.clip(shared.value.log_odds(batch.column(0), batch.column(1), held), -700, 700)))
            place = pa.array(np.repeat(np.arange(len(batch)), len(labels)))
            columns = [batch.column(2 + i).take(place) for i in range(len(keep))]
            columns += [pa.array(np.tile(labels, len(batch))), pa.array(score.ravel())]
            if ones:
                sizes, heads = _flat(batch.column(2 + len(keep)))
                y = np.zeros(score.shape, bool)
                y[np.repeat(np.arange(len(batch)), sizes), heads] = True
                columns.append(pa.array(y.ravel()))
            yield pa.RecordBatch.from_arrays(columns, names=[*keep, name, "score", *([label] if ones else [])])

    types = dict(rows.dtypes)
    schema = [*[f"`{c}` {types[c]}" for c in keep], f"{name} long", "score double", *([f"`{label}` boolean"] if ones else [])]
    return rows.select(*made, *keep, *([ones] if ones else [])).mapInArrow(run, ", ".join(schema))


def pair_logistic(
    rows: DataFrame, width: int, label: str = "label", train: str = "partition = 'train'", reg: float = 1e-3, steps: int = 100,
    features: DataFrame | FeatureTable | None = None, keep: Sequence[str] | None = None,
) -> tuple[DataFrame, Heads]:
    """rows(indices, values, label, ...) with a ``score`` from a model of the training rows; and the model. ``keep`` says which
    columns stay, if not all.

    Rows are made once, for the fit and the scores, and so are the scores. Rows of a feature table need it as ``features``; they
    are written as numbers.
    """
    held = features if isinstance(features, FeatureTable) else None
    rows = durable(rows)
    ones = F.when(F.col(label) == 1, F.array(F.lit(0))).otherwise(F.array().cast("array<int>")).alias("ones")
    made = ["at_a", "at_b"] if held else ["indices", "values"]
    model = fit_heads(rows.filter(train).select(*made, ones), 1, width, [1.0], reg, steps, held)
    keep = [c for c in rows.columns if c not in made] if keep is None else list(keep)
    return durable(head_scores(rows, model, [0], keep, "_head", held).drop("_head")), model


def event_logistic(
    rows: DataFrame, labels: DataFrame, vocabulary: DataFrame, prior: DataFrame, width: int, reg: float = 1e-3, steps: int = 100,
    features: DataFrame | FeatureTable | None = None, keep: Sequence[str] = (), label: str | None = None,
) -> DataFrame:
    """rows(pair_id, partition, indices, values) to pair_id, event_idx, score: a weighted head per event of the vocabulary, all
    fitted together, the training prior elsewhere. The vocabulary is small by contract: heads x ``width`` is the model's size.

    ``keep`` columns of a row stay with its scores, and ``label`` names one that says whether the pair has the event, so that
    no cell has to be joined afterwards. Rows of a feature table need it as ``features``.
    """
    held = features if isinstance(features, FeatureTable) else None
    kept = ["pair_id", *keep]
    chosen = vocabulary.select(F.col("event_idx").cast("long").alias("event_idx"), F.col("pos_weight").cast("double").alias("pos_weight")).orderBy("event_idx").collect()
    known = prior.join(vocabulary.select("event_idx"), "event_idx", "left_anti")
    base = known.agg(F.collect_list(F.struct(F.col("event_idx").cast("long").alias("event_idx"), F.col("prior").alias("score")))).head()[0]
    place = F.create_map(*[F.lit(x) for i, r in enumerate(chosen) for x in (r.event_idx, i)]) if chosen else F.lit(None).cast("map<bigint,int>")
    event = F.col("event_idx").cast("long")
    found = labels.select("pair_id", F.element_at(place, event).alias("head"), event.alias("event_idx"))
    if not (base and label):
        found = found.filter("head IS NOT NULL")
    found = found.groupBy("pair_id").agg(F.collect_set("head").alias("ones"), F.collect_set(F.when(F.col("head").isNull(), F.col("event_idx"))).alias("_others"))
    none = {"ones": F.array().cast("array<int>"), "_others": F.array().cast("array<bigint>")}
    rows = durable(rows.join(found if base and label else found.drop("_others"), "pair_id", "left").withColumns(
        {c: F.coalesce(c, empty) for c, empty in none.items() if c == "ones" or (base and label)}))
    out = None
    if chosen:
        made = ["at_a", "at_b"] if held else ["indices", "values"]
        model = fit_heads(rows.filter("partition = 'train'").select(*made, "ones"), len(chosen), width, [r.pos_weight for r in chosen], reg, steps, held)
        out = head_scores(rows, model, [r.event_idx for r in chosen], kept, features=held, ones="ones" if label else None, label=label or "label")
    if base or not chosen:
        cells = F.array(*[F.struct(F.lit(r.event_idx).cast("long").alias("event_idx"), F.lit(r.score).cast("double").alias("score")) for r in base])
        cells = cells if base else cells.cast("array<struct<event_idx:bigint,score:double>>")
        filled = rows.select(*kept, *(["_others"] if base and label else []), F.explode(cells).alias("p")).select("*", "p.event_idx", "p.score")
        if label:
            filled = filled.withColumn(label, F.array_contains("_others", F.col("event_idx")) if base else F.lit(False))
        filled = filled.select(*kept, "event_idx", "score", *([label] if label else []))
        out = filled if out is None else filled.unionByName(out)
    return out


def severity_forest(rows: DataFrame, group: str, target: str, seeds: Sequence[int] = (0, 1, 2, 3, 4), folds: int = 5, trees: int = 20,
                    depth: int = 5, grid: Sequence[int] | None = None, key: str = "id") -> DataFrame:
    """rows(id, group, features, target) to out-of-fold predictions: mean of the seeds, clipped to [0, 1].

    Folds share no group. With a grid of depths the one with the least first-seed error is used. Every task of every pass
    answers the driver: beyond ``FOREST_TASKS`` shuffle partitions forests read a written table, whose tasks are as many as its
    bytes ask for. Spark draws a tree's rows by partition, so a forest is repeatable for the same partitions only.
    """
    tagged = group_folds(rows, group, folds).cache()
    if tagged.rdd.getNumPartitions() > FOREST_TASKS:
        shuffled, tagged = tagged, durable(tagged).cache()
        shuffled.unpersist()

    def out_of_fold(seed: int, d: int) -> DataFrame:
        parts = None
        for fold in range(folds):
            forest = RandomForestRegressor(featuresCol="features", labelCol=target, numTrees=trees, maxDepth=d, seed=seed)
            model = forest.fit(tagged.filter(F.col("fold") != fold))
            scored = model.transform(tagged.filter(F.col("fold") == fold)).select(key, "prediction")
            parts = scored if parts is None else parts.unionByName(scored)
        return parts

    if grid:
        def error(d: int) -> float:
            joined = out_of_fold(seeds[0], d).join(tagged.select(key, target), key)
            return joined.agg(F.avg(F.abs(F.col("prediction") - F.col(target)))).head()[0]

        depth = min(grid, key=error)
    every = None
    for seed in seeds:
        part = out_of_fold(seed, depth)
        every = part if every is None else every.unionByName(part)
    mean = every.groupBy(key).agg(F.avg("prediction").alias("_m"))
    return rows.join(mean, key).withColumn("prediction", F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("_m")))).drop("_m")

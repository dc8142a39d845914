"""Elastic-net logistic fits in lockstep: many fits over the same rows, all of which take a step in one pass over them.

Rows have an array of features, a label (0, 1, null) and an array of parts, one number for each outer fold: the inner fold
of a training row, NONE where it has none, TEST where it is not in the training part. A training set is an outer fold k with
one inner fold left out, or with none (None). Its rows are scaled by their own means and deviations, its classes balanced.

The objective is that of pyspark.ml: the weighted mean of the log loss + reg (elastic |b| + (1 - elastic) / 2 b^2), the
intercept free. Steps are Newton's: tasks sum loss, gradient and Hessian of every fit, the driver solves the quadratic models
of all fits by coordinate descent and halves steps that don't descend. Sums of a pass are SUMS bytes a task at most, fits
being taken some at a time beyond; more than WIDE features have no Hessian, they are fitted one by one by pyspark.ml.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import StandardScaler
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


#: Parts of rows without an inner fold and outside of the training part.
NONE, TEST = -2, -1
#: Bytes of sums a task, features that have a Hessian, numbers in a piece of sums that are shuffled.
SUMS, WIDE, PIECE = 32 << 20, 1500, 8192


def arrays(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features, labels (null: NaN) and parts of a batch."""

    def square(name: str, kind: type) -> np.ndarray:
        c = batch.column(name)
        flat = c.flatten()
        if c.null_count or flat.null_count or len(flat) % max(1, len(c)) or len(set(np.diff(c.offsets.to_numpy()))) > 1:
            raise ValueError(f"{name} must have no nulls and the same length in all rows")
        return flat.to_numpy(zero_copy_only=False).astype(kind).reshape(len(c), -1)

    return square("x", float), batch.column("label").to_numpy(zero_copy_only=False).astype(float), square("part", int)


def filled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    return (b for b in batches if b.num_rows)


def trained(part: np.ndarray, k: int, i: int | None) -> np.ndarray:
    return part[:, k] != TEST if i is None else (part[:, k] >= 0) & (part[:, k] != i)


def chances(x: np.ndarray, scale: tuple, b: np.ndarray) -> np.ndarray:
    """Chances of label 1: rows x fits, of which b has (intercept, coefficients) as rows."""
    with np.errstate(over="ignore"):
        return 1 / (1 + np.exp(-(((x - scale[0]) * scale[1]) @ b[:, 1:].T + b[:, 0])))


def _merged(a: np.ndarray, b: np.ndarray, d: int) -> np.ndarray:
    """Rows, labels 0, labels 1, means and squared deviations of two disjoint sets, by set."""
    n = np.maximum(1, a[:, :1] + b[:, :1])
    gap = b[:, 3 : 3 + d] - a[:, 3 : 3 + d]
    return np.hstack([a[:, :3] + b[:, :3], a[:, 3 : 3 + d] + gap * b[:, :1] / n, a[:, 3 + d :] + b[:, 3 + d :] + gap**2 * a[:, :1] * b[:, :1] / n])


def scales(rows: DataFrame, sets: list[tuple[int, int | None]], d: int) -> list[tuple]:
    """For each training set: means, reciprocal deviations (0 where a feature doesn't vary), weights of label 0 and 1, and
    the numbers of both labels."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(sets), 3 + 2 * d))
        for batch in filled(batches):
            x, y, part = arrays(batch)
            if not np.isin(y[~np.isnan(y)], (0, 1)).all():
                raise ValueError("labels must be 0 or 1")
            for t, (k, i) in enumerate(sets):
                if (on := trained(part, k, i)).any():
                    mean = x[on].mean(axis=0)
                    own = np.hstack([on.sum(), (y[on] == 0).sum(), (y[on] == 1).sum(), mean, ((x[on] - mean) ** 2).sum(axis=0)])
                    total[t] = _merged(total[t : t + 1], own[None], d)[0]
        yield pa.RecordBatch.from_pydict({"s": [total.tobytes()]})

    total = np.zeros((len(sets), 3 + 2 * d))
    for r in rows.mapInArrow(run, "s binary").collect():  # a row a task
        total = _merged(total, np.frombuffer(r["s"]).reshape(total.shape), d)
    out = []
    for n, neg, pos, *rest in total:
        mean, spread = np.array(rest[:d]), np.sqrt(np.array(rest[d:]) / max(1, n - 1))
        flat = spread <= 1e-12 * np.abs(mean)
        kinds = (neg > 0) + (pos > 0)
        out.append((mean, np.where(flat, 0.0, 1 / np.where(flat, 1, spread)), n / (kinds * neg) if neg else 0.0, n / (kinds * pos) if pos else 0.0, neg, pos))
    return out


def _sums(rows: DataFrame, fits: list[tuple[tuple[int, int | None], tuple]], b: np.ndarray) -> np.ndarray:
    """For each fit (training set, scale) at its point: loss, gradient and Hessian, summed over its rows."""
    d = b.shape[1]
    width = 1 + d + d * d
    by_set: dict[tuple, list[int]] = {}
    for p, (s, _) in enumerate(fits):
        by_set.setdefault(s, []).append(p)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(fits), width))
        for batch in filled(batches):
            x, y, part = arrays(batch)
            for s, own in by_set.items():
                on, scale = trained(part, *s) & ~np.isnan(y), fits[own[0]][1]
                z, label = np.column_stack([np.ones(on.sum()), (x[on] - scale[0]) * scale[1]]), y[on]
                w = np.where(label == 1, scale[3], scale[2])
                margins = z @ b[own].T
                q = chances(x[on], scale, b[own])
                for j, p in enumerate(own):
                    m = margins[:, j]
                    total[p, 0] += (w * (np.logaddexp(0, m) - label * m)).sum()
                    total[p, 1 : 1 + d] += z.T @ (w * (q[:, j] - label))
                    total[p, 1 + d :] += (z.T @ (z * (w * q[:, j] * (1 - q[:, j]))[:, None])).ravel()
        flat = total.ravel()
        for g in range(0, len(flat), PIECE):
            yield pa.RecordBatch.from_arrays([pa.array([g], pa.int64()), pa.array([flat[g : g + PIECE].tobytes()], pa.binary())], names=["g", "s"])

    def add(t: pa.Table) -> pa.Table:
        return pa.table({"g": t["g"][:1], "s": pa.array([np.sum([np.frombuffer(v) for v in t["s"].to_pylist()], axis=0).tobytes()], pa.binary())})

    pieces = rows.mapInArrow(run, "g long, s binary")
    if rows.rdd.getNumPartitions() * len(fits) * width * 8 > 2 * SUMS:
        pieces = pieces.groupBy("g").applyInArrow(add, "g long, s binary")
    total = np.zeros(len(fits) * width)
    for r in pieces.collect():  # as many as a task has, or twice SUMS bytes at most
        v = np.frombuffer(r["s"])
        total[r["g"] : r["g"] + len(v)] += v
    return total.reshape(len(fits), width)


def _models(g: np.ndarray, h: np.ndarray, b: np.ndarray, l1: np.ndarray, l2: np.ndarray) -> np.ndarray:
    """The points that minimise g (z - b) + (z - b) h (z - b) / 2 + l1 |z| + l2 z^2 / 2 of each fit: coordinate descent."""
    z, r = b.copy(), g.copy()
    for _ in range(2000):
        moved = 0.0
        for j in range(b.shape[1]):
            own, p1, p2 = h[:, j, j], l1 if j else 0.0, l2 if j else 0.0
            u, low = own * z[:, j] - r[:, j], own + p2
            new = np.where(low > 0, np.sign(u) * np.maximum(np.abs(u) - p1, 0) / np.where(low > 0, low, 1), z[:, j])
            step = new - z[:, j]
            moved = max(moved, float((step**2 * low).max()))
            r += h[:, j] * step[:, None]
            z[:, j] = new
        if moved < 1e-22:
            break
    return z


def _lockstep(rows: DataFrame, fits: list[tuple], pairs: list[tuple[float, float]], d: int, passes: int) -> np.ndarray:
    n = np.array([s[2] * s[4] + s[3] * s[5] for _, s in fits])  # the sum of weights
    l1, l2 = (np.array([r * e for r, e in pairs]), np.array([r * (1 - e) for r, e in pairs]))
    b, step = np.zeros((len(fits), 1 + d)), np.zeros((len(fits), 1 + d))
    value, fall, part = np.full(len(fits), np.inf), np.zeros(len(fits)), np.ones(len(fits))

    def penalty(z: np.ndarray, on: np.ndarray) -> np.ndarray:
        return l1[on] * np.abs(z[:, 1:]).sum(axis=1) + l2[on] / 2 * (z[:, 1:] ** 2).sum(axis=1)

    left = np.arange(len(fits))
    for _ in range(passes):
        at = b[left] + part[left, None] * step[left]
        s = _sums(rows, [fits[p] for p in left], at) / n[left, None]
        now = s[:, 0] + penalty(at, left)
        if not np.isfinite(now).all():
            raise ValueError("features must be finite")
        down = now <= value[left] + 1e-4 * part[left] * fall[left] + 1e-14 * np.abs(now)
        part[left] = np.where(down, 1.0, part[left] / 2)
        ok, s = left[down], s[down]
        b[ok], value[ok] = at[down], now[down]
        g, h = s[:, 1 : 2 + d], s[:, 2 + d :].reshape(-1, 1 + d, 1 + d)
        z = _models(g, h, b[ok], l1[ok], l2[ok]) if len(ok) else b[ok]
        step[ok] = z - b[ok]
        fall[ok] = (g * step[ok]).sum(axis=1) + penalty(z, ok) - penalty(b[ok], ok)
        ended = ok[fall[ok] > -1e-10 * np.maximum(1, np.abs(value[ok]))]  # one more step would be squared: it is taken unseen
        b[ended] += step[ended]
        left = np.setdiff1d(left, np.union1d(ended, np.flatnonzero(part < 1e-10)))
        if not len(left):
            break
    return b


def fitted(rows: DataFrame, sets: list[tuple[int, int | None]], scaled: list[tuple], pairs: list[tuple[float, float]], passes: int = 60) -> np.ndarray:
    """(intercept, coefficients) of a fit to each training set with its pair (reg, elastic). A set of one class has no
    coefficients and an endless intercept."""
    d = len(scaled[0][0])
    b = np.zeros((len(sets), 1 + d))
    for p, s in enumerate(scaled):
        if not (s[4] and s[5]):
            b[p, 0] = np.inf if s[5] else -np.inf
    open_ = [p for p, s in enumerate(scaled) if s[4] and s[5]]
    if d > WIDE:
        for p in open_:
            (k, i), (reg, elastic) = sets[p], pairs[p]
            part = F.col("part")[k]
            train = rows.where(part != TEST if i is None else (part >= 0) & (part != i)).withColumn("_x", array_to_vector("x"))
            train = StandardScaler(withMean=True, inputCol="_x", outputCol="_s").fit(train).transform(train).where("label is not null")
            train = train.withColumn("_w", F.when(F.col("label") == 1, F.lit(float(scaled[p][3]))).otherwise(F.lit(float(scaled[p][2]))))
            m = LogisticRegression(featuresCol="_s", labelCol="label", weightCol="_w", regParam=reg, elasticNetParam=elastic, standardization=False, maxIter=passes).fit(train)
            b[p] = [m.intercept, *m.coefficients.toArray()]
        return b
    most = max(1, SUMS // (8 * (1 + (1 + d) + (1 + d) ** 2)))
    for k in range(0, len(open_), most):
        own = open_[k : k + most]
        b[own] = _lockstep(rows, [(sets[p], scaled[p]) for p in own], [pairs[p] for p in own], d, passes)
    return b


def tried(rows: DataFrame, sets: list[tuple[int, int | None]], scaled: list[tuple], b: np.ndarray) -> DataFrame:
    """(fit, label, score): rows of the inner fold that each fit has left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in filled(batches):
            x, _, part = arrays(batch)
            for p, (k, i) in enumerate(sets):
                on = part[:, k] == i
                label = batch.column("label").filter(pa.array(on)).cast(pa.int32())
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(label), p, np.int32)), label, pa.array(chances(x[on], scaled[p], b[p : p + 1])[:, 0])], names=["fit", "label", "score"])

    return rows.mapInArrow(run, "fit int, label int, score double")


def scored(rows: DataFrame, scaled: list[tuple], pairs: list[tuple[float, float]], b: np.ndarray) -> DataFrame:
    """(key, fold, label, score, reg, elastic): rows of each outer fold by the fit of the others."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in filled(batches):
            x, fold = arrays(batch)[0], batch.column("fold").to_numpy(zero_copy_only=False)
            for k, pair in enumerate(pairs):
                on = fold == k
                n, keep = int(on.sum()), pa.array(on)
                own = [batch.column("key").filter(keep), batch.column("fold").filter(keep), batch.column("label").filter(keep).cast(pa.int32()), pa.array(chances(x[on], scaled[k], b[k : k + 1])[:, 0])]
                yield pa.RecordBatch.from_arrays([*own, *(pa.array(np.full(n, v)) for v in pair)], names=["key", "fold", "label", "score", "reg", "elastic"])

    kinds = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    return rows.mapInArrow(run, f"key {kinds['key']}, fold {kinds['fold']}, label int, score double, reg double, elastic double")

"""Small dense kernels that Spark lacks: average linkage of a bounded number of items; exact t-SNE of a bounded number of
landmarks, by which any number of rows is placed."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType

from sampleloom.session import cut

#: Most items of a clustering, which sees all their pairs.
MOST = 2000
#: Rows that are embedded exactly; where there are more, the others are placed among so many by hash.
LANDMARKS = 5000
#: Landmarks by which a row is placed.
NEAREST = 10


def average_linkage(distance: np.ndarray) -> list[tuple[int, int, float, int]]:
    """Merges (a, b, height, size) of average-linkage clustering; new clusters are numbered from n on."""
    n = len(distance)
    d = distance.astype(float).copy()
    np.fill_diagonal(d, np.inf)
    ids, sizes, alive, merges = list(range(n)), np.ones(n), np.ones(n, bool), []
    for step in range(n - 1):
        k = int(np.argmin(np.where(alive[:, None] & alive[None, :], d, np.inf)))
        i, j = divmod(k, n)
        i, j = min(i, j), max(i, j)
        merges.append((min(ids[i], ids[j]), max(ids[i], ids[j]), float(d[i, j]), int(sizes[i] + sizes[j])))
        row = (d[i] * sizes[i] + d[j] * sizes[j]) / (sizes[i] + sizes[j])
        d[i], d[:, i], d[i, i], alive[j] = row, row, np.inf, False
        sizes[i] += sizes[j]
        ids[i] = n + step
    return merges


def leaf_order(merges: list[tuple[int, int, float, int]], n: int) -> list[int]:
    """Leaves from left to right."""
    children, out = {n + k: m[:2] for k, m in enumerate(merges)}, []
    stack = [n + len(merges) - 1] if merges else list(range(n))
    while stack:
        x = stack.pop()
        if x < n:
            out.append(x)
        else:
            stack += reversed(children[x])
    return out


def clustered(pairs: DataFrame, a: str, b: str, r: str) -> DataFrame:
    """(item, place): items in the leaf order of average linkage on 1 - r; pairs give both directions of every two items."""
    pdf = pairs.select(F.col(a).alias("a"), F.col(b).alias("b"), F.col(r).alias("r")).limit(MOST * MOST + 1).toPandas()
    names = sorted(set(pdf.a) | set(pdf.b))
    if len(names) > MOST:
        raise ValueError(f"{len(names)} items; clustering takes {MOST} at most")
    at = {x: k for k, x in enumerate(names)}
    d = np.ones((len(names), len(names)))
    d[pdf.a.map(at), pdf.b.map(at)] = 1 - pdf.r.fillna(0)
    order = leaf_order(average_linkage((d + d.T) / 2), len(names))
    return pairs.sparkSession.createDataFrame([(names[x], k) for k, x in enumerate(order)], pairs.select(F.col(a).alias("item")).schema.add("place", IntegerType()))


def tsne(x: np.ndarray, perplexity: float = 20.0, steps: int = 250, seed: int = 7) -> np.ndarray:
    """Exact t-SNE in two dimensions, by gradient descent with momentum, from the first two principal components."""
    n = len(x)
    s = (x * x).sum(1)
    d = np.maximum(s[:, None] + s[None, :] - 2 * x @ x.T, 0)
    x, d, p = x.astype(np.float32), d.astype(np.float32), np.zeros((n, n), np.float32)
    for i in range(n):
        lo, hi, beta, row = 0.0, np.inf, 1.0, np.delete(d[i], i)
        for _ in range(50):
            w = np.exp(-(row - row.min()) * beta)
            h = np.log(w.sum()) + beta * ((row - row.min()) * w).sum() / w.sum()
            if abs(h - np.log(perplexity)) < 1e-5:
                break
            lo, hi = (beta, hi) if h > np.log(perplexity) else (lo, beta)
            beta = beta * 2 if hi == np.inf else (lo + hi) / 2
        p[i, np.arange(n) != i] = w / w.sum()
    p = np.maximum((p + p.T) / (2 * n), 1e-12)
    c = x - x.mean(0)
    y = ((np.linalg.svd(c, full_matrices=False)[0][:, :2]) * 1e-2).astype(np.float32)
    v = np.zeros_like(y)
    for k in range(steps):
        t = y @ y.T
        q = 1 / (1 + np.diag(t)[:, None] + np.diag(t)[None, :] - 2 * t)
        np.fill_diagonal(q, 0)
        w = ((p * (4 if k < 50 else 1)) - np.maximum(q / q.sum(), 1e-12)) * q
        g = 4 * ((np.diag(w.sum(1)) - w) @ y)
        v = (0.5 if k < 50 else 0.8) * v - 50 * g
        y = y + v
        y -= y.mean(0)
    return y


def placed(x: np.ndarray, landmarks: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Each row at the mean of its nearest landmarks' places, weighted by a Gaussian of the distance to the farthest of them."""
    d = np.maximum((x * x).sum(1)[:, None] + (landmarks * landmarks).sum(1)[None, :] - 2 * x @ landmarks.T, 0)
    k = min(NEAREST, len(landmarks))
    near = np.argpartition(d, k - 1, axis=1)[:, :k]
    own = np.take_along_axis(d, near, 1)
    w = np.exp(-own / np.maximum(own.max(1, keepdims=True), 1e-12) * 4)
    return (w[:, :, None] * y[near]).sum(1) / w.sum(1)[:, None]


def embedded(df: DataFrame, key: str, features: str, landmarks: int = LANDMARKS) -> DataFrame:
    """(key, x, y) of every row by t-SNE: the `landmarks` rows of least hash are embedded exactly in one task (all rows, if
    there are no more), the others are placed by their nearest landmarks. Rows without features have null places."""
    rows = df.select(F.col(key).cast("long").alias("key"), F.col(features).cast("array<double>").alias("f"))
    chosen = cut(rows.where("f is not null").orderBy(F.xxhash64("key"), "key").limit(landmarks))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("key")
        y = tsne(np.stack(pdf["f"].to_list()).astype(float), min(20.0, max(2.0, (len(pdf) - 1) / 3)))
        return pd.DataFrame({"key": pdf["key"], "f": pdf["f"], "x": y[:, 0].astype(float), "y": y[:, 1].astype(float)})

    known = cut(chosen.withColumn("g", F.lit(1)).groupBy("g").applyInPandas(run, "key long, f array<double>, x double, y double"))
    table = known.toPandas()  # at most `landmarks` rows
    places, at = np.stack(table["f"].to_list()) if len(table) else np.zeros((0, 1)), table[["x", "y"]].to_numpy()

    def place(batches):
        for pdf in batches:
            out = np.full((len(pdf), 2), np.nan)
            has = pdf["f"].notna().to_numpy()
            if has.any():
                out[has] = placed(np.stack(pdf["f"][has].to_list()).astype(float), places, at)
            yield pd.DataFrame({"key": pdf["key"], "x": out[:, 0], "y": out[:, 1]})

    others = rows.join(known.select("key"), "key", "left_anti").mapInPandas(place, "key long, x double, y double")
    return known.select("key", "x", "y").unionByName(others).select(F.col("key").alias(key), F.nanvl("x", F.lit(None)).alias("x"), F.nanvl("y", F.lit(None)).alias("y"))

"""Top N items within every group, by sorted runs and a loser-tree merge.

1. Every input split is sorted by (group, score downwards, item) and read once; a split gives one run that keeps the
   first N different items of each group and seeks past the rest. A repeated (group, item) pair counts once, with its
   highest score: in a run it comes first there, and the N best of all runs are among the N best of each run. Hence a
   group with a third of all rows leaves at most N rows per run.
2. Runs are bucketed by the hash of the group (the only shuffle), each bucket in the order of groups (an external sort).
3. In each bucket a loser tree merges the runs, some whole groups at a time, so a task holds CHUNK_ROWS rows and one group
   (N rows a run at most) however large its bucket is; after N outputs every run seeks to its next group.

Empty tables give no rows. Rows with a null group, item or score, a NaN score, a score outside `valid`, or (with
`skip_self`) an item equal to its group are left out. Equal scores are ordered by item, in byte order. -0.0 equals 0.0.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


#: Rows merged at once.
CHUNK_ROWS = 100_000


class LoserTree:
    """Tournament over k sources: `winner` is the source with the least key; None stands for an exhausted one."""

    def __init__(self, keys: list):
        self.k = max(1, len(keys))
        self.keys = list(keys) or [None]
        self.losers = [0] * self.k
        self.winner = self._build(1) if self.k > 1 else 0

    def _less(self, a: int, b: int) -> bool:
        x, y = self.keys[a], self.keys[b]
        return y is None or (x is not None and x <= y)

    def _build(self, node: int) -> int:
        if node >= self.k:
            return node - self.k
        a, b = self._build(2 * node), self._build(2 * node + 1)
        win, lose = (a, b) if self._less(a, b) else (b, a)
        self.losers[node] = lose
        return win

    def replace(self, key) -> None:
        """Give the winner's source its next key and replay its path to the root."""
        keys, losers, win = self.keys, self.losers, self.winner
        keys[win] = key
        node = (win + self.k) >> 1
        while node:
            other = losers[node]
            y = keys[other]
            if y is not None and (key is None or y < key):
                losers[node], win, key = win, other, y
            node >>= 1
        self.winner = win


def _keep(groups: pa.Array, items: pa.Array, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Of rows sorted by group and score: which are among the first n different items of their group, and group starts."""
    rows = len(groups)
    new = np.ones(rows, bool)
    new[1:] = pc.not_equal(groups.slice(1), groups.slice(0, rows - 1)).to_numpy(zero_copy_only=False)
    group = np.cumsum(new) - 1
    codes = items.dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64)
    pair = group * (int(codes.max()) + 1) + codes
    first = np.zeros(rows, bool)
    first[np.unique(pair, return_index=True)[1]] = True
    seen = np.cumsum(first)
    before = (seen - first)[new][group]
    return first & (seen - before <= n), new


def _form_runs(n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tail = None
        for batch in batches:
            if not batch.num_rows:
                continue
            part = pa.Table.from_batches([batch])
            part = (pa.concat_tables([tail, part]) if tail is not None else part).combine_chunks()
            keep, new = _keep(part["g"].combine_chunks(), part["i"].combine_chunks(), n)
            last = int(np.flatnonzero(new)[-1])  # the last group may go on in the next batch
            done = part.slice(0, last).filter(pa.array(keep[:last]))
            tail = part.slice(last).filter(pa.array(keep[last:]))
            if done.num_rows:
                yield from done.combine_chunks().to_batches()
        if tail is not None:
            yield from tail.combine_chunks().to_batches()

    return run


def _whole_groups(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.Table]:
    """The rows, which are in the order of groups, in tables of whole groups and `rows` rows or somewhat more."""
    parts, size = [], 0
    for batch in batches:
        if not batch.num_rows:
            continue
        parts.append(batch)
        size += batch.num_rows
        if size < rows:
            continue
        whole = pa.Table.from_batches(parts).combine_chunks()
        group = whole["g"].combine_chunks()
        same = pc.equal(group, group[-1]).to_numpy(zero_copy_only=False)
        last = int(np.argmax(same))  # the last group may go on in the next batch
        if last:
            yield whole.slice(0, last).combine_chunks()
        parts = whole.slice(last).combine_chunks().to_batches()
        size = whole.num_rows - last
    if parts:
        yield pa.Table.from_batches(parts).combine_chunks()


def _merge_runs(n: int, rows: int):
    schema = pa.schema([("g", pa.string()), ("i", pa.string()), ("s", pa.float64()), ("rank", pa.int32())])

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for bucket in _whole_groups(batches, rows):
            yield merged(bucket)

    def merged(bucket: pa.Table) -> pa.RecordBatch:
        coded = bucket["g"].combine_chunks().dictionary_encode()
        names = coded.dictionary
        place = np.empty(len(names), np.int64)
        by_name = pc.sort_indices(names).to_numpy()
        place[by_name] = np.arange(len(names))
        group = place[coded.indices.to_numpy(zero_copy_only=False)]
        run = bucket["run"].combine_chunks().to_numpy(zero_copy_only=False)
        score = bucket["s"].combine_chunks().to_numpy(zero_copy_only=False)
        order = np.argsort(run, kind="stable")
        if not np.all((np.diff(group[order]) >= 0) | (np.diff(run[order]) != 0)):
            order = np.lexsort((np.arange(len(run)), group, run))
        bounds = [0, *(np.flatnonzero(np.diff(run[order])) + 1).tolist(), len(order)]
        runs, g = order.tolist(), group[order]
        ends = np.searchsorted(np.flatnonzero(np.append((np.diff(g) != 0) | (np.diff(run[order]) != 0), True)), np.arange(len(g)))
        ends = (np.flatnonzero(np.append((np.diff(g) != 0) | (np.diff(run[order]) != 0), True))[ends] + 1).tolist()
        g, s, items = g.tolist(), (-score[order]).tolist(), bucket["i"].combine_chunks().take(pa.array(order)).to_pylist()
        at, stop = bounds[:-1], bounds[1:]
        key = lambda p: (g[p], s[p], items[p])
        tree = LoserTree([key(p) for p in at])
        out: list[int] = []
        ranks: list[int] = []
        now, found = -1, []
        while (head := tree.keys[tree.winner]) is not None:
            src = tree.winner
            p = at[src]
            if head[0] != now:
                now, found = head[0], []
            if len(found) < n:
                if head[2] not in found:
                    found.append(head[2])
                    out.append(p)
                    ranks.append(len(found))
                p += 1
            if len(found) >= n and p < stop[src] and g[p] == now:
                p = ends[p]  # seek to the run's next group
            at[src] = p
            tree.replace(key(p) if p < stop[src] else None)
        taken = pa.array(order[out])
        return pa.record_batch(
            [bucket["g"].combine_chunks().take(taken), bucket["i"].combine_chunks().take(taken), pa.array(score[order[out]], pa.float64()), pa.array(ranks, pa.int32())],
            schema=schema,
        )

    return merge


def top_items(df: DataFrame, group: str, item: str, score: str, n: int = 5, valid: tuple[float, float] | None = None, skip_self: bool = False) -> DataFrame:
    """(group, item, score, rank): the n items of highest score of each group; see the module's text for the cases."""
    rows = df.select(F.col(group).cast("string").alias("g"), F.col(item).cast("string").alias("i"), (F.col(score).cast("double") + F.lit(0.0)).alias("s"))
    rows = rows.where(F.col("g").isNotNull() & F.col("i").isNotNull() & F.col("s").isNotNull() & ~F.isnan("s"))
    if valid:
        rows = rows.where(F.col("s").between(*valid))
    if skip_self:
        rows = rows.where(F.col("g") != F.col("i"))
    runs = rows.withColumn("run", F.spark_partition_id()).sortWithinPartitions("g", F.desc("s"), "i").mapInArrow(_form_runs(n), "g string, i string, s double, run int")
    merged = runs.repartition("g").sortWithinPartitions("g", "run", F.desc("s"), "i").mapInArrow(_merge_runs(n, CHUNK_ROWS), "g string, i string, s double, rank int")
    return merged.select(F.col("g").alias(group), F.col("i").alias(item), F.col("s").alias(score), "rank")

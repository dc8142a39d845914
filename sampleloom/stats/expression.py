"""Expression values: TPM, reference-matched differential scores, correlation of items over samples."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from sampleloom.operators.aggregates import safe_corr


def tpm(counts: DataFrame, lengths: DataFrame) -> DataFrame:
    """counts (sample_index, gene, n) with tpm: rate n / length in kb (1 where unknown), per million of the sample."""
    rates = counts.join(lengths, "gene", "left").withColumn("_r", F.col("n") / F.coalesce("length_kb", F.lit(1.0)))
    totals = rates.groupBy("sample_index").agg(F.sum("_r").alias("_t"))
    scale = F.when(F.col("_t") == 0, F.lit(1e-6)).otherwise(F.col("_t"))
    return rates.join(totals, "sample_index").withColumn("tpm", F.col("_r") / scale * 1e6).drop("_r", "_t", "length_kb")


def differential(values: DataFrame, bucket: str, least: int = 30, floor_sd: float = 1e-6) -> DataFrame:
    """Each value against its bucket's reference (the whole pool below `least` samples): lfc, z, reference_scope, reference_n.

    One pass gives the statistics of buckets and pool (grouping sets); the fallback is per (bucket, gene).
    """
    s = values.groupingSets([[bucket, "gene"], ["gene"]], bucket, "gene").agg(F.avg("v").alias("m"), F.stddev_pop("v").alias("sd"), F.count("*").alias("n"), F.grouping(bucket).alias("pool"))
    own = s.where(F.col("pool") == 0).where(F.col("n") >= least).select(bucket, "gene", F.struct("m", "sd", "n").alias("own"))
    pool = s.where("pool = 1").select("gene", F.struct("m", "sd", "n").alias("all"))
    got = values.join(own, [bucket, "gene"], "left").join(pool, "gene").withColumn("r", F.coalesce("own", "all"))
    got = got.withColumn("reference_scope", F.when(F.col("own").isNull(), "pool").otherwise("tissue")).withColumn("lfc", F.col("v") - F.col("r.m"))
    return got.withColumn("z", F.col("lfc") / (F.col("r.sd") + floor_sd)).withColumn("reference_n", F.col("r.n")).drop("own", "all", "r")


def per_sample_scores(scored: DataFrame, k: int, gate) -> DataFrame:
    """A row per sample: mean and largest |z|, genes beyond 2, and the k most raised and lowered genes through the gate."""
    from sampleloom.operators.windows import top_lists

    a = F.abs("z")
    base = scored.groupBy("sample_index").agg(F.round(F.avg(a), 6).alias("mean_abs_z"), F.round(F.max(a), 6).alias("max_abs_z"), F.count_if(a > 2).alias("n_gt2"), F.round(F.avg((a > 2).cast("int")), 8).alias("frac_gt2"), F.count("z").alias("n_compared"))
    return base.join(top_lists(scored, "sample_index", "gene", "z", k, gate), "sample_index", "left")


def _block_pairs(k: int, schema: pa.Schema):
    """Rows in the order of (first, second, chunk) -> the k best partners of each gene within each pair of blocks.

    Of a pair of blocks the sums over the samples that both genes have are kept (six matrices of block x block numbers),
    and the cells of one chunk of samples at a time.
    """

    def best(first: list, second: list, sums: np.ndarray, same: bool) -> tuple[list, list, list]:
        n, x, y, xx, yy, xy = sums
        with np.errstate(divide="ignore", invalid="ignore"):
            vx, vy, c = xx - x * x / n, yy - y * y / n, xy - x * y / n
            r = np.where((vx > 1e-12 * xx) & (vy > 1e-12 * yy), np.clip(c / np.sqrt(vx * vy), -1, 1), 0.0)
        r[n < 2] = np.nan
        out: tuple[list, list, list] = ([], [], [])
        for own, others, table in ((first, second, r), *(() if same else ((second, first, r.T),))):
            names = np.array(others, dtype=object)
            by_name = np.argsort(names, kind="stable")
            for g, row in zip(own, table):
                order = by_name[np.argsort(-np.round(row[by_name], 12), kind="stable")]
                order = [p for p in order[: k + 1].tolist() if others[p] != g and row[p] == row[p]][:k]
                out[0].extend([g] * len(order))
                out[1].extend(others[p] for p in order)
                out[2].extend(row[p] for p in order)
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair = chunk = sums = None
        places: tuple[dict, dict] = ({}, {})
        cells: tuple[list, list] = ([], [])

        def add() -> None:
            """The chunk's products into the sums."""
            nonlocal sums
            second = 0 if pair[0] == pair[1] else 1
            samples = np.unique(np.concatenate([c[1] for side in cells for c in side]))
            sides = []
            for side in {0, second}:
                v, has = np.zeros((len(places[side]), len(samples))), np.zeros((len(places[side]), len(samples)))
                for g, at, values in cells[side]:
                    where = np.searchsorted(samples, at)
                    v[places[side][g], where], has[places[side][g], where] = values, 1.0
                sides.append((v, has))
            (a, ha), (b, hb) = sides[0], sides[-1]
            new = np.stack([ha @ hb.T, a @ hb.T, ha @ b.T, (a * a) @ hb.T, ha @ (b * b).T, a @ b.T])
            if sums is not None:
                new[:, : sums.shape[1], : sums.shape[2]] += sums  # genes may come up in later chunks only
            sums = new
            cells[0].clear()
            cells[1].clear()

        def done() -> pa.RecordBatch:
            add()
            same = pair[0] == pair[1]
            out = best(list(places[0]), list(places[0 if same else 1]), sums, same)
            return pa.record_batch([pa.array(c, f.type) for c, f in zip(out, schema)], schema=schema)

        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in ("first", "second", "chunk", "side", "gene")), *(batch.column(c) for c in ("samples", "values"))):
                if pair is not None and row[:2] != pair:
                    yield done()
                    sums, places, cells = None, ({}, {}), ([], [])
                elif pair is not None and row[2] != chunk:
                    add()
                pair, chunk, side, gene = row[:2], row[2], row[3], row[4]
                places[side].setdefault(gene, len(places[side]))
                cells[side].append((gene, row[5].values.to_numpy(zero_copy_only=False), row[6].values.to_numpy(zero_copy_only=False)))
        if pair is not None:
            yield done()

    return run


def pearson_top(values: DataFrame, k: int, block: int = 512, chunk: int = 2048) -> DataFrame:
    """(gene, partner, rank, r): the k most correlated partners of each gene, over the samples that both have.

    Genes are cut into blocks of about `block`, samples into chunks of about `chunk`. Each unordered pair of blocks meets
    in one task, chunk after chunk, so a task holds 6 x block^2 + 4 x block x chunk numbers whatever the number of genes
    and samples, and gives k rows a gene and pair of blocks; all pairs are never kept, whole columns neither. Null and NaN cells
    are missing; of a cell that comes twice one counts. r is 0 where a gene doesn't vary; pairs with fewer than two common samples have none.
    """
    cells = values.where("gene is not null and sample_index is not null and v is not null and not isnan(v)")
    size = cells.agg(F.approx_count_distinct("gene").alias("g"), F.approx_count_distinct("sample_index").alias("s")).first()
    blocks, chunks = max(1, math.ceil(size["g"] / block)), max(1, math.ceil(size["s"] / chunk))
    means = cells.groupBy("gene").agg(F.avg("v").alias("m"))
    # differences from the mean: no digits are lost in the products
    shifted = cells.join(means, "gene").select("gene", "sample_index", (F.col("v") - F.col("m")).alias("z"))
    rows = shifted.groupBy("gene", F.pmod(F.xxhash64("sample_index"), F.lit(chunks)).cast("int").alias("chunk")).agg(F.collect_list(F.struct("sample_index", "z")).alias("c"))  # a chunk of one gene
    own, other = F.pmod(F.xxhash64("gene"), F.lit(blocks)).cast("int"), F.col("other")
    rows = rows.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    rows = rows.select(F.least("own", other).alias("first"), F.greatest("own", other).alias("second"), "chunk", (F.col("own") > other).cast("int").alias("side"), "gene", F.col("c.sample_index").alias("samples"), F.col("c.z").alias("values"))
    kind = values.schema["gene"].dataType
    schema = pa.schema([("gene", to_arrow_type(kind)), ("partner", to_arrow_type(kind)), ("r", pa.float64())])
    spread = rows.repartition("first", "second").sortWithinPartitions("first", "second", "chunk")
    best = spread.mapInArrow(_block_pairs(k, schema), f"gene {kind.simpleString()}, partner {kind.simpleString()}, r double")
    w = Window.partitionBy("gene").orderBy(F.desc(F.round("r", 12)), "partner")  # k rows a block
    return best.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def pearson_pairs(values: DataFrame, pairs: DataFrame) -> DataFrame:
    """(gene, partner, r) of given pairs, recomputed from the values."""
    x = pairs.join(values.select("gene", "sample_index", "v"), "gene").join(values.select(F.col("gene").alias("partner"), "sample_index", F.col("v").alias("w")), ["partner", "sample_index"])
    return x.groupBy("gene", "partner").agg(safe_corr("v", "w").alias("r"))



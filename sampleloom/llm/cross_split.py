"""Same or near-same records across splits: exact prefix-filter join of evaluation and training profiles.

A profile is the set of its genes, up and down apart, with their z. Two profiles are near when of all genes of either at
least `threshold` are in both and the z of each of these differ by less than `tolerance` of the larger in size.

Tokens are put in one order, rare ones first (counts of the most frequent VOCABULARY tokens, hash order for the rest; the
order affects speed only). Near sets of two tokens or more share at least two tokens among the first n - o + 2 of each,
o being the least overlap for their size, so pairs of prefix tokens are the index: the evaluation side is indexed and the
training side probes, both keyed by two tokens and their z steps. A step is as wide as two tolerances, and the indexed
side takes both steps that a z within the tolerance can fall in. Length and position filters, and 64-bit sketches of the token
sets, drop pairs whose overlap can't reach the threshold; the others are verified on the whole profiles. Sets of one token are keyed by it alone.
Keys and accessions that many training samples have are joined by fragments (operators/skew.py).

Samples are distinct values of sample_index (their latest row counts); those with in_holdout null belong to neither side.
Null or empty lists, names and z make no tokens; of a gene named twice on one side the first counts; a list of z shorter
than its genes gives null z. Null and NaN z are never near. Equal z of 0 are not near (0 is not less than 0).
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from itertools import combinations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sampleloom.functions.text import clean_upper, name_list
from sampleloom.operators.skew import fragment_replicate_join
from sampleloom.session import cut

#: Most token counts that are sent to the workers.
VOCABULARY = 200_000


def _latest(samples: DataFrame) -> DataFrame:
    cols = ["in_holdout", "status", "series_id", "geo_accession", "top_up_genes", "top_down_genes", "top_up_z", "top_down_z"]
    rows = samples.where("sample_index is not null and in_holdout is not null")
    return rows.groupBy("sample_index").agg(F.max_by(F.struct(*cols), F.coalesce("ingested_at", F.lit("1900-01-01").cast("timestamp"))).alias("r")).select("sample_index", "r.*")


def _profiles(latest: DataFrame) -> DataFrame:
    def side(mark: str, genes: str, z: str):
        pairs = F.arrays_zip(F.coalesce(F.col(genes), F.array()).alias("g"), F.coalesce(F.col(z), F.array()).alias("z"))
        return F.transform(F.filter(pairs, lambda x: x["g"].isNotNull() & (x["g"] != "")), lambda x: F.struct(F.concat(F.lit(mark), x["g"]).alias("t"), x["z"].cast("double").alias("z")))

    rows = latest.where("status = 'ok'").select("sample_index", "in_holdout", F.concat(side("+", "top_up_genes", "top_up_z"), side("-", "top_down_genes", "top_down_z")).alias("p"))
    return rows.where(F.size("p") > 0).select("sample_index", "in_holdout", F.col("p.t").alias("tokens"), F.col("p.z").alias("z"))


def _signatures(counts, threshold: float, tolerance: float):
    schema = pa.schema([("key", pa.int64()), ("sample_index", pa.int64()), ("sketch", pa.int64()), ("nij", pa.int64())])
    step = -2 * math.log1p(-tolerance)

    def code(token: str) -> int:
        b = token.encode()
        return zlib.crc32(b) << 32 | zlib.adler32(b)

    def steps(z: float | None, both: bool) -> tuple[int, ...]:
        """The step of ln|z|, with its sign; `both` adds the neighbour that is nearer."""
        if z is None or z != z or z == 0 or math.isinf(z):
            return ()
        x = math.log(abs(z)) / step
        k = math.floor(x)
        sign = 1 if z > 0 else -1
        keys = (k, k + 1 if x - k >= 0.5 else k - 1) if both else (k,)
        return tuple(2 * v + (sign > 0) for v in keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, int] = counts.value
        for batch in batches:
            keys, samples, sketches, nijs = out = [], [], [], []
            for sample, held, tokens, zs in zip(*(batch.column(k).to_pylist() for k in range(4))):
                own = {}
                for t, z in zip(tokens, zs):
                    own.setdefault(t, z)
                order = sorted(own, key=lambda t: (known.get(t, 0), code(t), t))
                n = len(order)
                least = math.ceil(threshold * n - 1e-9)
                before = len(keys)
                if n == 1:
                    for a in steps(own[order[0]], held):
                        keys.append(hash((code(order[0]), a)))
                        nijs.append(1 << 40)
                prefix = [(i, code(t), s) for i, t in enumerate(order[: n - least + 2]) if (s := steps(own[t], held))]
                for (i, a, x), (j, b, y) in combinations(prefix, 2):
                    keys += [hash((a, u, b, v)) for u in x for v in y]
                    nijs += [n << 40 | i << 20 | j] * (len(x) * len(y))
                sketch = 0
                for t in order:
                    sketch |= 1 << (code(t) * 0x9E3779B97F4A7C15 >> 58 & 63)
                sketches += [sketch - (sketch >> 63 << 64)] * (len(keys) - before)
                samples += [sample] * (len(keys) - before)
            yield pa.record_batch([pa.array(c, f.type) for c, f in zip(out, schema)], schema=schema)

    return run


def _verify(threshold: float, tolerance: float):
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for tx, zx, ty, zy in zip(*(batch.column(k).to_pylist() for k in (2, 3, 4, 5))):
                x, y = {}, {}
                for t, z in zip(tx, zx):
                    x.setdefault(t, z)
                for t, z in zip(ty, zy):
                    y.setdefault(t, z)
                both = x.keys() & y.keys()
                near = len(both) >= threshold * (len(x) + len(y) - len(both)) - 1e-9 and all(
                    (p := x[t]) is not None and (q := y[t]) is not None and abs(p - q) < tolerance * max(abs(p), abs(q)) for t in both
                )
                keep.append(near)
            mask = pa.array(keep, pa.bool_())
            yield pa.record_batch([batch.column(0).filter(mask), batch.column(1).filter(mask)], schema=schema)

    return run


def near_profiles(latest: DataFrame, threshold: float = 0.8, tolerance: float = 0.05) -> DataFrame:
    """(held, other): evaluation and training samples of near the same profile."""
    spark = latest.sparkSession
    profiles = cut(_profiles(latest))
    top = profiles.select(F.explode("tokens").alias("t")).groupBy("t").count().orderBy(F.desc("count"), "t").limit(VOCABULARY)
    counts = spark.sparkContext.broadcast({r["t"]: r["count"] for r in top.toLocalIterator()})
    def signed(held: bool, name: str) -> DataFrame:
        side = profiles.where(F.col("in_holdout") == held).select("sample_index", "in_holdout", "tokens", "z")
        rows = side.mapInArrow(_signatures(counts, threshold, tolerance), "key long, sample_index long, sketch long, nij long")
        return rows.select("key", F.col("sample_index").alias(name), F.col("sketch").alias(f"s{name}"), F.col("nij").alias(f"p{name}"))

    # a key that many training samples have is split over shards, and the evaluation samples of it go to each of them
    met = fragment_replicate_join(cut(signed(False, "b")), signed(True, "a"), "key", by=["b"])
    part = lambda side, bits: F.shiftright(F.col(f"p{side}"), bits).bitwiseAND((1 << 20) - 1)
    na, ia, ja, nb, ib, jb = (part(x, k) for x in "ab" for k in (40, 20, 0))
    need = F.ceil(F.lit(threshold / (1 + threshold)) * (na + nb) - F.lit(1e-9))
    # each token of one side only sets at most one bit that the other sketch lacks
    fits = (F.bit_count(F.col("sa").bitwiseXOR(F.col("sb"))) <= na + nb - 2 * need) & (F.least(na, nb) >= F.lit(threshold) * F.greatest(na, nb) - F.lit(1e-9))
    fits = fits & ((na == 1) | (F.least(ia, ib) + 1 + F.least(ja - ia, jb - ib) + F.least(na - ja - 1, nb - jb - 1) >= need))
    pairs = met.where(fits).select("a", "b").distinct()
    whole = profiles.select("sample_index", "tokens", "z")
    sides = pairs.join(whole.select(F.col("sample_index").alias("a"), F.col("tokens").alias("ta"), F.col("z").alias("za")), "a")
    sides = sides.join(whole.select(F.col("sample_index").alias("b"), F.col("tokens").alias("tb"), F.col("z").alias("zb")), "b")
    return sides.select("a", "b", "ta", "za", "tb", "zb").mapInArrow(_verify(threshold, tolerance), "a long, b long")


def overlaps(samples: DataFrame, threshold: float = 0.8, tolerance: float = 0.05) -> DataFrame:
    """(held, other, how): pairs of one evaluation and one training sample; how: accession, profile or both."""
    latest = _latest(samples)
    near = near_profiles(latest, threshold, tolerance).withColumn("how", F.lit("profile"))
    named = samples.where("sample_index is not null and in_holdout is not null").select("sample_index", "in_holdout", clean_upper(F.col("geo_accession")).alias("acc")).where("acc is not null")
    named = cut(named.distinct())
    same = fragment_replicate_join(named.where("not in_holdout").select("acc", F.col("sample_index").alias("b")), named.where("in_holdout").select("acc", F.col("sample_index").alias("a")), "acc")
    same = same.select("a", "b", F.lit("accession").alias("how"))
    both = near.unionByName(same).where("a <> b").groupBy("a", "b").agg(F.array_join(F.array_sort(F.collect_set("how")), "+").alias("how"))
    return both.select(F.col("a").alias("held"), F.col("b").alias("other"), "how")


def sample_pairs(samples: DataFrame, threshold: float = 0.8, tolerance: float = 0.05) -> DataFrame:
    """The pairs with the smaller sample_index first."""
    return overlaps(samples, threshold, tolerance).select(F.least("held", "other").alias("sample_index_a"), F.greatest("held", "other").alias("sample_index_b")).distinct()


def overlap_report(samples: DataFrame, threshold: float = 0.8, tolerance: float = 0.05) -> DataFrame:
    """Per split and cleaned series: samples that have a twin on the other side, and their links."""
    pairs = cut(overlaps(samples, threshold, tolerance))
    sides = pairs.select(F.lit("evaluation").alias("split"), F.col("held").alias("sample_index")).unionByName(pairs.select(F.lit("training").alias("split"), F.col("other").alias("sample_index")))
    per = sides.groupBy("split", "sample_index").agg(F.count("*").alias("links"))
    series = samples.select("sample_index", F.explode(name_list(F.col("series_id"))).alias("series_id")).distinct()
    return per.join(series, "sample_index").groupBy("split", "series_id").agg(F.count("*").alias("n_samples"), F.sum("links").alias("n_links"))

"""Splits that keep related records together: hash-to-min components, then weighted rendezvous hashing.

Records are tied by keys (here series, accession and patient). Of each record with several keys, the least is joined to
the others, so a key of any number of records adds one edge to a record, never pairs within a group; accessions and
patients that only one record has tie nothing and are left out. Components: every node keeps a cluster, sends the cluster
to its least member and the least member to the others, until nothing changes. Clusters are rows of a table that is
written to the shared folder each round (the round before is removed), so no cluster is ever held by one task, and the
nodes of large clusters, which the counts of a round name, are joined apart from the others. A component goes to the
split of least -ln(u) / share, u being a hash of component and split, so all of it lands in one split and shares hold
over components.

Null keys tie nothing; records without any key are components of their own. Repeated rows of a record are one record.
Splits with a null, NaN or non-positive share get nothing. Empty tables give no rows. Components whose rounds exceed
`rounds` (64, which is enough for chains of any practical length) raise an error rather than give a partial result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sampleloom.functions.text import clean_upper, name_list
from sampleloom.operators.skew import join_dimension
from sampleloom.session import cut, discard

#: Kinds of keys, as the first character of a node: series sort first, so they are the roots of components that have one.
SERIES, ACCESSION, PATIENT = "1:", "2:", "3:"


def _with_least(clusters: DataFrame, nodes: DataFrame, rows: int, largest: int) -> DataFrame:
    """Each row of a cluster with its least member m; the few nodes with a large part of all rows are joined apart."""
    limit = max(10_000, rows // (4 * int(clusters.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    if largest <= limit:
        return clusters.join(nodes.select("v", "m"), "v")
    heavy = F.broadcast(nodes.where(F.col("n") > limit).select("v", "m"))  # fewer than rows / limit
    light = clusters.join(heavy, "v", "left_anti").join(nodes.where(F.col("n") <= limit).select("v", "m"), "v")
    return light.unionByName(clusters.join(heavy, "v"))


def hash_to_min(edges: DataFrame, a: str = "a", b: str = "b", rounds: int = 64) -> DataFrame:
    """(node, root): the least node of the component of each node that has an edge."""
    both = edges.select(F.col(a).alias("a"), F.col(b).alias("b")).where("a is not null and b is not null and a <> b")
    pair = lambda x, y: F.struct(F.col(x).alias("v"), F.col(y).alias("u"))
    flat = lambda df, *pairs: df.select(F.explode(F.array(*pairs)).alias("e")).select("e.v", "e.u").distinct()
    clusters = cut(flat(both, pair("a", "b"), pair("b", "a"), pair("a", "a"), pair("b", "b")))
    state = None
    for _ in range(rounds):
        nodes = cut(clusters.groupBy("v").agg(F.min("u").alias("m"), F.count("*").alias("n"), F.sum(F.xxhash64("v", "u").cast("decimal(20,0)")).alias("h")))
        now = nodes.agg(F.sum("n").alias("n"), F.sum("h").alias("h"), F.max("n").alias("largest")).first()
        if (now["n"], now["h"]) == state:
            discard(clusters)
            return nodes.select(F.col("v").alias("node"), F.col("m").alias("root"))
        state = (now["n"], now["h"])
        sent = _with_least(clusters, nodes, now["n"] or 0, now["largest"] or 0)
        # the cluster goes to its least member, the least member to the others; one pass gives both
        moved = cut(flat(sent, pair("m", "u"), pair("u", "m")))
        discard(clusters)
        discard(nodes)
        clusters = moved
    raise RuntimeError(f"components not stable after {rounds} rounds")


def _stars(samples: DataFrame, labels: DataFrame) -> DataFrame:
    """(record, keys) of every sample: its series and those accessions and patients that another sample has too, sorted."""
    prefixed = lambda p, c: F.when(c.isNotNull(), F.concat(F.lit(p), c))
    own = F.concat(F.transform(name_list(F.col("series_id")), lambda x: F.concat(F.lit(SERIES), x)), F.array(prefixed(ACCESSION, clean_upper(F.col("geo_accession")))))
    rows = samples.where("sample_index is not null").select(F.col("sample_index").alias("record"), F.explode(own).alias("key"), F.lit(True).alias("sampled"))
    known = labels.where("has_resolved_patient and sample_index is not null").select(F.col("sample_index").alias("record"), prefixed(PATIENT, clean_upper(F.col("patient_key"))).alias("key"), F.lit(False).alias("sampled"))
    keys = cut(rows.unionByName(known))  # a null key keeps the record
    series = F.coalesce(F.startswith("key", F.lit(SERIES)), F.lit(False))
    loose = keys.where(~series)
    shared = loose.groupBy("key").agg(F.min("record").alias("low"), F.max("record").alias("high")).where("low <> high").select("key", F.lit(True).alias("shared"))
    ties = join_dimension(loose, shared, ["key"], "left").select("record", F.when(F.col("shared"), F.col("key")).alias("key"), "sampled")
    ties = ties.unionByName(keys.where(series))
    # a record has few keys
    return ties.groupBy("record").agg(F.array_sort(F.collect_set("key")).alias("keys"), F.max("sampled").alias("sampled")).where("sampled").drop("sampled")


def _edges(stars: DataFrame) -> DataFrame:
    """The least key of each record with each other key of it."""
    return stars.where(F.size("keys") > 1).select(F.get("keys", F.lit(0)).alias("a"), F.explode(F.slice("keys", 2, 1 << 30)).alias("b")).distinct()


def series_groups(samples: DataFrame, labels: DataFrame) -> DataFrame:
    """(series_id, group_series_id) of every cleaned series tied to another one; samples without a series tie nothing."""
    stars = _stars(samples, labels).where(F.startswith(F.get("keys", F.lit(0)), F.lit(SERIES)))
    roots = hash_to_min(_edges(stars)).where(F.startswith("node", F.lit(SERIES)))
    name = lambda c: F.substr(F.col(c), F.lit(len(SERIES) + 1))
    tied = roots.where("node <> root").select(name("node").alias("series_id"), name("root").alias("group_series_id"))
    return tied.unionByName(tied.select(F.col("group_series_id").alias("series_id"), "group_series_id").distinct())


def _rendezvous(component: Column, splits: list[tuple[str, float]]) -> Column:
    """The split of least -ln(u) / share; u in (0, 1] from an md5, so other engines can compute it."""

    def score(name: str, share: float) -> Column:
        u = (F.conv(F.substring(F.md5(F.concat(F.lit(name + "|"), component)), 1, 13), 16, 10).cast("double") + 1) / F.lit(float(16**13))
        return -F.ln(u) / F.lit(share)

    ranked = F.array_sort(F.array(*(F.struct(score(n, s).alias("x"), F.lit(n).alias("n")) for n, s in splits)))
    return ranked[0]["n"]


def assign_splits(samples: DataFrame, labels: DataFrame, targets: DataFrame) -> DataFrame:
    """(sample_index, component, split) of every sample; targets has a few rows (split, share)."""
    shares = targets.where("split is not null and share > 0 and not isnan(share)").groupBy("split").agg(F.sum("share").alias("share")).orderBy("split").collect()
    stars = cut(_stars(samples, labels))
    roots = hash_to_min(_edges(stars))
    every = join_dimension(stars.select("record", F.get("keys", F.lit(0)).alias("node")), roots, ["node"], "left")
    every = every.withColumn("component", F.coalesce("root", "node", F.concat(F.lit("r:"), F.col("record").cast("string"))))
    split = _rendezvous(F.col("component"), [(r["split"], r["share"]) for r in shares]) if shares else F.lit(None).cast("string")
    return every.select(F.col("record").alias("sample_index"), "component", split.alias("split"))


def split_report(samples: DataFrame, labels: DataFrame, targets: DataFrame) -> DataFrame:
    """Per split: wanted share, samples, share reached, components, and different series (none counted twice)."""
    given = cut(assign_splits(samples, labels, targets))
    series = samples.select("sample_index", F.explode(name_list(F.col("series_id"))).alias("series"))
    got = given.groupBy("split").agg(F.count("*").alias("n_samples"), F.countDistinct("component").alias("n_components"))
    got = got.withColumn("reached", F.round(F.col("n_samples") / F.sum("n_samples").over(Window.partitionBy(F.lit(1))), 6))  # a row a split
    n_series = given.join(series, "sample_index").groupBy("split").agg(F.countDistinct("series").alias("n_series"))
    return targets.select("split", "share").distinct().join(got, "split", "left").join(n_series, "split", "left")


def fold_overcounts(folds: DataFrame) -> DataFrame:
    """Runs whose folds count a series twice: train and validation series don't add up to the same number in all folds.

    Skipped folds (null counts) and repeated rows are left out; the least sum of a run is taken as its number of series.
    """
    rows = folds.select("run_id", "fold", "train_series_count", "val_series_count").dropna().distinct()
    rows = rows.withColumn("total", F.col("train_series_count") + F.col("val_series_count"))
    runs = rows.groupBy("run_id").agg(F.min("total").alias("n_series"), F.max("total").alias("most"), F.count("*").alias("n_folds"), F.sum("val_series_count").alias("val_sum"))
    return runs.select("run_id", "n_folds", "n_series", (F.col("most") - F.col("n_series")).alias("overcounted"), "val_sum")

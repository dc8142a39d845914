"""Parameterised questions over samples, answered set-wise: a refusal is a value (status and reason), never an error.

A request has a row id, a category, a sample and parameters (gene, gene_b, n, direction, threshold; all but the last
texts). A parameter that a category needs is never guessed: without it the request is refused. Each category is one plan over all its requests; the first
failing gate, in a fixed order, names the reason, and the answer is null unless the status is ok.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Category -> function (requests, context) -> (row, status, reason, answer).
REGISTRY: dict[str, Callable[[DataFrame, dict[str, DataFrame]], DataFrame]] = {}

UP = ["up", "above", "over", "higher", "top", "highest", "raised", ">"]
DOWN = ["down", "below", "under", "lower", "bottom", "lowest", "lowered", "<"]


def question(category: str):
    def add(f):
        REGISTRY[category] = f
        return f

    return add


def direction(c: Column) -> Column:
    """up, down, or null for no known alias."""
    d = F.lower(F.trim(c))
    return F.when(d.isin(UP), "up").when(d.isin(DOWN), "down")


def size_spec(c: Column, universe: Column) -> Column:
    """How many of a universe "5", "10%" or "0.1" ask for; null if it isn't usable."""
    t = F.trim(c)
    number = F.try_to_number(F.rtrim(F.replace(t, F.lit("%"), F.lit(""))), F.lit("999999.999999"))
    number = F.coalesce(number, F.when(F.rlike(t, F.lit(r"^[0-9]+%?$")), F.regexp_extract(t, "^([0-9]+)", 1).cast("decimal(12,6)")))
    share = F.when(F.endswith(t, F.lit("%")), number / 100).when(F.contains(t, F.lit(".")), number)
    n = F.when(share.isNotNull(), F.when((share > 0) & (share <= 1), F.ceil(share * universe))).otherwise(number).cast("int")
    return F.when((n >= 1) & (n <= universe), n)


def strict_integer(c: Column, low: int = 1, high: int | Column = 2**31 - 1) -> Column:
    """The integer that a text is, if it is nothing else and within [low, high]; null for decimals, words, booleans, null."""
    n = F.when(F.rlike(F.trim(c), F.lit(r"^[+-]?[0-9]{1,10}$")), F.trim(c).cast("long"))
    return F.when((n >= low) & (n <= high), n.cast("int"))


def _levels(ctx: dict[str, DataFrame]) -> DataFrame:
    """One value for each sample and gene; several columns of one symbol are averaged."""
    return ctx["values"].groupBy("sample", "gene").agg(F.avg("v").alias("v"))


def _lists(requests: DataFrame, ctx: dict[str, DataFrame]) -> DataFrame:
    """l: the genes and values of each sample that is asked for (a profile's list is short)."""
    asked = _levels(ctx).join(requests.select("sample").distinct(), "sample", "left_semi")
    return asked.groupBy("sample").agg(F.collect_list(F.struct("gene", "v")).alias("l"))


def _ordered(l: Column, sign: int) -> Column:
    """The list by value (sign -1: downwards), then gene."""
    return F.array_sort(F.transform(l, lambda x: F.struct((sign * x["v"]).alias("k"), x["gene"].alias("gene"), x["v"].alias("v"))))


def _result(df: DataFrame, gates: list[tuple[Column, str]], answer: Column) -> DataFrame:
    reason = F.coalesce(*(F.when(F.coalesce(bad, F.lit(True)), F.lit(name)) for bad, name in gates), F.lit(None).cast("string"))
    r = df.withColumn("reason", reason)
    return r.select("row", F.when(F.col("reason").isNull(), "ok").otherwise("insufficient_data").alias("status"), "reason", F.when(F.col("reason").isNull(), answer).alias("answer"))


def _known(requests: DataFrame, ctx: dict[str, DataFrame]) -> DataFrame:
    """Requests with `known` (the sample exists) and its DE row's figures."""
    return requests.join(ctx["samples"], "sample", "left").withColumn("known", F.col("sample_index").isNotNull())


def _unknown() -> tuple[Column, str]:
    return ~F.col("known"), "unknown_sample"


def _no_de() -> tuple[Column, str]:
    return F.col("de_status") != "ok", "de_unavailable"


@question("direct_abundance_query")
def direct_abundance(requests: DataFrame, ctx: dict[str, DataFrame]) -> DataFrame:
    """The value of a gene in the sample; several columns of one symbol are averaged."""
    r = _known(requests, ctx).join(_levels(ctx), ["sample", "gene"], "left")
    return _result(r, [_unknown(), (F.col("gene").isNull(), "no_gene"), (F.col("v").isNull(), "gene_not_in_matrix")], F.format_string("%.4f", F.col("v")))


@question("threshold_query")
def threshold(requests: DataFrame, ctx: dict[str, DataFrame]) -> DataFrame:
    """Genes strictly beyond the threshold on the side asked for, farthest first: "matching of universe: genes", with a
    mark where none or all match (degenerate)."""
    r = _known(requests, ctx).join(_lists(requests, ctx), "sample", "left").withColumn("d", direction(F.col("direction")))
    t = F.col("threshold")
    hits = F.when(F.col("d") == "up", _ordered(F.filter("l", lambda x: x["v"] > t), -1)).otherwise(_ordered(F.filter("l", lambda x: x["v"] < t), 1))
    r = r.withColumn("hits", hits)
    n, all_ = F.size("hits"), F.size("l")
    said = F.concat(n.cast("string"), F.lit(" of "), all_.cast("string"), F.lit(": "), F.array_join(F.col("hits.gene"), ","), F.when((n == 0) | (n == all_), "*").otherwise(""))
    finite = t.isNotNull() & ~F.isnan(t) & (F.abs(t) < float("inf"))
    return _result(r, [_unknown(), (F.col("d").isNull(), "bad_direction"), (~finite, "bad_threshold"), (F.col("l").isNull(), "not_in_matrix")], said)


@question("ranking_ordering_query")
def ranking(requests: DataFrame, ctx: dict[str, DataFrame]) -> DataFrame:
    """The first n genes of the sample from the top or the bottom, ties by gene, with a mark where the next one ties.

    n is a count, a percentage or a fraction of the sample's genes; without a usable one there is no answer."""
    r = _known(requests, ctx).join(_lists(requests, ctx), "sample", "left").withColumn("d", direction(F.col("direction")))
    r = r.withColumn("k", size_spec(F.col("n"), F.size("l"))).withColumn("o", F.when(F.col("d") == "up", _ordered(F.col("l"), -1)).otherwise(_ordered(F.col("l"), 1)))
    tie = F.when(F.get(F.col("o.v"), F.col("k") - 1) == F.get(F.col("o.v"), F.col("k")), "*").otherwise("")
    gates = [_unknown(), (F.col("d").isNull(), "bad_direction"), (F.col("l").isNull(), "not_in_matrix"), (F.col("k").isNull(), "bad_size")]
    return _result(r, gates, F.concat(F.array_join(F.slice(F.col("o.gene"), 1, F.greatest("k", F.lit(1))), ","), tie))


@question("comparative_query")
def comparative(requests: DataFrame, ctx: dict[str, DataFrame]) -> DataFrame:
    """Two genes of the sample: the higher one or "equal", the difference and the log2 fold change of the first against
    the second."""
    v = _levels(ctx)
    r = _known(requests, ctx).join(v, ["sample", "gene"], "left")
    r = r.join(v.select("sample", F.col("gene").alias("gene_b"), F.col("v").alias("w")), ["sample", "gene_b"], "left")
    higher = F.when(F.col("v") > F.col("w"), F.col("gene")).when(F.col("w") > F.col("v"), F.col("gene_b")).otherwise("equal")
    said = F.concat(higher, F.lit(" "), F.format_string("%.4f", F.abs(F.col("v") - F.col("w"))), F.lit(" "), F.format_string("%.4f", (F.col("v") - F.col("w")) / F.log(F.lit(2.0))))
    return _result(r, [_unknown(), (F.col("v").isNull(), "gene_not_in_matrix"), (F.col("w").isNull(), "second_gene_not_in_matrix")], said)


#: Partners a gene has in the graph.
PARTNERS = 100


def best_partners(edges: DataFrame) -> DataFrame:
    """(gene, partner, place): the PARTNERS best partners of each gene by usable correlation, then name, ranked afresh."""
    r = F.col("pearson_r").cast("double")
    ok = edges.where("gene is not null and partner is not null and gene <> partner").where(r.isNotNull() & ~F.isnan(r) & r.between(-1, 1))
    pairs = ok.groupBy("gene", "partner").agg(F.max(r).alias("r"))
    return pairs.withColumn("place", F.row_number().over(Window.partitionBy("gene").orderBy(F.desc("r"), "partner"))).where(F.col("place") <= PARTNERS)


@question("interaction_network_query")
def network(requests: DataFrame, ctx: dict[str, DataFrame]) -> DataFrame:
    """The gene's n best partners in the order of the graph, with their values in the sample (na: it has none).

    n is an integer of at most the gene's partners; without it there is no answer."""
    asked = requests.where("gene is not null").select("gene").distinct()
    partners = best_partners(ctx["edges"].join(asked, "gene", "left_semi"))
    graph = partners.groupBy("gene").agg(F.array_sort(F.collect_list(F.struct("place", "partner"))).alias("p"))  # at most PARTNERS
    r = _known(requests, ctx).join(graph, "gene", "left").withColumn("k", strict_integer(F.col("n"), 1, F.size("p")))
    near = r.where("k is not null").select("row", "sample", F.explode(F.slice("p", 1, F.col("k"))).alias("x")).select("row", "sample", "x.place", F.col("x.partner").alias("gene"))
    got = near.join(_levels(ctx), ["sample", "gene"], "left").groupBy("row").agg(
        F.array_sort(F.collect_list(F.struct("place", F.concat("gene", F.lit("="), F.when(F.col("v").isNotNull(), F.format_string("%.4f", F.col("v"))).otherwise("na")).alias("t")))).alias("l"), F.count("v").alias("found")
    )
    r = r.join(got, "row", "left")
    return _result(r, [_unknown(), (F.col("p").isNull(), "gene_not_in_graph"), (F.col("k").isNull(), "bad_size"), (F.coalesce("found", F.lit(0)) == 0, "no_partner_in_sample")], F.array_join(F.col("l.t"), ","))


@question("disease_subtype_classification")
def subtype(requests: DataFrame, ctx: dict[str, DataFrame]) -> DataFrame:
    return _result(_known(requests, ctx), [_unknown(), (F.col("subtype").isNull(), "no_label"), (F.col("subtype") == "", "outside_pool")], F.col("subtype"))


@question("comparative_differential_reasoning")
def differential(requests: DataFrame, ctx: dict[str, DataFrame]) -> DataFrame:
    """The first n raised or lowered genes of the sample."""
    r = _known(requests, ctx).withColumn("d", direction(F.col("direction"))).withColumn("k", size_spec(F.col("n"), F.lit(100)))
    names = F.when(F.col("d") == "up", F.col("up")).otherwise(F.col("down"))
    return _result(r, [_unknown(), (F.col("d").isNull(), "bad_direction"), (F.col("k").isNull(), "bad_size"), _no_de(), (names.isNull() | (F.size(names) == 0), "nothing_passes")], F.array_join(F.slice(names, 1, F.greatest("k", F.lit(1))), ","))


@question("gene_driver_reasoning")
def drivers(requests: DataFrame, ctx: dict[str, DataFrame]) -> DataFrame:
    """The n genes of a diseased sample that deviate most, with their z: raised (up), lowered (down) or either way (both,
    abs) by |z|, ties by gene. Genes without a z are left out, never imputed."""
    r = _known(requests, ctx).join(_lists(requests, ctx), "sample", "left").withColumn("d", F.lower(F.trim("direction"))).withColumn("k", strict_integer(F.col("n"), 1, 100))
    either = F.array_sort(F.transform("l", lambda x: F.struct((-F.abs(x["v"])).alias("k"), x["gene"].alias("gene"), x["v"].alias("v"))))
    o = F.when(F.col("d") == "up", _ordered(F.filter("l", lambda x: x["v"] > 0), -1)).when(F.col("d") == "down", _ordered(F.filter("l", lambda x: x["v"] < 0), 1)).otherwise(either)
    r = r.withColumn("o", o)
    gates = [_unknown(), (~F.col("diseased"), "not_diseased"), _no_de(), (F.col("k").isNull(), "bad_size"), (~F.col("d").isin("up", "down", "both", "abs"), "bad_direction"), (F.coalesce(F.size("o"), F.lit(-1)) <= 0, "nothing_computable")]
    said = F.transform(F.slice("o", 1, F.greatest("k", F.lit(1))), lambda x: F.concat(x["gene"], F.lit(" "), F.format_string("%.3f", x["v"])))
    return _result(r, gates, F.array_join(said, ","))


@question("magnitude_reasoning")
def magnitude(requests: DataFrame, ctx: dict[str, DataFrame]) -> DataFrame:
    return _result(_known(requests, ctx), [_unknown(), _no_de()], F.concat(F.col("bucket"), F.lit(" "), F.col("n_gt2").cast("string")))


def context(de: DataFrame, labels: DataFrame, edges: DataFrame) -> dict[str, DataFrame]:
    """samples (one row per accession), values (gene levels of the listed genes) and edges, as the questions use them."""
    sample = F.upper(F.trim("geo_accession"))
    one = de.where("geo_accession is not null").withColumn("sample", sample)
    one = one.groupBy("sample").agg(F.min_by(F.struct("sample_index", F.col("status").alias("de_status"), F.col("top_up_genes").alias("up"), F.col("top_down_genes").alias("down"), F.col("top_up_z").alias("uz"), F.col("top_down_z").alias("dz"), F.col("magnitude_bucket").alias("bucket"), F.col("n_genes_abs_z_gt2").alias("n_gt2")), "sample_index").alias("r")).select("sample", "r.*")
    lab = labels.groupBy("sample_index").agg(F.min("cvd_subtype").alias("subtype"), F.bool_or("is_cvd_disease").alias("diseased"))
    samples = one.join(lab, "sample_index", "left")
    z = lambda g, v: one.select("sample", F.explode(F.arrays_zip(F.col(g).alias("g"), F.col(v).alias("v"))).alias("p")).select("sample", F.col("p.g").alias("gene"), F.col("p.v").cast("double").alias("v"))
    values = z("up", "uz").unionByName(z("down", "dz")).where("v is not null and not isnan(v)")
    return {"samples": samples.drop("uz", "dz"), "values": values, "edges": edges.select("gene", "partner", "pearson_r")}


def answer(requests: DataFrame, ctx: dict[str, DataFrame], categories: list[str] | None = None) -> DataFrame:
    """(row, category, status, reason, answer) of all requests; a category without a function is refused."""
    out = None
    names = categories or sorted(REGISTRY)
    for c in names:
        part = REGISTRY[c](requests.where(F.col("category") == c), ctx).withColumn("category", F.lit(c))
        out = part if out is None else out.unionByName(part)
    other = requests.where(~F.col("category").isin(names) | F.col("category").isNull())
    refused = other.select("row", F.lit("insufficient_data").alias("status"), F.lit("unknown_category").alias("reason"), F.lit(None).cast("string").alias("answer"), "category")
    return out.unionByName(refused)

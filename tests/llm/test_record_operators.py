"""Problems 1, 2, 3, 6 and 9 on small fixtures and against brute force."""

import random
from collections import defaultdict
from datetime import datetime

import pytest

from sampleloom.llm import cross_split, mixing, split_groups, target_sample, top_items

# 2 ----------------------------------------------------------------------------------------------------------------


def test_loser_tree_merges():
    rng = random.Random(1)
    for k in (1, 2, 3, 7, 16):
        runs = [sorted(rng.randrange(50) for _ in range(rng.randrange(9))) for _ in range(k)]
        at = [0] * k
        tree = top_items.LoserTree([r[0] if r else None for r in runs])
        out = []
        while (key := tree.keys[tree.winner]) is not None:
            out.append(key)
            w = tree.winner
            at[w] += 1
            tree.replace(runs[w][at[w]] if at[w] < len(runs[w]) else None)
        assert out == sorted(x for r in runs for x in r)


@pytest.mark.parametrize("parts, chunk", [(1, 100_000), (5, 100_000), (5, 7)])
def test_top_items_against_brute_force(spark, monkeypatch, parts, chunk):
    monkeypatch.setattr(top_items, "CHUNK_ROWS", chunk)
    rng = random.Random(parts)
    rows = [("hot" if rng.random() < 0.4 else f"g{rng.randrange(40)}", f"p{rng.randrange(60)}", rng.choice([None, float("nan"), 2.0, -0.0, 0.0, *(rng.randrange(-9, 10) / 10 for _ in range(6))])) for _ in range(4000)]
    rows += [(None, "p1", 0.5), ("g1", None, 0.5), ("g1", "g1", 0.9), ("only", "p1", None)]
    df = spark.createDataFrame(rows, "gene string, partner string, r double").repartition(parts).selectExpr("*", "1 as g", "2 as i", "'x' as run", "7 as rank")
    got = {(r["gene"], r["rank"]): (r["partner"], r["r"]) for r in top_items.top_items(df, "gene", "partner", "r", 5, (-1.0, 1.0), skip_self=True).collect()}
    best: dict = defaultdict(dict)
    for g, p, r in rows:
        if g is not None and p is not None and g != p and r is not None and r == r and -1 <= r <= 1:
            best[g][p] = max(best[g].get(p, -9), r)
    want = {(g, k): pair for g, ps in best.items() for k, pair in enumerate(sorted(ps.items(), key=lambda x: (-x[1], x[0]))[:5], 1)}
    assert got == want
    assert top_items.top_items(df.limit(0), "gene", "partner", "r").count() == 0


# 1 ----------------------------------------------------------------------------------------------------------------

SAMPLES = "sample_index long, geo_accession string, series_id string"
LABELS = "sample_index long, patient_key string, has_resolved_patient boolean"


def test_series_groups(spark):
    samples = [(1, "A1", "gse1, GSE2"), (2, "A2", "GSE3 "), (3, " a2\t", "GSE4"), (4, "A4", "GSE5"), (5, "A5", "GSE1"), (6, None, None), (7, "A7", "GSE6"), (8, "A7", None), (None, "A4", "GSE9"), (5, "A5", "gse1")]
    labels = [(4, "P1", True), (5, " p1", True), (7, "P1", False), (2, None, True), (6, "P1", True), (99, "P1", True)]
    got = dict(map(tuple, split_groups.series_groups(spark.createDataFrame(samples, SAMPLES), spark.createDataFrame(labels, LABELS)).collect()))
    assert got == {"GSE1": "GSE1", "GSE2": "GSE1", "GSE5": "GSE1", "GSE3": "GSE3", "GSE4": "GSE3"}
    empty = split_groups.series_groups(spark.createDataFrame([], SAMPLES), spark.createDataFrame([], LABELS))
    assert empty.count() == 0


def test_components_of_a_long_chain(spark):
    n = 200
    edges = spark.createDataFrame([(f"k{i:03d}", f"k{i + 1:03d}") for i in range(n)] + [("z1", "z2"), (None, "z1"), ("z9", "z9")], "a string, b string")
    roots = {r["node"]: r["root"] for r in split_groups.hash_to_min(edges).collect()}
    assert len(roots) == n + 3 and {roots[k] for k in roots if k[0] == "k"} == {"k000"} and roots["z2"] == "z1"


def test_components_of_a_large_star(spark):
    """The root's cluster is large enough to be joined apart."""
    star = spark.range(1, 12_001).selectExpr("'k00000' as a", "concat('k', lpad(id, 5, '0')) as b")
    edges = star.unionByName(spark.createDataFrame([("z1", "z2"), ("z2", "z3"), ("z1", "z2")], "a string, b string"))
    roots = split_groups.hash_to_min(edges).groupBy("root").count().collect()
    assert {r["root"]: r["count"] for r in roots} == {"k00000": 12_001, "z1": 3}


def test_splits_keep_ties_and_shares(spark):
    samples = [(k, f"A{k}", f"GSE{k // 3}") for k in range(3000)] + [(5000, "A1", None), (5001, None, None)]
    labels = [(k, f"P{k // 6}", True) for k in range(600)]
    targets = spark.createDataFrame([("train", 0.8), ("validation", 0.1), ("test", 0.1), ("none", 0.0), (None, 0.5)], "split string, share double")
    rows = split_groups.assign_splits(spark.createDataFrame(samples, SAMPLES), spark.createDataFrame(labels, LABELS), targets).collect()
    by = {r["sample_index"]: r["split"] for r in rows}
    assert len(rows) == len(by) == 3002 and by[5000] == by[1]
    assert all(len({by[k] for k in range(s, s + 3)}) == 1 for s in range(0, 3000, 3)) and all(len({by[k] for k in range(s, s + 6)}) == 1 for s in range(0, 600, 6))
    share = sum(v == "train" for v in by.values()) / len(by)
    assert set(by.values()) == {"train", "validation", "test"} and 0.75 < share < 0.85


# 3 ----------------------------------------------------------------------------------------------------------------

DE = "sample_index long, geo_accession string, series_id string, in_holdout boolean, status string, top_up_genes array<string>, top_down_genes array<string>, top_up_z array<float>, top_down_z array<float>, ingested_at timestamp"


def _near(x, y):
    a = {("+", g): z for g, z in zip(x[5] or [], x[7] or [])} | {("-", g): z for g, z in zip(x[6] or [], x[8] or [])}
    b = {("+", g): z for g, z in zip(y[5] or [], y[7] or [])} | {("-", g): z for g, z in zip(y[6] or [], y[8] or [])}
    both = a.keys() & b.keys()
    return bool(both) and len(both) >= 0.8 * len(a.keys() | b.keys()) - 1e-9 and all(a[t] is not None and b[t] is not None and abs(a[t] - b[t]) < 0.05 * max(abs(a[t]), abs(b[t])) for t in both)


def test_cross_split_against_brute_force(spark):
    import numpy as np

    f32 = lambda v: float(np.float32(v))
    rng = random.Random(3)
    genes = [f"G{k}" for k in range(30)]
    rows = []
    for k in range(160):
        if rows and rng.random() < 0.6:
            base = rng.choice(rows)
            up, down, uz, dz = list(base[5] or []), list(base[6] or []), list(base[7] or []), list(base[8] or [])
            if up and rng.random() < 0.5:
                p = rng.randrange(len(up))
                up[p] = rng.choice([g for g in genes if g not in up])
            uz = [None if z is None else f32(z * rng.uniform(0.96, 1.04) if rng.random() < 0.8 else z * 1.3) for z in uz]
        else:
            up, down = rng.sample(genes, rng.choice([0, 1, 4, 8])), rng.sample(genes, rng.choice([0, 1, 5, 8]))
            uz, dz = [f32(rng.uniform(0.5, 9)) for _ in up], [f32(-rng.uniform(0.5, 9)) for _ in down]
            if uz and rng.random() < 0.1:
                uz[0] = None
        status = "ok" if rng.random() < 0.9 else "insufficient_data"
        rows.append((k, f"A{k if rng.random() < 0.9 else k // 2}", "S1", rng.choice([True, False, False, None]), status, up or None, down or None, uz or None, dz or None, datetime(2025, 1, 1)))
    df = spark.createDataFrame(rows + rows[:20], DE).selectExpr("*", "1 as key", "2 as n", "3 as a", "4 as tokens")
    got = {tuple(r) for r in cross_split.sample_pairs(df).collect()}
    want = set()
    for x in rows:
        for y in rows:
            if x[3] is True and y[3] is False and (x[1] == y[1] or (x[4] == y[4] == "ok" and _near(x, y))):
                want.add((min(x[0], y[0]), max(x[0], y[0])))
    assert got == want and len(want) > 5
    assert cross_split.sample_pairs(df.limit(0)).count() == 0
    assert cross_split.overlap_report(df).count() >= 1


# 6 ----------------------------------------------------------------------------------------------------------------

PLAN = "batch_id long, tissue_coarse string, patient string, template_index int"
TARGET = "batch_id long, tissue_coarse string, target_share double, draw_size int, target int, min_rows int"


def test_draw(spark):
    plan = [(1, " Heart." if k % 2 else "heart", f"p{k}", 0) for k in range(200)] + [(1, "lung", f"p{k}", 1) for k in range(5)] + [(1, "skin", "p1", 0)] * 9
    plan += [(1, "heart", None, 0), (None, "heart", "p", 0), (1, None, "p", 0), (1, "heart", "p", None), (1, "other", "p", 0), (2, "heart", "p0", 0)]
    targets = [(1, "heart", 0.5, 40, 20, 2), (1, "lung", 0.3, 40, 12, 2), (1, "skin", 0.1, 40, 4, 3), (1, "liver", 0.1, 40, 4, 0), (2, "heart", 1.0, 1, 1, 0), (3, "heart", None, None, None, None)]
    p, t = spark.createDataFrame(plan, PLAN).selectExpr("*", "1 as h", "2 as cat"), spark.createDataFrame(targets, TARGET)
    args = (p, t, "batch_id", "tissue_coarse", ["patient", "template_index"])
    report = {(r["batch_id"], r["tissue_coarse"]): r for r in target_sample.draw_report(*args).collect()}
    assert {k: (r["available"], r["shortfall"], r["drawn"]) for k, r in report.items()} == {(1, "heart"): (201, 0, 34), (1, "lung"): (5, 7, 5), (1, "skin"): (1, 3, 1), (1, "liver"): (0, 4, 0), (2, "heart"): (1, 0, 1), (3, "heart"): (0, 0, 0)}
    drawn = target_sample.draw(*args).collect()
    assert len({(r["batch_id"], r["tissue_coarse"], r["patient"], r["template_index"]) for r in drawn}) == len(drawn) == 41
    assert target_sample.draw(p.limit(0), *args[1:]).count() == 0 and target_sample.draw_report(p, t.limit(0), *args[2:]).count() == 0


def test_seats_against_brute_force():
    rng = random.Random(3)
    for _ in range(400):
        kinds = [(f"c{k}", rng.randrange(12), rng.choice([0, 1, 1, 2, 3, 5, 8]), rng.randrange(4)) for k in range(rng.randrange(1, 7))]
        size = rng.randrange(40)
        order = sorted((-1.0 if r <= f else (r - 0.5) / t, r, c) for c, a, t, f in kinds for r in range(1, a + 1) if r <= f or t > 0)[:size]
        assert target_sample.seats(kinds, size) == {c: sum(x[2] == c for x in order) for c, *_ in kinds}, (kinds, size)
    assert target_sample.seats([("a", 10**12, 7, 0), ("b", 10**12, 3, 5)], 10**9) == {"a": 7 * 10**8, "b": 3 * 10**8}


def test_draw_follows_targets_when_supply_is_ample(spark):
    plan = [(1, c, f"p{k}", 0) for c in ("a", "b", "c") for k in range(9000)]
    targets = [(1, "a", 0.6, 1000, 600, 1), (1, "b", 0.3, 1000, 300, 1), (1, "c", 0.1, 1000, 100, 1)]
    r = target_sample.draw_report(spark.createDataFrame(plan, PLAN), spark.createDataFrame(targets, TARGET), "batch_id", "tissue_coarse", ["patient", "template_index"]).collect()
    assert {x["tissue_coarse"]: x["drawn"] for x in r} == {"a": 600, "b": 300, "c": 100}


# 9 ----------------------------------------------------------------------------------------------------------------


def test_mixing(spark):
    docs = [(k, " Big" if k % 2 else "big", 10) for k in range(9000)] + [(10_000 + k, "small", 10) for k in range(100)] + [(20_000, "small", None), (20_001, None, 1000), (20_002, "BIG", -5)]
    mixes = [(1, "big", 0.5, 1), (1, "Small ", 0.5, 3), (2, "small", 0.025, 5), (2, "none", 0.1, 5), (3, "big", None, 2), (None, "big", 0.3, 1)]
    d = spark.createDataFrame(docs, "doc_id long, source string, n_tokens long").selectExpr("*", "1 as h", "2 as weight", "3 as src")
    m = spark.createDataFrame(mixes, "mix_id int, source string, target_weight double, max_repeat int")
    shares = {(r["mix_id"], r["source"]): r for r in mixing.mix_shares(d, m).collect()}
    total = 9000 * 10 + 1000 + 1000
    assert abs(shares[1, "big"]["used"] - 0.5 * total) <= 10 and shares[1, "small"]["used"] == 3000 and abs(shares[2, "small"]["used"] - 0.025 * total) <= 10
    assert {k for k, r in shares.items() if r["short"]} == {(1, "small"), (2, "none")} and shares[3, "big"]["used"] == 0
    rows = mixing.mix_selection(d, m).collect()
    assert max(r["times"] for r in rows if r["mix_id"] == 1) == 3 and len({(r["mix_id"], r["doc_id"]) for r in rows}) == len(rows)
    assert mixing.mix_shares(d.limit(0), m).where("used > 0").count() == 0 and mixing.mix_selection(d, m.limit(0)).count() == 0

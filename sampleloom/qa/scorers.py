"""Scorers of answers behind one interface: a name -> function (answer, truth) -> score, as columns; Arrow-batched models
fit in as pandas UDFs."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sampleloom.functions import answers as an

#: Name -> scorer.
SCORERS: dict[str, Callable[[Column, Column], Column]] = {}


def scorer(name: str):
    def add(f):
        if name in SCORERS:
            raise ValueError(f"two scorers named {name}")
        SCORERS[name] = f
        return f

    return add


@scorer("exact")
def exact(answer: Column, truth: Column) -> Column:
    return (an.normalise(answer) == an.normalise(truth)).cast("double")


@scorer("overlap")
def overlap(answer: Column, truth: Column) -> Column:
    """Common words over all words of either."""
    a, t = (F.array_distinct(F.split(an.normalise(c), " ")) for c in (answer, truth))
    return F.size(F.array_intersect(a, t)) / F.size(F.array_union(a, t))


@scorer("symbols")
def symbols(answer: Column, truth: Column) -> Column:
    """The share of the truth's symbols that the answer names."""
    return an.recall(an.symbols(answer), an.symbols(truth))


def scored(df: DataFrame, key: str, answer: str, truth: str, names: list[str] | None = None) -> DataFrame:
    """(key, scorer, score) by each of the named scorers (all by default)."""
    pairs = F.array(*(F.struct(F.lit(n).alias("scorer"), SCORERS[n](F.col(answer), F.col(truth)).alias("score")) for n in names or sorted(SCORERS)))
    return df.select(key, F.explode(pairs).alias("p")).select(key, "p.*")

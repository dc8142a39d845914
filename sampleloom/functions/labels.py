"""Weak labels from free text: keyword nets, categories by priority, patient identifiers, tissues, dates."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What stands for no patient identifier.
PLACEHOLDERS = ["", "na", "n/a", "none", "null", "unknown", "not available", "not provided", "not applicable", "--", "-", "?"]


def haystack(*columns: Column, separator: str = " || ") -> Column:
    """The columns in lower case, joined; nulls as empty texts."""
    return F.lower(F.concat_ws(separator, *(F.coalesce(c, F.lit("")) for c in columns)))


def net(text: Column, keywords: list[str]) -> Column:
    """Whether any keyword is in the (lower-case) text; one scan for all of them."""
    return F.rlike(text, F.lit("|".join(re.escape(k.lower()) for k in keywords)))


def first_category(text: Column, nets: dict[str, list[str]], default: str) -> Column:
    """The first category, in the given order, whose net hits."""
    return F.coalesce(*(F.when(net(text, k), F.lit(c)) for c, k in nets.items()), F.lit(default))


def all_categories(text: Column, nets: dict[str, list[str]]) -> Column:
    """Every category whose net hits, in the given order."""
    return F.filter(F.array(*(F.when(net(text, k), F.lit(c)) for c, k in nets.items())), lambda x: x.isNotNull())


def gated(gate: Column, value: Column, outside: str = "") -> Column:
    """The value inside the gate, a fixed one outside."""
    return F.when(F.coalesce(gate, F.lit(False)), value).otherwise(F.lit(outside))


def patient_id(text: Column, keys: list[str]) -> Column:
    """The value of the first "key: value" field among keys, in lower case; null for none or a placeholder."""
    names = "|".join(re.escape(k) for k in keys)
    value = F.trim(F.lower(F.regexp_extract(text, rf"(?i)(?:^|[,;\n])\s*(?:{names})\s*[:=]\s*([^,;\n]*)", 1)))
    return F.when(~value.isin(PLACEHOLDERS), value)


def patient_key(series: Column, patient: Column, accession: Column) -> Column:
    """series::patient, or a key of its own for a sample without a known patient."""
    return F.coalesce(F.concat(series, F.lit("::"), patient), F.concat(F.lit("__unresolved__::"), accession))


def coarse(text: Column, rules: list[tuple[str, str]], other: str = "other", blank: str = "unspecified") -> Column:
    """The first rule (pattern, name) that matches a normalised text."""
    out = F.when(F.coalesce(text, F.lit("")) == "", F.lit(blank))
    for pattern, name in rules:
        out = out.when(F.rlike(text, F.lit(pattern)), F.lit(name))
    return out.otherwise(F.lit(other))


def lenient_year(text: Column, formats: tuple[str, ...] = ("yyyy-MM-dd", "MMM dd yyyy", "yyyy/MM/dd", "yyyy")) -> Column:
    """The year of a date in one of several formats; -1 where none fits."""
    return F.coalesce(*(F.year(F.try_to_timestamp(text, F.lit(f))) for f in formats), F.lit(-1))

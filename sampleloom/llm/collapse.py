"""Duplicates hidden by formatting differences.

Byte-identical raw rows collapse first (map-side, with their counts), only the distinct survivors are canonicalised, and
these are grouped again on the full canonical text, summing the counts. The survivors are written to the shared folder
once, with their digests, so nothing is grouped or canonicalised twice. Lines get their record by digests of the raw
text; copies of one hot text are split by the loads that the survivors' counts tell (fragment_replicate_join).

Canonical text: lower case, only letters, marks and digits, a decimal point between digits and a minus directly before a
digit. A text made of "name: value" fields has its fields sorted: after the name stands a colon, an equals sign or a
dash between blanks, and between fields any of ; | , / or a line break that a name follows. Null counts as an empty text; rows
whose texts are all empty are one record like any other. Other columns are ignored, names may clash with ours.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sampleloom.operators.skew import fragment_replicate_join, plan_load
from sampleloom.session import cut

_DROP = r"[^\p{L}\p{M}\p{N}.\-]+|(?<![0-9])\.|\.(?![0-9])|-(?![0-9])"
_MARK = r"(?:[:=]|[\s\x{A0}][-\x{2013}\x{2014}][\s\x{A0}])"
_NAMED = r"[^\p{L}\p{N};|,/\r\n]*\p{L}[\p{L}\p{N}_ \t\x{A0}]*" + _MARK
_NEXT_FIELD = rf"[;|,/\r\n]+({_NAMED})"


def canonical_text(c: Column) -> Column:
    """Lower case without blanks and punctuation; '' for null."""
    return F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), _DROP, "")


def canonical_fields(c: Column) -> Column:
    """As canonical_text; a text made of two or more "name: value" fields has them sorted."""
    parts = F.split(F.regexp_replace(c, _NEXT_FIELD, "\u0002$1"), "\u0002")
    fields = (F.size(parts) >= 2) & F.rlike(c, F.lit(rf"^[\s;|,/]*{_NAMED}"))
    ordered = F.when(fields, F.array_join(F.array_sort(F.filter(F.transform(parts, canonical_text), lambda x: x != "")), "\u0001"))
    # fields need two marks, so plain sentences skip the splitting
    return F.when(F.rlike(c, F.lit(f"(?s){_MARK}.*{_MARK}")), F.coalesce(ordered, canonical_text(c))).otherwise(canonical_text(c))


def _digest(*cols: Column) -> Column:
    """16 bytes for the raw texts; null and '' differ, and no two rows of texts run into each other."""
    sized = [F.coalesce(F.concat(F.length(c).cast("string"), F.lit(":"), c), F.lit("-")) for c in cols]
    return F.substring(F.unhex(F.sha2(F.concat_ws("|", *sized), 256)), 1, 16)


def collapse_formatting(df: DataFrame, line: str, texts: list[str], field_texts: list[str] = ()) -> tuple[DataFrame, DataFrame]:
    """(records, members). records: first line, copies, variants and a digest of each record; members: line and first line
    of every line whose record has two lines or more. `field_texts` are the texts whose field order doesn't matter."""
    rows = df.select(F.col(line).alias("line"), *(F.col(t).cast("string").alias(f"t{k}") for k, t in enumerate(texts)))
    cols = [f"t{k}" for k in range(len(texts))]
    raw = rows.groupBy(*cols).agg(F.count("*").alias("n"), F.min("line").alias("low"))
    full = [f"c{k}" for k in range(len(texts))]
    canon = [(canonical_fields if t in field_texts else canonical_text)(F.col(f"t{k}")).alias(f"c{k}") for k, t in enumerate(texts)]
    survivors = raw.select(_digest(*map(F.col, cols)).alias("raw"), "n", "low", *canon)
    survivors = cut(survivors.withColumn("record", _digest(*map(F.col, full))))
    records = survivors.groupBy(*full).agg(F.sum("n").alias("copies"), F.count("*").alias("variants"), F.min("low").alias("first_line"), F.first("record").alias("record"))
    records = records.select("first_line", "copies", "variants", "record")
    several = records.where("copies > 1").select("record", "first_line")
    ours = survivors.select("raw", "n", "low", "record")  # digests only
    found = fragment_replicate_join(ours, several, "record")
    alone = found.where("n = 1").select(F.col("low").alias("line"), "first_line")
    lines = rows.select("line", _digest(*map(F.col, cols)).alias("raw"))
    hot = plan_load(ours.where("n > 1"), ["raw"], weight="n")
    copied = fragment_replicate_join(lines, found.where("n > 1").select("raw", "first_line"), "raw", plan=hot)
    members = alone.unionByName(copied.select("line", "first_line"))
    return records, members

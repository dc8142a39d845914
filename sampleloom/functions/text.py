"""Text expressions shared by the operators; all of them stay inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Blanks of any kind, for trimming: white space, Unicode separators and invisible marks.
BLANK = r"[\s\p{Z}\x{200B}-\x{200D}\x{2060}\x{FEFF}\x{AD}]"


def strip(c: Column) -> Column:
    """Without outer blanks of any kind (Spark's trim takes spaces only)."""
    return F.regexp_replace(c, rf"^{BLANK}+|{BLANK}+$", "")


def clean_upper(c: Column) -> Column:
    """Upper case without outer blanks; null where nothing is left."""
    return F.nullif(F.upper(strip(c)), F.lit(""))


def clean_lower(c: Column) -> Column:
    """Lower case without outer blanks; null where nothing is left."""
    return F.nullif(F.lower(strip(c)), F.lit(""))


def name_list(c: Column) -> Column:
    """The names in a cell that may hold several, in upper case, without repeats; empty array for null.

    Separators are blanks, commas, semicolons, bars, slashes, plus and ampersand, in any number.
    """
    parts = F.split(F.upper(F.coalesce(c, F.lit(""))), rf"(?:{BLANK}|[,;|/+&])+")
    return F.array_distinct(F.filter(parts, lambda x: x != ""))


def simple_words(c: Column) -> Column:
    """Lower case with every run of other characters than a-z and 0-9 as one blank, trimmed."""
    return F.trim(F.regexp_replace(F.lower(c), "[^a-z0-9]+", " "))

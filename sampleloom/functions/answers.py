"""Answer texts: templates, rendering, polarity, factual checks, benchmark normalisers."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

def fill(template: Column, values: dict[str, Column]) -> Column:
    """The template with {name} replaced by each value."""
    out = template
    for name, v in values.items():
        out = F.replace(out, F.lit("{" + name + "}"), F.coalesce(v.cast("string"), F.lit("")))
    return out


def capped_z(z: Column, cap: float = 50.0) -> Column:
    """A z-score as text, values beyond the cap as "> cap"."""
    return F.when(z > cap, F.lit(f"> {cap:g}")).when(z < -cap, F.lit(f"< -{cap:g}")).otherwise(F.format_string("%.2f", z))


def named_values(names: Column, values: Column, digits: int = 3) -> Column:
    """"A (1.000), B (2.000)" of two arrays."""
    pair = F.zip_with(names, values, lambda n, v: F.concat(n, F.lit(" ("), F.format_string(f"%.{digits}f", v.cast("double")), F.lit(")")))
    return F.array_join(pair, ", ")


def symbols(text: Column, stop: tuple[str, ...] = ("DNA", "RNA", "TPM", "CVD", "GSM")) -> Column:
    """Upper-case tokens of letters and digits that look like gene symbols, each once, without stop words."""
    found = F.array_distinct(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"[A-Z][A-Z0-9]{2,14}(?:-AS[0-9])?"), F.lit(0)))
    return F.array_except(found, F.array(*map(F.lit, stop)))


def numbers(text: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"[0-9]+(?:[.][0-9]+)?"), F.lit(0)))


def recall(found: Column, wanted: Column) -> Column:
    return F.size(F.array_intersect(found, wanted)) / F.greatest(F.size(wanted), F.lit(1))


def normalise(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}. ]+", " "), r"\s+", " "))


def two_way_softmax(a: Column, b: Column) -> Column:
    """exp(a) / (exp(a) + exp(b)) without overflow."""
    m = a - b
    return F.when(m >= 0, 1 / (1 + F.exp(-m))).otherwise(F.exp(m) / (1 + F.exp(m)))


def anls(answer: Column, truth: Column) -> Column:
    """1 - edit distance / longer length, 0 below 0.5."""
    x, y = F.lower(F.trim(answer)), F.lower(F.trim(truth))
    s = 1 - F.levenshtein(x, y) / F.greatest(F.length(x), F.length(y), F.lit(1))
    return F.when(s >= 0.5, s).otherwise(F.lit(0.0))


def yes_no(text: Column) -> Column:
    """yes unless the first sentence has the word no or not."""
    words = F.split(F.regexp_replace(F.substring_index(F.lower(text), ".", 1), ",", ""), " ")
    return F.when(F.array_contains(words, "no") | F.array_contains(words, "not"), F.lit("no")).otherwise(F.lit("yes"))


def choice_letter(text: Column, letters: str = "ABCDE") -> Column:
    """The letter of a multiple-choice answer: alone, "X. ..." or "The answer is X."; null otherwise."""
    alone = F.when(F.rlike(F.trim(text), F.lit(f"^[{letters}]$")), F.trim(text))
    lead = F.nullif(F.regexp_extract(text, rf"^([{letters}])\. ", 1), F.lit(""))
    said = F.nullif(F.regexp_extract(text, rf"The answer is ([{letters}])\.", 1), F.lit(""))
    return F.coalesce(alone, lead, said)


#: What says that disease is absent, which a label of "not confirmed" does not support.
OVERCLAIMS = r"\b(?:healthy|disease[- ]free|free of disease|no disease|unaffected|non[- ]?diseased|normal (?:sample|profile|tissue|subject))\b"
#: Marks of a negative and of a positive statement, and the words that a negation must govern.
NEGATIVE = r"\b(?:no|not|never|without|absent|lacks?|lacking|negative for|doesn't|isn't|cannot|could not|fails? to|unconfirmed|non[- ]?confirmed)\b"
POSITIVE = r"\b(?:yes|confirm(?:s|ed|ing)?|present|positive|indicates?|shows?|carries|consistent with|evidence of|case)\b"
DISEASE = r"\b(?:cardiovascular|disease|cvd|condition|case)\b"


def overclaims(text: Column) -> Column:
    """Whether the text claims that disease is absent."""
    return F.rlike(F.lower(text), F.lit(OVERCLAIMS))


def polarity(text: Column) -> Column:
    """pos, neg or undetermined: a leading verdict, else the marks; where both kinds stand, neg if a negation is within
    60 characters of a disease term in the same sentence, and no verdict otherwise. Null and blank texts have none."""
    t = F.lower(F.trim(F.coalesce(text, F.lit(""))))
    lead = F.regexp_extract(t, r"^(yes|no|status\s*:\s*\w+|disease[- ]?(?:positive|unconfirmed))\b", 1)
    # "unconfirmed" holds no "confirmed"
    neg, pos = F.rlike(t, F.lit(NEGATIVE)), F.rlike(F.regexp_replace(t, r"\b(?:unconfirmed|non[- ]?confirmed)\b", " "), F.lit(POSITIVE))
    governed = F.rlike(t, F.lit(f"{NEGATIVE}[^.]{{0,60}}{DISEASE}|{DISEASE}[^.]{{0,60}}{NEGATIVE}"))
    return (
        F.when(F.startswith(lead, F.lit("yes")), "pos").when((lead == "no") | F.contains(lead, F.lit("unconfirmed")), "neg").when(F.rlike(lead, F.lit("positive|confirmed")), "pos")
        .when(neg & ~pos, "neg").when(pos & ~neg, "pos").when(pos & neg & governed, "neg").otherwise("undetermined")
    )


@F.pandas_udf(StructType([StructField(n, StringType()) for n in ("status", "question", "answer", "anomaly")]))
def parse_completion(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    """A model's reply "QUESTION: ... ANSWER: ...": skipped, ok, or an error with its anomaly; labels may span lines."""
    label = re.compile(r"^[\W_]*(question|answer)[\W_]*:\s*", re.I)

    def one(t: str | None) -> tuple:
        if t is None or not t.strip():
            return "error", None, None, "empty"
        if re.match(r"^\W*skip\b", t.strip(), re.I):
            return "skip", None, None, None
        parts: dict[str, list[str]] = {}
        now = None
        for line in t.splitlines():
            if m := label.match(line):
                now = m[1].lower()
                parts.setdefault(now, []).append(line[m.end() :].strip())
            elif now and line.strip():
                parts[now].append(line.strip())
        q, a = (" ".join(parts.get(k, [])).strip(" *_") for k in ("question", "answer"))
        if not q or not a:
            return "error", q or None, a or None, "missing label"
        if re.match(r"^\W*skip\b", a, re.I):
            return "skip", q, None, "skip in answer"
        return "ok", q, a, None

    for s in texts:
        yield pd.DataFrame([one(t) for t in s], columns=["status", "question", "answer", "anomaly"])


#: Number words that benchmarks compare as digits.
_NUMBERS = {"none": "0", "zero": "0", "one": "1", "two": "2", "three": "3", "four": "4", "five": "5", "six": "6", "seven": "7", "eight": "8", "nine": "9", "ten": "10"}


def vqa_normalised(text: Column) -> Column:
    """Answers as visual question benchmarks compare them: punctuation (points next to a digit stay), number words, articles."""
    plain = F.regexp_replace(F.lower(text), r"(?<![0-9])\.(?![0-9])|[;/\[\]\"{}()=+\\_<>@`,?!\n]", " ")
    number = F.create_map(*(F.lit(x) for pair in _NUMBERS.items() for x in pair))
    words = F.filter(F.split(plain, r"\s+"), lambda w: ~w.isin("", "a", "an", "the"))
    return F.array_join(F.transform(words, lambda w: F.coalesce(F.element_at(number, w), w)), " ")


def last_choice(text: Column, options: dict[str, str], key: Column) -> Column:
    """A multiple-choice letter: the last one in brackets, else the last one between blanks, else, in texts of more than five words, the option
    whose text comes last; where nothing is said, a letter by the hash of `key`. Null texts say nothing."""
    letters = "".join(sorted(options))
    t = F.concat(F.lit(" "), F.regexp_replace(F.coalesce(text, F.lit("")), "[,.!?;:']+", " "), F.lit(" "))
    last = lambda found: F.when(F.size(found) > 0, F.element_at(found, -1))
    bracket = last(F.regexp_extract_all(t, F.lit(rf"\(([{letters}])\)"), F.lit(1)))
    spaced = last(F.regexp_extract_all(t, F.lit(rf"(?<=\s)([{letters}])(?=\s)"), F.lit(1)))
    low = F.lower(t)
    ends = F.array(*(F.struct((F.length(t) - F.instr(F.reverse(low), o.lower()[::-1])).alias("p"), F.lit(c).alias("c"), F.contains(low, F.lit(o.lower())).alias("has")) for c, o in options.items()))
    content = F.when(F.size(F.split(F.trim(t), r"\s+")) > 5, F.array_max(F.filter(ends, lambda x: x["has"]))["c"])
    by_hash = F.substring(F.lit(letters), F.pmod(F.conv(F.substring(F.md5(key.cast("string")), 1, 8), 16, 10).cast("long"), F.lit(len(letters))).cast("int") + 1, F.lit(1))
    return F.coalesce(bracket, spaced, content, by_hash)

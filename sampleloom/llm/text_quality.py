"""Per-document text quality statistics, and the form of a document by combined rules.

Every document is read whole and once, in Arrow batches; nothing is shuffled. Statistics: words, mean word length, share
of symbols, of lines that end a sentence, of common words, of repeated lines, paragraphs and sentences, the largest share
of the characters that one n-gram of two to four words covers, the share in rows of cells and in list items.

Rows and items are told by the shape that lines share, whatever their length: rows have the same number of cells, items
begin with a bullet, a number or a short name and a colon. The form follows from the figures together (`form_of`):
repetition first (a text that is hardly more than one line, sentence or phrase over and over is junk, whatever its
words), then prose, table, list, junk. Prose is told by the share of common words of four languages, and for other
languages by its shape: words with vowels and even case, sentences of a usual length, few symbols; texts without blanks
between words (Chinese, Japanese, Thai) by their letters and stops.
Null texts give null figures and the form null; texts without words are junk. The texts may be of any length.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Function words of the four languages of the documents.
COMMON = frozenset(
    "the of and to in is was were are be been that this it for on with as by at from an a or not no but which who had has have than we they our all its their there could would should did does do so if when because after before between about only more one two both each whether how what makes these those into over even though"
    " der die das und den von zu mit ist im des nicht ein eine einer auf für bei war als auch es an aus wir nach oder wurde wurden bleibt um dem sich lag nur für haben fanden keinen dieser"
    " le la les des du et en un une dans pour que qui est sur par pas ne au aux été avec ce cette nous était sont plus ou se si pour ou a ont chez entre"
    " el los las del y de una no es por con del al lo como más fue fueron su ha sin se que para en esta este entre muy".split()
)
_WORD = re.compile(r"[^\W_]+")
_LETTER = re.compile(r"[^\W\d_]")
_CELL_TAG = re.compile(r"<t[rdh]\b|</?t(?:able|head|body)\b", re.I)
_ITEM = re.compile(r"[ \t]*(?:[-*+•‣▪◦·–—»o]|\(?(?:\d{1,4}|[a-zA-Z]|[ivx]{1,5})[.):]|\[[ xX]?\]|#\d+)[ \t]+\S")
_FIELD = re.compile(r"[ \t]*[^\W\d_][\w\-]*(?: [\w\-]+){0,3}[:=][ \t]*\S")
_GAP = re.compile(r" {2,}")
_PARAGRAPH = re.compile(r"\n[ \t]*\n+")
_SENTENCE = re.compile(r"[.!?…。！？؟।]+(?:\s+|$)|[。！？]|\n+")
_SEPARATED = re.compile(r"[,;|•·/\t]|(?: [-–—] )")
#: Letters of scripts that put no blanks between words.
_UNSPACED = re.compile("[฀-໿က-႟ក-៿぀-ヿ㐀-鿿]")
_SPLIT_CASE = re.compile(r"[a-zß-ÿ][A-Z]")
_VOWEL = re.compile(r"[aeiouyàáâãäåæèéêëìíîïòóôõöøùúûüýœāēīōūăąęěůűőıİ]", re.I)
_LATIN = re.compile(r"[a-zà-ÿ]", re.I)
_NAME = re.compile(r"[A-Za-z]{1,6}\d+")

NAMES = ("n_words", "mean_word_length", "symbol_share", "line_end_share", "common_share", "repeated_line_share", "repeated_paragraph_share", "repeated_sentence_share", "top_ngram_share", "table_share", "list_share")


def _common(words: list[str]) -> float:
    """The share of common words among those with a letter."""
    named = len(words) - sum(map(str.isdigit, words))
    return sum(map(COMMON.__contains__, words)) / named if named else 0.0


def _top_ngram(words: list[str], chars: int) -> float:
    """The largest share of the words' characters in the repeats of one n-gram of 2 to 4 words."""
    most, places = 0, range(len(words) - 1)
    for n in (2, 3, 4):
        grams = [tuple(words[p : p + n]) for p in places if p + n <= len(words)] if n > 2 else list(zip(words, words[1:]))
        times = Counter(grams)
        if not times:
            break
        gram, top = times.most_common(1)[0]
        if top < 2:
            break
        most = max(most, top * sum(map(len, gram)))
        places = [p for p, g in zip(places, grams) if times[g] > 1]  # a longer repeat starts where a shorter one does
    return min(1.0, most / chars) if chars else 0.0


def _repeats(parts: list[str]) -> float:
    return 1 - len(set(parts)) / len(parts) if parts else 0.0


def _even(counts: list[int]) -> tuple[int, int]:
    """The most frequent count above 0 and how many lines have it."""
    times = Counter(c for c in counts if c)
    return max(times.items(), key=lambda x: (x[1], x[0])) if times else (0, 0)


def _cell_rows(lines: list[str], text: str) -> list[bool]:
    """Which lines are rows of cells: by the mark that makes most of them rows."""
    best: list[bool] = [False] * len(lines)
    most = 0

    def take(rows: list[bool]) -> None:
        nonlocal best, most
        size = sum(len(x) for x, r in zip(lines, rows) if r)
        if size > most:
            best, most = rows, size

    if "<" in text and _CELL_TAG.search(text):
        take([bool(_CELL_TAG.search(x)) for x in lines])
    if len(lines) < 2:
        return best
    if "|" in text:
        counts = [x.strip().strip("|").count("|") for x in lines]
        take([c > 0 or (x.count("|") == 2 and x.strip()[0] == x.strip()[-1] == "|") for c, x in zip(counts, lines)])
    if "\t" in text:
        take(["\t" in x.strip() for x in lines])
    for mark in (";", ",", "  "):
        if mark not in text:
            continue
        counts = [len(_GAP.findall(x.strip())) if mark == "  " else x.count(mark) for x in lines]
        n, times = _even(counts)
        if times < 2 or times < 0.6 * len(lines):
            continue
        rows = [c == n for c in counts]
        cells = sum(len(x.split()) for x, r in zip(lines, rows) if r) / (times * (n + 1))
        short_first = sum(len((_GAP.split(x.strip(), maxsplit=1) if mark == "  " else x.split(mark, 1))[0].split()) <= 3 for x, r in zip(lines, rows) if r)
        # short cells; or long ones behind a short key, on nearly all of several lines
        if cells <= 3 or (times >= max(3, 0.9 * len(lines)) and short_first >= 0.9 * times):
            take(rows)
    return best


def statistics(text: str) -> tuple[dict[str, float], str]:
    """The figures of one text and its form."""
    words = _WORD.findall(text.lower())
    lines = [x for x in text.splitlines() if x and not x.isspace()]
    solid = sum(map(len, text.split()))
    letters = sum(map(len, words))
    size = max(1, sum(map(len, lines)))
    rows = _cell_rows(lines, text)
    marked = [bool(_ITEM.match(x)) for x in lines] if len(lines) >= 2 else [False] * len(lines)
    named = [bool(_FIELD.match(x)) for x in lines] if len(lines) >= 2 and (":" in text or "=" in text) else marked
    items = marked if sum(marked) >= sum(named) else named
    sentences = [" ".join(s.split()) for s in _SENTENCE.split(text.lower())]
    sentences = [s for s in sentences if s]
    figures = {
        "n_words": len(words),
        "mean_word_length": letters / len(words) if words else 0.0,
        "symbol_share": 1 - min(1.0, letters / solid) if solid else 0.0,
        "line_end_share": sum(x.rstrip("\"'”’)»* \t")[-1:] in tuple(".!?…:。！？") for x in lines) / len(lines) if lines else 0.0,
        "common_share": _common(words),
        "repeated_line_share": _repeats(lines),
        "repeated_paragraph_share": _repeats(_PARAGRAPH.split(text)),
        "repeated_sentence_share": _repeats(sentences),
        "top_ngram_share": _top_ngram(words, letters),
        "table_share": sum(len(x) for x, r in zip(lines, rows) if r) / size,
        "list_share": sum(len(x) for x, r in zip(lines, items) if r) / size,
    }
    return figures, form_of(text, words, lines, [a or b for a, b in zip(rows, items)], sentences, figures)


def form_of(text: str, words: list[str], lines: list[str], shaped: list[bool], sentences: list[str], f: dict[str, float]) -> str:
    """prose, table, list or junk; `shaped` says which lines are rows or items."""
    if not words:
        return "junk"
    marked = max(f["table_share"], f["list_share"])
    if marked < 0.5:
        body = words
        if marked:  # a short list or table within a text: look at the rest
            own = [w for x, s in zip(lines, shaped) if not s for w in _WORD.findall(x.lower())]
            body = own if len(own) * 2 >= len(words) else words
        if (_common(body) >= 0.2 and f["symbol_share"] < 0.3) or _sentence_shaped(text, words, lines, sentences, f):
            return "junk" if _boilerplate(words, sentences, f) else "prose"
    elif f["list_share"] >= f["table_share"] and f["line_end_share"] >= 0.5 and f["n_words"] >= 8 * len(lines):
        if f["common_share"] >= 0.34 or _sentence_shaped(text, words, lines, sentences, f):
            return "junk" if _boilerplate(words, sentences, f) else "prose"  # numbered or bulleted whole sentences
    distinct = len(set(words)) / len(words)
    if f["table_share"] >= 0.5 and f["table_share"] >= f["list_share"]:
        return "table"
    single = sum(len(w) == 1 for w in words) / len(words)
    if f["symbol_share"] > 0.45 or (single > 0.5 and f["list_share"] < 0.5):
        return "junk"
    if f["list_share"] >= 0.5:
        return "list"
    if max(map(len, words)) > 40 or f["mean_word_length"] > 20:
        return "junk"
    if len(lines) >= 4:
        short = sum(len(x.split()) <= 6 for x in lines) / len(lines)
        return "list" if short >= 0.8 and f["repeated_line_share"] < 0.8 and _readable(text) else "junk"
    gaps = len(_SEPARATED.findall(text))
    return "list" if gaps >= 3 and gaps * 6 >= len(words) and distinct > 0.1 and _readable(text) else "junk"


def _boilerplate(words: list[str], sentences: list[str], f: dict[str, float]) -> bool:
    """Hardly anything but one phrase, line, sentence or paragraph over and over; a good part of repeats is still prose."""
    if len(sentences) >= 4 and f["repeated_sentence_share"] >= 0.75:
        return True
    if len(words) < 40:
        return False
    few = len(set(words)) <= 0.25 * len(words)
    return few and (f["top_ngram_share"] >= 0.25 or f["repeated_line_share"] >= 0.75 or f["repeated_paragraph_share"] >= 0.75)


def _natural(word: str) -> bool:
    """Like a word of a language: letters of even case, and vowels where the script writes them."""
    if _SPLIT_CASE.search(word) or len(word) > 30:
        return False
    return not _LATIN.match(word) or not word.isascii() or bool(_VOWEL.search(word)) or len(word) <= 2


def _sentence_shaped(text: str, words: list[str], lines: list[str], sentences: list[str], f: dict[str, float]) -> bool:
    """Running text of any language: natural words in sentences."""
    if f["symbol_share"] >= 0.25 or f["top_ngram_share"] >= 0.4:
        return False
    unspaced = len(_UNSPACED.findall(text))
    if unspaced * 2 > sum(map(len, words)):
        return unspaced >= 8 * len(sentences) and f["line_end_share"] > 0
    raw = [w for w in _WORD.findall(text) if _LETTER.search(w)]
    plain = [w for w in raw if w.isalpha()]
    if len(raw) < 5 or len(plain) < 0.6 * len(raw) or len(raw) < 0.7 * len(words):
        return False
    if sum(map(_natural, plain)) < 0.85 * len(plain) or len(set(words)) < 0.25 * len(words) and f["repeated_sentence_share"] < 0.5:
        return False
    if not 2.5 <= sum(map(len, plain)) / len(plain) <= 14 or max(map(len, words)) > 40:
        return False
    # an aside or two, but no row of short items; sentences rather than lines of a few words
    if len(_SEPARATED.findall(text)) * 4 >= len(words):
        return False
    return len(words) >= 5 * len(sentences) or (f["line_end_share"] >= 0.5 and len(words) >= 4 * len(sentences))


def _readable(text: str) -> bool:
    """Names or words: most have a digit at their end (identifiers) or a vowel, and no case that changes inside."""
    words = _WORD.findall(text)
    ok = sum(bool(_NAME.fullmatch(w)) or (bool(_VOWEL.search(w)) or not w.isascii() or w.isdigit() or len(w) <= 3) and not _SPLIT_CASE.search(w) for w in words)
    return ok >= 0.6 * len(words) and len({w.lower() for w in words}) > 2


_SCHEMA = pa.schema([("doc", pa.int64()), *((n, pa.float64()) for n in NAMES), ("form", pa.string())])


def _run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = [statistics(t) if t is not None else (dict.fromkeys(NAMES), None) for t in batch.column(1).to_pylist()]
        yield pa.record_batch([batch.column(0), *(pa.array([None if (v := r[0][n]) is None else float(v) for r in rows], pa.float64()) for n in NAMES), pa.array([r[1] for r in rows], pa.string())], schema=_SCHEMA)


def text_statistics(docs: DataFrame, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """doc, the figures of NAMES and form, one row per row of docs."""
    rows = docs.select(F.col(doc).cast("long").alias("doc"), F.col(text).cast("string").alias("text"))
    figures = rows.mapInArrow(_run, "doc long, " + ", ".join(f"{n} double" for n in NAMES) + ", form string")
    return figures.select(F.col("doc").alias(doc), F.col("n_words").cast("long").alias("n_words"), *NAMES[1:], "form")

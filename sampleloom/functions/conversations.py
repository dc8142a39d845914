"""Conversation records: turns, prompts, supervision masks over token arrays, lengths, padding."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

IGNORED = -100


def turns(question: Column, answer: Column) -> Column:
    return F.array(F.struct(F.lit("human").alias("from"), question.alias("value")), F.struct(F.lit("gpt").alias("from"), answer.alias("value")))


def questions(conversation: Column) -> Column:
    return F.transform(F.filter(conversation, lambda t: t["from"] == "human"), lambda t: t["value"])


def answers(conversation: Column) -> Column:
    return F.transform(F.filter(conversation, lambda t: t["from"] == "gpt"), lambda t: t["value"])


def prompt(question: Column, answer: Column, system: str = "") -> Column:
    """System text, then the turns; an image mark goes to the front of the question."""
    clean = F.trim(F.replace(question, F.lit("<image>"), F.lit("")))
    hoisted = F.when(F.contains(question, F.lit("<image>")), F.concat(F.lit("<image>\n"), clean)).otherwise(clean)
    return F.concat(F.lit(system + " " if system else ""), F.lit("USER: "), hoisted, F.lit(" ASSISTANT: "), answer, F.lit("</s>"))


#: Name of a prompt format -> function (question, answer) -> text.
FORMATS: dict[str, Callable[[Column, Column], Column]] = {}


def prompt_format(name: str):
    def add(f):
        if name in FORMATS:
            raise ValueError(f"two formats named {name}")
        FORMATS[name] = f
        return f

    return add


@prompt_format("chat")
def chat(question: Column, answer: Column) -> Column:
    return prompt(question, answer)


@prompt_format("plain")
def plain(question: Column, answer: Column) -> Column:
    return F.concat(question, F.lit("\n"), answer)


@prompt_format("instruction")
def instruction(question: Column, answer: Column) -> Column:
    return F.concat(F.lit("### Instruction:\n"), question, F.lit("\n### Response:\n"), answer)


def tokens(text: Column) -> Column:
    """Words between blanks, standing in for a tokenizer."""
    return F.filter(F.split(text, r"\s+"), lambda x: x != "")


def supervised(question_tokens: Column, answer_tokens: Column) -> Column:
    """Labels: the answer's tokens, IGNORED for the question's."""
    return F.concat(F.transform(question_tokens, lambda x: F.lit(str(IGNORED))), answer_tokens)


def answer_span(full: Column, prefix: Column) -> Column:
    """The tokens after the prefix; null where full doesn't begin with it."""
    same = F.slice(full, 1, F.greatest(F.size(prefix), F.lit(1))) == prefix
    return F.when((F.size(prefix) == 0) | same, F.slice(full, F.size(prefix) + 1, F.greatest(F.size(full) - F.size(prefix), F.lit(0))))


def with_image_token(text: Column, token: str = "-200") -> Column:
    """Tokens of a text with the image mark as its own token."""
    parts = F.split(text, "<image>")
    return F.flatten(F.transform(parts, lambda x, i: F.concat(F.when(i > 0, F.array(F.lit(token))).otherwise(F.array().cast("array<string>")), tokens(x))))


def length(question: Column, answer: Column, has_image: Column, image_tokens: int = 128) -> Column:
    """Words of a record, plus the image's; negative for text only."""
    n = F.size(tokens(question)) + F.size(tokens(answer))
    return F.when(has_image, n + image_tokens).otherwise(-n)


def padded(values: Column, size: int, pad: str) -> Column:
    """Cut or padded to size."""
    return F.slice(F.concat(values, F.array_repeat(F.lit(pad), size)), 1, size)


def tiles(width: Column, height: Column, step: int) -> Column:
    """Left upper corners of the tiles that cover an image, as structs."""
    xs, ys = (F.sequence(F.lit(0), F.greatest(v - 1, F.lit(0)), F.lit(step)) for v in (width, height))
    return F.flatten(F.transform(ys, lambda y: F.transform(xs, lambda x: F.struct(x.alias("x"), y.alias("y")))))

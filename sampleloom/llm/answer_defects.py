"""Broken prompt and response pairs, by ordered rules over whole texts; all expressions stay inside the JVM.

The facts of a text are its identifiers (letters followed by digits) and numbers, in lower case, without the names of
units; numbers may be written as words up to ninety-nine, with a decimal comma or with commas between thousands. Where
gt_answer is made of "name: value" fields, values in words are facts too. A pair is checked for, in this order:
  empty          no letter or digit, or only a stand-in for nothing
  copy           nothing but paraphrased_question or filled_question, with or without a lead-in
  refusal        none of the figures of gt_answer that the questions don't name, and a phrase of refusal, or a whole
                 sentence that speaks of the answerer or is in another language
  other_language the words are of another language or script, at least half of the facts being there
  truncated      facts of gt_answer are missing, or the text breaks off (an unclosed bracket or quotation, an ellipsis,
                 an opening or joining mark, or a joining word at its end)
Another language is told by its script, by common words of some languages, or, for any other, by having hardly a common
word of English and few of the three-letter sequences of English.
`defects` gives every triggered type, `defect` the first of them. Null answers are empty. With a null or factless
gt_answer only the marks of breaking off make an answer truncated. Null questions copy nothing.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Stand-ins for an answer.
STAND_INS = ["answer", "n a", "na", "none", "null", "nil", "nan", "empty", "blank", "tbd", "todo", "undefined", "not available", "no answer", "unknown", "missing"]
#: Words that may stand around a copied question.
LEAD_INS = "answer|question|quick|please|tell|me|kindly|for|this|sample|i|would|like|to|know|sure|ok|okay|certainly|of|course|here|is|the|reply|response|q|a"
#: Ways of refusing in English, as patterns over words in lower case with single blanks and no apostrophes.
REFUSALS = (
    # inability, unwillingness
    r"\b(?:can ?not|cant|could not|couldnt|wont|will not|would not|wouldnt|must not|may not|shall not|do not|dont|does not|did not|didnt)\b.{0,40}\b(?:answer|comment|speculate|share|provide|discuss|say|tell|interpret|judge|rewrite|help|assist|respond|reply|disclose|reveal|comply|complete|determine|give|offer|process|access)\w*\b"
    r"|\b(?:unable|not able|incapable|impossible|not possible|not at liberty|not allowed|not permitted|not authori[sz]ed|forbidden|prohibited|refus\w+|declin\w+|turn down|abstain|withh[eo]ld\w*|reluctant|unwilling|uncomfortable)\b"
    r"|\b(?:prefer|rather|choose|chose)\b.{0,20}\b(?:not|keep|leave|refrain|avoid)\b|\bto (?:my|our)sel(?:f|ves)\b|\bno (?:comment|answer|reply|response)\b|^skip\b"
    # regret
    r"|\b(?:regret\w*|unfortunately|sorry(?! for)|apolog\w+(?! for))\b"
    # rules, privacy, limits of knowledge
    r"|\b(?:policy|policies|guidelines|confidential\w*|classified|sensitive|private|privacy|restricted|off limits|out of scope|beyond (?:what|the scope|my)|(?:not|in)appropriate|outside (?:of )?(?:what|the scope|my))\b"
    r"|\b(?:falls?|lies?|is) (?:beyond|outside)\b|\b(?:language model|an ai|assistant)\b|\b(?:not enough|insufficient|lack\w*|dont have|do not have|without) (?:the |any |enough )?(?:context|information|access|data|knowledge)\b"
    r"|\b(?:consult|ask|contact|see) (?:a|an|your|the) (?:\w+ )?(?:specialist|expert|doctor|professional|clinician|physician|author)s?\b"
)
#: The same in other languages, for answers that end without a stop.
FOREIGN_REFUSALS = (
    r"\b(?:leider|kann ich nicht|ich kann nicht|nicht beantworten|es tut mir leid|darf ich nicht)\b|\b(?:désolée?|je ne peux pas|je refuse|impossible de répondre)\b|\b(?:lo siento|no puedo|lamentablemente)\b|\b(?:mi dispiace|non posso|purtroppo)\b"
    r"|\b(?:desculpe|não posso|infelizmente)\b|\b(?:helaas|kan ik niet)\b|\b(?:nie mogę|niestety|przepraszam)\b|\b(?:tyvärr|kan inte|jag vägrar)\b|\b(?:maalesef|üzgünüm)\b|\b(?:valitettavasti|en voi)\b|\b(?:beklager|desværre)\b"
    r"|抱歉|无法|不能回答|对不起|拒绝|申し訳|できません|извините|не могу|к сожалению|죄송|할 수 없"
)
#: Common words of English, and of other languages where they are no English words.
ENGLISH = "the of and to in is was were are be been for with on at by from as this that these those it its has have had which where when than then not no nor all any each only we you your i my our their there here who whose what how while around about above below under over past out up down within among between against per into onto off they them he she if so but an or one two most more less first last very also both such can may will would should could do does did after before during through because"
OTHERS = (
    "der die das den dem des ein eine einen einer ist sind und mit von im zu bei auf für nicht wird wurde dieser diese sich aus nach über und um gegenüber unter am "
    "le la les un une du de et est sont dans des pour avec sur plus par cet cette ce qui que se aux leur ont été "
    "el los las del y en una con son es esta este esa por para que se más sus su lo como "
    "il lo gli di che è e sono con per questo questa nel nella delle dei della degli più dalla si non tra sul "
    "o os as do da dos das em um uma com são para esta este mais pelo pela nos nas foi não "
    "het een van en op te met voor dat zijn is niet aan deze dit bij uit naar "
    "och att det som är på av för med den till inte från har jest się nie na to w z oraz dla tym przez"
)
#: A text whose three-letter sequences stand for English.
ENGLISH_TEXT = (
    "The level of a gene in this sample is higher than in most of the other samples that were measured, and the difference between the two groups remains after correction. "
    "We found that several values lie above the threshold, while the strongest ones belong to patients with a confirmed condition. Overall, the shift is rather large, moderate or minimal, depending on which reference was used. "
    "Its closest partners show a similar pattern; each of them stands at about half the reading of the leading one. Compared with controls of the same tissue, the expression rises or falls by more than expected, ranking first among everything recorded here. "
    "Researchers should also consider how many observations support every statement, whether further experiments are needed, and what might explain an unusual result. Nothing else comes near; three or four entries remain below it. "
    "Therefore the answer equals the number given in the table, measured at the time of the visit, and the total amount reaches its highest point during the last quarter of the year. Results like these would usually be taken from a recent report, listed in order, and checked again before they are published. "
    "Classification assigned the hypertrophic, vascular and congestive subtypes; biopsies exhibited downregulation across ventricles, arteries, muscles and whole blood, with upregulation of inflammatory markers in cardiomyopathy and heart failure. "
    "Quantile normalization, variance and correlation coefficients describe the distribution; significance thresholds, sequencing depth, replicates and batch effects limit every comparison. Strong signals were detected, exceeding controls."
)
_UNITS = r"log(?:1p(?:\s*[\(\[]?\s*tpm\s*[\)\]]?)?|2|10)"
_FACT = r"[a-z]+[0-9]+(?:-as[0-9]+)?|[0-9]+(?:[.][0-9]+)?"
#: Invisible characters and apostrophes, which are left out of words.
_LEFT_OUT = "\u200b\u200c\u200d\u2060\ufeff\u00ad'’`"
#: Blanks, quotation marks and emphasis that may follow the last sign of a text.
_OUTER = " \t\n\r\u000b\u000c\u00a0\u2002\u2003\u2009\u202f\u3000\u200b\ufeff\"'’”»*_`"
_OTHER_SCRIPT = r"[\p{L}&&[^\p{IsLatin}]]"
_UNITS_WORDS = "zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen".split()
_TENS_WORDS = "twenty thirty forty fifty sixty seventy eighty ninety".split()
#: 0 to 99 in words.
NUMBER_WORDS = {str(n): w for n, w in enumerate([*_UNITS_WORDS, *(t if not u else f"{t} {_UNITS_WORDS[u]}" for t in _TENS_WORDS for u in range(10))])}


def trigrams(text: str) -> set[str]:
    """The three-letter sequences of a text's words, with their ends."""
    return {w[k : k + 3] for x in re.findall(r"[^\W\d_]+", text.lower()) for w in [f" {x} "] for k in range(len(w) - 2)}


def plain_words(c: Column) -> Column:
    """Letters and digits in lower case, anything else as one blank, apostrophes left out."""
    text = F.translate(F.lower(F.coalesce(c, F.lit(""))), _LEFT_OUT, "")
    return F.trim(F.regexp_replace(text, r"[^\p{L}\p{M}\p{N}]+", " "))


def facts(c: Column) -> Column:
    """The identifiers and numbers of a text, each once."""
    text = F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), _UNITS, " ")
    return F.array_distinct(F.regexp_extract_all(text, F.lit(_FACT), F.lit(0)))


def _still_missing(missing: Column, answer: Column, words: Column) -> Column:
    """Missing facts that the answer doesn't have in words, with a decimal comma or with commas between thousands either."""
    said = F.expr(f"map({_listed(x for pair in NUMBER_WORDS.items() for x in pair)})")
    padded = F.concat(F.lit(" "), words, F.lit(" "))
    left = F.filter(missing, lambda x: ~F.coalesce(F.contains(padded, F.concat(F.lit(" "), F.element_at(said, x), F.lit(" "))), F.lit(False)))
    left = F.array_except(left, facts(F.regexp_replace(answer, "(?<=[0-9]),(?=[0-9]{3}(?![0-9]))", "")))
    return F.array_except(left, facts(F.regexp_replace(answer, "(?<=[0-9]),(?=[0-9])", ".")))


def _values_missing(truth: Column, words: Column) -> Column:
    """How many values in words of "name: value" fields the answer's words don't hold."""
    parts = F.filter(F.split(truth, r"[;|\r\n]+"), lambda x: F.rlike(x, F.lit(r"^[^\p{L}\p{N}]*\p{L}[\p{L}\p{N}_ ]*[:=]")))
    values = F.transform(parts, lambda x: plain_words(F.regexp_replace(x, r"^[^:=]*[:=]", "")))
    padded = F.concat(F.lit(" "), words, F.lit(" "))
    lost = F.filter(values, lambda x: F.rlike(x, F.lit(r"^[\p{L}\p{M} ]{3,}$")) & ~F.contains(padded, F.concat(F.lit(" "), x, F.lit(" "))))
    # two fields need two name marks
    return F.when(F.rlike(truth, F.lit(r"(?s)[:=].*[;|\r\n].*[:=]")) & (F.size(parts) >= 2), F.size(lost)).otherwise(0)


def _listed(words) -> str:
    """A list of plain words as SQL: parsed at once, where a literal each would take a call each."""
    return ", ".join(f"'{w}'" for w in words)


def _hits(words: str, vocabulary: list[str]) -> Column:
    """How many different words of a column the vocabulary has."""
    return F.expr(f"size(filter(array_distinct(split({words}, ' ')), x -> x in ({_listed(vocabulary)})))")


def _unlike_english(words: str, known: Column) -> Column:
    """Four words or more that the pair hasn't elsewhere, with few of the three-letter sequences of English."""
    own = F.array_except(F.expr(rf"filter(array_distinct(split({words}, ' ')), x -> x rlike r'^[\p{{L}}\p{{M}}]{{2,}}$')"), F.split(known, " "))
    parts = F.flatten(F.transform(own, lambda x: F.transform(F.sequence(F.lit(1), F.length(x)), lambda k: F.substring(F.concat(F.lit(" "), x, F.lit(" ")), k, F.lit(3)))))
    english = F.split(F.lit("|".join(sorted(trigrams(ENGLISH_TEXT)))), "[|]")
    # common parts by hash, not one by one
    share = 1 - F.size(F.array_except(parts, english)) / F.greatest(F.size(F.array_distinct(parts)), F.lit(1))
    return ((F.size(own) >= 4) & (share < 0.36)) | ((F.size(own) >= 6) & (share < 0.48))


def with_features(df: DataFrame, question: str, filled: str, answer: str, truth: str) -> DataFrame:
    """What the rules look at. The questions are looked at only where facts are missing, most rows having all."""
    a = F.col(answer)
    english = list(dict.fromkeys(ENGLISH.split()))
    others = [w for w in dict.fromkeys(OTHERS.split()) if w not in set(english) and len(w) > 1]  # single letters name variables
    f = df.withColumn("_w", plain_words(a)).withColumn("_g", facts(F.col(truth))).withColumn("_m", F.array_except("_g", facts(a)))
    f = f.withColumn("_m", F.when(F.size("_m") > 0, _still_missing(F.col("_m"), a, F.col("_w"))).otherwise(F.col("_m")))
    f = f.withColumn("_missing", F.size("_m")).withColumn("_facts", F.size("_g")).withColumn("_text", F.coalesce(a, F.lit("")))
    f = f.withColumn("_values", F.when(F.col("_missing") > 0, 0).otherwise(F.coalesce(_values_missing(F.col(truth), F.col("_w")), F.lit(0))))
    lacks = (F.col("_missing") > 0) | (F.col("_facts") == 0)
    f = f.withColumn("_q", F.when(lacks, plain_words(F.col(question))).otherwise("")).withColumn("_p", F.when(lacks, plain_words(F.col(filled))).otherwise(""))
    # figures that the answer has and the questions don't
    added = F.filter(F.array_except(F.array_except("_g", "_m"), facts(F.concat_ws(" ", F.col(question), F.col(filled)))), lambda x: F.rlike(x, F.lit("^[0-9]")))
    f = f.withColumn("_added", F.when(F.col("_missing") > 0, F.size(added)).otherwise(F.col("_facts")))
    f = f.withColumn("_english", _hits("_w", english)).withColumn("_other", _hits("_w", others))
    known = F.concat_ws(" ", plain_words(F.col(question)), plain_words(F.col(filled)), plain_words(F.col(truth)))
    return f.withColumn("_strange", F.when(F.col("_english") <= 1, _unlike_english("_w", known)).otherwise(False))


def _rules() -> dict[str, Column]:
    w, q, p, english, other = (F.col(c) for c in ("_w", "_q", "_p", "_english", "_other"))
    lacks = F.col("_missing") > 0
    empty = (w == "") | w.isin(STAND_INS)
    once = F.when(q != "", F.replace(w, q, F.lit(" "))).otherwise(w)
    rest = F.trim(F.regexp_replace(F.when(p != "", F.replace(once, p, F.lit(" "))).otherwise(once), " +", " "))
    within = (F.length(w) >= 12) & ((F.instr(q, w) > 0) | (F.instr(p, w) > 0))
    copy = ~empty & ((F.col("_facts") == 0) | lacks) & (within | ((rest != w) & F.rlike(rest, F.lit(rf"^(?:(?:{LEAD_INS})(?: |$))*$"))))
    beyond_ascii = F.octet_length(w) != F.length(w)
    letters = F.regexp_replace(F.regexp_replace(w, r"[^\p{L}]", ""), "log1p|tpm|log2", "")
    script = F.regexp_count(letters, F.lit(_OTHER_SCRIPT))
    foreign_script = beyond_ascii & ((script * 3 > F.length(letters)) | ((script >= 2) & (english <= 1)))
    foreign = ((other >= 2) & (other > english)) | foreign_script | F.col("_strange")
    end = F.rtrim(F.col("_text"), F.lit(_OUTER))
    whole = F.right(end, F.lit(1)).isin(".", "!", "?", "。", "！", "？", "।", "؟") & ~F.endswith(end, F.lit("..."))
    # a whole sentence of someone who speaks of themselves, or in a language without hardly a word of English
    speaks = whole & (F.rlike(w, F.lit(r"\b(?:i|im|id|ill|ive|me|my|myself|we|our|us)\b")) | foreign | ((english == 0) & ~F.rlike(w, F.lit(r"\ba\b")) & (F.size(F.split(w, " ")) >= 3)))
    nothing = (F.col("_facts") == 0) | (lacks & (F.col("_added") == 0))
    refusal = ~empty & nothing & (F.rlike(w, F.lit(f"{REFUSALS}|{FOREIGN_REFUSALS}")) | ((F.col("_facts") > 0) & speaks))
    other_language = ~empty & (F.col("_missing") * 2 <= F.col("_facts")) & foreign
    count = lambda ch: F.length("_text") - F.length(F.replace(F.col("_text"), F.lit(ch), F.lit("")))
    unclosed = (count("(") > count(")")) | (count("[") > count("]")) | (count("{") > count("}")) | (count("“") > count("”"))
    joining = F.rlike(end, F.lit(r"(?:\.\.\.|[…,(\[{=&+/])$|\b(?:and|or|the|a|an|of|with|is|are|by|to|at|for|from)$"))
    return {"empty": empty, "copy": copy, "refusal": refusal, "other_language": other_language, "truncated": ~empty & (lacks | (F.col("_values") > 0) | unclosed | joining)}


def answer_defects(df: DataFrame, line: str = "line_no", question: str = "paraphrased_question", filled: str = "filled_question", answer: str = "paraphrased_answer", truth: str = "gt_answer") -> DataFrame:
    """line, defect (the first in the order of the rules) and defects (all that were triggered) of each defective pair."""
    rows = df.select(F.col(line).alias("_line"), *(F.col(c).alias(f"_c{k}") for k, c in enumerate((question, filled, answer, truth))))
    rows = with_features(rows, "_c0", "_c1", "_c2", "_c3")
    found = F.filter(F.array(*(F.when(rule, F.lit(name)) for name, rule in _rules().items())), lambda x: x.isNotNull())
    # a generator instead of a filter: a filter on it would be pushed down and compute the rules once more
    some = rows.select(F.col("_line").alias(line), F.explode(F.filter(F.array(found), lambda x: F.size(x) > 0)).alias("defects"))
    return some.select(line, F.element_at("defects", 1).alias("defect"), "defects")

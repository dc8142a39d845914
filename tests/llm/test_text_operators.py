"""Problems 4, 7, 8 and 10 on small fixtures and against brute force."""

import random

import pytest

from sampleloom.llm import answer_defects, collapse, leakage, text_quality

LINES = "line_no long, paraphrased_question string, filled_question string, paraphrased_answer string, gt_answer string"


def _defects(spark, rows):
    df = spark.createDataFrame([(k, *r) for k, r in enumerate(rows)], LINES)
    return {r["line_no"]: r["defect"] for r in answer_defects.answer_defects(df).collect()}


Q, G = "How high is ABCD1 in GSM7?", "ABCD1 reads 4.5021 (log1p(TPM)) in GSM7, rank 12."


def test_defects(spark):
    cases = [
        (None, "empty"), ("", "empty"), (" \u200b\t", "empty"), ("N/A", "empty"), ("(empty)", "empty"), ("Answer: \n", "empty"),
        ("ABCD1 in GSM7 is at 4.5021, rank 12", None), ("abcd1: 4.5021 (gsm7, 12)", None), ("How high is ABCD1 in GSM7? ABCD1 has 4.5021, rank 12 in GSM7.", None),
        ("Sorry for the short text. ABCD1 has 4.5021 in GSM7, rank 12.", None),
        ("ABCD1 reads 4.50", "truncated"), ("ABCD1 in GSM7 is at 4.5021, ra", "truncated"), ("ABCD1 in GSM7 is at 4.5021, rank 12 (lo", "truncated"),
        ("I cannot answer this about GSM7.", "refusal"), ("Unfortunately I must decline.", "refusal"), ("Es tut mir leid, das kann ich nicht beantworten.", "refusal"),
        (Q, "copy"), ("Answer: how high is abcd1 in gsm7", "copy"), (Q + " " + Q, "copy"),
        ("Der Wert von ABCD1 liegt in GSM7 bei 4.5021, und zwar auf Rang 12.", "other_language"), ("在 GSM7 中 ABCD1 的值为 4.5021，排名 12。", "other_language"),
        # refusals of other wording and languages
        ("That lies beyond what can be shared here.", "refusal"), ("I'd prefer to keep this to myself.", "refusal"), ("This is confidential", "refusal"), ("I looked at it for a while and gave up.", "refusal"),
        ("Niestety nie mogę odpowiedzieć na to pytanie.", "refusal"), ("Jag kan tyvärr inte svara på den frågan.", "refusal"), ("Bu soruyu yanıtlayamam.", "refusal"), ("En voi vastata tähän kysymykseen.", "refusal"),
        # languages without a list of words, numbers in words and with commas
        ("ABCD1:n arvo näytteessä GSM7 on 4.5021 ja sijoitus 12.", "other_language"), ("У ABCD1 в GSM7 уровень 4,5021, место 12.", "other_language"), ("ABCD1 sits at 4.5021 in GSM7, rank twelve.", None),
        ("Expression of ABCD1: 4.5021. Ranking: 12. Sample: GSM7", None), ("ABCD1, GSM7: 4.5021, place 12 overall, measured twice", None), ("I looked it up: ABCD1 has 4.5021 in GSM7, rank 12.", None),
        # whatever blanks follow the end
        *((f"ABCD1 in GSM7 is at 4.5021, rank 12, and{blank * n}", "truncated") for blank in (" ", "\n", " ") for n in (0, 30, 3000)), ("ABCD1 in GSM7 is at 4.5021, rank 12." + " " * 300, None),
        ("It stands at “4.5021 in GSM7, rank 12", "truncated"), ("ABCD1 peaked.", "truncated"), ("ABCD1 (GSM7, rank 12) has 4.5021...", "truncated"),
    ]
    got = _defects(spark, [(Q, Q, answer, G) for answer, _ in cases])
    assert {k: (answer, got.get(k)) for k, (answer, want) in enumerate(cases) if got.get(k) != want} == {}


def test_values_in_words_are_facts(spark):
    q, g = "Under what subtype is GSM7 filed?", "subtype: heart failure; tissue: whole blood; sample: GSM7; reference_n: 12"
    rows = ["GSM7 is filed under heart failure (whole blood, 12 others)", "Against 12 others, GSM7 from whole blood is filed under heart", "12 others, GSM7, whole\u00a0 blood: HEART-failure."]
    assert _defects(spark, [(q, q, a, g) for a in rows]) == {1: "truncated"}


def test_defects_with_nulls_and_no_rows(spark):
    assert _defects(spark, [(None, None, None, None), (None, None, "Fine text here.", None)]) == {0: "empty"}
    assert answer_defects.answer_defects(spark.createDataFrame([], LINES)).count() == 0


def test_collapse(spark):
    rows = [
        (1, "c", "size: large; n: -2.5", "A is 1.25."), (2, "C", "n: -2.5 | size: large", "a is 1.25"), (3, "c", "size = large\nn = -2.5", " A  is (1.25)"),
        (4, "c", "size: large; n: 2.5", "A is 1.25."), (5, "c", "size: large; n: -2.5", "A is 125."), (6, "c", "size: large; n: -2.5", "A is 1.25."),
        (11, "c", "N - -2.5 / Size - large", "A is 1.25!"), (12, "c", "size - large;\nn: -2.5", "a IS 1.25"), (13, "c", "size: large - n: 2.5", "A is 1.25."),
        (7, None, None, None), (8, None, None, ""), (9, "d", "b, a", "x"), (10, "d", "a, b", "x"),
    ]
    df = spark.createDataFrame(rows, "line_no long, category string, gt_answer string, paraphrased_answer string").selectExpr("*", "'x' as n", "1 as line", "2 as raw", "3 as t0")
    records, members = collapse.collapse_formatting(df, "line_no", ["category", "gt_answer", "paraphrased_answer"], ["gt_answer"])
    assert {(r["line"], r["first_line"]) for r in members.collect()} == {(1, 1), (2, 1), (3, 1), (6, 1), (11, 1), (12, 1), (7, 7), (8, 7)}
    assert {r["first_line"]: (r["copies"], r["variants"]) for r in records.collect()} == {1: (6, 5), 4: (1, 1), 5: (1, 1), 13: (1, 1), 7: (2, 2), 9: (1, 1), 10: (1, 1)}
    none = collapse.collapse_formatting(df.limit(0), "line_no", ["category"], [])
    assert none[0].count() == none[1].count() == 0


def test_collapse_of_a_hot_record(spark):
    rows = [(k, "c", "same text", "Same answer" + "!" * (k % 3)) for k in range(6000)] + [(k, "c", f"text {k}", "a") for k in range(6000, 9000)]
    df = spark.createDataFrame(rows, "line_no long, category string, gt_answer string, paraphrased_answer string")
    members = collapse.collapse_formatting(df, "line_no", ["category", "gt_answer", "paraphrased_answer"], ["gt_answer"])[1].collect()
    assert len(members) == 6000 and {r["first_line"] for r in members} == {0}


def _words(rng, n):
    return [rng.choice(["alpha", "beta", "gamma", "delta", "x9", "the", "of", "über"]) + str(rng.randrange(12)) for _ in range(n)]


def test_leakage_against_brute_force(spark):
    rng = random.Random(5)
    items = [(k, " ".join(_words(rng, rng.randrange(5, 60)))) for k in range(30)] + [(30, None), (31, "")]
    docs = [(None, "no id"), (500, None), (501, ""), (502, "short")]
    for k in range(120):
        w = _words(rng, rng.randrange(0, 120))
        if k % 2:
            part = (items[rng.randrange(30)][1] or "").split()
            a = rng.randrange(max(1, len(part) - 11))
            cut = part[a : a + rng.choice([10, 11, 12, 13, 30])]
            w[len(w) // 2 : len(w) // 2] = [x.upper() + rng.choice(["", ",", "\u200b"]) for x in cut]
        docs.append((k, " ".join(w)))
    d = spark.createDataFrame(docs, "doc_id long, text string")
    i = spark.createDataFrame(items, "item_id long, text string")
    got = {tuple(r) for r in leakage.leaked_items(d, i).collect()}
    grams = lambda t: {tuple(w[k : k + 12]) for w in [leakage.words_of(t)] for k in range(len(w) - 11)}
    want = {(a, b) for a, t in docs for b, u in items if a is not None and grams(t) & grams(u)}
    assert got == want and want
    assert leakage.leaked_items(d.limit(0), i).count() == leakage.leaked_items(d, i.limit(0)).count() == 0


def test_leakage_with_edits_reaches_its_recall(spark):
    rng = random.Random(9)
    items = [(k, " ".join(f"w{rng.randrange(10**6)}" for _ in range(40))) for k in range(40)]
    docs = []
    for k in range(200):
        part = items[k % 40][1].split()[10:22]
        for _ in range(2):  # two edits: exchange or drop a word
            p = rng.randrange(1, len(part) - 1)
            part[p : p + 1] = rng.choice([["changed"], []])
        docs.append((k, " ".join(["lead"] * rng.randrange(9) + part + ["tail"] * 9)))
    got = {tuple(r) for r in leakage.leaked_items(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"), max_edits=2).collect()}
    assert got <= {(k, k % 40) for k in range(200)} and len(got) >= 0.9 * 200


def test_leakage_with_edits_of_natural_text_against_brute_force(spark):
    """Common words, substitutions, insertions and deletions at any place: every pair within two edits, or 0.95 of them."""
    rng = random.Random(4)
    subjects, verbs, objects = ["the group", "our team", "a nurse", "the committee", "this report"], ["looked at", "wrote about", "kept", "sent back", "asked for"], ["the samples of the day", "all of the records", "a list of names", "the results of the test", "some of the old notes"]
    sentence = lambda: f"{rng.choice(subjects)} {rng.choice(verbs)} {rng.choice(objects)} and then {rng.choice(['went home', 'closed the file', 'called the office'])}"
    items = [(k, ". ".join(sentence() for _ in range(3))) for k in range(12)]
    docs = []
    for k in range(60):
        w = leakage.words_of(items[k % 12][1])
        a = rng.randrange(len(w) - 14)
        part = w[a : a + 14]
        for _ in range(rng.randrange(4)):
            p = rng.randrange(len(part))
            part[p : p + rng.choice([0, 1])] = rng.choice([["of"], ["never"], []])
        docs.append((k, " ".join(leakage.words_of(sentence()) + part + leakage.words_of(sentence()))))

    def distance(passage: list[str], text: list[str]) -> int:
        row = [0] * (len(text) + 1)
        for k, x in enumerate(passage, 1):
            new = [k]
            for j, y in enumerate(text, 1):
                new.append(min(row[j - 1] + (x != y), row[j] + 1, new[-1] + 1))
            row = new
        return min(row)

    word = {k: leakage.words_of(t) for k, t in items}
    want = {(k, i) for k, t in docs for i, w in word.items() if any(distance(w[p : p + 12], t.split()) <= 2 for p in range(len(w) - 11))}
    got = {tuple(r) for r in leakage.leaked_items(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"), max_edits=2).collect()}
    assert got <= want and len(got) >= 0.95 * len(want) and len(want) > 60


@pytest.mark.parametrize(
    "text, form",
    [
        ("The samples were kept in the freezer for a week, and nobody looked at them before they had been measured again.", "prose"),
        ("die proben wurden vor der messung gekühlt und danach noch einmal gemessen weil der wert zu hoch war", "prose"),
        ("We looked\nat the values\nof the samples\nand found that\nthey were not\nas high as\nin the controls.", "prose"),
        ("The list of the parts is short and it is easy to read for all of us.\n- tubes\n- salt\n- ice\nThe rest of the text says what to do with them and in which order it is to be done.", "prose"),
        ("Contents\n- 5 ml amber buffer\n- 6 ml onyx buffer\n- 7 ml zephyr buffer\n- 9 ml buffer", "list"),
        ("Checklist, ABCD1, EFGH1, IJKL1, MNOP1, QRST1, UVWX1, YZAB1", "list"),
        ("a\tb\tc\n1\t2\t3\n4\t5\t6\n7\t8\t9", "table"), ("| a | b |\n|---|---|\n| 1 | 2 |\n| 3 | 4 |", "table"), ("gene,level\nABCD1,4.5\nEFGH1,2.5\nIJKL1,1.5", "table"),
        ("foo foo foo foo foo foo foo foo", "junk"), ("@*~$|%*< {-[#]]- {@#<^->", "junk"), ("", "junk"), (" \n\t", "junk"), ("zfptswj kbmjkrrjgjkp phpfdwqzgwdj qqpqx njbvrztgwn", "junk"),
        # rows and items of any length, tables and lists of two lines
        ("id,name,use\n" + "\n".join(f"{k},pump {k},The pump number {k} moves the cooling water through the second loop of the plant" for k in range(8)), "table"),
        ("\n".join(f"- check the pump {k} of the cooling loop and note the pressure at both ends in the sheet of the plant" for k in range(6)), "list"),
        ("- one\n- two", "list"), ("a | b\n1 | 2", "table"), ("Parts to order:\n" + "\n".join(f"QRST{k}" for k in range(20)), "list"),
        ("> The group looked at all the samples of the first\n> series and found that the results were stable in\n> both groups although there were few of them.", "prose"),
        # prose of languages without a list of words
        ("Η ομάδα εξέτασε τα δείγματα της σειράς. Τα αποτελέσματα ήταν σταθερά και στις δύο ομάδες, αν και ο αριθμός των δειγμάτων ήταν μικρός.", "prose"),
        ("Zespół zbadał próbki z pierwszej serii. Wyniki były stabilne w obu grupach, choć liczba próbek była niewielka i należy je powtórzyć.", "prose"),
        ("研究チームは最初のシリーズの試料を調べた。結果は両方の群で安定していたが、試料の数は少なかった。", "prose"),
        ("فحص الفريق عينات السلسلة الأولى. كانت النتائج مستقرة في المجموعتين، على الرغم من أن عدد العينات كان صغيرا.", "prose"),
        ("Ryhmä tutki ensimmäisen sarjan näytteet. Tulokset olivat vakaita molemmissa ryhmissä, vaikka näytteiden määrä oli pieni.", "prose"),
        ("xkcd qwrt plmn bvcx zxcv hjkl mnbv qwrtp sdfg hjklp. wrtp sdfgh jklz xcvb nmqw rtpsd fghj klzx.", "junk"),
        ("aBcDeF gHiJkL mNoPqR sTuVwX yZaBcD eFgHiJ kLmNoP qRsTuV wXyZaB cDeFgH.", "junk"),
    ],
)
def test_form(text, form):
    assert text_quality.statistics(text)[1] == form


def test_statistics_table(spark):
    df = spark.createDataFrame([(1, "One line.\nOne line.\n\nOne more line."), (2, None), (3, ""), (4, "word " * 200_000)], "doc_id long, text string")
    rows = {r["doc_id"]: r for r in text_quality.text_statistics(df).collect()}
    assert rows[1]["n_words"] == 7 and abs(rows[1]["repeated_line_share"] - 1 / 3) < 1e-9 and rows[1]["line_end_share"] == 1
    assert rows[2]["form"] is None and rows[2]["n_words"] is None and rows[3]["n_words"] == 0 and rows[4]["n_words"] == 200_000 and rows[4]["top_ngram_share"] > 0.99
    assert text_quality.text_statistics(df.limit(0)).count() == 0


def test_one_sentence_over_and_over_is_junk():
    once = "The data of this page are subject to the terms of use and may not be copied."
    rest = " ".join(f"The sample of patient {k} was taken on the day {k + 3} and sent to the laboratory {k * 7} of the clinic." for k in range(40))
    assert {text_quality.statistics(glue.join([once] * 300))[1] for glue in (" ", "\n", "\n\n")} == {"junk"}
    assert text_quality.statistics(once)[1] == "prose" and text_quality.statistics(f"{rest} {' '.join([once] * 10)}")[1] == "prose"

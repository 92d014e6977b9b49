"""Scores of choices, exam answers and judges."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import capitals, let

LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def argmax(choices: Column) -> Column:
    """The choice of greatest probability in an array of (choice, prob); of equals the earliest."""
    best = F.aggregate(choices, F.lit(None).cast("struct<choice:string,prob:double>"), lambda b, x: F.when(b.isNull() | (x["prob"] > b["prob"]), F.struct(x["choice"].alias("choice"), x["prob"].cast("double").alias("prob"))).otherwise(b))
    return best["choice"]


def top_probability(probs: Column, token: Column) -> Column:
    """Probability of a token with or without a space before it; 0 if neither is known."""
    zero = F.lit(0.0)
    return F.greatest(F.coalesce(F.try_element_at(probs, token), zero), F.coalesce(F.try_element_at(probs, F.concat(F.lit(" "), token)), zero))


def first_character(text: Column) -> Column:
    """First character of an answer; of a blank one none, which equals no gold answer."""
    return F.substring(F.trim(text), 1, 1)


def exam_parts(text: Column) -> Column:
    return F.transform(F.split(text, ","), lambda x: F.trim(x))


def exam_choice(answer: Column, predicted: Column) -> Column:
    """1 if both comma lists are one set."""
    a, p = F.array_distinct(F.split(answer, ",")), F.array_distinct(exam_parts(predicted))
    both = F.size(F.array_intersect(a, p))
    return ((both == F.size(a)) & (both == F.size(p))).cast("int")


def exam_choice_graded(answer: Column, predicted: Column) -> Column:
    """Points less one for each answer too many; short answers are filled up with wrong ones first."""
    a, p = F.split(answer, ","), exam_parts(predicted)
    n = F.greatest(F.size(p), F.size(a))
    return F.greatest(F.lit(0), F.size(F.array_intersect(F.array_distinct(a), F.array_distinct(p))) - n + F.size(a))


def exam_matching(answer: Column, predicted: Column) -> Column:
    """Places that agree; 0 if the lists differ in length."""
    a, p = F.split(answer, ","), exam_parts(predicted)
    hits = F.size(F.filter(F.zip_with(a, p, lambda x, y: x == y), lambda x: x))
    return F.when(F.size(a) == F.size(p), hits).otherwise(0)


def exam_text(answer: Column, predicted: Column) -> Column:
    """1 if the prediction's letters, in lower case, are one of the answers."""
    plain = F.lower(F.regexp_replace(predicted, r"[^\p{L}_]", ""))
    return F.array_contains(F.split(answer, ","), plain).cast("int")


def exam_score(kind: Column, task: Column, answer: Column, predicted: Column) -> Column:
    p = F.trim(predicted)
    return F.when(kind == "matching", exam_matching(answer, p)).when(kind == "text", exam_text(answer, p)).when(task == "16", exam_choice_graded(answer, p)).otherwise(exam_choice(answer, p))


def winner(m: Column, other: Column) -> Column:
    return F.when(m > other, "m").when(m < other, "M").otherwise("T")


def judge_decision(cm: Column, cM: Column, lm: Column, lM: Column, sm: Column, sM: Column) -> Column:
    """Content decides, or content with language where they are more than 2 apart in language; then language, then style."""
    content, language, style = winner(cm, cM), winner(lm, lM), winner(sm, sM)
    total = winner(cm + lm, cM + lM)
    apart = F.abs(lm - lM) > 2
    return F.when(content == "T", F.when(language != "T", language).otherwise(style)).when(apart, F.when(total != "T", total).otherwise(style)).otherwise(content)


def judge_scores(response: Column) -> Column:
    """Scores in a judge's JSON, 5 where one is missing; null if there is no JSON even after repair of quotes and keys."""
    found = F.regexp_extract(response, r"(?s)\{.*\}", 0)
    mended = F.regexp_replace(F.regexp_replace(found, "'", '"'), r"([\p{L}\p{N}_]+):", '"$1":')
    parsed = lambda x: F.from_json(x, "map<string,struct<score:string>>")
    score = lambda data, name: F.coalesce(F.try_element_at(data, F.lit(name))["score"].try_cast("double"), F.lit(5.0))
    # Names differ in case only, so they are keys of a map; the text is read once.
    names = ("content_m", "content_M", "language_m", "language_M", "style_m", "style_M")
    return let(F.coalesce(parsed(found), parsed(mended)), lambda data: F.when((found != "") & data.isNotNull(), F.array(*[score(data, n) for n in names])))


def outcome(decision: Column, label: Column) -> Column:
    """Who won a battle; a failed reading is a tie."""
    return F.when(decision.isNull() | (decision == "T"), "tie").when(decision == label, "model_wins").otherwise("reference_wins")


def judge_outcome(response: Column, label: Column) -> Column:
    return let(judge_scores(response), lambda s: outcome(F.when(s.isNotNull(), judge_decision(*[s[i] for i in range(6)])), label))


def yes(response: Column) -> Column:
    """1 for an answer that starts with Yes."""
    return F.ltrim(response).startswith("Yes").cast("int")


def kinopoisk_gold(label: Column) -> Column:
    return (label + 1).cast("string")


def gold_letter(answer: Column) -> Column:
    """Letter of an answer, Cyrillic look-alikes as Latin ones (fixed values)."""
    return F.translate(capitals(F.trim(answer)), "АВСЕ", "ABCE")


def starts_gold(gold: Column, predicted: Column) -> Column:
    """1 if the gold answer starts with the prediction."""
    return F.startswith(gold, predicted).cast("int")

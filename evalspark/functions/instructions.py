"""Checks of instructions on responses, by identifier; each gives a boolean column."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import WORD, count_of, let, overlap


def col(x) -> Column:
    """A column as it is, anything else as a literal: checks take their arguments as either."""
    return x if isinstance(x, Column) else F.lit(x)


def relation(n: Column, how, value) -> Column:
    """``less than`` or ``at least`` a number."""
    return F.when(col(how) == "less than", n < value).otherwise(n >= value)


def blank(text: Column) -> Column:
    return ~text.rlike(r"\S")


def bare(text: Column) -> Column:
    """Without white space at the ends."""
    return F.regexp_extract(text, r"(?s)\A\s*+(.*\S)", 1)


def parts(text: Column, pattern: str) -> Column:
    return F.split(text, pattern, -1)


def listed(keywords) -> Column:
    return keywords if isinstance(keywords, Column) else F.array(*map(F.lit, keywords))


def every(conditions) -> Column:
    return reduce(lambda a, b: a & b, conditions, F.lit(True))


def existence(r, keywords, lemma=None):
    """With a :class:`lemmas.Lemmatiser`, a keyword's lemmas are looked for among those of the response."""
    if lemma:
        return F.forall(lemma.counts(r, listed(keywords)), lambda n: n > 0)
    if not isinstance(keywords, Column):  # a pattern that is known is compiled once
        return every(r.rlike(f"(?iu){k}") for k in keywords)
    return F.forall(keywords, lambda k: F.regexp_like(r, F.concat(F.lit("(?iu)"), k)))


def frequency(r, keyword, how, value, lemma=None):
    n = lemma.counts(r, F.array(col(keyword)))[0] if lemma else F.regexp_count(r, F.concat(F.lit("(?iu)"), col(keyword)))
    return relation(n, how, value)


def forbidden(r, words, lemma=None):
    if lemma:
        return ~F.exists(lemma.counts(r, listed(words), whole=True), lambda n: n > 0)
    if not isinstance(words, Column):
        return every(~r.rlike(rf"(?iuU)\b{w}\b") for w in words)
    return ~F.exists(words, lambda w: F.regexp_like(r, F.concat(F.lit(r"(?iuU)\b"), w, F.lit(r"\b"))))


def letter_frequency(r, letter, how, value):
    if isinstance(letter, str) and len(letter) == 1 and letter.isascii() and letter.isalnum():
        # All letters of which the lower case has this one, in one pass.
        forms = "".join(c for c in map(chr, range(0x10000)) if letter.lower() in c.lower())
        return relation(F.length(F.regexp_replace(r, f"[^{forms}]++", "")), how, value)
    low = F.lower(r)
    return relation(F.length(low) - F.length(F.replace(low, F.lower(col(letter)), F.lit(""))), how, value)


#: Frequent words that tell languages of Latin script apart.
FREQUENT = {"en": "the and of to is that for with was this are you", "fr": "le les des et est une dans pour que qui vous avec", "de": "der die und das ist nicht ein eine mit den zu auf", "es": "el los las y es una para que por con del se", "it": "il gli che di e una per con non sono della è"}


#: Scripts of languages that aren't written in Latin letters.
SCRIPTS = {"ru": "Cyrillic", "uk": "Cyrillic", "bg": "Cyrillic", "ar": "Arabic", "fa": "Arabic", "ur": "Arabic", "hi": "Devanagari", "mr": "Devanagari", "ne": "Devanagari", "bn": "Bengali", "th": "Thai", "ta": "Tamil", "te": "Telugu", "kn": "Kannada", "gu": "Gujarati", "pa": "Gurmukhi", "ml": "Malayalam", "he": "Hebrew", "ko": "Hangul", "ja": "Hiragana"}


#: Frequent words of all languages between characters that no word has, by first letter.
FIRST = sorted({w[0] for v in FREQUENT.values() for w in v.split()})
WORDS_OF = "|".join(f"{a}(?:{'|'.join(sorted({w[1:] for v in FREQUENT.values() for w in v.split() if w[0] == a}, key=len, reverse=True))})" for a in FIRST)
FOUND = rf"(?<![\p{{L}}\p{{M}}\p{{N}}_])(?:{WORDS_OF})(?![\p{{L}}\p{{M}}\p{{N}}_])"


def most_frequent(r, lang):
    """Whether no language has more frequent words in a text than this one; they are looked for once."""
    found = F.regexp_extract_all(F.lower(r), F.lit(FOUND), F.lit(0))
    of = lambda ws, x: F.size(F.filter(ws, lambda w: w.isin(*FREQUENT[x].split())))
    return let(found, lambda ws: of(ws, lang) >= F.greatest(*[of(ws, x) for x in FREQUENT if x != lang]))


def script_letters(r, script):
    return F.length(F.regexp_replace(r, rf"\P{{Is{script}}}++", ""))


def language(r, lang, model=None):
    """By a :class:`languages.LanguageModel`, where it knows the language; else by script, and in Latin script by the
    language whose frequent words are most; texts that tell nothing pass. A column's languages are told one by one."""
    if isinstance(lang, Column):
        return F.coalesce(*[F.when(lang == x, language(r, x, model)) for x in (*FREQUENT, *SCRIPTS, "pt", "pl", "vi", "sw", "fi")], F.lit(True))
    if model is not None and lang in model.langs:
        return F.coalesce(model.guess(r) == lang, F.lit(True))
    if lang in SCRIPTS:
        own, latin = script_letters(r, SCRIPTS[lang]), script_letters(r, "Latin")
        return F.when(own + latin == 0, ~r.rlike(r"\p{L}")).otherwise(own > latin)
    # Letters are counted only where a text has those of both scripts.
    latin, cyrillic = r.rlike(r"\p{IsLatin}"), r.rlike(r"[\x{400}-\x{10FFFF}]") & r.rlike(r"\p{IsCyrillic}")
    own = most_frequent(r, lang) if lang in FREQUENT else F.lit(True)
    return F.when(cyrillic, (script_letters(r, "Latin") >= script_letters(r, "Cyrillic")) & own).when(latin, own).otherwise(True)


def sentences(r, how, value, model=None):
    """By a :class:`sentences.SentenceModel`; without one, runs of text that end with . ! or ?, or with the text."""
    if model is not None:
        return relation(model.count(r), how, value)
    return relation(count_of(r"[^.!?\s][^.!?]*([.!?]+|$)", r), how, value)


def paragraphs(r, value):
    p = parts(r, r"\s?\*\*\*\s?")
    n = F.size(p)
    inner = F.when(n > 2, F.exists(F.slice(p, 2, F.greatest(n - 2, F.lit(0))), blank)).otherwise(False)
    ends = blank(F.element_at(p, 1)).cast("int") + F.when(n > 1, blank(F.element_at(p, -1)).cast("int")).otherwise(0)
    return ~inner & (n - ends == value)


def word_count(r, how, value):
    return relation(count_of(WORD, r), how, value)


def nth_paragraph(r, total, nth, first):
    p = parts(r, "\n\n")
    n = F.size(F.filter(p, lambda x: ~blank(x)))
    own = bare(F.coalesce(F.when(col(nth) > 0, F.try_element_at(p, F.greatest(col(nth).cast("int"), F.lit(1)))), F.lit("")))
    word = F.regexp_replace(F.regexp_replace(F.regexp_extract(own, r"^\S+", 0), "^'+", ""), '^"+', "")
    return (n >= nth) & (own != "") & (n == total) & (F.lower(F.regexp_extract(word, "^[^.,?!'\"]*", 0)) == first)


def placeholders(r, value):
    return count_of(r"\[.*?\]", r) >= value


def postscript(r, marker):
    marker = col(marker)
    pattern = F.when(marker == "P.P.S", r"p\.\s?p\.\s?s").when(marker == "P.S.", r"p\.\s?s\.").otherwise(F.lower(marker))
    return F.regexp_like(F.lower(r), pattern)


def bullets(r, value):
    return count_of(r"(?m)^\s*\*[^*].*$", r) + count_of(r"(?m)^\s*-.*$", r) == value


def constrained(r, options):
    return F.exists(F.array(*[r.contains(o) for o in options]), lambda x: x)


def highlighted(r, value):
    one = F.filter(F.regexp_extract_all(r, F.lit(r"(\*[^\n*]*\*)"), F.lit(1)), lambda x: ~blank(F.replace(x, F.lit("*"), F.lit(""))))
    two = F.filter(F.regexp_extract_all(r, F.lit(r"(\*\*[^\n*]*\*\*)"), F.lit(1)), lambda x: ~blank(F.replace(x, F.lit("*"), F.lit(""))))
    return F.size(one) + F.size(two) >= value


def sections(r, splitter, value):
    return F.regexp_count(r, F.concat(F.lit(r"\s?"), col(splitter), F.lit(r"\s?\d+\s?"))) >= value


def sections_ru(r, splitter, value):
    return F.regexp_count(r, F.concat(F.lit(" ?"), col(splitter), F.lit(" ?[0-9A-Za-z]"))) >= value


def json_format(r):
    """Whether a response, its fences removed, is one JSON value from end to end. Readers stop after the first value, so it
    is put between brackets and between braces: what closes the one too soon is an error in the other."""
    body = bare(F.regexp_replace(F.regexp_replace(bare(r), "^```(json|Json|JSON)?", ""), "```$", ""))
    strict = {"allowSingleQuotes": "false", "columnNameOfCorruptRecord": "bad"}
    listed_ = F.from_json(F.concat(F.lit("["), body, F.lit("]")), "array<string>", strict)
    held = F.from_json(F.concat(F.lit('{"a":'), body, F.lit("}")), "a string, bad string", strict)
    return F.when(r.rlike(r'\A\s*+(?:```|[\[{"0-9tfnNI-])'), (F.size(listed_) == 1) & held["bad"].isNull()).otherwise(False)


def title(r):
    return F.exists(F.regexp_extract_all(r, F.lit(r"(<<[^\n]+>>)"), F.lit(1)), lambda x: ~blank(F.regexp_replace(x, "^<+|>+$", "")))


def two_responses(r):
    p = parts(r, r"\*\*\*\*\*\*")
    n = F.size(p)
    inner = F.when(n > 2, F.exists(F.slice(p, 2, F.greatest(n - 2, F.lit(0))), blank)).otherwise(False)
    full = F.filter(p, lambda x: ~blank(x))
    return F.when(~inner & (F.size(full) == 2), bare(F.try_element_at(full, F.lit(1))) != bare(F.try_element_at(full, F.lit(2)))).otherwise(False)


def repeat_prompt(r, prompt):
    return F.lower(bare(r)).startswith(F.lower(bare(prompt)))


def end_checker(r, phrase):
    return F.lower(F.regexp_replace(bare(r), '^"+|"+$', "")).endswith(F.lower(bare(col(phrase))))


def quotation(r):
    return r.rlike(r'(?s)\A\s*+".*"\s*\z')


def capital_words(r, how, value):
    """Words between white space and marks that have letters, all upper case."""
    tokens = F.regexp_extract_all(r, F.lit(r"([\p{L}\p{N}_'-]+)"), F.lit(1))
    return relation(F.size(F.filter(tokens, lambda t: (F.upper(t) == t) & (F.lower(t) != t))), how, value)


def all_capital(r, lang, model=None):
    return (F.upper(r) == r) & (F.lower(r) != r) & language(r, lang, model)


def all_lower(r, lang, model=None):
    return (F.lower(r) == r) & (F.upper(r) != r) & language(r, lang, model)


def no_comma(r):
    return ~r.contains(",")


def constrained_start(r, starter):
    return r.rlike(rf"(?m)^\s*{starter}.*$")


def rephrase(r, reference):
    strip = lambda x: F.regexp_replace(x, r"\*.*\*", "")
    return r.rlike(r"\*.*\*") & (strip(r) == strip(reference))


def key_sentences(r, keys, value):
    """Sentences end with . ! or ? before white space."""
    found = F.transform(F.split(F.regexp_replace(F.regexp_replace(r, "\n", " "), r"([.!?])\s+", "$1\n"), "\n"), bare)
    return F.size(F.array_intersect(found, F.array(*[F.lit(k) for k in keys]))) == value


def rephrase_paragraph(r, original, low, high):
    of = lambda x: F.regexp_extract_all(F.lower(x), F.lit(f"({WORD})"), F.lit(1))
    return overlap(of(original), of(r)).between(low, high)


#: Checks by identifier. The last four aren't part of the registered set.
CHECKS = {
    "keywords:existence": existence, "keywords:frequency": frequency, "keywords:forbidden_words": forbidden, "keywords:letter_frequency": letter_frequency,
    "language:response_language": language, "length_constraints:number_sentences": sentences, "length_constraints:number_paragraphs": paragraphs, "length_constraints:number_words": word_count, "length_constraints:nth_paragraph_first_word": nth_paragraph,
    "detectable_content:number_placeholders": placeholders, "detectable_content:postscript": postscript, "detectable_format:number_bullet_lists": bullets, "detectable_format:constrained_response": constrained, "detectable_format:number_highlighted_sections": highlighted, "detectable_format:multiple_sections": sections, "detectable_format:json_format": json_format, "detectable_format:title": title,
    "combination:two_responses": two_responses, "combination:repeat_prompt": repeat_prompt, "startend:end_checker": end_checker, "startend:quotation": quotation,
    "change_case:capital_word_frequency": capital_words, "change_case:english_capital": all_capital, "change_case:english_lowercase": all_lower, "punctuation:no_comma": no_comma,
    "multi-turn:constrained_start": constrained_start, "detectable_format:rephrase": rephrase, "keywords:key_sentences": key_sentences, "detectable_content:rephrase_paragraph": rephrase_paragraph,
}


def follows(identifier: str, response: Column, *args) -> Column:
    """Whether a response isn't blank and passes the check."""
    return ~blank(response) & CHECKS[identifier](response, *args)


#: The answers of which a constrained response has one.
OPTIONS = {"en": ("My answer is yes.", "My answer is no.", "My answer is maybe."), "ru": ("Мой ответ — да", "Мой ответ — нет", "Мой ответ — возможно")}
#: Arguments of the checks by identifier, in order, as data sets name them.
ARGUMENTS = {
    "keywords:existence": ("keywords",), "keywords:frequency": ("keyword", "relation", "frequency"), "keywords:forbidden_words": ("forbidden_words",), "keywords:letter_frequency": ("letter", "let_relation", "let_frequency"),
    "language:response_language": ("language",), "length_constraints:number_sentences": ("relation", "num_sentences"), "length_constraints:number_paragraphs": ("num_paragraphs",), "length_constraints:number_words": ("relation", "num_words"), "length_constraints:nth_paragraph_first_word": ("num_paragraphs", "nth_paragraph", "first_word"),
    "detectable_content:number_placeholders": ("num_placeholders",), "detectable_content:postscript": ("postscript_marker",), "detectable_format:number_bullet_lists": ("num_bullets",), "detectable_format:constrained_response": (), "detectable_format:number_highlighted_sections": ("num_highlights",), "detectable_format:multiple_sections": ("section_spliter", "num_sections"), "detectable_format:json_format": (), "detectable_format:title": (),
    "combination:two_responses": (), "combination:repeat_prompt": ("prompt_to_repeat",), "startend:end_checker": ("end_phrase",), "startend:quotation": (),
    "change_case:capital_word_frequency": ("capital_relation", "capital_frequency"), "change_case:english_capital": (), "change_case:english_lowercase": (), "punctuation:no_comma": (),
}
LISTS = ("keywords", "forbidden_words")
NUMBERS = re.compile("num_.*|nth_paragraph|.*frequency")


def follows_given(identifier: Column, response: Column, given: Column, lang: str) -> Column:
    """Whether a response follows the instruction that a row names, with the arguments that the row gives as JSON.

    An unknown instruction, one without its arguments, and a blank response aren't followed.
    """
    names = sorted({n for a in ARGUMENTS.values() for n in a})
    found = F.from_json(given, ", ".join(f"{n} string" for n in names))

    def argument(name):
        value = found[name]
        return F.from_json(value, "array<string>") if name in LISTS else value.cast("double").cast("int") if NUMBERS.fullmatch(name) else value

    def one(i):
        if i == "detectable_format:constrained_response":
            return constrained(response, OPTIONS[lang])
        if i.startswith("change_case:english_"):
            return CHECKS[i](response, lang)
        check = sections_ru if lang == "ru" and i == "detectable_format:multiple_sections" else CHECKS[i]
        return check(response, *map(argument, ARGUMENTS[i]))

    known = F.coalesce(*[F.when(identifier == i, one(i)) for i in ARGUMENTS], F.lit(False))
    return F.when(blank(response), False).otherwise(known)


def results_given(response: Column, identifiers: Column, given: Column, lang: str) -> Column:
    """Array of (instruction_id, category, followed) of a row's own instructions: parallel arrays of identifiers and JSON."""
    return F.transform(identifiers, lambda x, i: F.struct(x.alias("instruction_id"), F.element_at(F.split(x, ":"), 1).alias("category"), follows_given(x, response, F.get(given, i), lang).alias("followed")))


def results(response: Column, instructions: list[tuple]) -> Column:
    """Array of (instruction_id, category, followed) for (identifier, *arguments)."""
    return F.array(*[F.struct(F.lit(i[0]).alias("instruction_id"), F.lit(i[0].split(":")[0]).alias("category"), F.coalesce(follows(i[0], response, *i[1:]), F.lit(False)).alias("followed")) for i in instructions])

"""Entities, spans and opinions as column expressions."""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .plain import in_slices
from .text import small


def unfenced(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(F.trim(text), "^```(json)?", ""), "```$", ""))


def parse_tag_lines(text: Column) -> Column:
    """Map of tag to entities from lines ``TAG: [a, b]``; the last line of a tag counts."""
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"^\s*[^:\[\]]+:\s*\[.*\]\s*$"))
    entry = lambda x: F.struct(F.trim(F.regexp_extract(x, r"^([^:\[\]]+):", 1)).alias("tag"), F.filter(F.transform(F.split(F.regexp_extract(x, r"\[(.*)\]", 1), ","), lambda e: F.trim(e)), lambda e: e != "").alias("entities"))
    entries = F.transform(lines, entry)
    last = F.filter(entries, lambda x, i: ~F.exists(F.slice(entries, i + 2, F.greatest(F.size(entries) - i - 1, F.lit(0))), lambda y: y["tag"] == x["tag"]))
    return F.map_from_entries(last)


def parse_json_entities(text: Column) -> Column:
    """Array of [tag, entity] pairs from JSON, fences removed; none if it doesn't parse."""
    return F.coalesce(F.from_json(unfenced(text), "array<array<string>>"), F.array().cast("array<array<string>>"))


def parse_inline(text: Column, tag: str) -> Column:
    """Entities marked <TAG>...</TAG> in a text."""
    return F.regexp_extract_all(text, F.lit(f"<{tag}>(.*?)</{tag}>"), F.lit(1))


def same_text(marked: Column, text: Column) -> Column:
    """Whether a marked text, without tags and white space, is the text."""
    plain = lambda x: F.regexp_replace(F.regexp_replace(x, r"</?[\p{L}\p{N}_-]+>", ""), r"\s+", "")
    return plain(marked) == F.regexp_replace(text, r"\s+", "")


@F.arrow_udf(T.ArrayType(T.StructType([T.StructField("token", T.StringType()), T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())])))
def token_offsets(text: pa.Array) -> pa.Array:
    """(token, start, end) between white space, in one pass over a text."""
    found = lambda t: [{"token": m[0], "start": m.start(), "end": m.end()} for m in re.finditer(r"[^\t-\r ]+", t)]
    return in_slices(lambda t: None if t is None else found(t), OFFSETS, text)


OFFSETS = pa.list_(pa.struct([("token", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))


def tokens_in(offsets: Column, start: Column, end: Column) -> Column:
    """Indexes of the tokens that a stretch of characters touches."""
    marked = F.transform(offsets, lambda t, i: F.struct(i.alias("i"), ((t["start"] < end) & (t["end"] > start)).alias("in")))
    return F.transform(F.filter(marked, lambda x: x["in"]), lambda x: x["i"])


def locate_span(text: Column, phrase: Column) -> Column:
    """(start, end) of a phrase: as it stands, or else in any case; AUTHOR and NULL have none."""
    at = F.when(F.instr(text, phrase) > 0, F.instr(text, phrase)).otherwise(F.instr(small(text), small(phrase)))
    none = phrase.isin("AUTHOR", "NULL") | (at == 0)
    return F.when(~none, F.struct((at - 1).alias("start"), (at - 1 + F.length(phrase)).alias("end")))


def coverage(gold: Column, predicted: Column) -> Column:
    """Share of the gold token indexes that the prediction has; 1 if both are empty."""
    return F.when(F.size(gold) == 0, (F.size(predicted) == 0).cast("double")).otherwise(F.size(F.array_intersect(gold, predicted)) / F.size(gold))


def opinion_match(gold: Column, predicted: Column) -> Column:
    """Whether holder, target and expression each overlap (or are both empty) and the polarity agrees."""
    meets = lambda f: F.when((F.size(gold[f]) == 0) | (F.size(predicted[f]) == 0), F.size(gold[f]) == F.size(predicted[f])).otherwise(F.arrays_overlap(gold[f], predicted[f]))
    return meets("holder") & meets("target") & meets("expr") & (gold["polarity"] == predicted["polarity"])


def opinion_weight(gold: Column, predicted: Column) -> Column:
    """Mean coverage of holder, target and expression."""
    return (coverage(gold["holder"], predicted["holder"]) + coverage(gold["target"], predicted["target"]) + coverage(gold["expr"], predicted["expr"])) / 3


def distinct_opinions(opinions: Column) -> Column:
    """Opinions in order, without those whose (holder, target, polarity) an earlier kept one has with an overlapping expression."""
    empty = F.slice(opinions, 1, 0)
    clash = lambda a, b: (a["holder"] == b["holder"]) & (a["target"] == b["target"]) & (a["polarity"] == b["polarity"]) & ((a["expr"] == b["expr"]) | F.arrays_overlap(a["expr"], b["expr"]))
    return F.aggregate(opinions, empty, lambda kept, o: F.when(F.exists(kept, lambda k: clash(k, o)), kept).otherwise(F.array_append(kept, o)))


def bio_valid(tags: Column) -> Column:
    """No I tag without the same base before it; 2k-1 begins and 2k goes on with entity k, 0 is outside."""
    base = lambda t: F.floor((t + 1) / 2)
    before = F.concat(F.array(F.lit(0).cast("int")), F.slice(tags, 1, F.greatest(F.size(tags) - 1, F.lit(0))))
    return ~F.exists(F.zip_with(tags, before, lambda t, p: (t > 0) & (t % 2 == 0) & (base(t) != base(p))), lambda x: x)


def opinions_from_json(text: Column) -> Column:
    """Opinions of a model's JSON; anything else gives none, and nothing is evaluated as code."""
    schema = "array<struct<Source:string,Target:string,Polarity:string,Expression:string>>"
    found = F.coalesce(F.from_json(unfenced(text), schema), F.array().cast(schema))
    return F.filter(found, lambda o: o["Source"].isNotNull() & o["Target"].isNotNull() & o["Expression"].isNotNull() & o["Polarity"].isin("POS", "NEG"))


def valid_opinions(text: Column, opinions: Column) -> Column:
    """Opinions whose phrases occur in the text, in any case."""
    within = lambda p: p.isin("AUTHOR", "NULL") | small(text).contains(small(p))
    return F.filter(opinions, lambda o: within(o["Source"]) & within(o["Target"]) & within(o["Expression"]))


#: Tokens of a text to be tagged, and the marks that take no space before or after them.
TOKENS = r"(?U)\d+.\d+|\w+|\.{3}|[.,!?:;()\[\]«»]"
CLOSE, OPEN = (".", ",", "!", "?", ":", ";", "»", ")", "..."), ("(", "«")


def tag_tokens(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(TOKENS), F.lit(0))


def join_tokens(tokens: Column) -> Column:
    """Tokens as a text: spaces between them, but not before closing marks and not after opening ones."""
    init = F.struct(F.lit("").alias("text"), F.lit("").alias("last"))
    spaced = lambda a, t: F.when(t.isin(*CLOSE) | a["last"].isin(*OPEN) | (a["last"] == ""), t).otherwise(F.concat(F.lit(" "), t))
    return F.aggregate(tokens, init, lambda a, t: F.struct(F.concat(a["text"], spaced(a, t)).alias("text"), t.alias("last")))["text"]


def without_brackets(tokens: Column, tags: Column) -> Column:
    """(token, tag) pairs of two parallel arrays, without square brackets."""
    return F.filter(F.transform(tokens, lambda t, i: F.struct(t.alias("token"), F.get(tags, i).alias("tag"))), lambda x: ~x["token"].isin("[", "]"))


def annotations(lines: Column) -> Column:
    """(begin, end, tag, text) of annotation lines ``id TAG begin end[;begin end] text``, a row for each stretch; by begin,
    the longer one first."""
    line = r"^\w+\s(\w+)\s(\d+\s\d+(?:;\d+\s\d+)*)\s(.+)"
    part = lambda x, k: F.regexp_extract(x, line, k)
    number = lambda pair, k: F.element_at(F.split(pair, r"\s"), k).cast("int")
    each = lambda x: F.transform(F.split(part(x, 2), ";"), lambda p: F.struct(number(p, 1).alias("begin"), (-number(p, 2)).alias("back"), part(x, 1).alias("tag"), part(x, 3).alias("text")))
    found = F.flatten(F.transform(F.filter(lines, lambda x: x.rlike(line)), each))
    return F.transform(F.array_sort(found), lambda x: F.struct(x["begin"].alias("begin"), (-x["back"]).alias("end"), x["tag"].alias("tag"), x["text"].alias("text")))


def parallel_spans(begin: Column, end: Column, tag: Column, text: Column) -> Column:
    """(begin, end, tag, text) of four parallel arrays, by begin; of equals in their order."""
    rows = F.transform(begin, lambda b, i: F.struct(b.alias("begin"), i.alias("i"), F.get(end, i).alias("end"), F.get(tag, i).alias("tag"), F.get(text, i).alias("text")))
    return F.transform(F.array_sort(rows), lambda x: F.struct(x["begin"].alias("begin"), x["end"].alias("end"), x["tag"].alias("tag"), x["text"].alias("text")))


def strings(json: Column) -> Column:
    """A JSON column as an array of strings."""
    return F.from_json(json, "array<string>")


def opinion_sums(gold: Column, predicted: Column, match=opinion_match, weight=opinion_weight) -> Column:
    """(wp, np, wr, nr) of a sample's opinions: weights of those that have a match on the other side, and how many there are.

    The weight of one is its best over its matches.
    """
    best = lambda o, others, of: F.coalesce(F.array_max(F.transform(F.filter(others, lambda x: match(o, x)), lambda x: of(o, x))), F.lit(0.0))
    total = lambda xs, others, of: F.aggregate(xs, F.lit(0.0), lambda n, o: n + best(o, others, of))
    size = lambda x: F.size(x).cast("double")
    return F.struct(total(predicted, gold, lambda o, x: weight(o, x)).alias("wp"), size(predicted).alias("np"), total(gold, predicted, lambda o, x: weight(o, x)).alias("wr"), size(gold).alias("nr"))

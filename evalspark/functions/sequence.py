"""Scores that built-in functions can't express, as Arrow UDFs."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .algebra import NEAR, figure, same_answer
from .plain import SLICE, blocks_cover, boxed, grams, in_slices, lcs, marked, nested_entities, stops, tag_counts, tagged_entities, token_counts
from .plain import overlap as shared


def overlap(n: int = 1):
    """Arrow UDF: (same, np, ng) of the n-grams of two token arrays as multisets, a row at a time in linear time."""

    kind = pa.struct([(c, pa.int32()) for c in ("same", "np", "ng")])

    def one(p, g):
        p, g = (grams(x or [], n) if n > 1 else x or [] for x in (p, g))
        return {"same": shared(p, g), "np": len(p), "ng": len(g)}

    @F.arrow_udf("struct<same:int,np:int,ng:int>")
    def count(predicted: pa.Array, gold: pa.Array) -> pa.Array:
        return in_slices(one, kind, predicted, gold)

    return count


def lemmas(make):
    """Arrow UDF of word arrays from a factory, called once a batch on the executor, of a function from word to lemma."""

    @F.pandas_udf("array<string>")
    def each(words: pd.Series) -> pd.Series:
        lemma, known = make(), {}
        get = lambda w: known[w] if w in known else known.setdefault(w, lemma(w))
        return pd.Series([None if ws is None else [get(w) for w in ws] for ws in words])

    return each


def over_golds(metric):
    """Arrow UDF: the greatest value of a plain function of (predicted, gold) over an array of gold answers; 0 without any."""

    @F.pandas_udf("double")
    def best(predicted: pd.Series, golds: pd.Series) -> pd.Series:
        return pd.Series([max((float(metric(p or "", g or "")) for g in (() if gs is None else gs)), default=0.0) for p, gs in zip(predicted, golds)], dtype="float64")

    return best


@F.pandas_udf(T.DoubleType())
def best_f1(predicted: pd.Series, golds: pd.Series) -> pd.Series:
    """The best token F1 of a prediction's words over arrays of gold words, in linear time; 0 without any, and where either
    has no words, 1 if neither has."""

    def one(p, g):
        if not p or not g:
            return float(not p and not g)
        return 2.0 * shared(p, g) / (len(p) + len(g))

    lists = lambda gs: [list(g) for g in (() if gs is None else gs)]
    return pd.Series([max((one([] if p is None else list(p), g) for g in lists(gs)), default=0.0) for p, gs in zip(predicted, golds)], dtype="float64")


@F.pandas_udf(T.DoubleType())
def rouge_l(predicted: pd.Series, gold: pd.Series) -> pd.Series:
    """F-measure of the longest common subsequence of two token arrays."""

    def one(p, g):
        same = lcs(p, g) if p is not None and g is not None else 0
        return 2.0 * same / (len(p) + len(g)) if same else 0.0

    return pd.Series([one(p, g) for p, g in zip(predicted, gold)], dtype="float64")


@F.pandas_udf(T.DoubleType())
def copied(source: pd.Series, predicted: pd.Series) -> pd.Series:
    """1 if matching blocks cover 99 % of the source."""
    return pd.Series([float(blocks_cover((a or "").strip(), (b or "").strip(), 0.99)) for a, b in zip(source, predicted)], dtype="float64")


@F.pandas_udf(T.ArrayType(T.StructType([T.StructField("tag", T.StringType()), T.StructField("entity", T.StringType())])))
def parse_nested(text: pd.Series) -> pd.Series:
    return pd.Series([[{"tag": t, "entity": e} for t, e in nested_entities(x or "")] for x in text])


ENTITIES = T.ArrayType(T.StructType([T.StructField("tag", T.StringType()), T.StructField("entity", T.StringType())]))


@F.pandas_udf(T.StructType([T.StructField("entities", ENTITIES), T.StructField("tokens", T.ArrayType(T.StringType()))]))
def bio(tokens: pd.Series, tags: pd.Series) -> pd.DataFrame:
    """(entities, tokens with each entity as one between its marks) of token and tag arrays; the shorter one counts."""
    rows = [tagged_entities(list(() if t is None else t), list(() if g is None else g)) for t, g in zip(tokens, tags)]
    return pd.DataFrame({"entities": [[{"tag": k, "entity": e} for k, e in found] for found, _ in rows], "tokens": [out for _, out in rows]})


@F.pandas_udf(T.StringType())
def inline(text: pd.Series, spans: pd.Series) -> pd.Series:
    """Texts with nested (begin, end, tag) marked."""
    return pd.Series([marked(t or "", [(s["begin"], s["end"], s["tag"]) for s in (() if ss is None else ss)]) for t, ss in zip(text, spans)])


def counts_by_tag(tags: tuple):
    """Arrow UDF: array of (tag, tp, fn, fp) of gold and found (tag, entity) as multisets, a row at a time."""

    kind = pa.list_(pa.struct([("tag", pa.string()), *((c, pa.int64()) for c in ("tp", "fn", "fp"))]))
    pairs = lambda x: [(e["tag"], e["entity"]) for e in x or () if e["entity"] is not None]

    @F.arrow_udf("array<struct<tag:string,tp:bigint,fn:bigint,fp:bigint>>")
    def count(gold: pa.Array, found: pa.Array) -> pa.Array:
        return in_slices(lambda g, f: [dict(zip(("tag", "tp", "fn", "fp"), r)) for r in tag_counts(pairs(g), pairs(f), tags)], kind, gold, found)

    return count


@F.arrow_udf(T.DoubleType())
def math_equal(predicted: pa.Array, gold: pa.Array) -> pa.Array:
    """1 if the boxed answer is the gold one, as :func:`algebra.same_answer` has it. A batch's texts are each read once, its
    plain numbers are compared as columns, and its other pairs once each."""
    left, right = (c.fill_null("").dictionary_encode() for c in (predicted, gold))
    own = [boxed(p) for p in left.dictionary.to_pylist()]
    want = [g if (inner := boxed(g)) is None else inner for g in right.dictionary.to_pylist()]
    i, j = (c.indices.to_numpy(zero_copy_only=False).astype("int64") for c in (left, right))
    x, y = (np.array([math.nan if t is None else figure(t) for t in texts], dtype="float64")[at] for texts, at in ((own, i), (want, j)))
    with np.errstate(invalid="ignore"):
        same, apart = x == y, np.abs(x - y) > NEAR * np.maximum(1.0, np.maximum(np.abs(x), np.abs(y)))
    out = same.astype("float64")
    rest = np.flatnonzero(~(same | apart))
    pairs, at = np.unique(i[rest] * len(want) + j[rest], return_inverse=True)
    held = ((own[k // len(want)], want[k % len(want)]) for k in pairs.tolist())
    out[rest] = np.array([float(p is not None and same_answer(p, g)) for p, g in held], dtype="float64")[at]
    return pa.array(out)


def counted_tokens(batches):
    """Arrow batches of texts as bytes to batches of (m, next, n), as :func:`plain.token_counts` has them."""
    texts = (t for b in batches for i in range(0, b.num_rows, SLICE) for t in b.column(0).slice(i, SLICE).to_pylist())
    for one, two, n in token_counts(texts):
        yield pa.RecordBatch.from_arrays([pa.array(one, pa.binary()).cast(pa.string()), pa.array(two, pa.binary()).cast(pa.string()), pa.array(n, pa.int64())], ["m", "next", "n"])


PAIRS = T.ArrayType(T.StructType([T.StructField("m", T.StringType()), T.StructField("next", T.StringType())]))
STOPS = pa.struct([("some", pa.bool_()), ("near", pa.list_(pa.struct([("m", pa.string()), ("next", pa.string())])))])


@F.arrow_udf(T.StructType([T.StructField("some", T.BooleanType()), T.StructField("near", PAIRS)]))
def near_stops(text: pa.Array) -> pa.Array:
    """:func:`plain.stops` of texts as bytes."""
    return in_slices(stops, STOPS, text)

"""Sentences by a model that a corpus teaches without labels: abbreviations, collocations across a stop, and words that
start sentences, told by log-likelihood ratios of counts."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import sequence
from ..sources.shared import written

#: The levels of the published method, and its chance that an abbreviation has its stop.
ABBREVIATION, COLLOCATION, STARTER, WITH_STOP = 0.3, 7.88, 30.0, 0.99
#: Openers and closers around a token; its own stop stays.
AROUND = r"^[^\p{L}\p{N}]+|[^\p{L}\p{N}.!?]+$"
#: All numbers are one type.
NUMBER, DIGITS = "##", r"^[0-9]+([.,:/-][0-9]+)*$"


def cored(token: Column) -> Column:
    return F.regexp_replace(token, AROUND, "")


def bared(core: Column) -> Column:
    return F.lower(F.regexp_replace(core, "[.!?]+$", ""))


def marked(token: Column, core: Column, bare: Column) -> Column:
    """:func:`mark` of a token whose core and bare form are known."""
    return F.struct(
        F.when(bare.rlike(DIGITS), NUMBER).otherwise(bare).alias("base"),
        core.rlike(r"[^.!?]\.$").alias("stop"),
        core.rlike(r"\.\.$").alias("dots"),
        (token.rlike(r"[!?][^\p{L}\p{N}]*$") | token.rlike(r"^\.+$")).alias("hard"),
        core.rlike(r"^\p{Lu}").alias("upper"),
    )


def mark(token: Column) -> Column:
    """(base, stop, dots, hard, upper) of a token: its type without a stop, whether one full stop ends it, or several, or a
    mark that always ends a sentence, and whether it starts with a capital."""
    return marked(token, cored(token), bared(cored(token)))


def log_part(k: Column, p: Column) -> Column:
    """k ln p, and 0 for no k."""
    return F.when(k == 0, 0.0).otherwise(k * F.ln(p))


def likelihood(k: Column, n: Column, p: Column) -> Column:
    return log_part(k, p) + log_part(n - k, 1 - p)


def abbreviation_score(n: Column, stop: Column, total: Column, stops: Column, base: Column) -> Column:
    """Log-likelihood ratio of a type's stops, less for long types and for those seen without one, more for inner stops."""
    p = stops / total
    ratio = -2 * (likelihood(stop, n, p) - log_part(stop, F.lit(WITH_STOP)) - log_part(n - stop, F.lit(1 - WITH_STOP)))
    inner = F.length(base) - F.length(F.replace(base, F.lit("."), F.lit("")))
    letters = (F.length(base) - inner).cast("double")
    return ratio * F.exp(-letters) * (inner + 1) * F.pow(letters, (stop - n).cast("double"))


def together(one: Column, two: Column, both: Column, total: Column) -> Column:
    """Log-likelihood ratio that one thing seen ``one`` times is followed by another, seen ``two`` times, ``both`` times."""
    p, p1, p2 = two / total, both / one, (two - both) / (total - one)
    return -2 * (likelihood(both, one, p) + likelihood(two - both, total - one, p) - likelihood(both, one, p1) - likelihood(two - both, total - one, p2))


def counted(df: DataFrame, text: str) -> tuple[DataFrame, DataFrame]:
    """(types: base, n, n_stop) and (after: base, next, n of a type with a stop before another), over all texts.

    Texts are read once for both. Tokens are combined as they stand before the shuffle, and read for what they are but once
    each.
    """
    rows = df.select(F.col(text).cast("binary").alias("text")).mapInArrow(sequence.counted_tokens, "m string, next string, n bigint")
    whole = rows.groupBy("m", "next").agg(F.sum("n").alias("n"))
    read = whole.select(mark(F.col("m")).alias("m"), F.col("next").isNull().alias("alone"), mark(F.col("next"))["base"].alias("next"), "n")
    # Filters come after the table is written: before it, each would read the tokens once more.
    read = written(read.select("m.base", "m.stop", "alone", "next", "n"), "sentence-tokens")
    types = read.filter("alone and base <> ''").groupBy("base").agg(F.sum("n").alias("n"), F.sum(F.when(F.col("stop"), F.col("n")).otherwise(0)).alias("n_stop"))
    return types, read.filter("not alone and stop and base <> '' and next <> ''").groupBy("base", "next").agg(F.sum("n").alias("n"))


def scored(types: DataFrame) -> DataFrame:
    """types with score and abbreviation; numbers, and types without letters or a stop, are none."""
    total = types.agg(F.sum("n").alias("total"), F.sum("n_stop").alias("stops"))
    letters = F.col("base").rlike(r"\p{L}") & (F.col("n_stop") > 0)
    score = F.when(letters, F.round(abbreviation_score(F.col("n"), F.col("n_stop"), F.col("total"), F.col("stops"), F.col("base")), 6))
    rows = types.crossJoin(F.broadcast(total)).withColumn("score", score)
    return rows.select("base", "n", "n_stop", "score", F.coalesce(F.col("score") >= ABBREVIATION, F.lit(False)).alias("abbreviation"))


def counts(df: DataFrame, text: str) -> tuple[DataFrame, DataFrame]:
    """(scored types, after) of all texts, written, as each is read several times: the texts are read once for either."""
    types, after = counted(df, text)
    return written(scored(written(types, "sentence-counts")), "sentence-types"), written(after, "sentence-pairs")


def special(base: Column) -> Column:
    """Numbers and single letters, whose stops are judged by what follows."""
    return (base == NUMBER) | base.rlike(r"^\p{L}$")


def starters(types: DataFrame, after: DataFrame) -> DataFrame:
    """(next, n, score) of words that follow a sure end of a sentence more often than chance has it."""
    sure = after.join(types.select("base", "abbreviation"), "base").filter(~F.col("abbreviation") & ~special(F.col("base")))
    first = sure.groupBy("next").agg(F.sum("n").alias("n"))
    totals = sure.agg(F.sum("n").alias("ends")).crossJoin(types.agg(F.sum("n").alias("total")))
    rows = first.join(types.select(F.col("base").alias("next"), F.col("n").alias("own")), "next").crossJoin(F.broadcast(totals))
    score = F.round(together(F.col("ends"), F.col("own"), F.col("n"), F.col("total")), 6)
    kept = rows.withColumn("score", score).filter(F.col("next").rlike(r"\p{L}") & (F.col("score") >= STARTER) & (F.col("n") * F.col("total") > F.col("own") * F.col("ends")))
    return kept.select("next", "n", "score")


def collocations(types: DataFrame, after: DataFrame) -> DataFrame:
    """(base, next, n, score) of pairs that a stop joins rather than parts: after abbreviations, numbers and single letters."""
    one = types.select("base", F.col("n_stop").alias("one"), "abbreviation")
    two = types.select(F.col("base").alias("next"), F.col("n").alias("two"))
    rows = after.join(one, "base").filter(F.col("abbreviation") | special(F.col("base"))).join(two, "next").crossJoin(F.broadcast(types.agg(F.sum("n").alias("total"))))
    score = F.round(together(F.col("one"), F.col("two"), F.col("n"), F.col("total")), 6)
    kept = rows.withColumn("score", score).filter(F.col("next").rlike(r"\p{L}") & (F.col("n") > 1) & (F.col("score") >= COLLOCATION) & (F.col("n") * F.col("total") > F.col("one") * F.col("two")))
    return kept.select("base", "next", "n", "score")


def unsure(types: DataFrame) -> DataFrame:
    """(base) of types whose stop may not end a sentence: abbreviations, numbers and single letters."""
    return types.filter(F.col("abbreviation") | special(F.col("base"))).select("base")


def judged(types: DataFrame, after: DataFrame) -> DataFrame:
    """(base, next, capital) of all pairs across a stop that may not end a sentence: it does before a capital, or never."""
    first, joined = starters(types, after).select("next", F.lit(True).alias("first")), collocations(types, after).select("base", "next", F.lit(True).alias("joined"))
    rows = after.select("base", "next").join(unsure(types), "base").join(first, "next", "left").join(joined, ["base", "next"], "left")
    capital = F.col("joined").isNull() & ((F.col("base") == NUMBER) | F.col("first").isNotNull())
    # What follows may be without a type, so neither a capital nor a starter.
    return rows.select("base", "next", capital.alias("capital")).unionByName(unsure(types).select("base", F.lit("").alias("next"), F.lit(False).alias("capital")))


def near(text: Column) -> tuple[Column, Column]:
    """(whether a text has a token, array of (m, next) of its tokens that may end a sentence, each with the next, marked)."""
    found = sequence.near_stops(text.cast("binary"))
    # Arrays of what is known, one after another: inside one lambda each use would work it out anew.
    core = F.transform(found["near"], lambda s: F.struct(s["m"].alias("m"), cored(s["m"]).alias("mc"), s["next"].alias("next"), cored(s["next"]).alias("nc")))
    bare = F.transform(core, lambda s: F.struct(*[s[c].alias(c) for c in ("m", "mc", "next", "nc")], bared(s["mc"]).alias("mb"), bared(s["nc"]).alias("nb")))
    return found["some"], F.transform(bare, lambda s: F.struct(marked(s["m"], s["mc"], s["mb"]).alias("m"), marked(s["next"], s["nc"], s["nb"]).alias("next")))


def ending(m: Column, after: Column, by_stop: Column) -> Column:
    """Whether a sentence ends between a token and the next, where ``by_stop`` says it of one full stop."""
    return F.when(m["hard"], True).when(m["dots"], after["upper"]).when(m["stop"], by_stop).otherwise(False)


@dataclass(frozen=True)
class SentenceModel:
    """What a corpus has taught; sets that go to each task as literals."""

    abbreviations: tuple[str, ...] = ()
    starters: tuple[str, ...] = ()
    collocations: tuple[str, ...] = ()

    def ends(self, m: Column, after: Column) -> Column:
        """Whether a sentence ends between a token and the next."""
        weak = m["base"].isin(*self.abbreviations) | m["base"].rlike(r"^\p{L}$")
        joined = F.concat_ws(" ", m["base"], after["base"]).isin(*self.collocations)
        capital = after["upper"]
        return ending(m, after, F.when(joined, False).when(m["base"] == NUMBER, capital).when(weak, capital & after["base"].isin(*self.starters)).otherwise(True))

    def count(self, text: Column) -> Column:
        """Sentences of a text; the last needs no mark. 0 without a token, null for null."""
        some, read = near(text)
        return F.size(F.filter(read, lambda s: self.ends(s["m"], s["next"]))) + some.cast("int")


def sets(types: DataFrame, after: DataFrame) -> list[DataFrame]:
    """The members of a model's sets, each a table of one column."""
    return [types.filter("abbreviation").select("base"), starters(types, after).select("next"), collocations(types, after).select(F.concat_ws(" ", "base", "next"))]


def learn(df: DataFrame, text: str) -> SentenceModel:
    """The model of all texts of a column, with all members of its sets. They grow with the vocabulary, and come to the
    driver: :func:`per_text` counts by tables where they are many.

    Null and empty texts have no tokens; an empty table gives an empty model, to which each stop ends a sentence.
    """
    return SentenceModel(*(tuple(sorted(r[0] for r in rows.collect())) for rows in sets(*counts(df, text))))


def by_join(df: DataFrame, key: str, text: str, known: DataFrame) -> DataFrame:
    """(key, n) of each row, as :meth:`SentenceModel.count` has n, by a table of all judged pairs of its column."""
    some, read = near(F.col(text))
    open_ = lambda s: s["m"]["stop"] & ~s["m"]["hard"] & ~s["m"]["dots"]
    # A lambda's argument is worked out once for both of its uses.
    parts = F.transform(F.array(read), lambda r: F.struct(
        F.size(F.filter(r, lambda s: ending(s["m"], s["next"], F.lit(False)))).alias("sure"),
        F.transform(F.filter(r, open_), lambda s: F.struct(s["m"]["base"].alias("base"), s["next"]["base"].alias("next"), s["next"]["upper"].alias("upper"))).alias("open"),
    ))[0]
    rows = df.select(F.monotonically_increasing_id().alias("row"), F.col(key).alias("key"), some.cast("int").alias("some"), parts.alias("p"))
    # The array is a column of its own, so that no row of its members carries it.
    rows = rows.select("row", "key", (F.col("p.sure") + F.col("some")).alias("sure"), F.col("p.open").alias("open")).select("row", "key", "sure", F.explode_outer("open").alias("o"))
    # Rows without a pair to judge meet none: their number spreads them.
    none = F.col("o").isNull()
    pairs = rows.select("row", "key", "sure", F.when(none, "").otherwise(F.col("o.base")).alias("base"), F.when(none, F.col("row").cast("string")).otherwise(F.col("o.next")).alias("next"), F.col("o.upper").alias("upper"))
    ends = F.when(F.col("upper").isNull(), 0).when(F.col("capital").isNull() | (F.col("capital") & F.col("upper")), 1).otherwise(0)
    whole = pairs.join(known, ["base", "next"], "left").groupBy("row").agg(F.first("key").alias(key), F.first("sure").alias("sure"), F.sum(ends).alias("ends"))
    return whole.select(key, (F.col("sure") + F.col("ends")).cast("int").alias("n"))


def per_text(df: DataFrame, key: str, text: str, most: int = 100_000) -> DataFrame:
    """(key, n) of each row: the sentences of its text by the model of all. Sets of ``most`` members at most go to each task
    as literals; where one has more, pairs across a stop are joined with those that all sets judge."""
    types, after = counts(df, text)
    found = [[r[0] for r in rows.limit(most + 1).collect()] for rows in sets(types, after)]
    if all(len(s) <= most for s in found):
        return df.select(key, SentenceModel(*(tuple(sorted(s)) for s in found)).count(F.col(text)).alias("n"))
    return by_join(df, key, text, written(judged(types, after), "sentence-judged"))

"""A lemmatiser that learns from pairs of form and lemma: rules that exchange endings, kept as a trie of suffixes."""

from __future__ import annotations

import re
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.sequence import lemmas

#: Letters before the exchanged ending that a rule may look at, and the mark of a word's start.
CONTEXT, START = 4, "^"
#: What is no word to the checks of Russian responses.
PLAIN = re.compile(r"[A-Za-z0-9!#$%&'()*+,./:;<=>?@\[\]^_`{|}~—\"\-]+")


def common_start(a: Column, b: Column) -> Column:
    """Letters that two words have in common from their start."""
    at = F.sequence(F.lit(1), F.greatest(F.least(F.length(a), F.length(b)), F.lit(1)))
    return F.size(F.filter(at, lambda i: (F.substr(a, F.lit(1), i) == F.substr(b, F.lit(1), i)) & (i <= F.least(F.length(a), F.length(b)))))


def suffixes(word: Column, low: Column, high: Column) -> Column:
    """The word's last letters, from ``low`` of them to ``high``, the mark of its start counted."""
    whole = F.concat(F.lit(START), word)
    return F.transform(F.sequence(low, F.greatest(low, F.least(high, F.length(whole)))), lambda k: F.substr(whole, F.length(whole) - k + 1, k))


def learn_rules(pairs: DataFrame, form: str = "form", lemma: str = "lemma", context: int = CONTEXT) -> DataFrame:
    """(suffix, strip, add, n): for words that end so, how many letters go and what comes in their place.

    Each pair counts for its ending with 0 to ``context`` letters before it; of a suffix's rules the most frequent one
    stays, of equal ones that which strips least, and none that its next shorter suffix has too. Pairs with a null count
    for nothing.
    """
    known = pairs.select(F.col(form).alias("form"), F.col(lemma).alias("lemma")).dropna()
    start = common_start(F.col("form"), F.col("lemma"))
    cut = known.select("form", (F.length("form") - start).alias("strip"), F.substr("lemma", start + 1, F.length("lemma")).alias("add"))
    each = cut.select(F.explode(suffixes(F.col("form"), F.col("strip"), F.col("strip") + context)).alias("suffix"), "strip", "add")
    counts = each.groupBy("suffix", "strip", "add").agg(F.count(F.lit(1)).alias("n"))
    best = counts.groupBy("suffix").agg(F.min(F.struct((-F.col("n")).alias("n"), "strip", "add")).alias("r")).select("suffix", "r.strip", "r.add", (-F.col("r.n")).alias("n"))
    shorter = best.select(F.col("suffix").alias("__s"), F.col("strip").alias("__strip"), F.col("add").alias("__add"))
    known = best.join(shorter, (F.length("suffix") > 0) & (F.substr("suffix", F.lit(2), F.length("suffix")) == F.col("__s")), "left")
    return known.filter(F.col("__s").isNull() | (F.col("strip") != F.col("__strip")) | (F.col("add") != F.col("__add"))).select("suffix", "strip", "add", "n")


def lemmas_of(words: DataFrame, rules: DataFrame, word: str = "word") -> DataFrame:
    """``words`` with lemma: by the rule of the longest suffix, or the word itself without any. Rules are joined, so they
    may be many; each of ``words`` should be there once."""
    longest = rules.agg(F.max(F.length("suffix")).alias("most"))
    ends = words.crossJoin(F.broadcast(longest)).select(word, F.explode(suffixes(F.col(word), F.lit(0), F.coalesce("most", F.lit(0)))).alias("suffix"))
    best = ends.join(rules, "suffix").groupBy(word).agg(F.max_by(F.struct("strip", "add"), F.length("suffix")).alias("r"))
    whole = F.concat(F.substr(word, F.lit(1), F.length(word) - F.col("r.strip")), F.col("r.add"))
    return words.join(best, word, "left").withColumn("lemma", F.coalesce(whole, F.col(word))).drop("r")


@dataclass(frozen=True)
class Lemmatiser:
    """Rules by suffix, for columns of word arrays."""

    rules: dict[str, tuple[int, str]]
    longest: int

    def __call__(self, word: str) -> str:
        whole = START + word
        for k in range(min(len(whole), self.longest), -1, -1):
            if (rule := self.rules.get(whole[len(whole) - k :])) is not None:
                return word[: len(word) - rule[0]] + rule[1]
        return word

    def words(self, of: Column) -> Column:
        """Lemmas of an array of words."""
        return lemmas(lambda: self)(of)

    def phrase(self, text: str) -> str:
        """A text's words, without ASCII's marks, digits and Latin letters, as lemmas with a space between."""
        return " ".join(map(self, PLAIN.sub(" ", text.lower()).split()))

    def counts(self, of: Column, keywords: Column, whole: bool = False) -> Column:
        """How often each keyword's lemmas occur among a text's, in any case; as whole words where asked."""

        @F.pandas_udf("array<int>")
        def count(texts: pd.Series, lists: pd.Series) -> pd.Series:
            edge = r"\b" if whole else ""
            one = lambda t, ks: [len(re.findall(edge + self.phrase(k) + edge, t, re.I)) for k in ks]
            return pd.Series([one(self.phrase(t or ""), () if ks is None else ks) for t, ks in zip(texts, lists)])

        return count(of, keywords)


def learn(pairs: DataFrame, form: str = "form", lemma: str = "lemma", context: int = CONTEXT, most: int = 1_000_000) -> Lemmatiser:
    """The lemmatiser of a lexicon. More than ``most`` rules are an error: use :func:`lemmas_of`, which joins them."""
    rows = learn_rules(pairs, form, lemma, context).limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} rules")
    return Lemmatiser({r.suffix: (r.strip, r.add) for r in rows}, max((len(r.suffix) for r in rows), default=0))

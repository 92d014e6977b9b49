"""Language identification by letter n-grams: log-odds counted over labelled texts, added up over a text."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Lengths of n-grams, and n-grams that a model has at most, the most frequent ones.
LENGTHS, MOST = (1, 2, 3), 50_000
#: Weights are whole numbers of this part, so that sums don't depend on their order.
SCALE = 10_000
#: Words that a task remembers.
REMEMBER = 100_000


def words(text: Column) -> Column:
    """Words of letters alone in lower case, with a mark at either end."""
    return F.transform(F.regexp_extract_all(F.lower(text), F.lit(r"(\p{L}+)"), F.lit(1)), lambda w: F.concat(F.lit("_"), w, F.lit("_")))


def grams(word: Column) -> Column:
    of = lambda k: F.transform(F.sequence(F.lit(1), F.length(word) - k + 1), lambda i: F.substr(word, i, F.lit(k)))
    return F.flatten(F.array(*map(of, LENGTHS)))


def gram_counts(df: DataFrame, lang: str, text: str) -> DataFrame:
    """(lang, gram, n). Words are counted first, so that n-grams are made of distinct words, not of running text."""
    each = df.filter(F.col(lang).isNotNull()).select(F.col(lang).alias("lang"), F.explode_outer(words(F.col(text))).alias("word")).filter("word is not null")
    counts = each.groupBy("lang", "word").agg(F.count(F.lit(1)).alias("n"))
    return counts.select("lang", "n", F.explode(grams(F.col("word"))).alias("gram")).groupBy("lang", "gram").agg(F.sum("n").alias("n"))


def weights(counts: DataFrame, most: int = MOST) -> DataFrame:
    """(lang, gram, weight): logarithms of smoothed shares, in parts of SCALE; every language has each kept n-gram."""
    kept = counts.groupBy("gram").agg(F.sum("n").alias("all")).orderBy(F.col("all").desc(), "gram").limit(most)
    rows = counts.join(F.broadcast(kept), "gram")
    totals = rows.groupBy("lang").agg(F.sum("n").alias("total"))
    size = kept.agg(F.count(F.lit(1)).alias("size"))
    every = kept.select("gram").crossJoin(F.broadcast(totals)).crossJoin(F.broadcast(size)).join(rows.select("lang", "gram", "n"), ["lang", "gram"], "left")
    share = (F.coalesce("n", F.lit(0)) + 0.5) / (F.col("total") + 0.5 * F.col("size"))
    return every.select("lang", "gram", F.round(F.ln(share) * SCALE).cast("bigint").alias("weight"))


@dataclass(frozen=True)
class LanguageModel:
    """Weights of n-grams, one for each language."""

    langs: tuple[str, ...]
    table: dict[str, tuple[int, ...]]

    def guess(self, text: Column) -> Column:
        """The language whose weights add up highest, of equal ones the first by name; null without a known n-gram."""
        langs, table = self.langs, self.table

        @F.pandas_udf("string")
        def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            known: dict[str, tuple] = {}

            def of(word):
                found = [w for k in LENGTHS for i in range(max(len(word) - k + 1, 1)) if (w := table.get(word[i : i + k]))]
                out = tuple(map(sum, zip(*found)))
                if len(known) >= REMEMBER:
                    known.clear()
                known[word] = out
                return out

            def best(ws):
                sums = None
                for w in () if ws is None else ws:
                    if s := (known.get(w) or of(w)):
                        sums = [a + b for a, b in zip(sums, s)] if sums else s
                return langs[max(range(len(langs)), key=lambda i: (sums[i], -i))] if sums else None

            for batch in batches:
                yield pd.Series([best(ws) for ws in batch], dtype="object")

        return run(words(text))


def learn(df: DataFrame, lang: str, text: str, most: int = MOST) -> LanguageModel:
    """The model of all texts whose language is known. Its n-grams are ``most`` at most; languages are few."""
    rows = weights(gram_counts(df, lang, text), most).groupBy("gram").agg(F.sort_array(F.collect_list(F.struct("lang", "weight"))).alias("w")).collect()
    langs = tuple(x.lang for x in rows[0].w) if rows else ()
    return LanguageModel(langs, {r.gram: tuple(x.weight for x in r.w) for r in rows})

"""Selection, sampling and reshaping of samples. Randomness is a hash, so reruns agree."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..sources.shared import written

#: Fixed values of the portable draw.
A, B, C, P = 48271, 69621, 12345, 2147483647


def draw(a: Column, b: Column, n: Column | int) -> Column:
    """A number below n from two numbers, in plain integer arithmetic: a linear step, two squarings, a last step."""
    x = (F.lit(A).cast("bigint") * a.cast("bigint") + F.lit(B).cast("bigint") * b.cast("bigint") + C) % P
    for _ in range(2):
        x = (x * x + 7) % P
    return (x * 16807 % P) % n


def numbered(df: DataFrame, *order, by: tuple = ()) -> DataFrame:
    """``pos`` from 0 in an order, over all rows or within groups.

    Over all rows, ranges of the order are sorted apart and numbered by the sizes of the ranges before them. The rows
    are written with their range first: planned twice, the ranges of the rows and those of their sizes could differ.
    """
    if by:
        return df.withColumn("pos", F.row_number().over(Window.partitionBy(*by).orderBy(*order)) - 1)
    parts = written(df.repartitionByRange(*order).withColumn("__part", F.spark_partition_id()), "numbered")
    own = Window.partitionBy("__part").orderBy(*order)
    rows = parts.withColumn("__own", F.row_number().over(own) - 1)
    sizes = parts.groupBy("__part").agg(F.count(F.lit(1)).alias("__n"))
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("__part", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"))
    return rows.join(F.broadcast(offsets), "__part").withColumn("pos", F.col("__before") + F.col("__own")).drop("__part", "__own", "__before")


def head(df: DataFrame, n: int, *order) -> DataFrame:
    """The first n rows; only n rows a task are kept on the way."""
    return df.orderBy(*order).limit(n)


def spread(df: DataFrame, *key) -> DataFrame:
    """The rows by their key over as many tasks as a shuffle has, for work that is long beside their bytes."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *key)


def exclude(df: DataFrame, prompts: DataFrame, key: str) -> DataFrame:
    return df.join(prompts.select(key), key, "left_anti")


def few_shot(df: DataFrame, k: int, *order, start: int = 0) -> DataFrame:
    """Rows ``start`` to ``start + k`` of the order, with their place ``pos``: the examples of a prompt."""
    first = df.orderBy(*order).limit(start + k)
    return numbered(first.withColumn("__all", F.lit(0)), *order, by=("__all",)).filter(F.col("pos") >= start).drop("__all")


def held_out(test: DataFrame, prompts: DataFrame, key: str, same_split: bool) -> DataFrame:
    """Test rows that aren't examples; only where both come from one split can a row be either."""
    return exclude(test, prompts, key) if same_split else test


def positional_split(df: DataFrame, n: int, *order) -> tuple[DataFrame, DataFrame]:
    """(the first n rows in order, the others), both with ``pos``."""
    placed = numbered(df, *order)
    return placed.filter(F.col("pos") < n), placed.filter(F.col("pos") >= n)


def unmarked(df: DataFrame, text: str) -> DataFrame:
    """Rows whose text has no square brackets, which mark entities."""
    return df.filter(~F.col(text).rlike(r"[\[\]]"))


def of_lengths(df: DataFrame, bucket: str, allowed: tuple = ("4k", "8k", "16k", "32k")) -> DataFrame:
    return df.filter(F.col(bucket).isin(*allowed))


def with_gold(df: DataFrame, gold: str) -> DataFrame:
    """Rows whose gold answer is known."""
    return df.filter(F.col(gold).isNotNull())


def both_ways(df: DataFrame, right: str, wrong: str, text: str = "text", label: str = "correct") -> DataFrame:
    """Two rows of each: its right sentence, labelled 1, and its wrong one, labelled 0."""
    side = F.explode(F.array(F.struct(F.lit(1).alias("l"), F.col(right).alias("t")), F.struct(F.lit(0).alias("l"), F.col(wrong).alias("t"))))
    return df.select(*[c for c in df.columns if c not in (right, wrong)], side.alias("__s")).select("*", F.col("__s.t").alias(text), F.col("__s.l").alias(label)).drop("__s")


def parity(df: DataFrame, pos: str = "pos", name: str = "side") -> DataFrame:
    """Adds the place's parity, by which pairs are put in one order or the other."""
    return df.withColumn(name, (F.col(pos) % 2).cast("int"))


def aligned(df: DataFrame, a: str, b: str, order: str, swapped_: str = "i") -> DataFrame:
    """The two columns, exchanged in rows whose order says so."""
    s = F.col(order) == swapped_
    return df.withColumns({a: F.when(s, F.col(b)).otherwise(F.col(a)), b: F.when(s, F.col(a)).otherwise(F.col(b))})


def by_subject(df: DataFrame, subject: str, shots: int, *order) -> tuple[DataFrame, DataFrame]:
    """(examples, the others) of every subject in one scan: the first ``shots`` rows of each are examples."""
    placed = numbered(df, *order, by=(subject,))
    return placed.filter(F.col("pos") < shots), placed.filter(F.col("pos") >= shots).drop("pos")


def crossed(questions: DataFrame, names: DataFrame, limit: int = 10_000) -> DataFrame:
    """Every question for every row of a small table (models, prompts): names go to each task, so they are counted first."""
    n = names.limit(limit + 1).count()
    if n > limit:
        raise ValueError(f"more than {limit} rows would go with every question")
    rows = [r.asDict() for r in names.collect()]
    each = F.array(*[F.struct(*[F.lit(r[c]).cast(names.schema[c].dataType).alias(c) for c in names.columns]) for r in rows])
    if not rows:
        return questions.limit(0).select("*", *[F.lit(None).cast(names.schema[c].dataType).alias(c) for c in names.columns])
    return questions.withColumn("__n", F.explode(each)).select(*questions.columns, *[F.col(f"__n.{c}").alias(c) for c in names.columns])


def strided(df: DataFrame, n: int, key: str) -> DataFrame:
    """First n rows of the walk over residue classes of the place, the step being a tenth of the rows, rounded up.

    Keys alone are numbered; the other columns join the n rows that are taken.
    """
    total = df.agg(F.count(F.lit(1)).alias("k"))
    placed = numbered(df.select(key), key).join(F.broadcast(total)).withColumn("step", F.greatest(F.floor((F.col("k") + 9) / 10), F.lit(1)))
    placed = placed.withColumn("turn", F.col("pos") % F.col("step")).orderBy("turn", "pos").limit(n).select(key, "pos")
    return placed if df.columns == [key] else df.join(F.broadcast(placed), key)


def per_group(df: DataFrame, n: int, group: str, *order) -> DataFrame:
    # The number itself is compared, so that each task leaves out what can't be among the first before the shuffle.
    placed = df.withColumn("__n", F.row_number().over(Window.partitionBy(group).orderBy(*order)))
    return placed.filter(F.col("__n") <= n).drop("__n")


def cap_for(n: int, groups: int) -> int:
    return n // groups + 1


def stratified(df: DataFrame, n: int, kind: str, key: str) -> DataFrame:
    """First n rows of each kind, interleaved: ``turn`` goes round the kinds in the order they first appear."""
    firsts = df.groupBy(kind).agg(F.min(key).alias("first"))
    return per_group(df, n, kind, key).join(firsts, kind).withColumn("rn", F.row_number().over(Window.partitionBy(kind).orderBy(key))).withColumn("turn", F.row_number().over(Window.orderBy("rn", "first"))).drop("rn", "first")


def swapped(df: DataFrame, a: str, b: str, gold: str) -> DataFrame:
    """Each row as it is and with its two choices swapped, the gold choice (1 or 2) too."""
    both = df.withColumn("swapped", F.explode(F.array(F.lit(False), F.lit(True))))
    s = F.col("swapped")
    flip = F.when(F.col(gold) == "1", "2").otherwise("1")
    return both.withColumns({a: F.when(s, F.col(b)).otherwise(F.col(a)), b: F.when(s, F.col(a)).otherwise(F.col(b)), gold: F.when(s, flip).otherwise(F.col(gold))})


def distractors(df: DataFrame, key: str, choice: str, n: int = 5, most: int = 8) -> DataFrame:
    """Other choices from the next n rows, or the previous n near the end, without the row's own.

    Places are numbered over ranges; the neighbours of a row come from rows of nearby places by an equi-join, not
    from one sorted partition.
    """
    placed = numbered(df.select(key, choice), key)
    total = placed.agg(F.max("pos").alias("last"))
    own = placed.join(F.broadcast(total)).withColumn("sign", F.when(F.col("pos") + n <= F.col("last"), 1).otherwise(-1))
    want = own.select(key, choice, F.explode(F.sequence(F.lit(1), F.lit(n))).alias("i"), "pos", "sign").withColumn("at", F.col("pos") + F.col("i") * F.col("sign"))
    near = want.join(placed.select(F.col("pos").alias("at"), F.col(choice).alias("other")), "at").filter(F.col("other") != F.col(choice))
    pool = near.groupBy(key).agg(F.array_sort(F.collect_set("other")).alias("pool"))
    return df.select(key, choice).join(pool, key, "left").select(key, choice, F.slice(F.coalesce("pool", F.array().cast("array<string>")), 1, most).alias("pool"))


def neighbours(df: DataFrame, key: str, value: str, n: int = 5) -> DataFrame:
    """(key, values): the value of each of the n rows that follow a row, in order, or of the n before it near the end."""
    placed = numbered(df.select(key, value), key)
    last = placed.agg(F.max("pos").alias("last"))
    first = F.when(F.col("pos") + n <= F.col("last"), F.col("pos") + 1).otherwise(F.col("pos") - n)
    want = placed.crossJoin(F.broadcast(last)).select(key, F.explode(F.sequence(first, first + n - 1)).alias("at"))
    near = want.join(placed.select(F.col("pos").alias("at"), F.col(value).alias("v")), "at")
    return near.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("at", "v"))).alias("s")).select(key, F.transform("s", lambda x: x["v"]).alias("values"))


def shuffled(choices: Column, seed: Column) -> Column:
    """An array in the order of a hash of place and seed."""
    keyed = F.transform(choices, lambda c, i: F.struct(draw(seed, i + 1, 1000003).alias("k"), i.alias("i"), c.alias("c")))
    return F.transform(F.array_sort(keyed), lambda x: x["c"])


def sentences(df: DataFrame, key: str, text: str, least: int = 5) -> DataFrame:
    """(key, line, start, end, sentence) of the lines of a text, with running offsets, longer than ``least``."""

    @F.pandas_udf("array<struct<line:int,start:int,sentence:string>>")
    def lines(texts: pd.Series) -> pd.Series:
        def one(whole):
            out, at = [], 0
            for i, s in enumerate((whole or "").split("\n")):
                if len(s) > least:
                    out.append({"line": i, "start": at, "sentence": s})
                at += len(s) + 1
            return out

        return texts.map(one)

    each = df.select(key, F.explode(lines(F.col(text))).alias("s"))
    return each.select(key, "s.line", "s.start", (F.col("s.start") + F.length("s.sentence")).alias("end"), "s.sentence")


def spans_in(sentences_: DataFrame, spans: DataFrame, key: str, width: int = 256) -> DataFrame:
    """Spans (key, begin, stop) with the sentence that holds them, their places counted from its start.

    A join by bins of ``width`` places: a sentence is in each bin that it touches, a span in that of its begin, so what
    meets lies close together, and each pair meets once. Only places are in bins; sentences join what was found.
    Null and negative places are in no sentence; spans that repeat are found as often; the columns but the key and the
    places shouldn't have names in common.
    """
    bins = F.sequence(F.floor(F.col("start") / width), F.floor(F.col("end") / width))
    held = sentences_.select(key, "line", "start", "end", F.explode(bins).alias("__bin"))
    placed = spans.filter(F.col("begin") <= F.col("stop")).withColumn("__bin", F.floor(F.col("begin") / width))
    inside = held.join(placed, [key, "__bin"]).filter((F.col("begin") >= F.col("start")) & (F.col("stop") <= F.col("end"))).drop("__bin", "end")
    moved = inside.withColumns({"begin": F.col("begin") - F.col("start"), "stop": F.col("stop") - F.col("start")}).drop("start")
    return sentences_.join(moved, [key, "line"])


def bio_entities(df: DataFrame, key: str, pos: str, token: str, tag: str) -> DataFrame:
    """(key, tag, entity) from rows of tokens with tags B-X, I-X and O: an entity starts at B or where the kind changes."""
    w = Window.partitionBy(key).orderBy(pos)
    kind = F.when(F.col(tag) != "O", F.substring(tag, 3, 100))
    rows = df.withColumn("kind", kind).withColumn("last", F.lag("kind").over(w))
    starts = F.col("kind").isNotNull() & (F.col(tag).startswith("B-") | ~F.col("last").eqNullSafe(F.col("kind")))
    runs = rows.withColumn("run", F.sum(starts.cast("int")).over(w)).filter("kind is not null")
    return runs.groupBy(key, "run").agg(F.first("kind").alias("tag"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(pos, token))), lambda x: x[token]), " ").alias("entity"))


def normal_bio(tag: Column, last: Column) -> Column:
    """An orphan I becomes B, and a B right after its own kind becomes I."""
    kind = F.substring(tag, 3, 100)
    same = last.isNotNull() & (last != "O") & (F.substring(last, 3, 100) == kind)
    return F.when(tag == "O", tag).when(same, F.concat(F.lit("I-"), kind)).otherwise(F.concat(F.lit("B-"), kind))


def fan_out(df: DataFrame, sentences_: str, chosen: str) -> DataFrame:
    """One row a sentence, labelled 1 if its place is among the chosen."""
    return df.select("*", F.posexplode(sentences_).alias("place", "sentence")).withColumn("label", F.array_contains(chosen, F.col("place")).cast("int")).drop(sentences_, chosen)


def row_type(opinions: Column) -> Column:
    """Kind of a row by its opinions."""
    any_ = lambda f: F.exists(opinions, f)
    return F.when(F.size(opinions) == 0, "empty").when(F.size(opinions) > 1, "multi").when(any_(lambda o: o["Source"] == "NULL"), "src_null").when(any_(lambda o: o["Source"] == "AUTHOR"), "src_author").when(any_(lambda o: o["Expression"].contains(" ")), "multi_expr").otherwise("default")

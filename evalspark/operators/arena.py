"""Battles of one model's answers with those of others, judged both ways round, and the ratings that come of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.choice import argmax, outcome
from ..functions.text import style_counts
from . import predict, rating
from .prompts import MESSAGE, fill, message

#: What a judge may say: the first answer, the second, or neither.
CHOICES = ["m", "M", "T"]
#: Style counts that are features of a battle.
STYLES = ("len_answer", "header_count", "list_count", "bold_count", "code_blocks_count")
SYSTEM = "You compare two answers to an instruction. Say m if the first is better, M if the second is, T if they are as good."
LAYOUT = "# Instruction\n{instruction}\n\n# Answer m\n{m}\n\n# Answer M\n{M}"


def pairings(answers: DataFrame, model: str, id_: str = "id") -> DataFrame:
    """(id, model, reference, instruction, m, M, label): each answer of ``model`` beside every other model's to the same
    id, once in each place; ``label`` says in which place the model's own is. ``answers`` has id, model, instruction and
    output, one for a model and id; ids that the model hasn't answered are no battle, and null answers are empty."""
    own = answers.filter(F.col("model") == model).select(id_, "instruction", F.coalesce("output", F.lit("")).alias("own"))
    other = answers.filter(F.col("model") != model).select(id_, F.col("model").alias("reference"), F.coalesce("output", F.lit("")).alias("other"))
    both = own.join(other, id_).withColumn("label", F.explode(F.array(F.lit("m"), F.lit("M"))))
    first = F.col("label") == "m"
    return both.select(F.col(id_).alias("id"), F.lit(model).alias("model"), "reference", "instruction", F.when(first, F.col("own")).otherwise(F.col("other")).alias("m"), F.when(first, F.col("other")).otherwise(F.col("own")).alias("M_"), "label")


def judge_prompt(layout: str = LAYOUT, system: str = SYSTEM) -> Column:
    """The judge's messages as JSON, which servers take as they are; the answer is begun by an empty turn."""
    said = fill(layout, instruction=F.col("instruction"), m=F.col("m"), M=F.col("M_"))
    turns = F.array(message("system", F.lit(system)), message("user", said)).cast(f"array<{MESSAGE}>")
    return F.to_json(turns)


def judged(rows: DataFrame, make, layout: str = LAYOUT, system: str = SYSTEM) -> DataFrame:
    """Adds ``outcome`` by the judge's likeliest word, invalid where it gives none any chance, and the style counts of
    both answers."""
    asked = predict.choose(rows.withColumn("__p", judge_prompt(layout, system)), "__p", CHOICES, make).drop("__p")
    sure = F.aggregate("probs", F.lit(0.0), lambda a, p: a + p["prob"]) > 0
    first = F.col("label") == "m"
    won = F.when(sure, outcome(argmax(F.col("probs")), F.col("label"))).otherwise("invalid")
    styles = {"model": F.when(first, F.col("m")).otherwise(F.col("M_")), "reference": F.when(first, F.col("M_")).otherwise(F.col("m"))}
    out = asked.withColumn("outcome", won).withColumn("seq", F.when(first, 0).otherwise(1))
    return out.withColumns({f"{side}_styles": style_counts(text) for side, text in styles.items()}).drop("probs", "m", "M_")


def battles(judgements: DataFrame) -> DataFrame:
    """(id, model, reference, winner, z0, ...): both judgements of a battle as one, with its style features."""
    one = rating.consolidate(judgements)
    styles = judgements.groupBy("id", "model", "reference").agg(F.first("model_styles").alias("a"), F.first("reference_styles").alias("b"))
    flat = one.join(styles, ["id", "model", "reference"]).select("id", "model", "reference", "winner", *[F.col(f"{side}.{k}").alias(f"{side}_{k}") for side in "ab" for k in STYLES])
    return rating.style_features(flat, [(f"a_{k}", f"b_{k}") for k in STYLES]).drop(*[f"{side}_{k}" for side in "ab" for k in STYLES])


def arena(answers: DataFrame, model: str, make, baseline: str | None = None, bags: int = 100, previous: DataFrame | None = None) -> DataFrame:
    """(model, rating, std, ci_lower, ci_upper, votes) of all models, style apart, from judged battles of one of them and,
    where given, from earlier judgements (id, model, reference, outcome, seq, model_styles, reference_styles)."""
    from ..sources.shared import written

    now = judged(pairings(answers, model), make)
    every = now if previous is None else now.unionByName(previous, allowMissingColumns=True)
    fought = written(battles(every), "arena")
    found = rating.style_ratings(fought, [f"z{k}" for k in range(len(STYLES))], baseline, bags).filter("kind = 'model'")
    votes = fought.select(F.explode(F.array("model", "reference")).alias("name")).groupBy("name").agg(F.count(F.lit(1)).alias("votes"))
    return found.join(votes, "name", "left").select(F.col("name").alias("model"), F.col("value").alias("rating"), "std", "ci_lower", "ci_upper", F.coalesce("votes", F.lit(0)).alias("votes"))

"""The boundary to models: predictions are columns of the row that asked for them."""

from __future__ import annotations

import hashlib
from typing import Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

INFO = "pred_text string, prompt_len int, generated_len int, error string"


class Predictor(Protocol):
    """Takes prompts of one batch and gives an answer for each; made on the executor by its factory."""

    def generate(self, prompts: list[str]) -> list[str]: ...

    def probabilities(self, prompts: list[str], choices: list[str]) -> list[dict[str, float]]: ...

    def log_probs(self, prompts: list[str]) -> list[list[tuple[int, float, int, int]]]: ...


class HashPredictor:
    """Answers drawn from a hash of the prompt: the same on each run and machine."""

    def __init__(self, answers: tuple[str, ...] = ("Yes", "No")):
        self.answers = answers

    def number(self, text: str) -> int:
        return int.from_bytes(hashlib.md5(text.encode()).digest()[:6], "big")

    def generate(self, prompts):
        return [self.answers[self.number(p) % len(self.answers)] for p in prompts]

    def probabilities(self, prompts, choices):
        out = []
        for p in prompts:
            n = [1 + self.number(p + "|" + c) % 1000 for c in choices]
            out.append({c: x / sum(n) for c, x in zip(choices, n)})
        return out

    def log_probs(self, prompts):
        out = []
        for p in prompts:
            at, row = 0, []
            for w in p.split(" "):
                row.append((self.number(w) % 50000, 0.0 if not row else -1.0 - self.number(w) % 100 / 50, at, at + len(w)))
                at += len(w) + 1
            out.append(row)
        return out


def one_by_one(ask, prompts: list[str]) -> list[tuple]:
    """Answers with their errors: where a batch fails, its prompts are asked alone, so a failure stays with its row."""
    try:
        return [(x, None) for x in ask(prompts)]
    except Exception as e:  # noqa: BLE001
        if len(prompts) == 1:
            return [(None, str(e)[:500])]
        return [x for p in prompts for x in one_by_one(ask, [p])]


def generate(df: DataFrame, prompt: str, make, max_prompt: int | None = None) -> DataFrame:
    """Adds pred_text, prompt_len, generated_len and error. Prompts over the limit get an empty answer and an error."""

    @F.pandas_udf(f"struct<{', '.join(INFO.split(', ')).replace(' ', ':').replace(',:', ',')}>")
    def answer(prompts: pd.Series) -> pd.DataFrame:
        model, n = make(), prompts.fillna("").str.split().str.len()
        fits = (n <= max_prompt) if max_prompt else n >= 0
        got = dict(zip(prompts.index[fits], one_by_one(model.generate, prompts[fits].fillna("").tolist())))
        rows = [got.get(i, ("", "prompt too long")) for i in prompts.index]
        return pd.DataFrame({"pred_text": [a or "" for a, _ in rows], "prompt_len": [int(k) if f else None for k, f in zip(n, fits)], "generated_len": [len((a or "").split()) for a, _ in rows], "error": [e for _, e in rows]}).astype({"prompt_len": "Int32", "generated_len": "int32"})

    out = df.withColumn("__a", answer(F.col(prompt)))
    return out.select(*df.columns, "__a.*")


def choose(df: DataFrame, prompt: str, choices: list[str], make) -> DataFrame:
    """Adds ``probs``: (choice, prob) in the order of the choices."""

    @F.pandas_udf("array<struct<choice:string,prob:double>>")
    def ask(prompts: pd.Series) -> pd.Series:
        got = one_by_one(lambda p: make().probabilities(p, choices), prompts.fillna("").tolist())
        return pd.Series([[{"choice": c, "prob": float((x or {}).get(c, 0.0))} for c in choices] for x, _ in got])

    return df.withColumn("probs", ask(F.col(prompt)))


def token_log_probs(df: DataFrame, prompt: str, make) -> DataFrame:
    """Adds ``tokens``: (id, lp, start, end)."""

    @F.pandas_udf("array<struct<id:int,lp:double,start:int,end:int>>")
    def ask(prompts: pd.Series) -> pd.Series:
        got = one_by_one(lambda p: make().log_probs(p), prompts.fillna("").tolist())
        return pd.Series([[dict(zip(("id", "lp", "start", "end"), t)) for t in (x or [])] for x, _ in got])

    return df.withColumn("tokens", ask(F.col(prompt)))


def answer_log_prob(tokens: Column, start: Column) -> Column:
    """Mean log-probability of the tokens from a place on; null without any."""
    own = F.filter(tokens, lambda t: t["start"] >= start)
    return F.try_divide(F.aggregate(own, F.lit(0.0), lambda a, t: a + t["lp"]), F.size(own))


def on_last_message(tokens: Column, start: Column, end: Column) -> Column:
    """Tokens that touch [start, end), with places counted from start."""
    own = F.filter(tokens, lambda t: (t["end"] > start) & (t["start"] < end))
    return F.transform(own, lambda t: F.struct(t["id"].alias("id"), t["lp"].alias("lp"), F.greatest(t["start"] - start, F.lit(0)).alias("start"), (t["end"] - start).alias("end")))


def with_reasoning(df: DataFrame, prompt: str, make, end: str = "</think>", truncation: str = "\n</think>\n", limit: int = 2048) -> DataFrame:
    """Two steps: reasoning up to its end mark (cut and closed where the mark is missing), then the answer after it."""
    first = generate(df, prompt, make).withColumnRenamed("pred_text", "reasoning")
    closed = close_reasoning(F.col("reasoning"), end, truncation, limit)
    second = first.drop("prompt_len", "generated_len").withColumnRenamed("error", "reasoning_error").withColumn("reasoning", closed).withColumn("__next", F.concat(F.col(prompt), F.col("reasoning")))
    return generate(second, "__next", make).drop("__next")


def close_reasoning(text: Column, end: str = "</think>", truncation: str = "\n</think>\n", limit: int = 2048) -> Column:
    """Reasoning up to and with its end mark, or its first ``limit`` words and the truncation text."""
    cut = F.concat(F.array_join(F.slice(F.split(text, " "), 1, limit), " "), F.lit(truncation))
    return F.when(text.contains(end), F.concat(F.substring_index(text, end, 1), F.lit(end))).otherwise(cut)

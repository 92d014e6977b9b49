"""Queries by name, each with the SQL that gives the same rows where SQL can; and tasks by name."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Examples that a prompt may have without a budget.
MOST_SHOTS = 1000

QUERIES: dict[str, Callable] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a function of a table reader under its name."""

    def add(f):
        def run(spark, sf_dir):
            return f(lambda t: spark.read.parquet(f"{sf_dir}/{t}.parquet"))

        run.__name__, run.__doc__ = f.__name__, f.__doc__
        QUERIES[f.__name__] = run
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


@dataclass(frozen=True)
class TaskSpec:
    """A task: where its rows lie, what is asked, how rows are scored, how each metric is aggregated, and which metrics its
    score is the mean of.

    ``prepare`` makes rows with what the templates and the scorer name from raw ones with an ``id``; ``gold`` is the expected answer as a column of
    them. ``user`` and ``bot`` are templates of {columns}; an answer follows ``bot``. Rows to be scored have the column
    ``pred``, which :meth:`predict` adds.
    """

    name: str
    method: str
    scorer: Callable[[DataFrame], DataFrame]
    aggs: dict[str, Callable[[DataFrame], DataFrame]]
    leaderboard: tuple[str, ...] = ()
    bootstrap: bool = True
    data: str = ""
    subset: str | None = None
    splits: tuple[str, str] = ("test", "prompt")
    first_shot: int = 0
    choices: tuple[str, ...] = ()
    gold: Callable[[], Column] | None = None
    prepare: Callable[[DataFrame], DataFrame] | None = None
    user: str = "{text}"
    bot: str = ""
    system: str = ""
    params: dict = field(default_factory=dict)
    judge: Callable[[DataFrame], Column] | None = None

    def rows(self, spark, root: str, split: str, form: str = "parquet") -> DataFrame:
        """Raw rows of a split; without an ``id``, they get one by file and place, which goes by their order."""
        path = "/".join(x for x in (root.rstrip("/"), self.data, self.subset, split) if x)
        df = spark.read.format(form).load(path)
        if "id" in df.columns:
            return df
        place = F.col("_metadata.row_index") if form == "parquet" else F.monotonically_increasing_id()
        return df.select(F.concat_ws("#", F.col("_metadata.file_name"), F.lpad(place.cast("string"), 12, "0")).alias("id"), *df.columns)

    def prepared(self, df: DataFrame) -> DataFrame:
        return self.prepare(df) if self.prepare else df

    def load(self, spark, root: str, split: str | None = None, form: str = "parquet") -> DataFrame:
        """Rows of a split below ``root``: the task's data set, its subset where it has one, and the split, as folders."""
        return self.prepared(self.rows(spark, root, split or self.splits[0], form))

    def samples(self, spark, root: str, shots: int = 0, form: str = "parquet") -> tuple[DataFrame, DataFrame]:
        """(rows to be scored, examples): ``shots`` examples from ``first_shot`` on of the second split, or of the first
        ``prompt_rows`` where the task sets these aside; rows that are examples, or set aside, aren't scored."""
        from ..operators import sampling

        test, pool = (self.rows(spark, root, s, form) for s in self.splits)
        apart = self.params.get("prompt_rows")
        if apart:
            pool = sampling.head(pool, apart, "id")
        chosen = sampling.few_shot(pool, shots, "id", start=self.first_shot).drop("pos")
        test = sampling.held_out(test, pool if apart else chosen, "id", self.splits[0] == self.splits[1])
        return self.prepared(test), self.prepared(chosen).limit(shots)

    def messages(self, df: DataFrame, answered: bool = False) -> Column:
        """Messages of a row; with its answer where it is an example."""
        from ..operators.prompts import fill, message

        values = {c: F.col(c).cast("string") for c in df.columns if "{" + c + "}" in self.user + self.bot}
        out = [message("system", F.lit(self.system))] if self.system else []
        out.append(message("user", fill(self.user, **values)))
        answer = fill(self.bot, **values)
        if answered:
            answer = F.concat(answer, self.gold())
        return F.array(*out, message("assistant", answer)) if answered or self.bot else F.array(*out)

    def ask(self, df: DataFrame, examples: DataFrame | None = None, budget: int | None = None, make=None) -> DataFrame:
        """Adds ``prompt``: the examples, a handful, and then the row itself, as one text.

        With a budget and ``make``, a factory of tokenizers (:func:`prompts.pack_rendered`), as many examples as fit, from
        the last of them to the first. Rows whose own answer is scored (log_probs) end with it; ``start`` is its place.
        """
        from ..operators.prompts import pack_rendered, rendered

        scored = self.method == "log_probs"
        messages = self.messages(df, answered=scored)
        rows = df.withColumn("__own", rendered(messages))
        if scored:
            rows = rows.withColumn("__length", F.length(F.element_at(messages, -1)["content"]))
        shots = None if examples is None else examples.select(rendered(self.messages(examples, answered=True)).alias("text")).withColumn("pos", F.monotonically_increasing_id())
        if shots is not None and budget is not None:
            rows = pack_rendered(rows, shots, budget, "__own", make).drop("shots")
        else:
            held = [] if shots is None else [r[0] for r in shots.limit(MOST_SHOTS + 1).select("text").collect()]
            if len(held) > MOST_SHOTS:
                raise ValueError(f"more than {MOST_SHOTS} examples")
            rows = rows.withColumn("prompt", F.concat(F.lit("".join(x + "\n" for x in held)), F.col("__own")))
        if scored:
            rows = rows.withColumn("start", F.length("prompt") - F.col("__length"))
        return rows.drop("__own", "__length")

    def predict(self, df: DataFrame, make) -> DataFrame:
        """Adds ``pred``, the likeliest choice or the generated text, or ``scores``, the log-probabilities of the answer's
        own tokens."""
        from ..functions.choice import argmax
        from ..operators.predict import choose, generate, on_last_message, token_log_probs

        if self.method == "choose":
            return choose(df, "prompt", list(self.choices), make).withColumn("pred", argmax(F.col("probs")))
        if self.method == "log_probs":
            tokens = token_log_probs(df, "prompt", make)
            own = on_last_message(F.col("tokens"), F.col("start"), F.length("prompt"))
            return tokens.withColumn("scores", F.transform(own, lambda t: t["lp"])).drop("tokens")
        return generate(df, "prompt", make).withColumnRenamed("pred_text", "pred")

    def verdicts(self, df: DataFrame, make) -> DataFrame:
        """Adds ``verdict``, what a judge says to a row's prediction, where the task has one."""
        from ..operators.predict import generate
        from ..operators.prompts import rendered

        if not self.judge:
            return df
        asked = generate(df.withColumn("__judge", rendered(self.judge(df))).drop("prompt_len", "generated_len", "error"), "__judge", make)
        return asked.withColumnRenamed("pred_text", "verdict").drop("__judge")

    def evaluate(self, df: DataFrame) -> DataFrame:
        """(task, metric, value) of rows with predictions; each aggregate gives one row with one value.

        Aggregates that are columns of the scored rows (those with ``column``) are worked out together, in one scan.
        """
        scored = self.scorer(df)
        together = {m: a.column() for m, a in self.aggs.items() if hasattr(a, "column")}
        out = []
        if together:
            entry = F.array(*[F.struct(F.lit(m).alias("metric"), F.col(f"`{m}`").cast("double").alias("value")) for m in together])
            out.append(scored.agg(*[c.alias(m) for m, c in together.items()]).select(F.explode(entry).alias("e")).select(F.lit(self.name).alias("task"), "e.metric", "e.value"))
        one = lambda metric, agg: agg(scored).toDF("value").select(F.lit(self.name).alias("task"), F.lit(metric).alias("metric"), F.col("value").cast("double").alias("value"))
        return reduce(DataFrame.unionByName, out + [one(m, a) for m, a in self.aggs.items() if m not in together])

    def score(self, metrics: DataFrame) -> DataFrame:
        kept = metrics.filter(F.col("metric").isin(*self.leaderboard)) if self.leaderboard else metrics
        return kept.groupBy("task").agg(F.avg("value").alias("score"))


TASKS: dict[str, TaskSpec] = {}


def register(spec: TaskSpec) -> TaskSpec:
    TASKS[spec.name] = spec
    return spec

"""Prompts as arrays of (role, content)."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MESSAGE = "struct<role:string,content:string>"
#: Examples that go with every query, at most.
MOST_EXAMPLES = 10_000


def few(examples: DataFrame) -> DataFrame:
    """Examples go to each task as one array, so they are counted first."""
    if examples.limit(MOST_EXAMPLES + 1).count() > MOST_EXAMPLES:
        raise ValueError(f"more than {MOST_EXAMPLES} examples")
    return examples


def message(role: str, content: Column) -> Column:
    return F.struct(F.lit(role).alias("role"), content.alias("content"))


#: Names of roles that mean another.
ROLES = {"bot": "assistant"}


def conversation(messages: Column, inputs: Column) -> Column:
    """Messages with {names} replaced by the fields of a map, and the roles under their usual names; an unknown role is an error."""
    put = lambda text: F.aggregate(F.map_entries(inputs), text, lambda t, e: F.replace(t, F.concat(F.lit("{"), e["key"], F.lit("}")), e["value"]))
    role = lambda r: F.when(r.isin(*ROLES), F.element_at(F.create_map(*[F.lit(x) for kv in ROLES.items() for x in kv]), r)).when(r.isin("system", "user", "assistant"), r).otherwise(F.raise_error(F.concat(F.lit("unknown role "), r)).cast("string"))
    return F.transform(messages, lambda m: F.struct(role(m["role"]).alias("role"), put(m["content"]).alias("content")))


def pack_instructed(df: DataFrame, examples: DataFrame, budget: int, query: str, full: str, short: str, size=None, repeat: bool = False) -> DataFrame:
    """Adds ``messages`` (user texts, the query's last) of which the first has the full instruction and the others the short one.

    ``examples`` (pos, text, answer) are a handful; the longest prefix of them that fits under the budget with the query
    is taken. A query alone has the full instruction, as has every one with ``repeat``.
    """
    size = size or word_tokens
    put = lambda template, text: F.replace(F.lit(template), F.lit("{text}"), text)
    shots = few(examples).agg(F.array_sort(F.collect_list(F.struct("pos", "text", "answer"))).alias("__s"))
    rows = df.crossJoin(F.broadcast(shots))
    turns = F.transform("__s", lambda x, i: F.array(F.struct(F.lit("user").alias("role"), F.when(i == 0, put(full, x["text"])).otherwise(put(short, x["text"])).alias("content")), F.struct(F.lit("assistant").alias("role"), x["answer"].alias("content"))))
    length = lambda pair: size(pair[0]["content"]) + size(pair[1]["content"])
    # With examples the query has the short instruction; the budget is over what comes of it.
    own = lambda template: F.array(F.struct(F.lit("user").alias("role"), put(template, F.col(query)).alias("content")))
    rows = rows.withColumn("__t", turns).withColumn("__own", own(full if repeat else short))
    upto = F.aggregate("__t", F.struct(F.lit(0).alias("n"), F.array().cast("array<int>").alias("out")), lambda a, p: F.struct((a["n"] + length(p)).alias("n"), F.array_append(a["out"], a["n"] + length(p)).alias("out")))["out"]
    fit = F.size(F.filter(upto, lambda n: n + size(F.col("__own")[0]["content"]) < budget))
    rows = rows.withColumn("__k", fit)
    return rows.withColumn("messages", F.when(F.col("__k") == 0, own(full)).otherwise(F.concat(F.flatten(F.slice("__t", F.lit(1), F.col("__k"))), F.col("__own")))).drop("__s", "__t", "__own", "__k")


def numbered_answers(answers: Column) -> Column:
    """Accepted answers as lines 1) ..., 2) ..."""
    return F.array_join(F.transform(answers, lambda x, i: F.concat((i + 1).cast("string"), F.lit(") "), x)), "\n")


def judge_messages(question: Column, predicted: Column, answers: Column, shots: list[tuple[str, str]], layout: str = "Question: {q}\n\nAnswer: {p}\n\nAccepted answers:\n{a}") -> Column:
    """A Yes/No dialogue that ends with the answer to be judged: pairs of (case, verdict), then the case in the same layout."""
    own = fill(layout, q=question, p=predicted, a=numbered_answers(answers))
    turns = [message(r, F.lit(x)) for case, verdict in shots for r, x in (("user", case), ("assistant", verdict))]
    return F.array(*turns, message("user", own))


def allowed_words(text: Column, frame: str = "") -> Column:
    """The distinct words that an answer drawn from a text may use, with those of a fixed frame around it."""
    return F.array_distinct(F.concat(F.split(F.lit(frame), r"\s+"), F.split(text, r"\s+")))


def fill(template: str, **values: Column) -> Column:
    """A template with {names} replaced."""
    out = F.lit(template)
    for name, value in values.items():
        out = F.replace(out, F.lit("{" + name + "}"), value)
    return out


def word_tokens(text: Column) -> Column:
    """Length by an additive tokenizer; others can put their own length in its place."""
    return F.size(F.filter(F.split(text, r"\s+"), lambda w: w != ""))


def pack(df: DataFrame, examples: DataFrame, budget: int, query_len: str, newest_first: bool = True) -> DataFrame:
    """Adds ``shots``: the longest prefix of the examples that fits, with the query, under the budget.

    ``examples`` (pos, text, len) is the few-shot part of a prompt split, so a handful of rows that go to every query as one
    array with running lengths. The default packing renders from the last example to the first.
    """
    shots = few(examples).agg(F.array_sort(F.collect_list(F.struct("pos", "text", "len"))).alias("s"))
    running = F.aggregate("s", F.struct(F.lit(0).cast("bigint").alias("n"), F.array().cast("array<struct<pos:bigint,text:string,upto:bigint>>").alias("out")), lambda a, x: F.struct((a["n"] + x["len"]).alias("n"), F.array_append(a["out"], F.struct(x["pos"].cast("bigint").alias("pos"), x["text"].alias("text"), (a["n"] + x["len"]).alias("upto"))).alias("out")))["out"]
    joined = df.crossJoin(F.broadcast(shots.select(running.alias("s"))))
    fits = F.filter("s", lambda x: x["upto"] + F.col(query_len) < budget)
    order = F.reverse(fits) if newest_first else fits
    return joined.withColumn("shots", F.transform(order, lambda x: x["text"])).drop("s")


def pack_rendered(df: DataFrame, examples: DataFrame, budget: int, text: str, make, most: int = 1000) -> DataFrame:
    """Adds ``prompt`` and ``shots``: as many of the first examples as fit, with the row's own text, under the budget.

    For tokenizers whose lengths don't add up: ``make()`` gives, on the executor, an object with ``render(texts)``, the
    prompt of several texts in turn, and ``count(prompt)``. The examples (pos, text) go before the row's text from the
    last to the first; the number of them is found by halving, as a prompt with one more is never shorter, so a row takes
    the logarithm of their number in countings, in one Arrow pass. A row that fits with none is asked alone.

    ``examples`` go to each task; more than ``most`` are an error. Null texts are empty.
    """
    shots = examples.orderBy("pos").limit(most + 1).select("text").collect()
    if len(shots) > most:
        raise ValueError(f"more than {most} examples")
    shots = [r[0] or "" for r in shots]

    @F.pandas_udf("struct<prompt:string,shots:int>")
    def packed(texts: pd.Series) -> pd.DataFrame:
        model = make()

        def best(own):
            whole = lambda k: model.render([*shots[:k][::-1], own or ""])
            low, high = 0, len(shots)
            while low < high:
                mid = (low + high + 1) // 2
                low, high = (mid, high) if model.count(whole(mid)) < budget else (low, mid - 1)
            return whole(low), low

        return pd.DataFrame([best(t) for t in texts], columns=["prompt", "shots"]).astype({"shots": "int32"})

    return df.withColumn("__p", packed(F.col(text))).select(*df.columns, "__p.*")


def pack_by(df: DataFrame, examples: DataFrame, budget: int, query_len: str, by: str) -> DataFrame:
    """As :func:`pack`, in natural order, with the examples of the row's own group."""
    from pyspark.sql.window import Window

    from ..sources.shared import written

    # Groups are few and rows of one many, so that a shuffle by group would have a group's rows in one task. Examples that
    # are few go to each task; they are written, as they are counted first.
    examples = written(examples, "examples")
    near = F.broadcast if examples.limit(MOST_EXAMPLES + 1).count() <= MOST_EXAMPLES else lambda df: df
    w = Window.partitionBy(by).orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    run = examples.withColumn("upto", F.sum("len").over(w)).groupBy(by).agg(F.array_sort(F.collect_list(F.struct("pos", "text", "upto"))).alias("s"))
    fits = F.filter(F.coalesce("s", F.array().cast("array<struct<pos:bigint,text:string,upto:bigint>>")), lambda x: x["upto"] + F.col(query_len) < budget)
    return df.join(near(run), by, "left").withColumn("shots", F.transform(fits, lambda x: x["text"])).drop("s")


def history(df: DataFrame, dialogue: str, turn: str, text: str, budget: int) -> DataFrame:
    """Adds ``context``: the earlier turns of the dialogue that fit the budget, oldest dropped first.

    Turns of a dialogue are few beside the dialogues; a running total of lengths tells how far back a row can reach.
    """
    from pyspark.sql.window import Window

    own = Window.partitionBy(dialogue).orderBy(turn)
    rows = df.withColumn("len", word_tokens(F.col(text))).withColumn("upto", F.coalesce(F.sum("len").over(own.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    # What can fit starts less than the budget back: the window is a range of the running total, not the whole dialogue.
    back = Window.partitionBy(dialogue).orderBy("upto").rangeBetween(-budget, 0)
    past = F.array_sort(F.collect_list(F.struct(F.col(turn).alias("turn"), F.col("upto").alias("from"), F.col(text).alias("text"))).over(back))
    fits = F.filter(past, lambda x: (x["turn"] < F.col(turn)) & (F.col("upto") - x["from"] + F.col("len") <= budget))
    return rows.withColumn("context", F.transform(fits, lambda x: x["text"])).drop("len", "upto")


def lettered(options: Column) -> Column:
    """Options as lines A. ..., B. ..."""
    return F.array_join(F.transform(options, lambda x, i: F.concat(F.char(65 + i), F.lit(". "), x)), "\n")


def rag_context(segments: Column, none: str = "") -> Column:
    """Numbered segments, or a fixed text without any."""
    return F.when(F.size(segments) == 0, none).otherwise(F.array_join(F.transform(segments, lambda x, i: F.concat((i + 1).cast("string"), F.lit(". "), x)), "\n"))


def chat_text(messages: Column, roles: dict[str, tuple[str, str]], system: str = "", generate: str = "") -> Column:
    """A conversation as one text: each role's prefix and suffix, and a start for the answer if the last role is user."""
    wrap = lambda m: F.concat(*[F.coalesce(*[F.when(m["role"] == r, F.lit(x[k])) for r, x in roles.items()], F.lit("")) if k is not None else m["content"] for k in (0, None, 1)])
    last = F.element_at(messages, -1)["role"]
    return F.concat(F.lit(system), F.array_join(F.transform(messages, wrap), ""), F.when(last == "user", generate).otherwise(""))


def chat_by_config(messages: Column, config: dict, go_on: bool = True) -> Column:
    """A conversation by its configuration: what goes around the contents of each role, a line before all of them, and
    one after a user's turn, from which the model speaks. Roles without a text are left out. With ``go_on`` an answer at
    the end stays open: nothing follows its content."""
    around = {}
    for kind, role in (("system", "system"), ("user", "user"), ("bot", "assistant")):
        role, text = config.get(f"{kind}_role", role), config.get(f"{kind}_message_template", "")
        before, _, after = text.replace("{role}", role).partition("{content}")
        around[role] = (before, after, bool(text))
    bot = config.get("bot_role", "assistant")

    def turn(m, i):
        ends = (i == F.size(messages) - 1) & F.lit(go_on) & (m["role"] == bot)
        return F.coalesce(*[F.when(m["role"] == r, F.concat(F.lit(b), m["content"], F.when(ends, "").otherwise(a))) for r, (b, a, said) in around.items() if said], F.lit(""))

    line = lambda name: F.lit(config[name] + "\n" if config.get(name) else "")
    last = F.try_element_at(messages, F.lit(-1))["role"]
    return F.concat(line("global_prefix"), F.array_join(F.transform(messages, turn), ""), F.when(last == config.get("user_role", "user"), line("suffix")).otherwise(""))


def split_trailing(messages: Column) -> Column:
    """(prompt, answers): the assistant turns at the end apart from what precedes them."""
    last = F.aggregate(F.transform(messages, lambda m, i: F.when(m["role"] != "assistant", i + 1).otherwise(0)), F.lit(0), lambda a, x: F.greatest(a, x))
    return F.struct(F.slice(messages, F.lit(1), last).alias("prompt"), F.slice(messages, last + 1, F.greatest(F.size(messages) - last, F.lit(0))).alias("answers"))


def budget(model_len: Column, prompt: Column, new: Column, reasoning: Column) -> Column:
    """(prompt, reasoning) cut to the model's length: reasoning first, then the prompt."""
    over = F.greatest(prompt + new + reasoning - model_len, F.lit(0))
    cut = F.least(over, reasoning)
    return F.struct(F.greatest(prompt - (over - cut), F.lit(0)).alias("prompt"), (reasoning - cut).alias("reasoning"))


def tag_lines(entities: Column) -> Column:
    """Gold entities, a map of tag to array, as lines ``Tag: [a, b]`` by tag."""
    entries = F.array_sort(F.map_entries(entities))
    return F.array_join(F.transform(entries, lambda e: F.concat(e["key"], F.lit(": ["), F.array_join(e["value"], ", "), F.lit("]"))), "\n")


def inline_tags(text: Column, spans: Column) -> Column:
    """Spans (start, end, tag), apart from each other, marked in the text."""
    ordered = F.array_sort(spans)
    init = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))
    step = lambda a, s: F.struct(s["end"].cast("int").alias("at"), F.concat(a["out"], F.substr(text, a["at"] + 1, s["start"] - a["at"]), F.lit("<"), s["tag"], F.lit(">"), F.substr(text, s["start"] + 1, s["end"] - s["start"]), F.lit("</"), s["tag"], F.lit(">")).alias("out"))
    return F.aggregate(ordered, init, step, lambda a: F.concat(a["out"], F.substr(text, a["at"] + 1, F.length(text))))


def rendered(messages: Column) -> Column:
    """Messages as ``[role]:`` lines with their contents."""
    return F.array_join(F.transform(messages, lambda m: F.concat(F.lit("["), m["role"], F.lit("]:\n"), m["content"])), "\n")

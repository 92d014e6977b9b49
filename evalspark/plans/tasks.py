"""Registered tasks. Their data sets lie below a folder of the user's; texts of prompts can be replaced by ``dataclasses.replace``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import choice, instructions, plain, sequence, spans, text
from ..operators import aggregates as agg
from ..operators import prompts, sampling
from .registry import TaskSpec, register

LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


class Mean:
    """The mean of a column, which is worked out with others in one scan."""

    def __init__(self, metric: str):
        self.metric = metric

    def column(self) -> Column:
        return agg.mean(F.col(self.metric))

    def __call__(self, df: DataFrame) -> DataFrame:
        return df.agg(self.column())


mean_of = Mean


def macro(df: DataFrame) -> DataFrame:
    return agg.f1_macro(df, "gold", "pred")


def correlation(df: DataFrame) -> DataFrame:
    return agg.mcc(df, "gold", "pred")


LABEL_AGGS = {"acc": mean_of("acc"), "f1_macro": macro, "f1-macro": macro, "mcc": correlation}


def labelled(df: DataFrame) -> DataFrame:
    return df.withColumn("acc", F.col("gold") == F.col("pred"))


def gold_from(column: str):
    return lambda: F.col(column).cast("string")


def asked(df: DataFrame) -> DataFrame:
    """Rows with ``instruction``: raw ones have messages with {names} of their inputs instead."""
    if "instruction" in df.columns or "messages" not in df.columns:
        return df
    inputs = F.from_json(F.to_json("inputs"), "map<string,string>") if "inputs" in df.columns else F.create_map().cast("map<string,string>")
    turns = prompts.conversation(F.col("messages"), F.coalesce(inputs, F.create_map().cast("map<string,string>")))
    return df.withColumn("instruction", F.array_join(F.transform(turns, lambda m: m["content"]), "\n"))


def gold_column(make):
    return lambda df: asked(df).withColumn("gold", make())


def labels(name: str, choices, metrics=("acc",), gold=None, method="choose", scorer=labelled, **more) -> TaskSpec:
    """A task whose answers are one of some labels."""
    gold = gold or gold_from("outputs")
    more.setdefault("prepare", gold_column(gold))
    return register(TaskSpec(name, method, scorer, {m: LABEL_AGGS[m] for m in metrics}, choices=tuple(choices), gold=gold, **more))


BOTH, ASK = ("acc", "f1_macro"), "{instruction}"
labels("rcb", "123", BOTH, data="rcb", user=ASK)
labels("rummlu_short", "ABCD", data="rummlu", user=ASK)
labels("ruopenbookqa", "ABCD", BOTH, data="ruopenbookqa", user=ASK)
labels("ruworldtree", "ABCD", BOTH, data="ruworldtree", user=ASK)
labels("rutie", "12", data="rutie", user=ASK)
labels("rwsd", ("Да", "Нет"), data="rwsd", user=ASK, scorer=lambda df: df.withColumn("acc", choice.starts_gold(F.col("gold"), F.col("pred"))))
labels("ruscibench_grnti_ru", LETTERS, BOTH, data="ruscibench_grnti_ru", user=ASK)
labels("rucola", "01", ("acc", "mcc"), gold_from("label"), data="rucola", subset="main", splits=("validation", "train"), first_shot=29, user="Is the text acceptable Russian in syntax, morphology and meaning? Answer 1 if it is and 0 if not.\nText: {sentence}", bot="Answer: ")
labels("kinopoisk", "123", ("acc", "f1-macro"), lambda: choice.kinopoisk_gold(F.col("label")), data="kinopoisk", splits=("test", "train"), leaderboard=("f1-macro",), user="What does the review think of the film: 1 bad, 2 neither, 3 good?\n{text}", bot="Answer: ")


def sided(df: DataFrame) -> DataFrame:
    """The better of two answers comes first or second by a hash of the question; its letter is gold."""
    first = sampling.draw(F.crc32("question"), F.lit(1), 2) == 0
    one, two = F.when(first, F.col("best")).otherwise(F.col("bad")), F.when(first, F.col("bad")).otherwise(F.col("best"))
    return df.withColumn("answers", F.concat(F.lit("***A***\n"), one, F.lit("\n\n***B***\n"), two)).withColumn("gold", F.when(first, "A").otherwise("B"))


labels("habr_qa_sbs", "AB", BOTH, gold_from("gold"), data="habr_qa_sbs", splits=("train", "train"), prepare=sided, user="Which answer to the question is better?\n{question}\n\n{answers}", bot="Letter of the better answer: ", params={"prompt_rows": 1000})


def widened(df: DataFrame) -> DataFrame:
    """Four answers and eight of the rows that follow, in the order of a hash; rows whose gold answer isn't known go.

    The others are those of the next five rows (the five before, near the end): all first answers, then all second ones
    and so on, without the row's own four.
    """
    own = F.array(*[F.col(f"answer{x}") for x in "ABCD"])
    said = F.translate(F.regexp_replace("correct_answer", "^answer", ""), "АБСД", "ABCD")
    known = F.when(said.isin(*"ABCD"), F.get(own, F.instr(F.lit("ABCD"), said) - 1)).otherwise(F.when(F.array_contains(own, F.col("correct_answer")), F.col("correct_answer")))
    placed = df.withColumn("__four", own)
    near = sampling.neighbours(placed, "id", "__four")
    others = F.flatten(F.transform(F.sequence(F.lit(0), F.lit(3)), lambda k: F.transform("values", lambda v: F.get(v, k))))
    rows = placed.withColumn("__gold", known).filter("__gold is not null").join(near, "id")
    choices = F.concat("__four", F.slice(F.filter(others, lambda c: ~F.array_contains("__four", c)), 1, 8))
    out = rows.withColumn("choices", sampling.shuffled(choices, F.crc32(F.col("question")))).withColumn("gold", F.substring(F.lit(LETTERS), F.array_position("choices", F.col("__gold")).cast("int"), F.lit(1)))
    lines = F.array_join(F.transform("choices", lambda x, i: F.concat(F.substring(F.lit(LETTERS), i + 1, F.lit(1)), F.lit(". "), x)), "\n")
    return out.withColumn("options", lines).drop("__four", "__gold", "values")


for topic in ("movies", "music", "law", "books"):
    labels(f"shlepa/{topic}mc", LETTERS[:12], gold=gold_from("gold"), data=f"{topic}_mc", splits=("train", "train"), prepare=widened, user="{question}\n{options}", bot="Answer: ")


def graded(df: DataFrame) -> DataFrame:
    return df.withColumn("score", choice.exam_score(F.col("kind"), F.col("task"), F.col("gold"), F.col("pred")))


register(TaskSpec("use", "generate", graded, {"grade_norm": lambda df: agg.variant_sum(df, "score", "variant")}, data="use", gold=gold_from("outputs"), prepare=lambda df: asked(df).selectExpr("*", "meta.type as kind", "meta.id_task as task", "meta.variant as variant", "outputs as gold"), user=ASK))


def both_sides(df: DataFrame) -> DataFrame:
    """Each row and the same with its choices exchanged; a pair is right if both are."""
    flat = df.selectExpr("meta.id as id", "inputs.choice1 as choice1", "inputs.choice2 as choice2", "inputs.premise as premise", "outputs as gold")
    return sampling.swapped(flat, "choice1", "choice2", "gold")


PAIRED = {"acc": lambda df: agg.paired_accuracy(df, "acc", "id")}
register(TaskSpec("parus", "choose", labelled, PAIRED, data="parus", choices=("1", "2"), gold=gold_from("gold"), prepare=both_sides, user="{premise}\n1. {choice1}\n2. {choice2}", bot="Answer: "))


def ordered(df: DataFrame) -> DataFrame:
    """Grammatical sentence first and second; pairs that were annotated the other way round are exchanged first."""
    rows = sampling.aligned(df, "gram", "ungram", "order").select("id", F.col("gram").alias("one"), F.col("ungram").alias("two"), F.lit("1").alias("gold"))
    return sampling.swapped(rows, "one", "two", "gold")


register(TaskSpec("ruparam", "choose", lambda df: labelled(df.withColumn("pred", F.trim("pred"))), PAIRED, data="ruparam", choices=("1", "2"), splits=("test", "test"), gold=gold_from("gold"), prepare=ordered, user="Which sentence is better Russian?\n1. {one}\n2. {two}", params={"prompt_rows": 10}))


def first_said(df: DataFrame) -> DataFrame:
    return labelled(df.withColumn("pred", choice.first_character(F.col("pred"))))


labels("rublimp/classify", (), BOTH, gold_from("gold"), "generate", first_said, data="rublimp", splits=("train", "train"), prepare=lambda df: sampling.both_ways(df, "source_sentence", "target_sentence").withColumn("gold", F.when(F.col("correct") == 1, "0").otherwise("1")), user="Has the sentence a mistake: 0 no, 1 yes?\n{text}", bot="Answer: ")


def exchanged(df: DataFrame) -> DataFrame:
    rows = df.select("*", F.col("source_sentence").alias("one"), F.col("target_sentence").alias("two"), F.lit("1").alias("gold"))
    return sampling.swapped(rows, "one", "two", "gold")


labels("rublimp/choice", (), BOTH, gold_from("gold"), "generate", first_said, data="rublimp", splits=("train", "train"), prepare=exchanged, user="Which sentence has no mistake?\n1. {one}\n2. {two}", bot="Answer: ")


def mmlu(df: DataFrame) -> DataFrame:
    return agg.mean_of_means(df.withColumn("acc", F.col("acc").cast("double")), "acc", "subject", "category")


for lang in ("ru", "en"):
    register(TaskSpec(f"mmlu_{lang}", "choose", labelled, {"acc": mmlu}, data="mmlu", subset=lang, splits=("test", "dev"), choices=tuple("ABCD"), gold=gold_from("answer"), prepare=lambda df: df.withColumn("gold", F.col("answer").cast("string")), user="{question}\n{options}", bot="Answer: "))


def answered(df: DataFrame) -> DataFrame:
    """F1 and exactness, the best over the accepted answers."""
    normal = lambda c: text.words(text.squad_normal(c))
    f1 = sequence.best_f1(normal(F.col("pred")), F.transform("golds", normal))
    return df.withColumns({"f1": f1, "em": text.best_over(F.col("golds"), lambda g: text.squad_exact(F.col("pred"), g))})


register(TaskSpec("multiq", "generate", answered, {"f1": mean_of("f1"), "em": mean_of("em")}, data="multiq", gold=lambda: F.col("golds")[0], prepare=lambda df: asked(df).withColumn("golds", F.col("outputs.segment")), user=ASK))


def longest(predicted: str, gold: str) -> float:
    """ROUGE-L of two texts, as :func:`sequence.rouge_l` has it of their tokens."""
    p, g = (plain.rouge_words(x) for x in (predicted, gold))
    same = plain.lcs(p, g)
    return 2.0 * same / (len(p) + len(g)) if same else 0.0


def rouge_one(df: DataFrame) -> DataFrame:
    return df.withColumn("rougel", sequence.rouge_l(text.rouge_tokens(F.col("pred")), text.rouge_tokens(F.col("gold"))))


def rouge_best(df: DataFrame) -> DataFrame:
    """The best ROUGE-L over the accepted answers."""
    return df.withColumn("rougel", sequence.over_golds(longest)(F.col("pred"), F.col("golds")))


ROUGE = {"rougel": mean_of("rougel")}
for source, target in (("ru", "en"), ("en", "ru")):
    register(TaskSpec(f"flores_{source}_{target}", "generate", rouge_one, ROUGE, data="flores", gold=gold_from("gold"), prepare=lambda df, s=source, t=target: df.select(F.col(f"inputs.{s}").alias("text"), F.col(f"inputs.{t}").alias("gold")), user=f"Translate from {source} into {target}: {{text}}"))
register(TaskSpec("treewayabstractive", "generate", rouge_one, ROUGE, data="treeway", gold=gold_from("gold"), prepare=lambda df: df.withColumn("text", F.array_join("src_sents", " ")).withColumn("gold", F.array_join("summary_sents", " ")), user="Summarise the article.\n{text}", bot="TL;DR: "))
register(TaskSpec("gazeta", "generate", rouge_one, ROUGE, data="gazeta", gold=gold_from("summary"), prepare=lambda df: df.withColumn("gold", F.col("summary")), user="Summarise the news.\n{text}", bot="TL;DR: "))


def fanned(df: DataFrame) -> DataFrame:
    text_ = F.array_join("src_sents", " ").alias("text")
    return sampling.fan_out(df.select("id", text_, "src_sents", "extractive_summary"), "src_sents", "extractive_summary")


register(TaskSpec("treewayextractive", "log_probs", lambda df: agg.common_scores(df, "id", "scores"), {"r_precision": lambda df: agg.r_precision(df, "id", "label", "score", "place")}, data="treeway", gold=gold_from("sentence"), prepare=fanned, user="Find the most important sentences.\n{text}", bot="Most important: "))


def judged(df: DataFrame) -> DataFrame:
    """Rows that a judge has answered in ``verdict``, beside the best ROUGE-L."""
    return rouge_best(df).withColumn("llm_judge_accuracy", choice.yes(F.col("verdict")))


def passages(df: DataFrame) -> DataFrame:
    """Accepted answers as golds, and the passages as one numbered text."""
    chunks = F.col("context.chunk") if isinstance(df.schema["context"].dataType, T.ArrayType) else F.array("context")
    return df.withColumn("golds", F.col("answers")).withColumn("context", prompts.rag_context(chunks))


#: What a judge is shown before the case.
VERDICTS = [
    ("Say Yes if the answer means the same as one of the accepted ones, else No. Judge by these alone.\n\nQuestion: Which city is on the Spree?\n\nAnswer: Berlin\n\nAccepted answers:\n1) Hamburg\n2) Munich", "No"),
    ("Question: How much is a half?\n\nAnswer: It is 0.5\n\nAccepted answers:\n1) 1/2\n2) 0.5", "Yes"),
]


def ask_judge(df: DataFrame) -> Column:
    return prompts.judge_messages(F.col("question"), F.col("pred"), F.col("golds"), VERDICTS)


for place in ("", "_data_first"):
    for corpus in ("rubqqa", "rus_tydiqa", "sberquadqa", "rus_xquadqa"):
        ask = ("{question}\n\n{context}", "{context}\n\n{question}")[bool(place)]
        common = dict(data=corpus, gold=lambda: F.col("golds")[0], prepare=passages, user=ask, splits=("train", "train"))
        register(TaskSpec(f"rag/{corpus}{place}", "generate", rouge_best, ROUGE, **common))
        register(TaskSpec(f"rag/{corpus}{place}_judge", "generate", judged, {"llm_judge_accuracy": mean_of("llm_judge_accuracy"), **ROUGE}, ("llm_judge_accuracy",), bootstrap=False, judge=ask_judge, **common))


def solved(df: DataFrame) -> DataFrame:
    return df.withColumn("acc", sequence.math_equal(F.col("pred"), F.col("gold")))


for name, gold, task in (("doom/math", "short answer", "task"), ("doom/phys", "answer", "task"), ("t-math", "verifiable_answer", "question")):
    register(TaskSpec(name, "generate", solved, {"acc": mean_of("acc")}, data=name.replace("/", "_"), splits=("train", "train"), gold=gold_from("gold"), prepare=lambda df, g=gold, q=task: df.withColumn("gold", F.col(f"`{g}`").cast("string")).withColumn("text", F.trim(q)), user="Solve the problem and put the answer into \\boxed{}.\n{text}"))

#: Subtasks of long contexts whose metric isn't em, and lengths.
LONG = {"ru_sci_passage_count": "count_score", "ru_qasper": "f1"}
LONG_TASKS = ("passkey", "matreshka_yes_no", "matreshka_names", "passkey_with_librusec", "librusec_history", "ru_gsm100", "ru_sci_passage_count", "ru_2wikimultihopqa", "long_context_multiq", "ru_sci_abstract_retrieval", "ru_trec", "ru_sci_fi", "librusec_mhqa", "ru_babilong_qa1", "ru_babilong_qa2", "ru_babilong_qa3", "ru_babilong_qa4", "ru_babilong_qa5", "ru_quality", "ru_tpo", "ru_qasper")


def bucketed(df: DataFrame) -> DataFrame:
    """Mean over lengths of the mean score of each, to three digits."""
    return agg.bucket_mean(df, "score", "length").agg(F.avg("mean"))


for name in LONG_TASKS:
    register(TaskSpec(f"libra/{name}", "generate", lambda df, m=LONG.get(name, "em"): df.withColumn("score", text.libra_score(F.lit(m), F.col("pred"), F.col("golds"))), {"score": bucketed}, data="libra", subset=name, gold=lambda: F.col("golds")[0], prepare=lambda df: sampling.of_lengths(df.withColumn("golds", F.col("positive_outputs")), "length"), user="{context}\n{input}"))


def copying(most: int):
    def scorer(df: DataFrame) -> DataFrame:
        c = text.copy_parts(text.words(F.col("gold")), text.words(F.col("pred")), F.col("pred"), most)
        return df.withColumn("__c", c).select("*", "__c.*").drop("__c").withColumn("lcs", sequence.copied(F.col("gold"), F.col("pred")))

    return scorer


COPY = {m: mean_of(m) for m in ("symbol_per_token", "len", "lcs", "tokens_per_word")}
for part, lang in (("sent", "ru"), ("sent", "en"), ("para", "ru"), ("para", "en"), ("doc", "ru")):
    register(TaskSpec(f"cp_{part}_{lang}", "generate", copying(8000), COPY, ("len",) if part == "sent" else ("lcs",), data=f"cp_{part}_{lang}", gold=gold_from("outputs"), prepare=gold_column(gold_from("outputs")), user=ASK))


def pairs_of(entities: Column) -> Column:
    return F.flatten(F.transform(F.map_entries(entities), lambda e: F.transform(e["value"], lambda x: F.struct(e["key"].alias("tag"), x.alias("entity")))))


#: How a model's entities are read, by style.
STYLES = {
    "dict": lambda pred, _: pairs_of(spans.parse_tag_lines(pred)),
    "json": lambda pred, _: F.transform(F.filter(spans.parse_json_entities(pred), lambda x: F.size(x) == 2), lambda x: F.struct(x[0].alias("tag"), x[1].alias("entity"))),
    "in-place": lambda pred, query: F.when(spans.same_text(pred, query), sequence.parse_nested(pred)),
}


def entity_scores(style: str, tags: tuple):
    """(tag, tp, fn, fp) by row, of ``gold``, an array of (tag, entity), and what a model found, as multisets: nothing is
    shuffled but sums by tag."""

    def scorer(df: DataFrame) -> DataFrame:
        found = df.select("gold", STYLES[style](F.col("pred"), F.col("query")).alias("found"))
        return found.select(F.explode(sequence.counts_by_tag(tags)(F.col("gold"), F.col("found"))).alias("c")).select("c.*")

    return scorer


def tag_mean(tags: tuple):
    return lambda counts: agg.tag_f1(counts, list(tags)).agg(F.avg("f1"))


#: Tags of the entity tasks.
TAGS = {
    "nerel": ("AGE", "AWARD", "CITY", "COUNTRY", "CRIME", "DATE", "DISEASE", "DISTRICT", "EVENT", "FACILITY", "FAMILY", "IDEOLOGY", "LANGUAGE", "LAW", "LOCATION", "MONEY", "NATIONALITY", "NUMBER", "ORDINAL", "ORGANIZATION", "PENALTY", "PERCENT", "PERSON", "PRODUCT", "PROFESSION", "RELIGION", "STATE_OR_PROVINCE", "TIME", "WORK_OF_ART"),
    "nerel-bio": ("FINDING", "DISO", "INJURY_POISONING", "PHYS", "DEVICE", "LABPROC", "ANATOMY", "CHEM"),
    "patient_queries": ("SIM", "SUBW", "GEN", "SPEC"),
    "collection3": ("PER", "ORG", "LOC"),
}


def in_lines(spans_: Column):
    """Rows (id, query, gold, answer) of the lines of a text that hold an entity, which is where it begins."""

    def prepare(df: DataFrame) -> DataFrame:
        whole = df.select("id", "text", spans_.alias("spans"))
        lines = sampling.sentences(whole, "id", "text").join(whole.select("id", "spans"), "id")
        within = F.filter("spans", lambda e: (e["begin"] >= F.col("start")) & (e["begin"] <= F.col("end")))
        moved = F.transform(within, lambda e: F.struct((e["begin"] - F.col("start")).alias("begin"), F.least(e["end"] - F.col("start"), F.length("sentence")).alias("end"), e["tag"].alias("tag"), e["text"].alias("entity")))
        rows = lines.withColumn("spans", moved).filter(F.size("spans") > 0)
        gold = F.transform("spans", lambda e: F.struct(e["tag"].alias("tag"), e["entity"].alias("entity")))
        return rows.select(F.concat_ws("#", F.col("id").cast("string"), F.lpad(F.col("line").cast("string"), 6, "0")).alias("id"), F.col("sentence").alias("query"), gold.alias("gold"), sequence.inline(F.col("sentence"), F.col("spans")).alias("marked"))

    return prepare


def of_tokens(df: DataFrame) -> DataFrame:
    """Rows (id, query, gold, marked) of (id, tokens, tags) with tags B-X, I-X and O."""
    rows = df.withColumn("__b", sequence.bio(F.col("tokens"), F.col("tags")))
    return rows.select("id", spans.join_tokens(F.col("tokens")).alias("query"), F.col("__b.entities").alias("gold"), spans.join_tokens(F.col("__b.tokens")).alias("marked"))


def patients(df: DataFrame) -> DataFrame:
    """Queries without square brackets, cut into tokens; their tags put right."""
    tags = F.split("merged_ner", ",")
    normal = F.transform(tags, lambda t, i: sampling.normal_bio(t, F.get(tags, i - 1)))
    return of_tokens(sampling.unmarked(df, "query").select("id", spans.tag_tokens(F.col("query")).alias("tokens"), normal.alias("tags")))


def collection(df: DataFrame) -> DataFrame:
    """Rows whose tags are in order, without square brackets; 2k-1 begins and 2k goes on with the k-th tag."""
    name = lambda t: F.when(t == 0, "O").otherwise(F.concat(F.when(t % 2 == 1, "B-").otherwise("I-"), F.element_at(F.array(*map(F.lit, TAGS["collection3"])), F.greatest(F.floor((t + 1) / 2), F.lit(1)).cast("int"))))
    pairs = spans.without_brackets(F.col("tokens"), F.col("ner_tags"))
    rows = df.filter(spans.bio_valid(F.col("ner_tags"))).select("id", pairs.alias("p"))
    return of_tokens(rows.select("id", F.transform("p", lambda x: x["token"]).alias("tokens"), F.transform("p", lambda x: name(x["tag"])).alias("tags")))


def answer_in(style: str, tags: tuple):
    """The gold entities as a model of the style would write them."""

    def gold() -> Column:
        if style == "in-place":
            return F.col("marked")
        if style == "json":
            return F.concat(F.lit("```json\n"), F.to_json(F.transform("gold", lambda e: F.array(e["tag"], e["entity"]))), F.lit("\n```"))
        of = lambda tag: F.transform(F.filter("gold", lambda e: e["tag"] == tag), lambda e: e["entity"])
        return F.concat(*[F.concat(F.lit(f"{tag}: ["), F.array_join(of(tag), ", "), F.lit("]\n")) for tag in tags])

    return gold


#: How the raw rows of a corpus become entities, and its splits.
CORPORA = {
    "nerel": (lambda df: in_lines(spans.annotations(F.col("entities")))(df), ("test", "train")),
    "nerel-bio": (lambda df: in_lines(spans.parallel_spans(*[F.col(f"span_entity_{c}") for c in ("start_chars", "end_chars", "types", "surface")]))(df), ("test", "validation")),
    "patient_queries": (patients, ("test", "validation")),
    "collection3": (collection, ("test", "validation")),
}
for corpus, tags in TAGS.items():
    for style in STYLES:
        prepare, splits = CORPORA[corpus]
        register(TaskSpec(f"ner/{corpus}/{style}", "generate", entity_scores(style, tags), {"f1-macro": tag_mean(tags)}, data=corpus, splits=splits, gold=answer_in(style, tags), prepare=prepare, user="Find the entities of these kinds: " + ", ".join(tags) + ".\n{query}", params={"tags": tags}))


def instructed(df: DataFrame) -> DataFrame:
    """Rows with the arguments of each of their instructions as JSON."""
    kind = df.schema["kwargs"].dataType.elementType
    given = F.col("kwargs") if isinstance(kind, T.StringType) else F.transform("kwargs", lambda k: F.to_json(k))
    return df.select("id", "prompt", "instruction_id_list", given.alias("given"))


def followed(lang: str):
    """Rows with ``checks``, an array of (instruction_id, category, followed)."""
    return lambda df: df.withColumn("checks", instructions.results_given(F.col("pred"), F.col("instruction_id_list"), F.col("given"), lang))


class AllFollowed(Mean):
    """Share of rows that follow all their instructions."""

    def __init__(self):
        super().__init__("checks")

    def column(self) -> Column:
        return F.avg(F.forall("checks", lambda c: c["followed"]).cast("double"))


class EachFollowed(AllFollowed):
    """Share of instructions that are followed."""

    def column(self) -> Column:
        return F.try_divide(F.sum(F.size(F.filter("checks", lambda c: c["followed"]))), F.sum(F.size("checks")))


for lang in ("ru", "en"):
    register(TaskSpec(f"ifeval_{lang}", "generate", followed(lang), {"prompt_level": AllFollowed(), "inst_level": EachFollowed()}, ("prompt_level",), data="ifeval", subset=lang, splits=("train", "train"), gold=lambda: F.lit(""), prepare=instructed, user="{prompt}"))


def tokens_of(offsets: Column, places: Column) -> Column:
    """Token indexes that any of the stretches ``begin:end`` touches; -1 where the first is NULL: the author."""
    part = lambda p, k: F.element_at(F.split(p, ":"), k).cast("int")
    found = F.array_distinct(F.flatten(F.transform(places, lambda p: spans.tokens_in(offsets, part(p, 1), part(p, 2)))))
    return F.when(places[0] == "NULL", F.array(F.lit(-1))).otherwise(found)


def placed_opinions(offsets: Column, opinions_: Column) -> Column:
    """(holder, target, expr, polarity) as token indexes, from opinions whose parts each have surfaces and places."""
    each = F.transform(opinions_, lambda o: F.struct(tokens_of(offsets, o["Source"][1]).alias("holder"), tokens_of(offsets, o["Target"][1]).alias("target"), tokens_of(offsets, o["Polar_expression"][1]).alias("expr"), o["Polarity"].alias("polarity")))
    return spans.distinct_opinions(each)


def annotated(df: DataFrame) -> DataFrame:
    """Rows (id, text, opinions, tokens, gold): the opinions of the raw rows as token indexes."""
    rows = df.select("id", "text", "opinions").withColumn("tokens", spans.token_offsets(F.col("text")))
    return rows.withColumn("gold", placed_opinions(F.col("tokens"), F.col("opinions")))


def said_opinions(text_: Column, offsets: Column, pred: Column) -> Column:
    """A model's opinions as token indexes; those that name something that the text lacks go."""
    at = lambda p: F.when(p == "AUTHOR", "NULL").when(p == "NULL", "0:0").otherwise(F.concat_ws(":", spans.locate_span(text_, p)["start"].cast("string"), spans.locate_span(text_, p)["end"].cast("string")))
    whole = lambda x: F.when(x.startswith("["), F.from_json(x, "array<string>")).otherwise(F.array(x))
    known = F.filter(spans.opinions_from_json(pred), lambda o: F.forall(F.concat(F.array(o["Source"], o["Target"]), whole(o["Expression"])), lambda p: F.coalesce(p.isin("AUTHOR", "NULL") | F.contains(text.small(text_), text.small(p)), F.lit(False))))
    none = F.lit(None).cast("array<string>")
    parts = F.transform(known, lambda o: F.struct(F.array(none, F.array(at(o["Source"]))).alias("Source"), F.array(none, F.array(at(o["Target"]))).alias("Target"), F.array(none, F.transform(whole(o["Expression"]), at)).alias("Polar_expression"), o["Polarity"].alias("Polarity")))
    return placed_opinions(offsets, parts)


def written_opinions() -> Column:
    """The raw rows' opinions as a model should write them."""
    first = lambda x: x[0][0]
    return F.to_json(F.transform("opinions", lambda o: F.struct(first(o["Source"]).alias("Source"), first(o["Target"]).alias("Target"), o["Polarity"].alias("Polarity"), o["Polar_expression"][0].alias("Expression"))))


def opinions(match, weight, eps: float):
    """Sums of matched opinions; ``gold`` and ``found``, which is read from ``pred`` where it isn't there, are arrays of
    (holder, target, expr, polarity)."""

    def scorer(df: DataFrame) -> DataFrame:
        found = F.col("found") if "found" in df.columns else said_opinions(F.col("text"), F.col("tokens"), F.col("pred"))
        rows = df.select("gold", found.alias("found"))
        return rows.select(spans.opinion_sums(F.col("gold"), F.col("found"), match, weight).alias("s")).agg(*[F.sum(f"s.{c}").alias(c) for c in ("wp", "np", "wr", "nr")])

    return scorer, {"f1": lambda df: agg.opinion_prf(df, eps).select("f1")}


def simple_match(a: Column, b: Column) -> Column:
    """Holder and target each overlap (or are both empty) and the polarity agrees."""
    return spans.opinion_match(a.withField("expr", F.array(F.lit(0))), b.withField("expr", F.array(F.lit(0))))


def simple_weight(a: Column, b: Column) -> Column:
    return (spans.coverage(a["holder"], b["holder"]) + spans.coverage(a["target"], b["target"])) / 2


for name, match, weight, eps in (("ruopinionne", spans.opinion_match, spans.opinion_weight, 1e-16), ("ruopinionne_simple", simple_match, simple_weight, 1e-18)):
    scorer, aggs = opinions(match, weight, eps)
    register(TaskSpec(name, "generate", scorer, aggs, data="ruopinionne", splits=("test", "prompt"), gold=written_opinions, prepare=annotated, user="Find the opinions on named entities, as a JSON list of Source, Target, Polarity (POS, NEG) and Expression.\n{text}"))

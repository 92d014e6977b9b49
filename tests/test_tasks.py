"""Every registered task from a folder of raw rows to a score."""

import json
from functools import reduce

import pytest

from evalspark.operators import predict, sampling
from evalspark.plans import tasks
from evalspark.plans.registry import TASKS

MESSAGES = "messages array<struct<role:string,content:string>>, inputs map<string,string>, outputs string"
SAY = [{"role": "user", "content": "Is {a} right?"}]
OPINIONS = "array<struct<Source:array<array<string>>,Target:array<array<string>>,Polar_expression:array<array<string>>,Polarity:string>>"


def raw(name):
    """(schema, rows) of a task's raw data."""
    if name.startswith("shlepa"):
        return "question string, answerA string, answerB string, answerC string, answerD string, correct_answer string", [(f"q{i}", *[f"{x}{i}" for x in "abcd"], "ABCD"[i % 4]) for i in range(12)]
    if name.startswith(("doom", "t-math")):
        return "task string, question string, `short answer` string, answer string, verifiable_answer string", [(f" find {i} ", f" find {i} ", str(i), str(i), str(i)) for i in range(4)]
    if name.startswith("libra"):
        return "context string, input string, positive_outputs array<string>, length string", [("c", "i", ["Yes", "x"], f"{4 << (i % 2)}k") for i in range(4)]
    if name.startswith("rag"):
        return "question string, context array<struct<chunk:string>>, answers array<string>", [(f"q{i}", [("one",), ("two",)], ["Yes", "No"]) for i in range(4)]
    if name.startswith("rublimp"):
        return "source_sentence string, target_sentence string", [(f"right {i}", f"wrong {i}") for i in range(4)]
    if name.startswith("mmlu"):
        return "subject string, category string, question string, options string, answer string", [(f"s{i % 2}", "c", f"q{i}", "A. x", "ABCD"[i]) for i in range(4)]
    if name.startswith("flores"):
        return "inputs struct<ru:string,en:string>", [((f"да {i}", f"yes {i}"),) for i in range(4)]
    if name.startswith("treeway"):
        return "src_sents array<string>, summary_sents array<string>, extractive_summary array<int>", [(["one two", "three four", f"five {i}"], ["one two"], [0, 2]) for i in range(3)]
    if name.startswith("ner/nerel/"):
        return "text string, entities array<string>", [("Bob lives in Rome.\nshort\nNothing here at all", ["T1 PERSON 0 3 Bob", "T2 CITY 13 17 Rome"])] * 3
    if name.startswith("ner/nerel-bio/"):
        return "text string, span_entity_types array<string>, span_entity_start_chars array<int>, span_entity_end_chars array<int>, span_entity_surface array<string>", [("The cold is bad.\nHe has a broken arm.", ["DISO", "INJURY_POISONING"], [4, 26], [8, 36], ["cold", "broken arm"])] * 3
    if name.startswith("ner/patient"):
        return "query string, merged_ner string", [("head hurts, metro Mir", "B-SIM,I-SIM,O,O,B-SUBW"), ("a [b]", "O,O")]
    if name.startswith("ner/collection3"):
        return "tokens array<string>, ner_tags array<int>", [(["Bob", "Ray", "of", "[", "Rome", "."], [1, 2, 0, 0, 5, 0]), (["x"], [2])]
    if name.startswith("ifeval"):
        return "prompt string, instruction_id_list array<string>, kwargs array<struct<num_words:int,relation:string,keywords:array<string>>>", [("say", ["length_constraints:number_words", "keywords:existence", "punctuation:no_comma"], [(5, "less than", None), (None, None, ["yes"]), (None, None, None)])] * 3
    if name.startswith("ruopinionne"):
        return f"text string, opinions {OPINIONS}", [("Bob praised Rome.", [([["Bob"], ["0:3"]], [["Rome"], ["12:16"]], [["praised"], ["4:11"]], "POS")]), ("none", [])] * 2
    if name.startswith("cp_"):
        return MESSAGES, [(SAY, {"a": f"x{i}"}, "copy this text") for i in range(3)]
    plain = {
        "rucola": ("sentence string, label int", [(f"text {i}", i % 2) for i in range(40)]),
        "kinopoisk": ("text string, label int", [(f"film {i}", i % 3) for i in range(4)]),
        "habr_qa_sbs": ("question string, best string, bad string", [(f"q{i}", "good", "bad") for i in range(1004)]),
        "use": ("messages array<struct<role:string,content:string>>, inputs map<string,string>, outputs string, meta struct<type:string,id_task:string,variant:int>", [(SAY, {"a": "x"}, "Yes,No", ("text", "7", 1))] * 2),
        "parus": ("inputs struct<choice1:string,choice2:string,premise:string>, outputs string, meta struct<id:int>", [(("a", "b", "p"), "1", (i,)) for i in range(3)]),
        "ruparam": ("id int, gram string, ungram string, order string", [(i, "good", "bad", "si"[i % 2]) for i in range(14)]),
        "multiq": ("messages array<struct<role:string,content:string>>, inputs map<string,string>, outputs array<struct<segment:string>>", [(SAY, {"a": "x"}, [("Yes",), ("no way",)])] * 2),
        "gazeta": ("title string, text string, summary string", [("t", "long text", "Yes it is")] * 2),
    }
    return plain.get(name) or (MESSAGES, [(SAY, {"a": f"x{i}"}, "1") for i in range(4)])


def written(spark, root, name):
    spec = TASKS[name]
    schema, rows = raw(name)
    for split in set(spec.splits):
        path = "/".join(x for x in (str(root), name.replace("/", "-"), spec.data, spec.subset, split) if x)
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("overwrite").parquet(path)
    return spec, f"{root}/{name.replace('/', '-')}"


GROUPS = [sorted(TASKS)[i::8] for i in range(8)]


@pytest.mark.parametrize("names", GROUPS)
def test_from_raw_rows_to_a_score(spark, tmp_path, names):
    scores = []
    for name in names:
        spec, root = written(spark, tmp_path, name)
        test, shots = spec.samples(spark, root, 0 if spec.method == "log_probs" or name.startswith("ifeval") else 2)
        asked = spec.ask(test, None if spec.method == "log_probs" or name.startswith("ifeval") else shots)
        done = spec.verdicts(spec.predict(asked, predict.HashPredictor), predict.HashPredictor)
        scores.append(spec.score(spec.evaluate(done)))
    got = {r.task: r.score for r in reduce(lambda a, b: a.unionByName(b), scores).collect()}
    assert set(got) == set(names) and all(v is not None and v == v for v in got.values()), got


def test_splits_shots_and_pools(spark, tmp_path):
    spec, root = written(spark, tmp_path, "rucola")
    test, shots = spec.samples(spark, root, 3)
    assert [r.sentence for r in shots.collect()] == ["text 29", "text 30", "text 31"] and test.count() == 40
    spec, root = written(spark, tmp_path, "ruparam")
    test, shots = spec.samples(spark, root, 2)
    assert {r.id for r in shots.collect()} == {0, 1} or shots.count() == 2
    assert {r.id for r in test.collect()} == {10, 11, 12, 13}
    spec, root = written(spark, tmp_path, "rublimp/choice")
    test, shots = spec.samples(spark, root, 1)
    assert test.count() == 6  # four rows both ways, without the example


def test_ask_packs_under_a_budget(spark, tmp_path):
    class Words:
        def render(self, texts):
            return "\n".join(texts)

        def count(self, prompt):
            return len(prompt.split())

    spec, root = written(spark, tmp_path, "kinopoisk")
    test, shots = spec.samples(spark, root, 3)
    most = {b: max(r.prompt.count("[user]:") for r in spec.ask(test, shots, b, Words).collect()) for b in (10, 40, 1000)}
    assert most[10] == 1 and 1 < most[40] < 4 and most[1000] == 4


def test_entities_of_raw_rows(spark, tmp_path):
    spec, root = written(spark, tmp_path, "ner/nerel/in-place")
    row = spec.load(spark, root).first()
    assert (row["query"], [tuple(x) for x in row.gold], row.marked) == ("Bob lives in Rome.", [("PERSON", "Bob"), ("CITY", "Rome")], "<PERSON>Bob</PERSON> lives in <CITY>Rome</CITY>.")
    spec, root = written(spark, tmp_path, "ner/nerel-bio/json")
    got = {r["query"]: [tuple(x) for x in r.gold] for r in spec.load(spark, root).collect()}
    assert got == {"The cold is bad.": [("DISO", "cold")], "He has a broken arm.": [("INJURY_POISONING", "broken arm")]}
    assert tasks.TAGS["nerel-bio"] == ("FINDING", "DISO", "INJURY_POISONING", "PHYS", "DEVICE", "LABPROC", "ANATOMY", "CHEM")
    spec, root = written(spark, tmp_path, "ner/patient_queries/dict")
    rows = spec.load(spark, root).collect()
    assert [(r["query"], [tuple(x) for x in r.gold], r.marked) for r in rows] == [("head hurts, metro Mir", [("SIM", "head hurts"), ("SUBW", "Mir")], "<SIM>head hurts</SIM>, metro <SUBW>Mir</SUBW>")]
    spec, root = written(spark, tmp_path, "ner/collection3/json")
    rows = spec.load(spark, root).collect()
    assert [(r["query"], [tuple(x) for x in r.gold]) for r in rows] == [("Bob Ray of Rome.", [("PER", "Bob Ray"), ("LOC", "Rome")])]


@pytest.mark.parametrize("style", ["dict", "json", "in-place"])
def test_gold_answers_score_one(spark, tmp_path, style):
    """A model that writes the gold answer has every tag that occurs right."""
    for corpus, tags in (("nerel", 2), ("nerel-bio", 2), ("patient_queries", 2), ("collection3", 2)):
        spec, root = written(spark, tmp_path, f"ner/{corpus}/{style}")
        rows = spec.load(spark, root)
        metrics = spec.evaluate(rows.withColumn("pred", spec.gold()))
        assert metrics.first().value == pytest.approx(tags / len(tasks.TAGS[corpus])), (corpus, style)


def test_opinions_of_raw_rows(spark, tmp_path):
    from pyspark.sql import functions as F

    for name in ("ruopinionne", "ruopinionne_simple"):
        spec, root = written(spark, tmp_path, name)
        rows = spec.load(spark, root)
        assert spec.evaluate(rows.withColumn("pred", spec.gold())).first().value == pytest.approx(1.0)
        said = json.dumps([{"Source": "NULL", "Target": "rome", "Polarity": "POS", "Expression": ["praised"]}, {"Source": "Bob", "Target": "Paris", "Polarity": "POS", "Expression": "praised"}])
        half = spec.evaluate(rows.withColumn("pred", F.lit(said))).first().value
        assert half == pytest.approx(0.0)  # NULL is no one, and Paris isn't in the text


def test_instructions_with_their_own_arguments(spark):
    """Each instruction with arguments that a response follows, and with others that it doesn't."""
    from evalspark.functions import instructions
    from pyspark.sql import functions as F

    cases = [
        ("keywords:existence", {"keywords": ["Yes", "no"]}, "yes or no", "yes"), ("keywords:frequency", {"keyword": "a", "frequency": 2, "relation": "at least"}, "a A", "a"), ("keywords:forbidden_words", {"forbidden_words": ["bad"]}, "badly", "so bad"),
        ("keywords:letter_frequency", {"letter": "E", "let_frequency": 2, "let_relation": "less than"}, "e", "eEe"), ("language:response_language", {"language": "hi"}, "नमस्ते दुनिया", "hello"), ("language:response_language", {"language": "en"}, "this is the one for you", "der und die das ist nicht"),
        ("length_constraints:number_sentences", {"num_sentences": 2, "relation": "at least"}, "One. Two.", "One"), ("length_constraints:number_paragraphs", {"num_paragraphs": 2}, "a *** b", "a"), ("length_constraints:number_words", {"num_words": 3, "relation": "less than"}, "a b", "a b c"),
        ("length_constraints:nth_paragraph_first_word", {"num_paragraphs": 2, "nth_paragraph": 2, "first_word": "so"}, "a\n\nSo it is", "a\n\nNo"), ("detectable_content:number_placeholders", {"num_placeholders": 1}, "[x]", "x"), ("detectable_content:postscript", {"postscript_marker": "P.S."}, "a\nP.S. b", "a"),
        ("detectable_format:number_bullet_lists", {"num_bullets": 2}, "* a\n* b", "* a"), ("detectable_format:constrained_response", {}, "My answer is no.", "no"), ("detectable_format:number_highlighted_sections", {"num_highlights": 1}, "*a*", "a"), ("detectable_format:multiple_sections", {"section_spliter": "Part", "num_sections": 2}, "Part 1 a Part 2 b", "Part 1"),
        ("detectable_format:json_format", {}, '{"a": 1}', "a"), ("detectable_format:title", {}, "<<t>>", "t"), ("combination:two_responses", {}, "a ****** b", "a"), ("combination:repeat_prompt", {"prompt_to_repeat": "Say it"}, "say it: no", "no"), ("startend:end_checker", {"end_phrase": "The end. "}, "x the END.", "x"),
        ("startend:quotation", {}, '"a"', "a"), ("change_case:capital_word_frequency", {"capital_frequency": 2, "capital_relation": "at least"}, "A B c", "a b"), ("change_case:english_capital", {}, "THE ONE", "The"), ("change_case:english_lowercase", {}, "the one", "The"), ("punctuation:no_comma", {}, "a", "a,"),
        ("no:such", {}, "a", "a"),
    ]
    assert {c[0] for c in cases} - {"no:such"} == set(instructions.ARGUMENTS)
    for as_map in (False, True):
        rows = [(i, r, json.dumps({k: str(v) if as_map and not isinstance(v, list) else v for k, v in args.items()}), n) for i, args, yes, no in cases for n, r in ((1, yes), (0, no), (0, "  "))]
        df = spark.createDataFrame(rows, "i string, r string, k string, want int")
        got = df.select("i", "r", "want", instructions.follows_given(F.col("i"), F.col("r"), F.col("k"), "en").alias("ok")).collect()
        assert [(x.i, x.r) for x in got if x.ok != bool(x.want) and x.i != "no:such"] == [] and not any(x.ok for x in got if x.i == "no:such")


def test_shepherded_choices_are_twelve(spark):
    """Against the plain rule, with answers that rows have in common."""
    rows = [(i, f"q{i}", "same", f"b{i % 5}", f"c{i}", f"d{i}", "D") for i in range(30)]
    df = spark.createDataFrame(rows, "id int, question string, answerA string, answerB string, answerC string, answerD string, correct_answer string")
    got = {r.id: r for r in tasks.widened(df).collect()}
    assert len(got) == 30
    for i, row in enumerate(rows):
        near = rows[i + 1 : i + 6] if i < len(rows) - 5 else rows[i - 5 : i]
        own = list(row[2:6])
        want = own + [x for k in range(2, 6) for x in (r[k] for r in near) if x not in own][:8]
        assert sorted(got[i].choices) == sorted(want) and len(want) == 12 and got[i].choices["ABCDEFGHIJKL".index(got[i].gold)] == f"d{i}"


def test_resumed_order(spark, tmp_path):
    """Rows without an id are numbered by file and place."""
    spec, root = written(spark, tmp_path, "gazeta")
    ids = [r.id for r in sampling.head(spec.load(spark, root), 5, "id").collect()]
    assert ids == sorted(ids) and len(set(ids)) == 2

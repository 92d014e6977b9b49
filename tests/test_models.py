import random

import pytest

from evalspark.functions import algebra


@pytest.mark.parametrize(
    "a, b",
    [
        ("x(x+1)", "x^2+x"), ("{1,2}", "{2,1}"), (r"\{1,2\}", "2;1"), (r"\frac{1}{2}", "0.5"), (r"x=\frac{4}{8}", r"\frac12"), ("(a+b)^2", "a^2+2ab+b^2"),
        (r"\frac{x^2-1}{x-1}", "x+1"), (r"\sin^2x+\cos^2x" if False else r"(\sin(x))^2+(\cos(x))^2", "1"), (r"\sqrt{8}", r"2\sqrt{2}"), ("[1;2)", r"\left[1; 2\right)"), (r"(-\infty;1]\cup[2;3]", r"[2,3]\cup(-\infty,1]"),
        ("2^{10}", "1024"), (r"x\in[0,1]", "[0;1]"), ("y=2x+1", "1+2x"), ("3,5", "3.5"), ("e^{a+b}", "e^ae^b"), ("5!", "120"), (r"\frac{a}{b}+\frac{c}{d}", r"\frac{ad+bc}{bd}"), ("-x^2", "-(x*x)"), ("1/2x", "x/2"), ("x+y=1", "1=y+x"),
    ],
)
def test_answers_that_are_equal(a, b):
    assert algebra.same_answer(a, b) and algebra.same_answer(b, a)


@pytest.mark.parametrize("a, b", [("x(x+1)", "x^2+1"), ("{1,2}", "{1,3}"), ("{1,1}", "{1}"), ("[1;2)", "[1;2]"), ("(1,2)", "(2,1)"), ("x+1", "x+1.001"), (r"\sqrt{x}", "x"), ("1/x", "1/(x+1)"), ("", "1"), ("((", "1"), ("1/0", "2"), ("x", "y"), ("yes", "no"), ("(1,2)", "{1,2,3}")])
def test_answers_that_differ(a, b):
    assert not algebra.same_answer(a, b) and not algebra.same_answer(b, a)


def test_long_answers_and_products_of_random_polynomials():
    assert algebra.same_answer("+".join(["x"] * 3000), "3000x") and not algebra.same_answer("+".join(["x"] * 3000), "2999x")
    r = random.Random(5)
    for _ in range(40):
        a, b, c, d = (r.randrange(-9, 10) for _ in range(4))
        assert algebra.same_answer(f"({a}x+({b}))({c}y+({d}))", f"{a * c}xy+({a * d})x+({b * c})y+({b * d})")
        assert not algebra.same_answer(f"({a}x+({b}))({c}y+({d}))", f"{a * c}xy+({a * d})x+({b * c})y+({b * d + 1})")


def test_sentences_of_abbreviations_and_initials(spark):
    """Abbreviations and initials that a corpus teaches don't end sentences; what follows them may."""
    from pyspark.sql import functions as F

    from evalspark.operators import sentences

    names, verbs = ["Smith", "Jones", "Brown", "Miller", "Weber", "Young"], ["came", "went", "stayed", "wrote", "slept", "left"]
    r = random.Random(1)
    plain = lambda: f"{r.choice(['The', 'But the', 'Then the'])} {r.choice(names)} house {r.choice(verbs)} and the {r.choice(names)} {r.choice(verbs)}."
    line = lambda: f"{plain()} Dr. {r.choice(names)} {r.choice(verbs)} home at No. {r.randrange(90)} and {r.choice(verbs)}. {plain()} And J. {r.choice(names)} {r.choice(verbs)}."
    corpus = spark.createDataFrame([(line(),) for _ in range(300)] + [(None,), ("",)], "text string")
    model = sentences.learn(corpus, "text")
    assert {"dr", "no"} <= set(model.abbreviations) and "but" in model.starters and "house" not in model.abbreviations
    cases = [("Dr. Smith came.", 1), ("He saw Dr. Jones. The end.", 2), ("J. Brown went! Why? Nobody said", 3), ("We met the Dr. But the house stayed.", 2), ("We met the Dr. Smith house.", 1), ("Room No. 7 slept. But no.", 2), ("Wait... what", 1), ("Wait... What", 2), ("", 0), (" \n", 0), (None, None), ("one", 1), ("It cost 3.50 dollars. It went.", 2)]
    got = spark.createDataFrame(cases, "text string, want int").select("text", "want", model.count(F.col("text")).alias("n")).collect()
    assert [(x.text, x.n) for x in got] == [(x.text, x.want) for x in got]
    empty = sentences.learn(corpus.limit(0), "text")
    assert empty == sentences.SentenceModel() and spark.range(1).select(empty.count(F.lit("Dr. A. B"))).first()[0] == 2


def test_sentences_by_a_model_of_any_size(spark, tmp_path):
    """No abbreviation is left out where there are more than go to tasks as literals."""
    from evalspark.plans import catalogue

    n = 100_500
    names = (chr(0x4E00 + k // 400) + chr(0x4E00 + k % 400) for k in range(n))
    rows = [(k, f"{name}. word {name}. word") for k, name in enumerate(names)] + [(n, "The end. The end."), (n + 1, None), (n + 2, "")]
    spark.createDataFrame(rows, "doc_id bigint, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = catalogue.queries()["sentence_counts"](spark, str(tmp_path))
    assert {tuple(r) for r in got.groupBy("n_sentences").count().collect()} == {(1, n), (2, 1), (0, 2)}


def test_sentences_by_literals_and_by_tables(spark):
    """Both count the same in each row, also where keys repeat."""
    from evalspark.operators import sentences

    r = random.Random(11)
    words = ["The", "but", "But", "Smith", "house", "came", "Ж.", "j.", "7.", "3.50.", "12", "Dr.", "dr.", "No.", "no.", "--", "...", "Wait...", "so?", "Yes!", "end.", "end.)", "(The", "\u201cBut", "No.,", "e.g.", ".", "X"]
    line = lambda: " ".join(r.choice(words) for _ in range(r.randrange(1, 25)))
    taught = [f"The house came. But Dr. Smith came. {r.choice(['The', 'But'])} No. 7 came home e.g. so." for _ in range(200)]
    rows = [(k // 2, x) for k, x in enumerate([*taught, *(line() for _ in range(300)), None, "", " \n", "one", "Dr.", "Dr. --"])] + [(None, "A b. C"), (None, "A b. C d. E")]
    df = spark.createDataFrame(rows, "id int, text string")
    model = sentences.learn(df, "text")
    assert all((model.abbreviations, model.starters, model.collocations))
    want, some = (sorted(map(str, sentences.per_text(df, "id", "text", most).collect())) for most in (100_000, 0))
    assert want == some == sorted(map(str, df.select("id", model.count(df.text).alias("n")).collect()))
    assert sentences.per_text(df.limit(0), "id", "text", -1).collect() == []


def test_languages_of_held_out_documents(spark):
    """Fitted to half of the documents by hash, over 99 % of the other half are told."""
    from pyspark.sql import functions as F

    from evalspark.operators import languages

    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang", "text")
    half = F.crc32(F.col("doc_id").cast("string")) % 2
    model = languages.learn(docs.filter(half == 0), "lang", "text")
    rest = docs.filter((half == 1) & F.col("lang").isNotNull())
    share = rest.agg(F.avg((model.guess(F.col("text")) == F.col("lang")).cast("double"))).first()[0]
    assert share > 0.99
    odd = spark.createDataFrame([(None,), ("",), ("123 --",), ("日本",)], "text string")
    assert [r[0] for r in odd.select(model.guess(F.col("text"))).collect()][:3] == [None] * 3
    assert languages.learn(docs.limit(0), "lang", "text").langs == ()


def test_lemmas_by_the_longest_suffix(spark):
    from pyspark.sql import functions as F

    from evalspark.functions import instructions
    from evalspark.operators import lemmas

    forms = {"стол": "стол стола столу столом столы столов", "кот": "кот кота коту котом коты котов", "книга": "книга книги книге книгу книгой", "рука": "рука руки руке руку рукой", "идти": "идти шёл шла"}
    pairs = spark.createDataFrame([(f, lemma) for lemma, fs in forms.items() for f in fs.split()] + [(None, "a"), ("a", None)], "form string, lemma string")
    rules = lemmas.learn_rules(pairs)
    model = lemmas.learn(pairs)
    for form, lemma in pairs.dropna().collect():
        assert model(form) == lemma or form in ("шла", "шёл"), form
    assert model("мостом") == "мост" and model("ноги") == "нога" and model("") == "" and model("шла") == "идти"
    words = spark.createDataFrame([(w,) for w in ["мостом", "ноги", "шла", "котов", "xyz", ""]], "word string")
    assert {r.word: r.lemma for r in lemmas.lemmas_of(words, rules).collect()} == {w: model(w) for w in ["мостом", "ноги", "шла", "котов", "xyz", ""]}
    text = F.lit("Котов и столы, но не руку.")
    checks = [instructions.existence(text, ["кот", "стола"], model), instructions.existence(text, ["книга"], model), instructions.frequency(text, "кот", "at least", 1, model), instructions.forbidden(text, ["рука"], model), instructions.forbidden(text, ["книга"], model)]
    assert list(spark.range(1).select(*checks).first()) == [True, False, True, False, True]
    assert lemmas.learn(pairs.limit(0))("стола") == "стола"


def test_lemmatised_rouge_and_models_in_checks(spark):
    from pyspark.sql import functions as F

    from evalspark.functions import instructions, sequence, text
    from evalspark.operators import languages, lemmas, sentences

    model = lemmas.Lemmatiser({"ы": (1, ""), "а": (1, "")}, 1)
    df = spark.createDataFrame([("столы и кота", "стол и кот")], "p string, g string")
    tokens = lambda c: model.words(text.rouge_tokens(F.col(c)))
    assert df.select(sequence.rouge_l(tokens("p"), tokens("g"))).first()[0] == 1.0
    lang = languages.LanguageModel(("de", "en"), {"th": (-50, -10), "sch": (-10, -50)})
    r = F.lit("Dr. Smith and the others. They left.")
    got = spark.range(1).select(instructions.language(r, "en", lang), instructions.language(r, "de", lang), instructions.sentences(r, "less than", 3, sentences.SentenceModel(("dr",))), instructions.sentences(r, "less than", 3)).first()
    assert list(got) == [True, False, True, False]


def test_spans_in_by_bins(spark):
    from evalspark.operators import sampling

    r = random.Random(3)
    docs = [(i, "\n".join("x" * r.choice([2, 7, 30, 700]) for _ in range(r.randrange(1, 9)))) for i in range(20)] + [(20, None), (21, "")]
    spans = [(r.randrange(23), b, b + r.choice([0, 3, 40])) for b in (r.randrange(1500) for _ in range(600))]
    df = spark.createDataFrame(docs, "id int, text string")
    lines = sampling.sentences(df, "id", "text")
    want = sorted((d, s["line"], b - s["start"], e - s["start"]) for s in map(lambda x: x.asDict(), lines.collect()) for d, b, e in spans if d == s["id"] and s["start"] <= b and e <= s["end"])
    for width in (1, 8, 256, 5000):
        got = sampling.spans_in(lines, spark.createDataFrame(spans + [(3, None, None)], "id int, begin int, stop int"), "id", width).collect()
        assert sorted((x.id, x.line, x.begin, x.stop) for x in got) == want


def test_packing_is_the_exhaustive_choice(spark):
    from evalspark.operators import prompts

    class Odd:
        """Words, and a token for each seven letters of the whole: lengths don't add up."""

        def render(self, texts):
            return " ".join(texts)

        def count(self, prompt):
            return len(prompt.split()) + len(prompt) // 7

    r = random.Random(4)
    shots = ["w" * r.randrange(1, 9) + " x" * r.randrange(5) for _ in range(23)]
    rows = [(i, "q " * r.randrange(60)) for i in range(80)] + [(80, None)]
    got = prompts.pack_rendered(spark.createDataFrame(rows, "id int, text string"), spark.createDataFrame(list(enumerate(shots)), "pos int, text string"), 60, "text", Odd).collect()
    model = Odd()
    for x in got:
        whole = lambda k, t=rows[x.id][1]: model.render([*shots[:k][::-1], t or ""])
        k = max([0, *[k for k in range(len(shots) + 1) if model.count(whole(k)) < 60]])
        assert (x.shots, x.prompt) == (k, whole(k))
    with pytest.raises(ValueError):
        prompts.pack_rendered(spark.createDataFrame(rows, "id int, text string"), spark.createDataFrame(list(enumerate(shots)), "pos int, text string"), 60, "text", Odd, most=3)


def test_draws_follow_their_weights(spark):
    from collections import Counter

    from evalspark.operators import optimizer

    df = spark.createDataFrame([(1, 1.0), (2, 2.0), (3, 5.0), (4, 0.0), (5, None), (None, 9.0)], "id int, w double")
    first = Counter(optimizer.draws(df, "w", "id", 1, seed).first()["id"] for seed in range(300))
    assert set(first) == {1, 2, 3} and first[3] > first[2] > first[1] and 150 < first[3] < 225
    got = optimizer.draws(df, "w", "id", 10, 5).orderBy("turn").collect()
    assert sorted(x.id for x in got) == [1, 2, 3] and [x.turn for x in got] == [0, 1, 2]
    assert optimizer.power_law_draws(df.dropna(), "w", "id", 2, seed=3).count() == 2


def test_chat_templates(spark):
    from pyspark.sql import functions as F

    from evalspark.functions import templates
    from evalspark.operators import prompts

    turns = "array<struct<role:string,content:string>>"
    df = spark.createDataFrame([([("system", "be kind"), ("user", " hi ")],), ([("user", "a"), ("assistant", "b")],), ([],)], f"m {turns}")
    say = lambda t, gen=True, **names: [r[0] for r in df.select(templates.chat(F.col("m"), t, gen, **names)).collect()]
    assert say("{{ bos_token }}{% for message in messages %}<{{ message['role'] }}>{{ message.content | trim }}{% endfor %}", bos_token="^") == ["^<system>be kind<user>hi", "^<user>a<assistant>b", "^"]
    assert say("{%- for m in messages -%}\n  {%- if m.role == 'user' -%} U {%- elif not loop.last -%} S {%- else -%} A {%- endif -%}\n{%- endfor -%}\n{% if add_generation_prompt %}>{% endif %}") == ["SU>", "UA>", ">"]
    assert say("{% if messages[0]['role'] == 'system' %}\nS:{{ messages[0].content }}\n{% endif %}\n{% for m in messages %}\n{{ loop.index0 }}\n{% endfor %}", False) == ["S:be kind\n0\n1\n", "0\n1\n", ""]
    for wrong in ("{% for m in messages %}", "{% set x = 1 %}", "{{ nothing }}", "{{ f(messages) }}", "{% else %}", "{% endif %}", "{{ messages | length }}"):
        with pytest.raises(templates.Unknown):
            templates.chat(F.col("m"), wrong)

    config = {"system_message_template": "{content}\n", "user_message_template": "[{role}] {content} [/]", "bot_message_template": "{content}</s>", "global_prefix": "<s>", "suffix": "go:"}
    by = lambda c, **more: [r[0] for r in df.select(prompts.chat_by_config(F.col("m"), c, **more)).collect()]
    assert by(config) == ["<s>\nbe kind\n[user]  hi  [/]go:\n", "<s>\n[user] a [/]b", "<s>\n"]
    assert by(config, go_on=False)[1] == "<s>\n[user] a [/]b</s>"
    bare = {"system_message_template": "", "user_message_template": "{content}", "bot_message_template": "{content}", "bot_role": "bot"}
    assert by(bare) == [" hi ", "a", ""]

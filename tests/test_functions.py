import difflib
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from evalspark.functions import choice, instructions, sequence, spans, text
from evalspark.functions.plain import blocks_cover, lcs, longest_match, math_value, nested_entities, suffix_match
from evalspark.plans import catalogue


def one(spark, *columns, **values):
    df = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} {'array<string>' if isinstance(v, list) else 'string'}" for k, v in values.items())) if values else spark.range(1)
    return df.select(*[c.alias(f"c{i}") for i, c in enumerate(columns)]).first()


def test_squad(spark):
    f = lambda p, g: one(spark, text.squad_f1(F.col("p"), F.col("g")), text.squad_exact(F.col("p"), F.col("g")), p=p, g=g)
    assert tuple(f("The cat, sat!", "cat sat")) == (1.0, 1.0)
    assert tuple(f("a a b", "a b b")) == (pytest.approx(2 / 3), 0.0) or f("x x b", "x b b")[0] == pytest.approx(2 / 3)
    assert tuple(f("the", "")) == (1.0, 1.0)
    assert f("dog", "")[0] == 0.0


def test_libra(spark):
    r = one(spark, text.libra_em(F.col("p"), F.col("g")), text.libra_f1(F.col("p"), F.col("g")), text.libra_count(F.lit("1 and 2 and 2"), F.lit("2")), text.libra_count(F.lit("none"), F.lit("2")), p="Ответ: Красный, мяч.", g="красный мяч")
    assert r[0] == 1.0 and r[1] == pytest.approx(2 * 2 / 5) and r[2] == pytest.approx(2 / 3) and r[3] == 0.0


def test_rouge_matches_counts(spark):
    r = random.Random(1)
    rows = [(" ".join(r.choice("abc") for _ in range(r.randrange(0, 9))), " ".join(r.choice("abc") for _ in range(r.randrange(0, 9)))) for _ in range(40)]
    df = spark.createDataFrame(rows, "p string, g string")
    tokens = lambda c: text.rouge_tokens(F.col(c))
    for row in df.select("p", "g", text.rouge_n(F.col("p"), F.col("g"), 1).alias("r1"), text.rouge_n(F.col("p"), F.col("g"), 2).alias("r2"), sequence.rouge_l(tokens("p"), tokens("g")).alias("rl")).collect():
        p, g = row.p.split(), row.g.split()
        for n, got in ((1, row.r1), (2, row.r2)):
            a, b = (Counter(zip(*[x[i:] for i in range(n)])) for x in (p, g))
            same = sum((a & b).values())
            assert got == pytest.approx(2 * same / (sum(a.values()) + sum(b.values())) if same else 0.0)
        best = [[0] * (len(g) + 1) for _ in range(len(p) + 1)]
        for i, x in enumerate(p):
            for j, y in enumerate(g):
                best[i + 1][j + 1] = best[i][j] + 1 if x == y else max(best[i][j + 1], best[i + 1][j])
        assert lcs(p, g) == best[-1][-1]
        assert row.rl == pytest.approx(2 * best[-1][-1] / (len(p) + len(g)) if best[-1][-1] else 0.0)


def test_choice_ties_take_the_first(spark):
    probs = F.array(*[F.struct(F.lit(c).alias("choice"), F.lit(p).alias("prob")) for c, p in (("x", 0.2), ("y", 0.4), ("z", 0.4))])
    assert one(spark, choice.argmax(probs))[0] == "y"


def test_exam(spark):
    r = one(spark, choice.exam_choice(F.lit("1,2"), F.lit("2, 1")), choice.exam_choice_graded(F.lit("1,2"), F.lit("1,3,2")), choice.exam_choice_graded(F.lit("1,2"), F.lit("1")), choice.exam_matching(F.lit("1,2,3"), F.lit("1,3,3")), choice.exam_text(F.lit("мир,дом"), F.lit("12 Дом!")), choice.exam_matching(F.lit("1,2"), F.lit("1")))
    assert tuple(r) == (1, 1, 1, 2, 1, 0)


@pytest.mark.parametrize(
    "scores,want",
    [((7, 5, 5, 5, 1, 9), "m"), ((5, 5, 4, 6, 9, 1), "M"), ((5, 5, 5, 5, 9, 1), "m"), ((6, 5, 1, 9, 5, 5), "M"), ((9, 5, 2, 6, 3, 4), "M"), ((5, 5, 5, 5, 5, 5), "T")],
)
def test_judge_cascade(spark, scores, want):
    assert one(spark, choice.judge_decision(*[F.lit(s) for s in scores]))[0] == want


def test_judge_reads_mended_json(spark):
    said = "so: {'content_m': {'score': 8}, content_M: {'score': 3}}"
    assert one(spark, choice.judge_outcome(F.lit(said), F.lit("m")), choice.judge_outcome(F.lit("no json"), F.lit("m")))[0:2] == ("model_wins", "tie")


CASES = [
    ("punctuation:no_comma", (), "a b", True), ("punctuation:no_comma", (), "a, b", False), ("punctuation:no_comma", (), "  ", False),
    ("length_constraints:number_paragraphs", (2,), "a *** b", True), ("length_constraints:number_paragraphs", (2,), "*** a *** b ***", True), ("length_constraints:number_paragraphs", (3,), "a *** *** b", False),
    ("length_constraints:nth_paragraph_first_word", (2, 2, "hello"), "x\n\n'Hello, you", True), ("length_constraints:nth_paragraph_first_word", (2, 2, "hello"), "x", False),
    ("detectable_format:number_bullet_lists", (2,), "* a\n- b", True), ("detectable_format:number_bullet_lists", (1,), "** a", False),
    ("detectable_format:number_highlighted_sections", (1,), "*x*", True), ("detectable_format:number_highlighted_sections", (1,), "* *", False),
    ("detectable_format:title", (), "<<T>>", True), ("detectable_format:title", (), "<< >>", False),
    ("detectable_format:json_format", (), "```json\n{\"a\": 1}\n```", True), ("detectable_format:json_format", (), "{a", False), ("detectable_format:json_format", (), "null", True),
    ("combination:two_responses", (), "a ****** b", True), ("combination:two_responses", (), "a ****** a", False),
    ("startend:quotation", (), ' "x" ', True), ("startend:quotation", (), '"', False), ("startend:end_checker", ("Bye.",), 'ok bye."', True),
    ("keywords:frequency", ("привет", "at least", 2), "Привет привет", True), ("keywords:forbidden_words", (["кот"],), "Кот", False), ("keywords:forbidden_words", (["кот"],), "котик", True),
    ("change_case:english_capital", ("en",), "ABC DEF", True), ("change_case:english_lowercase", ("en",), "aBc", False), ("change_case:capital_word_frequency", ("at least", 2), "AB c DE", True),
    ("detectable_content:postscript", ("P.S.",), "text\nP.S. more", True), ("detectable_format:multiple_sections", ("Section", 2), "Section 1 a Section 2 b", True),
    ("multi-turn:constrained_start", ("I say",), "x\n I say y", True), ("language:response_language", ("ru",), "привет", True),
]


def test_instructions(spark):
    got = one(spark, *[instructions.follows(i, F.lit(r), *a) for i, a, r, _ in CASES])
    assert [(c[0], c[2], g) for c, g in zip(CASES, got)] == [(c[0], c[2], c[3]) for c in CASES]


def test_all_instructions_are_there():
    assert len(instructions.CHECKS) == 29


def test_spans(spark):
    r = one(spark, spans.parse_tag_lines(F.lit("PER: [a, b]\nLOC: []\nPER: [c]")), spans.parse_json_entities(F.lit('```json\n[["a", "b"]]\n```')), spans.parse_json_entities(F.lit("no")), spans.token_offsets(F.lit("ab  c")), spans.tokens_in(spans.token_offsets(F.lit("one two three four")), F.lit(5), F.lit(10)))
    assert r[0] == {"LOC": [], "PER": ["c"]} and r[1] == [["a", "b"]] and r[2] == []
    assert [tuple(x) for x in r[3]] == [("ab", 0, 2), ("c", 4, 5)] and r[4] == [1, 2]


def test_nested_and_math(spark):
    assert nested_entities("<A>x <B>y</B></A> </C>") == [("B", "y"), ("A", "x y")]
    assert math_value("1" + chr(92) + ";000") == math_value("1000") and math_value("1;2") != math_value("12")
    assert math_value("\\frac{1}{2}") == 0.5 == math_value("0.5")
    assert one(spark, sequence.math_equal(F.lit("\\boxed{\\frac{4}{2}}"), F.lit("2")), sequence.math_equal(F.lit("2"), F.lit("2")))[0:2] == (1.0, 0.0)


@pytest.mark.parametrize("a, b, same", [("\\sqrt{16}", "4", True), ("2^{3}", "8", True), ("\\frac{1}{\\sqrt{4}}", "0.5", True), ("3\\cdot 4", "12", True), ("2\\pi", "6.283185307", True), ("(1, 2)", "(1;2)", True), ("1, 3", "1, 2", False), ("x+1", "x+1", True), ("x+1", "1+x", False), ("50\\%", "50", True), ("5^{-1}", "0.2", True), ("1/0", "1/0", True), ("9**9**9", "3", False), ("__import__('os')", "1", False), ("3,5", "3.5", True), ("\\sqrt[3]{27}", "3", True)])
def test_math_values(a, b, same):
    assert (math_value(a) == math_value(b)) == same


def test_languages(spark):
    said = {"en": "This is the house that you and I know.", "fr": "Le chat est dans la maison et il dort avec les enfants.", "de": "Der Hund ist nicht in dem Haus und die Katze auch.", "es": "El perro es de los que no duermen por la noche."}
    for lang, t in said.items():
        assert {k: one(spark, instructions.language(F.lit(t), k))[0] for k in said} == {k: k == lang for k in said}
    assert one(spark, instructions.language(F.lit("Привет, как дела"), "ru"), instructions.language(F.lit("Привет"), "en"), instructions.language(F.lit("123"), "en"))[0:3] == (True, False, True)


def test_lemmas(spark):
    lemma = sequence.lemmas(lambda: lambda w: w.rstrip("s"))
    got = one(spark, text.rouge_tokens(F.lit("Cats, dog's dogs"), lemma), text.libra_em(F.lit("two cats"), F.lit("cat"), lemma), text.libra_f1(F.lit("cats dogs"), F.lit("cat dog"), lemma))
    assert got[0] == ["cat", "dog", "", "dog"] and got[1:] == (1.0, 1.0)


def test_entity_rows(spark):
    r = one(spark, spans.parallel_spans(F.expr("array(5, 1, 5)"), F.expr("array(6, 2, 9)"), F.expr("array('a', 'b', 'c')"), F.expr("array('x', 'y', 'z')")), spans.without_brackets(F.expr("array('[', ']', 'w')"), F.expr("array('O', 'O', 'B-X')")), spans.strings(F.lit('["a", "b"]')), spans.join_tokens(spans.tag_tokens(F.lit("Он сказал (тихо): «да» ... 1.5 !"))))
    assert [(x.begin, x.end, x.tag) for x in r[0]] == [(1, 2, "b"), (5, 6, "a"), (5, 9, "c")]
    assert [tuple(x) for x in r[1]] == [("w", "B-X")] and r[2] == ["a", "b"] and r[3] == "Он сказал (тихо): «да»... 1.5!"


def test_best_of_several_golds(spark):
    from evalspark.plans.tasks import longest

    df = spark.createDataFrame([("a b c", ["x", "a c d"]), ("a", []), (None, ["q"])], "p string, g array<string>")
    assert [r[0] for r in df.select(sequence.over_golds(longest)("p", "g")).collect()] == [pytest.approx(2 * 2 / 6), 0.0, 0.0]


def test_lcs_and_overlaps_by_brute_force(spark):
    r = random.Random(11)
    for _ in range(200):
        a, b = ([r.choice("abcde") for _ in range(r.randrange(0, 90))] for _ in range(2))
        row = [0] * (len(b) + 1)
        for x in a:
            old = row[:]
            for j, y in enumerate(b):
                row[j + 1] = old[j] + 1 if x == y else max(old[j + 1], row[j])
        assert lcs(a, b) == row[-1]
    rows = [([r.choice("xyz") for _ in range(r.randrange(0, 9))], [r.choice("xyz") for _ in range(r.randrange(0, 9))]) for _ in range(40)] + [(None, ["x"])]
    df = spark.createDataFrame(rows, "p array<string>, g array<string>")
    for n in (1, 2):
        for p, g, o in df.select("p", "g", sequence.overlap(n)(F.col("p"), F.col("g"))).collect():
            a, b = (Counter(tuple(t[i : i + n]) for i in range(len(t) - n + 1)) for t in (p or [], g))
            assert tuple(o) == (sum((a & b).values()), sum(a.values()), sum(b.values()))


def test_copied_is_matching_blocks(spark):
    a, b = "abcdefghij" * 12, "abcdefghij" * 12 + "x"
    assert one(spark, sequence.copied(F.lit(a), F.lit(b)), sequence.copied(F.lit(a), F.lit("zz")))[0:2] == (1.0, 0.0)
    assert sum(x.size for x in difflib.SequenceMatcher(None, a, b, autojunk=False).get_matching_blocks()) == len(a)


def test_matching_blocks_are_those_of_difflib():
    r = random.Random(1)
    for k in range(3000):
        letters = "ab" if k % 2 else "abcde "
        a, b = ("".join(r.choice(letters) for _ in range(r.randrange(0, n))) for n in (40, 60))
        if k % 5 == 0:
            x = r.randrange(len(a) + 1)
            b = b[:9] + a[:x] + "c" + a[x + k % 3 :] + b[9:]
        m = difflib.SequenceMatcher(None, a, b, autojunk=False)
        f, size = m.find_longest_match(0, len(a), 0, len(b)), sum(x.size for x in m.get_matching_blocks())
        assert longest_match(a, b, 0, len(a), 0, len(b)) == suffix_match(a, b) == (f.a, f.b, f.size)
        assert all(blocks_cover(a, b, share) == ((size / len(a) if a else size) >= share) for share in (0.99, 0.7, 0.4))
    long = "".join(r.choice("abcd ") for _ in range(30000))
    assert blocks_cover(long, "x" * 9000 + long[:20000] + "y" + long[20000:], 0.99) and not blocks_cover(long, long[::-1], 0.99)


def test_queries_take_whole_documents(spark, tmp_path):
    from evalspark.operators.predict import HashPredictor

    gold, texts = "a passage of the benchmark", [f"{'many words come before ' * 9}{i}" for i in range(8)]
    spark.createDataFrame([(0, gold)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    spark.createDataFrame([(i, t + gold, "en") for i, t in enumerate(texts)], "doc_id long, text string, lang string").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, 1) for i in range(8)], "doc_id long, quality int").write.parquet(str(tmp_path / "labels.parquet"))
    assert [r.lcs for r in catalogue.queries()["copied_text"](spark, str(tmp_path)).collect()] == [1.0] * 8
    said = HashPredictor().generate([f"Is this good? {t}{gold}" for t in texts])
    assert 0 < said.count("Yes") < 8
    assert catalogue.queries()["predicted_scores"](spark, str(tmp_path)).first().acc == pytest.approx(said.count("Yes") / 8)


def test_opinions(spark):
    df = spark.sql("select array(named_struct('holder', array(1), 'target', array(2), 'expr', array(3, 4), 'polarity', 'POS'), named_struct('holder', array(1), 'target', array(2), 'expr', array(4), 'polarity', 'POS')) o")
    r = df.select(spans.distinct_opinions(F.col("o")).alias("d"), spans.opinion_match(F.col("o")[0], F.col("o")[1]).alias("m"), spans.opinion_weight(F.col("o")[0], F.col("o")[1]).alias("w")).first()
    assert len(r.d) == 1 and r.m and r.w == pytest.approx((1 + 1 + 0.5) / 3)


def test_cases_letter_by_letter(spark):
    assert one(spark, choice.gold_letter(F.lit(" ßА")), text.capitals(F.lit("aŉᾳé")), text.small(F.lit("İΟΔΟΣ")))[0:3] == ("ẞA", "AŉᾼÉ", "iοδοσ")
    found = one(spark, spans.locate_span(F.lit("İn der Straße"), F.lit("STRAẞE")), spans.locate_span(F.lit("ΟΔΟΣΑ"), F.lit("οδοσ")))
    assert tuple(found[0]) == (7, 13) and tuple(found[1]) == (0, 4)


def test_queries_of_cases_follow_their_sql(spark, tmp_path):
    rows = [(0, 0, "user", "öß und straß"), (0, 1, "user", "eins ß"), (0, 2, "user", "ﬁn ŉ")]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(str(tmp_path / "conversations.parquet"))
    run = lambda name: sorted(map(tuple, catalogue.queries()[name](spark, str(tmp_path)).collect()))
    duckdb = pytest.importorskip("duckdb").connect()
    duckdb.execute(f"create view conversations as select * from '{tmp_path}/conversations.parquet/*.parquet'")
    for name in ("answer_forms", "located_opinions"):
        assert run(name) == sorted(duckdb.execute(catalogue.oracle_sql()[name]).fetchall()) and len(run(name)) == 3


def test_json_is_one_value(spark):
    right = ['{"a": [1, {"b": null}], "a": 2}', "```json\n[1, 2]\n```", " -1.5e3 ", "null", '"x"']
    wrong = ["4703443633947811 and words", "1 2", "1]", "1}", '1, "b": 2', "1] x", '{"a": 1} x', "[1] [2]", "{'a': 1}", "01", "[1,]", "words", ""]
    rows = spark.createDataFrame([(x,) for x in right + wrong], "r string").select("r", F.coalesce(instructions.follows("detectable_format:json_format", F.col("r")), F.lit(False))).collect()
    assert {r for r, ok in rows if ok} == set(right)

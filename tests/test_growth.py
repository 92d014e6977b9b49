import itertools
import random
import re
from collections import Counter

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from evalspark.functions import algebra, sequence
from evalspark.functions import plain as plain_functions
from evalspark.functions.plain import SLICE, in_slices
from evalspark.operators import rating, sentences
from evalspark.plans import catalogue

DATA = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().toString()


def test_rows_are_objects_a_few_at_a_time():
    live, most = [], []

    def one(x, y):
        live.append(x)
        most.append(len(live))
        return (x or 0) + y

    class Column:
        def __init__(self, values):
            self.values = pa.array(values)

        def __len__(self):
            return len(self.values)

        def slice(self, at, n):
            live.clear()
            return self.values.slice(at, n)

    a, b = [None if i % 7 == 0 else i for i in range(2 * SLICE + 50)], list(range(2 * SLICE + 50))
    assert in_slices(one, pa.int64(), Column(a), Column(b)).to_pylist() == [(x or 0) + y for x, y in zip(a, b)]
    assert max(most) == SLICE and len(in_slices(one, pa.int64(), Column([]), Column([]))) == 0


@pytest.mark.parametrize("name", ["ifeval_checks", "ifeval_by_instruction", "ifeval_by_category", "ifeval_prompt_level", "ifeval_more_checks"])
def test_checks_are_worked_out_once(spark, name):
    assert "size(array(" not in plan(catalogue.queries()[name](spark, DATA))


def test_sentence_pairs_read_their_counts(spark):
    assert not any("documents" in f for f in catalogue.queries()["sentence_pairs"](spark, DATA).inputFiles())


def test_sentences_are_split_once_and_outside_expressions(spark):
    counts = plan(catalogue.queries()["sentence_counts"](spark, DATA)).split("== Physical Plan ==")[1]
    assert "near_stops" in counts and "split(" not in counts


def test_tokens_are_counted_in_bounded_tables(spark):
    texts = ["Dr. A. B\tc\vd. e?", None, "", " \n", "one", "a\u00a0b c.\u2003d x\x1cy. z", "Dr. A. ... Ж. ж!"]
    encoded = [t if t is None else t.encode() for t in texts]
    whole, parts = (Counter(), Counter())
    for total, most in ((whole, 1 << 18), (parts, 2)):
        for one, two, n in plain_functions.token_counts(encoded, most):
            total.update({k: v for k, v in zip(zip(one, two), n)})
    words = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for t in texts]
    want = Counter((w.encode(), None) for ws in words for w in ws) + Counter((a.encode(), b.encode()) for ws in words for a, b in zip(ws, ws[1:]) if "." in a)
    assert whole == parts == want and list(plain_functions.token_counts([])) == []
    sizes = [len(one) for one, _, _ in plain_functions.token_counts([b"a b"] * 100, 4)]
    assert sizes == [2] and [len(x[0]) for x in plain_functions.token_counts((f"w{k}".encode() for k in range(100)), 10)] == [10] * 10
    assert plain_functions.stops(None) is None and plain_functions.stops(b" ") == {"some": False, "near": []}
    types, after = sentences.counted(spark.createDataFrame([(t,) for t in texts], "text string"), "text")
    assert {tuple(r) for r in types.collect()} >= {("dr", 2, 2), ("a", 2, 2), ("ж", 2, 1), ("one", 1, 0)} and ("dr", "a", 2) in {tuple(r) for r in after.collect()}


def test_examples_of_groups_go_to_the_rows(spark):
    assert "SortMergeJoin" not in plan(catalogue.queries()["fewshot_pack_mmlu"](spark, DATA)).split("== Physical Plan ==")[1]


def test_answers_are_spread(spark):
    assert catalogue.queries()["math_answers"](spark, DATA).rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions")) > 1


def test_battles_are_consolidated_row_by_row(spark):
    assert "keys=[id" not in plan(catalogue.queries()["battle_consolidation"](spark, DATA)).split("== Physical Plan ==")[1].split("SortMergeJoin")[0].split("BroadcastHashJoin")[0]
    names = [*rating.CODES, "invalid", None]
    rows = [(k, "a", "b", list(pair)) for k, pair in enumerate(itertools.product(names, names))]
    df = spark.createDataFrame(rows, "id int, model string, reference string, outcomes array<string>")
    apart = rating.consolidate(df.select("id", "model", "reference", F.posexplode("outcomes").alias("seq", "outcome")))
    got = df.select("id", rating.agreed(*[rating.coded(F.col("outcomes")[k]) for k in (0, 1)]).alias("winner")).filter("winner is not null")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, apart.select("id", "winner").collect())) and got.count() == 21


def test_answers_of_a_batch_are_each_read_once(spark, monkeypatch):
    r = random.Random(7)
    forms = ["{}", "{}.50", "0{}", "-{}", "\\frac{{{0}}}{{2}}", "{}/3", "{}e3", "{},5", "[{0};7]", "({0},7)", "x+{}", "{}+x", "\\{{{0},1\\}}", "\\text{{{}}}", "{}0000000001", "0.{}0000000001", "1/0", ""]
    texts = [r.choice(forms).format(r.randrange(6)) for _ in range(60)] + ["10000000000", "10000000001", "1e400", "9" * 400, "1.0000001", "1.00001"]
    gold = [*texts, *(f"so \\boxed{{{x}}}" for x in texts[:5]), None]
    rows = [(p, g) for p in [*(f"\\boxed{{{x}}}" for x in texts), "none", "\\boxed{3", None] for g in gold]
    inner = lambda g: g if plain_functions.boxed(g) is None else plain_functions.boxed(g)
    want = [float((own := plain_functions.boxed(p or "")) is not None and algebra.same_answer(own, inner(g or ""))) for p, g in rows]
    calls = []
    monkeypatch.setattr(sequence, "same_answer", lambda a, b: calls.append((a, b)) or algebra.same_answer(a, b))
    columns = [pa.array([row[k] for row in rows], pa.string()) for k in (0, 1)]
    assert sequence.math_equal.func(*columns).to_pylist() == want and 0 < sum(want) < len(want)
    calls.clear()
    assert sequence.math_equal.func(pa.array(["\\boxed{\\frac{8}{2}}"] * 500), pa.array([str(k % 250) for k in range(500)])).to_pylist() == [float(k % 250 == 4) for k in range(500)]
    assert not calls and len(sequence.math_equal.func(*(pa.array([], pa.string()),) * 2)) == 0
    assert sequence.math_equal.func(pa.array(["\\boxed{x+1}"] * 50), pa.array(["1+x"] * 50)).to_pylist() == [1.0] * 50 and len(calls) == 1


@pytest.mark.parametrize("text", ["0", "-0", "7", "-12.50", "123456789012345678", "0.123456789512345", "99999999.0000000005"])
def test_plain_numbers_have_the_value_of_their_tree(text):
    assert plain_functions.DECIMAL.fullmatch(text) and plain_functions.math_value(text) == round(plain_functions.arithmetic(text), 9)


def test_numbers_apart_are_no_answers():
    r = random.Random(5)
    forms = ["{}", "\\frac{{{0}}}{{2}}", "{}^2", "({}+1)*2", "\\sqrt{{{}}}", "-{}"]
    texts = [r.choice(forms).format(r.randrange(30)) for _ in range(120)]
    for a in texts:
        for b in texts:
            if algebra.far_apart(a, b):
                assert not algebra.same_expression(algebra.plain(a), algebra.plain(b))
    assert algebra.far_apart("2", "3") and not algebra.far_apart("2e5", "3") and not algebra.far_apart("x", "3")

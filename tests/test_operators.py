import json
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from evalspark.operators import aggregates as agg
from evalspark.operators import bootstrap, leaderboard, optimizer, predict, prompts, rating, sampling
from evalspark.plans.registry import TaskSpec
from evalspark.sources import readers, sinks


def test_known_leaderboard_means(spark):
    rows = [("a", "t", "acc", 0.725), ("a", "t", "mcc", 0.24077390894881104), ("b", "t", "acc", 0.735), ("b", "t", "mcc", 0.21467076918233885)]
    got = {r.model: r.score for r in leaderboard.task_scores(spark.createDataFrame(rows, "model string, task string, metric string, value double")).collect()}
    assert got["a"] == pytest.approx(0.4828869544744055) and got["b"] == pytest.approx(0.4748353845911694)


def test_report_layout(spark):
    df = spark.createDataFrame([("m", "b", "acc", 0.5), ("m", "a", "acc", 0.25)], "model string, task string, metric string, value double")
    assert leaderboard.report(df, "m") == "mean\ta\tb\n0.375\t0.250\t0.500"


def test_f1_and_mcc(spark):
    df = spark.createDataFrame([("x", "x"), ("x", "y"), ("y", "y"), ("z", "x")], "g string, p string")
    assert agg.f1_macro(df, "g", "p").first()[0] == pytest.approx((0.5 + 2 / 3 + 0) / 3)
    c, s, pt, pp, tt = 2, 4, 2 * 2 + 2 * 1, 8, 4 + 1 + 1
    assert agg.mcc(df, "g", "p").first()[0] == pytest.approx((c * s - pt) / math.sqrt((s * s - pp) * (s * s - tt)))
    assert agg.mcc(df.withColumn("p", F.lit("x")), "g", "p").first()[0] == 0.0


def test_multiset_identity(spark):
    a, b = spark.createDataFrame([(1,), (1,), (2,)], "k int"), spark.createDataFrame([(1,), (3,)], "k int")
    size = lambda how: agg.multiset(a, b, ["k"], how).agg(F.sum("n")).first()[0]
    assert size("intersect") + size("subtract") == 3 and size("union") == 4 and size("add") == 5


def test_numbering_is_dense(spark):
    df = sampling.numbered(spark.range(1000).select((F.col("id") * 7 % 1000).alias("k")).repartition(5), "k")
    assert df.filter("pos <> k").count() == 0 and df.count() == 1000


def test_numbering_of_wide_rows(spark):
    parts = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "64")
    try:
        rows = spark.range(200_000).select((F.col("id") * 7919 % 200_000).alias("k"), F.repeat(F.md5(F.col("id").cast("string")), 8).alias("text"))
        df = sampling.numbered(rows, "k")
        assert df.count() == 200_000 and df.filter("pos <> k").count() == 0
        pools = sampling.distractors(rows.select("k", F.col("k").cast("string").alias("c")), "k", "c")
        assert pools.filter("size(pool) <> 5").count() == 0
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", parts)


def test_small_row_operators(spark):
    df = spark.createDataFrame([(i, f"t{i}" + "[" * (i == 2), "good", "bad", "i" if i % 2 else "d", None if i == 4 else "A", f"{4 << i % 3}k") for i in range(6)], "k int, text string, a string, b string, o string, gold string, len string")
    keys = lambda x: sorted(r.k for r in x.collect())
    assert [(r.k, r.pos) for r in sampling.few_shot(df, 2, "k", start=3).orderBy("k").collect()] == [(3, 3), (4, 4)]
    shots = df.filter("k < 2")
    assert keys(sampling.held_out(df, shots, "k", True)) == [2, 3, 4, 5] and keys(sampling.held_out(df, shots, "k", False)) == list(range(6))
    first, others = sampling.positional_split(df, 2, "k")
    assert keys(first) == [0, 1] and keys(others) == [2, 3, 4, 5]
    assert keys(sampling.unmarked(df, "text")) == [0, 1, 3, 4, 5] and keys(sampling.with_gold(df, "gold")) == [0, 1, 2, 3, 5]
    assert keys(sampling.of_lengths(df, "len", ("4k",))) == [0, 3]
    both = sampling.both_ways(df.select("k", "a", "b"), "a", "b")
    assert sorted(tuple(r) for r in both.filter("k = 1").collect()) == [(1, "bad", 0), (1, "good", 1)] and both.columns == ["k", "text", "correct"]
    assert [r.side for r in sampling.parity(df, "k").orderBy("k").collect()] == [0, 1] * 3
    assert {(r.o, r.a) for r in sampling.aligned(df, "a", "b", "o").collect()} == {("i", "bad"), ("d", "good")}
    shots, rest = sampling.by_subject(df, "o", 1, "k")
    assert keys(shots) == [0, 1] and keys(rest) == [2, 3, 4, 5]
    names = spark.createDataFrame([("x", 1), ("y", 2)], "model string, n int")
    crossed = sampling.crossed(df.select("k"), names)
    assert crossed.count() == 12 and crossed.columns == ["k", "model", "n"] and sampling.crossed(df, names.limit(0)).count() == 0
    with pytest.raises(ValueError):
        sampling.crossed(df, spark.range(5).toDF("m"), limit=4)


def test_packing_drops_the_last_first(spark):
    shots = spark.createDataFrame([(0, "a", 2), (1, "b", 3), (2, "c", 4)], "pos long, text string, len long")
    q = spark.createDataFrame([(1, 1), (2, 5), (3, 50)], "id int, n int")
    got = {r.id: r.shots for r in prompts.pack(q, shots, 11, "n").collect()}
    assert got == {1: ["c", "b", "a"], 2: ["b", "a"], 3: []}


def test_swap_symmetry(spark):
    df = sampling.swapped(spark.createDataFrame([("p", "q", "1")], "a string, b string, gold string"), "a", "b", "gold")
    assert sorted(tuple(r) for r in df.collect()) == [("p", "q", "1", False), ("q", "p", "2", True)]


def test_inline_tags_round_trip(spark):
    df = spark.sql("select 'Ann saw Rome' t, array(named_struct('start', 8, 'end', 12, 'tag', 'LOC'), named_struct('start', 0, 'end', 3, 'tag', 'PER')) s")
    assert df.select(prompts.inline_tags(F.col("t"), F.col("s"))).first()[0] == "<PER>Ann</PER> saw <LOC>Rome</LOC>"


def test_generation_keeps_failures_with_their_rows(spark):
    class Model:
        def generate(self, prompts):
            if any("bad" in p for p in prompts):
                raise ValueError("no")
            return [p.upper() for p in prompts]

    df = spark.createDataFrame([(1, "ok one"), (2, "bad"), (3, "a b c d e")], "id int, prompt string").coalesce(1)
    got = {r.id: (r.pred_text, r.error, r.prompt_len) for r in predict.generate(df, "prompt", Model, 4).collect()}
    assert got == {1: ("OK ONE", None, 2), 2: ("", "no", 1), 3: ("", "prompt too long", None)}


def test_reasoning_in_two_steps(spark):
    class Model:
        def generate(self, prompts):
            return ["done" if "</think>" in p else "thinking a lot" for p in prompts]

    r = predict.with_reasoning(spark.createDataFrame([("q",)], "prompt string"), "prompt", Model, limit=1).first()
    assert r.pred_text == "done" and r.reasoning == "thinking\n</think>\n"


def test_choices_and_log_probs(spark):
    df = spark.createDataFrame([("a b c",)], "prompt string")
    probs = predict.choose(df, "prompt", ["x", "y"], predict.HashPredictor).first().probs
    assert [p.choice for p in probs] == ["x", "y"] and sum(p.prob for p in probs) == pytest.approx(1)
    t = predict.token_log_probs(df, "prompt", predict.HashPredictor).withColumn("v", predict.answer_log_prob(F.col("tokens"), F.lit(2))).first()
    assert t.v == pytest.approx(sum(x.lp for x in t.tokens[1:]) / 2)


def battles(spark, n=400):
    strength = {"a": 0.2, "b": 0.0, "c": -0.3}
    rows, names = [], sorted(strength)
    for i in range(n):
        x, y = names[i % 3], names[(i + 1) % 3]
        p = 1 / (1 + 10 ** (strength[y] - strength[x]))
        rows.append((i, x, y, 2 if i % 10 == 9 else (0 if (i * 7919 % 1000) / 1000 < p else 1)))
    return spark.createDataFrame(rows, "id long, model string, reference string, winner int")


def test_ratings_at_the_optimum(spark):
    b = battles(spark)
    counts = rating.pair_counts(b).toPandas()
    names = sorted({*counts.model, *counts.reference})
    place = {m: i for i, m in enumerate(names)}
    i, j = counts.model.map(place).to_numpy(), counts.reference.map(place).to_numpy()
    r = rating.fit(i, j, counts.wins.to_numpy(), counts.losses.to_numpy(), 3)
    p = 1 / (1 + np.exp(-rating.ALPHA * (r[i] - r[j])))
    g = rating.ALPHA * (counts.wins.to_numpy() - (counts.wins + counts.losses).to_numpy() * p)
    assert np.abs(np.bincount(i, g, 3) - np.bincount(j, g, 3) - 0.5 * r).max() < 1e-8
    got = {x.model: x.rating for x in rating.ratings(b, "b").collect()}
    assert got["b"] == pytest.approx(1000) and got["a"] > got["b"] > got["c"]
    styled = rating.ratings_with_style(b, [], names, "b")
    assert all(styled[m] == pytest.approx(got[m], abs=0.05) for m in names)
    boot = {x.model: x for x in rating.bootstrap_ratings(b, 12, "b").collect()}
    assert (boot["b"].std, boot["b"].ci_lower, boot["b"].ci_upper) == (0, 1000, 1000)


def test_consolidation(spark):
    rows = [(1, "a", "b", "model_wins", 0), (1, "a", "b", "reference_wins", 1), (2, "a", "b", "tie", 0), (3, "a", "b", "invalid", 0), (4, "a", "b", "reference_wins", 0)]
    got = {r.id: r.winner for r in rating.consolidate(spark.createDataFrame(rows, "id int, model string, reference string, outcome string, seq int")).collect()}
    assert got == {1: 2, 2: 2, 4: 1}


def test_bootstrap_centres_on_the_mean(spark):
    df = spark.range(50).select(F.col("id").alias("pos"), (F.col("id") % 2).alias("v"))
    bags = bootstrap.resample(df, "pos", 50, 40).groupBy("bag").agg(F.avg("v").alias("value"))
    s = bootstrap.summary(bags).first()
    assert abs(s["mean"] - 0.5) < 0.1 and 0.02 < s["std"] < 0.15
    w = bootstrap.weighted(spark.range(2000).withColumnRenamed("id", "k"), "k", 10).groupBy("bag").agg(F.sum("weight").alias("n"))
    assert all(1700 < r.n < 2300 for r in w.collect())


def test_battles_are_drawn_one_by_one(spark):
    # Two battles that agree in a hash folded to 1,000,003 values, with opposite winners: drawn as one, they cancel.
    rows = spark.range(60000).select("id", F.lit("a").alias("model"), F.lit("b").alias("reference"))
    folded = rows.withColumn("k", F.pmod(F.xxhash64("id", "model", "reference"), F.lit(1000003)))
    both = folded.groupBy("k").agg(F.sort_array(F.collect_list("id")).alias("ids")).filter("size(ids) = 2")
    pairs = both.select(F.posexplode("ids").alias("winner", "id"), F.lit("a").alias("model"), F.lit("b").alias("reference"))
    assert pairs.count() > 1000
    boot = {r.model: r for r in rating.bootstrap_ratings(pairs, 20, "b").collect()}
    assert boot["a"].rating == 1000 and boot["a"].std > 0 and boot["a"].ci_lower < boot["a"].ci_upper


def test_weights_are_poisson(spark):
    w = bootstrap.weighted(spark.range(20000).withColumnRenamed("id", "k"), ("k",), 20).groupBy("weight").agg(F.count(F.lit(1)).alias("n"))
    share = {r.weight: r.n / 400000 for r in w.collect()}
    assert all(abs(share[k] - math.exp(-1) / math.factorial(k)) < 0.004 for k in range(1, 6)) and max(share) > 6
    assert len(bootstrap.STEPS) > 15 and list(bootstrap.STEPS) == sorted(set(bootstrap.STEPS))


def test_categories_and_table(spark):
    s = spark.createDataFrame([("m", "a", 0.5, 0.3), ("m", "b", 0.7, 0.4), ("m", "c", 0.9, 0.0)], "model string, task string, score double, std double")
    c = leaderboard.by_category(s, spark.createDataFrame([("a", "x"), ("b", "x")], "task string, category string"))
    got = {r.category: (r["mean"], r["std"]) for r in c.collect()}
    assert got["x"] == (pytest.approx(0.6), pytest.approx(0.25)) and got["Other"][0] == pytest.approx(0.9)
    assert leaderboard.overall(c).first()["mean"] == pytest.approx(0.75)
    assert "| m | 0.700 ± 0.167 | 0.500 ± 0.300 | — |" in leaderboard.markdown(leaderboard.table(s.filter("task <> 'c' or true"), ["a", "zz"]))


def test_concatenated_documents(spark, tmp_path):
    p = tmp_path / "log.jsonl"
    docs = [{"a": 1, "b": {"c": "x\ny"}}, {"a": 2, "b": {"c": "z"}}, {"a": 3, "b": {"c": "}"}}]
    p.write_text("\n".join(json.dumps(d, indent=4) for d in docs) + "\n")
    got = readers.json_documents(spark, str(p), "a int, b struct<c:string>").orderBy("a").collect()
    assert [(r.a, r.b.c) for r in got] == [(1, "x\ny"), (2, "z"), (3, "}")]


def test_results_tree_and_resume(spark, tmp_path):
    for model in ("m1", "group/m2"):
        d = tmp_path / model
        d.mkdir(parents=True)
        (d / "acc_total.jsonl").write_text(json.dumps({"leaderboard_result": 0.5}, indent=2))
    assert sorted((r.model, r.task) for r in readers.results(spark, str(tmp_path)).collect()) == [("m1", "acc"), ("m2", "acc")]
    df = spark.createDataFrame([("m", "t", "acc", 0.5)], "model string, task string, metric string, value double")
    sinks.totals(df, str(tmp_path / "out"))
    assert sinks.finished(spark, str(tmp_path / "out"), "m", "t") and not sinks.finished(spark, str(tmp_path / "out"), "m", "u")


def test_yaml_settings(tmp_path):
    p = tmp_path / "c.yaml"
    p.write_text("defaults: {batch_size: 8, max_len: 4000}\ntasks:\n- {name: a}\n- {name: b, batch_size: 1, max_prompt_len: 5}\n")
    assert [(t["name"], t["batch_size"], t["max_prompt_len"]) for t in readers.task_configs(str(p))] == [("a", 8, 4000), ("b", 1, 5)]


def test_optimiser(spark):
    score = lambda prompt: spark.createDataFrame([(i, float(len(prompt) > 20 + i), "p") for i in range(3)], "sample int, score double, pred string")
    out = optimizer.optimise(spark, "[user]: hi", lambda prompt, feedback: prompt + " more", score, 8)
    assert out.agg(F.max("score")).first()[0] == 1.0
    ids = [r.id for r in optimizer.lineage(spark, out, out.count() - 1).collect()]
    assert ids[0] == out.count() - 1 and ids[-1] == 0


def test_task(spark):
    spec = TaskSpec("t", "generate", lambda df: df.withColumn("acc", F.col("g") == F.col("p")), {"acc": lambda s: s.agg(agg.mean(F.col("acc"))), "f1": lambda s: agg.f1_macro(s, "g", "p")})
    df = spark.createDataFrame([("x", "x"), ("y", "x")], "g string, p string")
    m = {r.metric: r.value for r in spec.evaluate(df).collect()}
    assert m["acc"] == 0.5 and spec.score(spec.evaluate(df)).first().score == pytest.approx((0.5 + m["f1"]) / 2)


def test_tasks_are_registered():
    from evalspark.plans import tasks  # noqa: F401
    from evalspark.plans.registry import TASKS

    assert len(TASKS) > 80 and {"rucola", "mmlu_ru", "libra/passkey", "ner/nerel/json", "ifeval_ru", "rag/rubqqa_judge", "ruopinionne_simple"} <= set(TASKS)
    assert TASKS["kinopoisk"].leaderboard == ("f1-macro",) and TASKS["rucola"].first_shot == 29


def test_a_task_from_rows_to_score(spark, tmp_path):
    from evalspark.plans import tasks  # noqa: F401
    from evalspark.plans.registry import TASKS

    spec = TASKS["rucola"]
    rows = spark.createDataFrame([(i, f"text {i}", i % 2) for i in range(40)], "id int, sentence string, label int")
    for split in spec.splits:
        rows.write.parquet(str(tmp_path / spec.data / spec.subset / split))
    test = spec.load(spark, str(tmp_path))
    shots = sampling.few_shot(spec.load(spark, str(tmp_path), spec.splits[1]), 2, "id", start=spec.first_shot)
    asked = spec.ask(test, shots)
    first = asked.filter("id = 3").first().prompt
    assert first.count("[user]:") == 3 and "Answer: 1" in first and first.endswith("Text: text 3\n[assistant]:\nAnswer: ")
    metrics = spec.evaluate(spec.predict(asked, predict.HashPredictor))
    assert {r.metric for r in metrics.collect()} == {"acc", "mcc"} and spec.score(metrics).count() == 1


def test_shepherded_choices(spark):
    from evalspark.plans import tasks

    rows = spark.createDataFrame([(i, f"q{i}", *[f"{x}{i}" for x in "abcd"], ("answerB", "Б", "c2", "none")[i % 4] if i < 4 else "answerA") for i in range(12)], "id int, question string, answerA string, answerB string, answerC string, answerD string, correct_answer string")
    got = {r.id: r for r in tasks.widened(rows).collect()}
    assert set(got) == set(range(12)) - {3}
    for i, want in ((0, "b0"), (1, "b1"), (2, "c2"), (5, "a5")):
        assert got[i].choices["ABCDEFGHIJKL".index(got[i].gold)] == want


def test_instructed_packing(spark):
    shots = spark.createDataFrame([(0, "s t", "one"), (1, "u v", "two")], "pos int, text string, answer string")
    q = spark.createDataFrame([("w x",)], "q string")
    say = lambda budget, **more: [(m.role, m.content) for m in prompts.pack_instructed(q, shots, budget, "q", "long long long {text}", "short {text}", **more).first().messages]
    assert say(100) == [("user", "long long long s t"), ("assistant", "one"), ("user", "short u v"), ("assistant", "two"), ("user", "short w x")]
    assert say(11) == [("user", "long long long s t"), ("assistant", "one"), ("user", "short w x")] and say(5) == [("user", "long long long w x")]


def test_judge_dialogue(spark):
    m = spark.range(1).select(prompts.judge_messages(F.lit("q"), F.lit("p"), F.array(F.lit("a"), F.lit("b")), [("case", "No")])).first()[0]
    assert [(x.role, x.content) for x in m] == [("user", "case"), ("assistant", "No"), ("user", "Question: q\n\nAnswer: p\n\nAccepted answers:\n1) a\n2) b")]


def test_ties_ids_and_exact_bags(spark):
    rows = [(i, "a", "b", (0, 0, 1, 2)[i % 4]) for i in range(200)] + [(i, "b", "c", (0, 1, 2)[i % 3]) for i in range(200, 320)]
    df = spark.createDataFrame(rows, "id int, model string, reference string, winner int")
    tie = rating.ratings_with_ties(df, "b").collect()
    assert len(tie) == 3 and 0 < 1 / (1 + math.exp(-tie[0].tie)) < 0.5
    assert {(r.model, r.number) for r in rating.model_ids(df, "id").collect()} == {("a", 0), ("b", 1), ("c", 2)}
    exact, near = ({r.model: r for r in rating.bootstrap_ratings(df, 60, "b", exact=e).collect()} for e in (True, False))
    assert exact["a"].rating == near["a"].rating and 0.4 < exact["a"].std / near["a"].std < 2.5


def test_all_models_under_all_prompts(spark):
    q = spark.createDataFrame([(1, "x"), (2, "y")], "id int, question string")
    texts = spark.createDataFrame([(0, "A {question}"), (1, "B {question}")], "prompt_id int, template string")
    got = optimizer.run_all(q, texts, {"m": predict.HashPredictor, "n": predict.HashPredictor}).collect()
    assert len(got) == 8 and {r.prompt for r in got} == {"A x", "A y", "B x", "B y"}


def test_readers_of_lines_and_images(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text("".join(json.dumps({"n": i}) + "\n" for i in range(50)))
    assert [r.n for r in readers.jsonl(spark, str(tmp_path / "a.jsonl"), "n int", first=3).collect()] == [0, 1, 2]
    (tmp_path / "img").mkdir()
    (tmp_path / "img" / "x.bin").write_bytes(b"\x89PNG\r\n\x1a\n")
    (tmp_path / "img" / "y.bin").write_bytes(b"none")
    got = sorted(r.image_url or "" for r in readers.images(spark, str(tmp_path / "img")).collect())
    assert got[0] == "" and got[1].startswith("data:image/png;base64,")


def test_categories_with_times(spark):
    scores = spark.createDataFrame([("m", "a", 0.5, 0.1, 3.0), ("m", "b", 0.7, 0.1, 4.0), ("n", "a", 0.9, 0.1, None)], "model string, task string, score double, std double, time double")
    names = spark.createDataFrame([("a", "one")], "task string, category string")
    got = [tuple(r) for r in leaderboard.category_table(scores, names, ["one", "Other"], with_times=True).collect()]
    assert got == [("n", "0.900 ± 0.100", "—", "0.900 ± 0.100", "—"), ("m", "0.600 ± 0.071", "0.700 ± 0.100", "0.500 ± 0.100", "7")]


def test_style_ratings_are_the_penalised_optimum(spark):
    """The gradient of the whole likelihood, worked out row by row, is zero at what Newton's steps end in; bags spread
    about as Poisson weights should, and a hash's bags are those of another run."""
    import random

    import numpy as np

    r = random.Random(3)
    strength, names = {"a": 0.3, "b": 0.0, "c": -0.2}, ["a", "b", "c"]
    rows = []
    for i in range(900):
        x, y = r.sample(names, 2)
        z, u = r.uniform(-1, 1), r.uniform(-1, 1)
        p = 1 / (1 + math.exp(-(math.log(10) * (strength[x] - strength[y]) + 0.8 * z)))
        rows.append((i, x, y, 2 if r.random() < 0.1 else int(r.random() > p), z, u))
    df = spark.createDataFrame(rows, "id int, model string, reference string, winner int, z double, u double").repartition(3)
    theta = rating.fit_style(df, ["z", "u"], names)[0]
    grad = -0.5 * theta
    for _, x, y, won, *f in rows:
        if won < 2:
            i, j = names.index(x), names.index(y)
            e = (1 - won) - 1 / (1 + math.exp(-(math.log(10) * (theta[i] - theta[j]) + np.dot(f, theta[3:]))))
            grad[i] += math.log(10) * e
            grad[j] -= math.log(10) * e
            grad[3:] += np.array(f) * e
    assert np.abs(grad).max() < 1e-6 and abs(theta[3] - 0.8) < 0.4 and abs(theta[4]) < 0.4
    got = {x["name"]: x for x in rating.style_ratings(df, ["z", "u"], "b", bags=40).collect()}
    again = {x["name"]: x for x in rating.style_ratings(df.repartition(2), ["z", "u"], "b", bags=40).collect()}
    assert got["b"].value == 1000 and got["b"].std == 0 and got["a"].ci_lower < got["a"].value < got["a"].ci_upper
    assert all(abs(got[k].std - again[k].std) < 1e-6 for k in got) and 0 < 1 / (1 + math.exp(-got["a"].tie)) < 0.2
    weights = rating.bag_weights(np.arange(200000, dtype=np.uint64), 5)
    assert abs(weights.mean() - 1) < 0.01 and abs(weights.var() - 1) < 0.02
    assert rating.style_ratings(df.limit(0), ["z"]).count() == 0


def test_an_arena_from_answers_to_ratings(spark):
    """A judge that likes answers with good in them, and the first place a little."""
    from evalspark.operators import arena

    class Judge:
        def probabilities(self, prompts, choices):
            out = []
            for p in prompts:
                said = json.loads(p)[-1]["content"]
                first, second = (x.count("good") for x in said.split("# Answer m\n")[1].split("# Answer M\n"))
                out.append({"m": 0.0, "M": 0.0, "T": 0.0} if "mute" in said else {"m": 0.3 + (first > second), "M": 0.2 + (second > first), "T": 0.25})
            return out

    goods = {"top": 3, "mid": 2, "low": 1}
    rows = [(i, m, f"do {i}", "good " * (n if i % 5 else 3 - n) + f"**{m}**") for i in range(30) for m, n in goods.items()]
    rows += [(30, m, "mute", "x") for m in goods] + [(31, "low", "alone", "x"), (32, "mid", "null", None), (32, "top", "null", "good")]
    answers = spark.createDataFrame(rows, "id int, model string, instruction string, output string")
    pairs = arena.pairings(answers, "mid")
    assert pairs.count() == 2 * (2 * 31 + 1)
    seen = arena.judged(pairs, Judge)
    assert {r.outcome for r in seen.filter("id = 30").collect()} == {"invalid"}
    got = {r.model: r for r in arena.arena(answers, "mid", Judge, "mid", bags=20).collect()}
    assert got["top"].rating > got["mid"].rating == 1000 > got["low"].rating and got["mid"].votes == 61
    more = {r.model: r.votes for r in arena.arena(answers, "top", Judge, bags=0, previous=seen).collect()}
    assert more["top"] > got["top"].votes
    ratings = arena.arena(answers, "mid", Judge, "mid", bags=20)
    table = spark.createDataFrame([("top", "0.5"), ("new", "0.1")], "model string, mean string")
    shown = {r.model: r.arena for r in leaderboard.with_ratings(table, ratings).collect()}
    assert shown["new"] == "—" and " ± " in shown["top"]

import hashlib
import random
import re
import time

import numpy as np
import pytest

P = pytest.importorskip("public_tokenizers")

from evalspark.llm import bpe, line_rules, mixing, pii, quality_model, secrets_scan, shards, words  # noqa: E402

#: Digits count as alike in lines, so texts of different lines are written without.
LETTERS = str.maketrans("0123456789", "abcdefghij")
ODD = [None, "", " ", "\n\n", "a", "a" * 30000, "ab " * 5000, "é ñ 日本 👩‍👩‍👧", "\x00\x1f\x85", "x\n" * 50]


def frame(spark, rows):
    """Rows with other columns whose names the operators use themselves."""
    return spark.createDataFrame([(i, t, s, 1, "n") for i, t, s in rows], "doc_id long, text string, source string, n_bytes int, node string")


def odd(spark):
    rows = [(i, t, None if i % 3 == 0 else f"s{i % 2}") for i, t in enumerate(ODD)]
    return frame(spark, [*rows, rows[4], (None, "no identifier", None)])


def test_bpe_is_the_library(spark):
    from tokenizers import Tokenizer

    path = P.path("word_bpe_49k.json")
    library = Tokenizer.from_file(path)
    r = random.Random(2)
    texts = [t or "" for t in ODD] + ["It's <|endoftext|>I'LL <|startoftext|>x<|end", "ΑΣΣ İ ſtK", "ᲊꟋ x"] + ["".join(chr(r.choice((r.randrange(32, 127), r.randrange(160, 0x2000), r.randrange(0x10000, 0x1FFFF)))) for _ in range(30)) for _ in range(150)]
    df = frame(spark, [(i, t, "s") for i, t in enumerate(texts)])
    for row in bpe.encode_decode(df, path).collect():
        want = library.encode(texts[row.doc_id], add_special_tokens=False).ids
        assert np.frombuffer(row.ids, "<u4").tolist() == want and row.n_tokens == len(want)
        assert row.decoded == library.decode(want, skip_special_tokens=False)


def test_secret_patterns():
    r = random.Random(3)
    bits = ["api_key", "TOKEN", "passwd", " ", "=", ":", '"', "'", "abcd1234", "AKIA", "ABCDEF0123456789", "deadbeef", "0a" * 16, "ſecret", "\n"]
    for _ in range(3000):
        t = "".join(r.choice(bits) for _ in range(r.randrange(0, 14)))
        want = [("assign", m.start(), m.end()) for m in re.finditer(r"(?ai:(password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", t) if len(m[2]) >= 8]
        want += [("access", m.start(), m.end()) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 16]
        want += [("hex", m.start(), m.end()) for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 32]
        base, spans = secrets_scan.scan(t)
        assert base == sorted(want, key=lambda s: (s[1], secrets_scan.KINDS.index(s[0]))) and set(base) <= set(spans)


def test_battery_tells_keys_from_text():
    r = random.Random(4)
    letters = secrets_scan.ALPHABETS["base62"]
    found = lambda n: sum(secrets_scan.random_runs(["".join(r.choice(letters) for _ in range(n))])[0] for _ in range(200))
    assert found(20) > 70 and found(32) > 140 and found(40) > 165 and found(64) > 190 and found(120) > 195
    plain = ["the_quick_brown_fox_1_jumps_over_the_lazy_dog", "aaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaa1", "abcdefghijklmnopqrstuvwxyz0123456789", "path/to/some/file/in/the/tree/v1", "Sat-Sun-Mon-Tue-Wed-Thu-Fri-2024", "getUserNameFromConfigFileList2", "IMG_20240102_123456_final", "HTTPServerErrorCount500Total"]
    assert not any(secrets_scan.random_runs(plain))
    vocabulary = "get set user name file path item list count index total value error state table column row time date config server".split()
    joins = ("_".join, "-".join, "/".join, lambda w: "".join(x.capitalize() for x in w), lambda w: "_".join(w).upper(), "".join)
    ordinary = [r.choice(joins)([r.choice(vocabulary) for _ in range(r.randrange(4, 9))]) + str(r.randrange(10 ** r.randrange(1, 8))) for _ in range(3000)]
    assert sum(secrets_scan.random_runs([x])[0] for x in ordinary) == 0


def test_false_discovery_control_is_the_greatest_count():
    r = random.Random(14)
    letters = secrets_scan.ALPHABETS["base62"]
    for _ in range(150):
        runs = ["".join(r.choice(letters[: r.choice((12, 30, 62))]) for _ in range(r.randrange(18, 60))) for _ in range(r.randrange(1, 12))]
        p = {}
        for i, x in enumerate(runs):
            if secrets_scan.is_mixed(x) and (b := secrets_scan.battery(x)) and min(b[1:4]) >= secrets_scan.LEVEL:
                p[i] = b[4]
        best = max((k for k in range(len(p) + 1) if sum(v <= secrets_scan.RATE * k / len(runs) for v in p.values()) >= k), default=0)
        want = set(sorted(p, key=lambda i: (p[i], i))[:best])
        assert {i for i, yes in enumerate(secrets_scan.random_runs(runs)) if yes} == want


def test_binomial_tail():
    for n, k in ((19, 9), (39, 17), (5, 0), (5, 6)):
        got = [secrets_scan.binomial_tail(k, n, 0.2)]
        draws = np.random.default_rng(1).binomial(n, 0.2, 200_000)
        assert got[0] == pytest.approx((draws >= k).mean(), abs=3e-3)
    assert secrets_scan.binomial_tail(100, 401, 0.2) == pytest.approx(secrets_scan.binomial_tail(100, 400, 0.2), abs=2e-3)


def test_keys_behind_names_are_found():
    r = random.Random(4)
    letters = secrets_scan.ALPHABETS["base62"]
    short, long = (["".join(r.choice(letters) for _ in range(n)) for _ in range(200)] for n in (40, 120))
    alone = [k for k in short if secrets_scan.random_runs([k])[0]]
    assert len(alone) > 165  # the power at 40 letters, as the README has it
    for before in ("export AWS_ACCESS_ID=", "AWS_SECRET_ACCESS_KEY=", "a=b=", "NAME=="):
        for keys, want in ((short, set(alone)), (long, {k for k in long if secrets_scan.random_runs([k])[0]})):
            got = {k for k in keys if ("random", len(before), len(before) + len(k)) in secrets_scan.scan(before + k + "\n")[1]}
            assert got == want
    key = next(k for k in long if secrets_scan.random_runs([k])[0])
    for t in (f"conf/my-app/{key}", f"my_app-v1/{key}", f"{key}/in/my-app", f"NAME=my-app/{key}=="):
        (kind, a, b), = secrets_scan.scan(t)[1]
        assert kind == "random" and key in t[a:b]
    url, std = ("".join(r.choice(secrets_scan.ALPHABETS[n]) for _ in range(300)) for n in ("base64url", "base64"))
    assert url in f"a/b+c/{url}"[slice(*secrets_scan.scan(f"a/b+c/{url}")[1][0][1:])]
    assert std in f"my-app_{std}"[slice(*secrets_scan.scan(f"my-app_{std}")[1][0][1:])]
    plain = ["name=the_quick_brown_fox_1_jumps_over_the_lazy_dog", "path/to/some-file/in/the_tree/v1/of/it", "=" * 40, "A=" * 30, "x=abcdefghijklmnopqrstuvwxyz0123456789"]
    assert not any(secrets_scan.scan(t)[1] for t in plain)


def test_pii_patterns():
    r = random.Random(5)
    bits = ["a@b", ".c", "@", "+1", "(555) ", "1.2.3.4", "256.", "4111 1111 1111 1111", "4111111111111111", "-", " ", "x", "123", "+44 20 7946 0958", "."]
    luhn = lambda d: sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(d))) % 10 == 0
    digits = lambda s: re.sub("[^0-9]", "", s)
    for _ in range(3000):
        t = "".join(r.choice(bits) for _ in range(r.randrange(0, 12)))
        want = [("email", m.start(), m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
        want += [("ip", m.start(), m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(x) <= 255 for x in m[0].split("."))]
        want += [("card", m.start(), m.end()) for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t) if 14 <= len(digits(m[0])) <= 19 and luhn(digits(m[0]))]
        want += [("phone", m.start(), m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 10 <= len(digits(m[0])) <= 15]
        assert pii.base_spans(t) == sorted(want, key=lambda s: (s[1], pii.KINDS.index(s[0])))


def test_semi_crf_on_held_out_examples():
    model, held = pii.trained(), pii.examples(200, seed=99)
    assert sum(model.best(t) == g for t, g in held) > 180
    base, spans = pii.scan("call (555) 123-4567 or jo [at] site [dot] org", model)
    assert not base and [k for k, _, _ in spans] == ["phone", "email"]
    for t, kind in (("call 030 1234567 now", "phone"), ("tel 06 12 34 56 78", "phone"), ("jo at site dot org", "email"), ("at 10 20 30 40 50", None), ("on 2024-01-05 12:30:22", None)):
        assert [k for k, _, _ in pii.scan(t, model)[1]] == ([kind] if kind else [])


def segmentations(model, rows, end):
    """All ways to cut the tokens before ``end``: (score, entities)."""
    if not end:
        return [(0.0, [])]
    return [(score + model.score(kind, f), found + ([(kind, start, end)] if kind else [])) for start, kind, f in rows[end] for score, found in segmentations(model, rows, start)]


def test_dynamic_programming_is_the_best_of_all_segmentations():
    model = pii.trained()
    for text in ("(555) 123-4567", "10.0.0.1", "1 at b dot org", "030 1234567", "4111-1111 22", "+1 22 333"):
        tokens = pii.TOKEN.findall(text)
        every = segmentations(model, model.segments(tokens, "", ""), len(tokens))
        score, found = max(every, key=lambda x: x[0])
        got = model.best(tokens)
        assert got == found or abs(next(s for s, f in every if f == got) - score) < 1e-9


def test_gradient_is_that_of_the_likelihood():
    tokens, gold = pii.TOKEN.findall("a 030 1234567"), [("phone", 2, 5)]

    def likelihood(weights):
        model = pii.SemiCrf()
        model.weights.update(weights)
        rows = model.segments(tokens, "", "")
        every = segmentations(model, rows, len(tokens))
        own = next(s for s, f in every if f == gold)
        return own - np.logaddexp.reduce([s for s, _ in every])

    model = pii.SemiCrf()
    r = random.Random(3)
    for row in model.segments(tokens, "", ""):
        for _, kind, f in row:
            for x in f:
                model.weights[kind, x] = r.uniform(-0.5, 0.5)
    start = dict(model.weights)
    model.step(tokens, gold, 1.0, 0.0)
    for key in list(start)[::7]:
        up, down = ({**start, key: start[key] + d} for d in (1e-5, -1e-5))
        assert model.weights[key] - start[key] == pytest.approx((likelihood(up) - likelihood(down)) / 2e-5, abs=2e-3)


def test_long_stretches_cost_in_proportion():
    model, seen = pii.trained(), []
    for n in (4000, 16000):
        began = time.process_time()
        assert pii.scan("1 " * n, model)[0] == []
        seen.append(time.process_time() - began)
    assert seen[1] < 8 * seen[0]


def test_line_measures():
    r, hashes = random.Random(6), words.WordHashes()
    for t in ["a\n\x0b\na\r\n a", "é # é\nx\nx", *[" ".join(r.choice("ab") for _ in range(r.randrange(0, 60))) for _ in range(300)]]:
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        at = {}
        for i in range(len(w) - 7):
            at.setdefault(tuple(w[i : i + 8]), []).append(i)
        covered = {j for v in at.values() if len(v) > 1 for i in v for j in range(i, i + 8)}
        seen, dup = set(), 0
        for line in t.split("\n"):
            if re.search(r"[^\x20\x09-\x0D]", line):
                dup += line in seen
                seen.add(line)
        assert line_rules.measure(t, hashes)[:5] == (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), dup, len(covered))


def test_boilerplate_depletes(spark):
    body = lambda i: " ".join(f"w{i}x{j}" for j in range(30))
    notice = " ".join(f"n{j}" for j in range(30))
    rows = [(i, f"{body(i)}\n{notice}", "h") for i in range(20)] + [(100, notice + "\nhi", "h"), (101, notice + "\nhi", "other")] + [(200 + i, body(999), "h") for i in range(15)]
    got = {r.doc_id: r for r in line_rules.quality_rules(frame(spark, rows), most_docs=10, most_share=0.1).collect()}
    assert got[0].kept and got[0].n_boiler_words == 30 and not got[100].kept and not got[100].base_failed and got[101].kept
    assert all(got[200 + i].kept for i in range(15))


def test_boilerplate_lines_are_removed(spark):
    body = lambda i: " ".join(f"w{i}x{j}" for j in range(30)).translate(LETTERS)
    rows = [(i, f"{body(i)}\n\nAll  Rights 20{i:02d}\n {body(i + 500)}\nall rights 1999", "h") for i in range(20)] + [(50, "all rights 2000", "other"), (51, None, "h"), (52, "x\n", None), (3, "all rights 2000\n\n", "h")]
    got = [(r.doc_id, r.cleaned, r.n_boiler_words) for r in line_rules.quality_rules(frame(spark, rows), most_docs=10, most_share=0.05).collect()]
    want = [(i, f"{body(i)}\n\n {body(i + 500)}", 6) for i in range(20)] + [(50, "all rights 2000", 0), (51, "", 0), (52, "x\n", 0), (3, "\n", 3)]
    assert sorted(got) == sorted(want)


def test_boilerplate_does_not_depend_on_the_size_of_the_host(spark):
    body = lambda i: " ".join(f"w{i}x{j}" for j in range(30)).translate(LETTERS)
    rows = [(i, body(i) + ("\nbig" if i < 101 else ""), "big") for i in range(2500)]
    rows += [(3000 + i, body(i) + "\nhost", "a") for i in range(12)] + [(4000 + i, body(i) + "\nfew", "b") for i in range(5)]
    got = {r.doc_id: r.n_boiler_words for r in line_rules.quality_rules(frame(spark, rows)).collect()}
    assert {i for i, n in got.items() if n} == {*range(101), *range(3000, 3012)}


def test_boilerplate_by_brute_force(spark):
    r = random.Random(12)
    lines = [" ".join(r.choice("abcdefgh") * r.randrange(1, 4) for _ in range(r.randrange(1, 9))) for _ in range(60)]
    rows = [(i, "\n".join(r.choice(lines if r.random() < 0.3 else lines[:6]) for _ in range(r.randrange(0, 8))) + (f"\n{i}x" + "y" * (i % 9)) * (i % 2), r.choice(["p", "p", "q", None])) for i in range(400)]
    most, share, least = 30, 0.1, 0.2
    norm = lambda x: re.sub("[0-9]", "0", " ".join(x.lower().split()))
    texts_of, holders = {}, {}
    for _, t, host in rows:
        texts_of.setdefault(host, set()).add(t)
    for host, all_ in texts_of.items():
        for t in all_:
            for line in {norm(x) for x in t.split("\n") if x.strip()}:
                holders.setdefault((host, line), set()).add(t)
    boiler = {k for k, v in holders.items() if len(v) > most or (len(v) > line_rules.HANDFUL and len(v) > share * len(texts_of[k[0]]))}
    want = {}
    for i, t, host in rows:
        kept = [x for x in t.split("\n") if not x.strip() or (host, norm(x)) not in boiler]
        n, left = len(t.split()), sum(len(x.split()) for x in kept)
        want[i] = ("\n".join(kept), n - left, n - (n - left) < least * n)
    got = {x.doc_id: (x.cleaned, x.n_boiler_words) for x in line_rules.quality_rules(frame(spark, rows), most_docs=most, most_share=share, least_left=least).collect()}
    assert boiler and got == {i: v[:2] for i, v in want.items()}
    kept = {x.doc_id: (x.kept, x.base_failed) for x in line_rules.quality_rules(frame(spark, rows), most_docs=most, most_share=share, least_left=least).collect()}
    assert all(k == (not failed and not want[i][2]) for i, (k, failed) in kept.items())


def test_cumulative_link_orders_grades():
    r = np.random.default_rng(0)
    grades = r.integers(0, 3, 900)
    rows = [np.unique(np.concatenate([r.integers(100, 2000, 20), [g], [3 + (r.random() < 0.5)]])) for g in grades]
    model = quality_model.fit(rows[:600], grades[:600])
    assert model.thresholds == sorted(model.thresholds)
    held = [(g, model.grade(set(f.tolist()))) for f, g in zip(rows[600:], grades[600:])]
    assert np.mean([(p >= 0.5) == (g == 2) for g, (_, p) in held]) > 0.95
    assert np.corrcoef([g for g, _ in held], [e for _, (e, _) in held])[0, 1] > 0.9
    assert quality_model.fit([], np.zeros(0, int)).grade({1}) == (None, 1.0)


def test_quality_on_documents(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    model = quality_model.train(docs, quality_model.grades(labels))
    got = quality_model.classify(docs, model).join(quality_model.grades(labels), "doc_id").toPandas()
    assert got[got.grade == 2].kept.mean() > 0.9 and got[got.grade == 0].kept.mean() < 0.1
    assert quality_model.keep_good(docs, model).count() == quality_model.classify(docs, model).filter("kept").count()


def test_quality_on_held_out_documents(spark):
    """Fitted on the documents whose hash is even, scored on the others."""
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    graded = quality_model.grades(labels)
    model = quality_model.train(docs, graded.filter("crc32(cast(doc_id as string)) % 2 = 0"))
    got = quality_model.classify(docs, model).join(graded.filter("crc32(cast(doc_id as string)) % 2 = 1"), "doc_id").toPandas()
    assert len(got) > 500 and got[got.grade == 2].kept.mean() > 0.9 and got[got.grade == 0].kept.mean() < 0.1
    assert got[got.grade == 1].kept.mean() < 0.2


def test_the_fit_is_at_the_top_of_its_likelihood():
    r = np.random.default_rng(4)
    grades = r.integers(0, 3, 300)
    rows = [np.unique([g if r.random() < 0.8 else r.integers(0, 3), 10 + r.integers(0, 3)]) for g in grades]
    penalty = 5e-3
    model = quality_model.fit(rows, grades, penalty=penalty, steps=3000, rate=0.03)
    weight = (300 / 3 / np.bincount(grades))[grades] / (300 / 3 / np.bincount(grades))[grades].sum()

    def loss(weights, cut):
        score = np.array([sum(weights.get(int(c), 0.0) for c in f) for f in rows])
        under = 1 / (1 + np.exp(-(np.array(cut)[None] - score[:, None])))
        p = np.diff(np.concatenate([np.zeros((300, 1)), under, np.ones((300, 1))], axis=1), axis=1)[np.arange(300), grades]
        return -(weight * np.log(p)).sum() + penalty / 2 * sum(w * w for w in weights.values())

    at = loss(model.weights, model.thresholds)
    for key in model.weights:
        assert loss({**model.weights, key: model.weights[key] + 0.05}, model.thresholds) > at < loss({**model.weights, key: model.weights[key] - 0.05}, model.thresholds)
    for k in range(2):
        for d in (-0.05, 0.05):
            assert loss(model.weights, [t + d * (i == k) for i, t in enumerate(model.thresholds)]) > at


def test_mix_comes_near_targets(spark):
    r = random.Random(8)
    rows = [(i, " ".join(["w"] * r.randrange(0, 40)), r.choice(["b", "a", None, "é", "a", "a"])) for i in range(600)]
    got = mixing.mix(frame(spark, rows)).toPandas()
    assert len(got) == 600 and (got.taken <= 3 * got["size"]).all()
    total = got["size"].sum()
    assert got.groupby(["source_size", "target"]).size().reset_index().target.sum() == pytest.approx(total)
    for (_, target), part in got.groupby(["source_size", "target"]):
        assert abs(part.taken.sum() - target) <= 40
    again = mixing.mix(frame(spark, rows).repartition(7)).toPandas()
    assert got.sort_values("doc_id").reset_index(drop=True).equals(again.sort_values("doc_id").reset_index(drop=True))
    kept = mixing.mix_documents(frame(spark, rows))
    assert kept.columns == ["doc_id", "text", "source", "n_bytes", "node"]


def test_shards_split_only_where_needed(spark):
    rows = [(i, "x" * (i % 50), "s") for i in range(500)] + [(900, "y" * 5000, "s")] + [(7, "z" * 90, "s")] * 60
    got = shards.shard(frame(spark, rows), limit=600).toPandas()
    assert len(got) == len(rows)
    each = got.groupby("shard").agg(b=("n_bytes", "sum"), n=("n_bytes", "size"), s=("shard_bytes", "first"))
    assert (each.b == each.s).all() and ((each.b <= 600) | (each.n == 1)).all()
    names = sorted(each.index)
    assert not any(b.startswith(a) for a, b in zip(names, names[1:]))
    for name in names:
        if name:
            assert got[got.shard.str.startswith(name[:-1])].n_bytes.sum() > 600


@pytest.mark.parametrize("rows", ["odd", "none"])
def test_odd_tables(spark, rows):
    df = odd(spark) if rows == "odd" else odd(spark).limit(0)
    n = df.count()
    path = P.path("word_bpe_49k.json")
    found = [bpe.encode_decode(df, path), secrets_scan.scan_secrets(df), pii.scan_pii(df), line_rules.quality_rules(df), mixing.mix(df), shards.shard(df), quality_model.classify(df, quality_model.Model({}, []))]
    assert [f.count() for f in found] == [n] * len(found)


def test_sha_of_empty_ids(spark):
    r = bpe.encode_decode(frame(spark, [(1, None, "s")]), P.path("word_bpe_49k.json")).first()
    assert bytes(r.ids) == b"" and r.decoded == "" and hashlib.sha256(bytes(r.ids)).hexdigest().startswith("e3b0c442")


def test_expected_grades_where_one_is_absent():
    """Grades 0 and 2 alone: certain top documents are expected to have 2, certain poor ones 0."""
    r = random.Random(6)
    rows = [(g, {quality_model.code(f"w:{g}"), quality_model.code(f"w:{r.randrange(50)}")}) for g in (0, 2) for _ in range(80)]
    model = quality_model.fit([np.array(sorted(c)) for _, c in rows], np.array([g for g, _ in rows]))
    grade = lambda g: model.grade({quality_model.code(f"w:{g}")})[0]
    assert grade(2) > 1.9 and grade(0) < 0.1
    shifted = quality_model.fit([np.array(sorted(c)) for _, c in rows], np.array([g + 3 for g, _ in rows]))
    assert shifted.grade({quality_model.code("w:2")})[0] > 4.9 and shifted.grade({quality_model.code("w:0")})[0] < 3.1


def test_rows_that_repeat_an_identifier_are_fitted_once(spark):
    rows = [(i, ("good words here " if i % 2 else "bad junk text ") * 5, "s") for i in range(40)]
    docs = frame(spark, rows * 3)
    graded = spark.createDataFrame([(i, 2 * (i % 2)) for i in range(40)], "doc_id long, grade int")
    one, three = quality_model.train(frame(spark, rows), graded), quality_model.train(docs, graded)
    assert one.weights == three.weights and one.thresholds == three.thresholds


def test_false_discoveries_are_controlled_over_the_corpus(spark):
    """Thousands of texts of one run each: few ordinary ones are called random, most keys are found, and the bars decide as
    Benjamini and Hochberg over the sorted values would, but for the width of a bar."""
    r = random.Random(21)
    letters = secrets_scan.ALPHABETS["base62"]
    vocabulary = "get set user name file path item list count index total value error state table column row time date config server".split()
    plain = ["_".join(r.choice(vocabulary) for _ in range(r.randrange(4, 9))) + str(r.randrange(10**6)) for _ in range(3000)]
    keys = ["".join(r.choice(letters) for _ in range(48)) for _ in range(150)]
    rows = [(i, f"run {x} ends", "s") for i, x in enumerate(plain + keys)]
    got = {x.doc_id: x for x in secrets_scan.scan_secrets(frame(spark, rows)).collect()}
    named = {i for i, x in got.items() if x.n_random}
    true, false = len([i for i in named if i >= 3000]), len([i for i in named if i < 3000])
    assert true > 120 and false <= max(2, 0.03 * (true + false))
    assert all(got[i].spans == f"random:4:{4 + 48}" and got[i].n_spans == 1 for i in named if i >= 3000)

    p = [secrets_scan.battery(x) for x in plain + keys if secrets_scan.is_mixed(x)]
    values = sorted(b[4] for b in p if b)
    exact = max((v for k, v in enumerate(values, 1) if v <= secrets_scan.RATE * k / len(values)), default=0)
    bars = {}
    for v in values:
        bars[secrets_scan.step(v)] = bars.get(secrets_scan.step(v), 0) + 1
    edge = 2 ** (-secrets_scan.first_bar(list(bars.items()), secrets_scan.RATE) / secrets_scan.GRADES)
    assert exact / 2**0.1 <= edge <= secrets_scan.RATE
    assert secrets_scan.first_bar([], 0.01) is None and secrets_scan.first_bar([(0, 5)], 0.01) is None


def test_members_by_bits(spark):
    """Each member is told, whatever the number of bits; with bits to spare few others are."""
    from pyspark.sql import functions as F

    rows = spark.range(4000).select(F.concat(F.lit("h"), (F.col("id") % 7).cast("string")).alias("host"), F.col("id").alias("text_key"))
    inside = rows.filter("text_key % 10 = 0")
    for most, share in ((1 << 29, 0.05), (1 << 15, 0.05), (64, 0.05)):
        bits, n = line_rules.members(inside, ["host", "text_key"], most)
        told = rows.withColumn("b", line_rules.bit_of(["host", "text_key"], n)).withColumn("__bucket", F.bitmap_bucket_number("b")).join(F.broadcast(bits), "__bucket", "left")
        got = {r.text_key for r in told.filter(line_rules.is_set(F.col("bits"), F.bitmap_bit_position("b"))).collect()}
        assert {i for i in range(0, 4000, 10)} <= got and len(got) < 400 + share * 3600
    assert n == 1 << 15


def test_texts_that_lose_lines_are_the_same_by_few_bits(spark):
    r = random.Random(31)
    rows = []
    for i in range(400):
        lines = ["".join(r.choice("abcdefgh") for _ in range(30)).translate(LETTERS) for _ in range(3)]
        if i % 4 == 0:
            lines.insert(1, "a line that very many of these have")
        rows.append((i, "\n".join(lines), "s"))
    df = frame(spark, rows)
    got = {x.doc_id: (x.n_boiler_words, x.cleaned, x.kept) for x in line_rules.quality_rules(df, most_docs=50).collect()}
    joined, few = ({x.doc_id: (x.n_boiler_words, x.cleaned, x.kept) for x in line_rules.quality_rules(df, most_docs=50, most_lines=0, **more).collect()} for more in ({}, {"most_bits": 1}))
    assert got == joined == few and len(got) == 400 and sum(n > 0 for n, _, _ in got.values()) == 100
    assert all("very many" not in text for _, text, _ in got.values())

import collections
import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

pytest.importorskip("public_tokenizers")

from evalspark.llm import common, components, exact, jaccard, suffix  # noqa: E402
from test_text_operators import frame, odd  # noqa: E402


def near(docs):
    """Sizes and components by all pairs that share a shingle."""
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    sets, holders, root = {}, collections.defaultdict(list), {}
    for i, t in docs:
        w = [x.translate(lower) for x in re.findall(r"[^\x20\x09-\x0D]+", t or "")]
        sets[i] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
        root[i] = i
        for s in sets[i]:
            holders[s].append(i)

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, s in sets.items():
        for j, n in collections.Counter(j for x in s for j in holders[x] if j < i).items():
            if 100 * n >= 75 * (len(s) + len(sets[j]) - n):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return {i: (len(s), find(i)) for i, s in sets.items()}


def alike(seed):
    r = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    some = lambda n: [r.choice(vocabulary) for _ in range(n)]
    passage, out = some(70), []
    for _ in range(16):
        base = some(r.choice([1, 3, 6, 12, 40, 90, 190, 260, 800]))
        for _ in range(r.choice([1, 2, 5, 24])):
            w = list(base)
            for _ in range(int(len(w) * r.choice([0, 0.01, 0.02, 0.03, 0.05]))):
                w[r.randrange(len(w))] = r.choice(vocabulary)
            out.append(" ".join(w + passage * (r.random() < 0.4)))
    out += [" ".join(some(r.randrange(5, 40)) + passage + some(8)) for _ in range(40)]
    return list(enumerate([*out, None, "", " \n", "Foo bar", "foo  BAR", "foo"]))


@pytest.mark.parametrize("tile", [jaccard.TILE, 5])
def test_near_components_by_brute_force(spark, monkeypatch, tile):
    """With small tiles, widely shared parts go to many tasks."""
    monkeypatch.setattr(jaccard, "TILE", tile)
    rows = alike(3)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.near_components(frame(spark, [(i, t, "s") for i, t in rows])).collect()}
    assert got == near(rows)


def test_tables_that_are_done_with_go(spark):
    import os

    mark = len(common.WRITTEN)
    got = jaccard.near_components(frame(spark, [(i, t, "s") for i, t in alike(5)]))
    left = common.WRITTEN[mark:]
    n = got.count()
    common.discard(spark, mark, left[0])
    assert n == len(alike(5)) and len(left) < 8 and common.WRITTEN[mark:] == [left[0]]
    assert [os.path.exists(p.removeprefix("file:")) for p in left] == [True] + [False] * (len(left) - 1)


def test_sketches_bound_the_difference():
    r = np.random.default_rng(1)
    for n in (3, 50, 400, 3000):
        a = np.unique(r.integers(0, 1 << 63, n).astype(np.uint64))
        b = np.unique(np.concatenate([a[: n * 9 // 10], r.integers(0, 1 << 63, n // 5 + 1).astype(np.uint64)]))
        d = len(np.setxor1d(a, b))
        assert jaccard.distances([jaccard.sketch(a)], [jaccard.sketch(b)])[0] <= d
        if d <= (len(a) + len(b)) // 7 and 100 * min(len(a), len(b)) >= 75 * max(len(a), len(b)):
            assert len(np.intersect1d(jaccard.signatures(a)[0], jaccard.signatures(b)[0]))


def test_one_of_each_component_stays(spark):
    rows = [(1, "a b c d e f"), (2, "a b c d e f"), (3, "q r s t u v"), (4, None)]
    kept = jaccard.keep_one(frame(spark, [(i, t, "s") for i, t in rows]))
    assert sorted(r.doc_id for r in kept.collect()) == [1, 3, 4] and kept.columns[3:] == ["n_bytes", "node"]


def test_rows_of_one_identifier_are_rows_of_their_own(spark):
    first, other, third, fourth = "a b c d e f", "g h i j k l", "q r s t u v", "w x y z a a"
    rows = [(5, first), (5, other), (1, first), (None, third), (None, third), (7, fourth), (7, fourth), (None, None), (None, ""), (2, third)]
    kept = jaccard.keep_one(frame(spark, [(i, t, "s") for i, t in rows]))
    want = [(1, first), (5, other), (2, third), (7, fourth), (None, None), (None, "")]
    assert sorted(map(str, ((r.doc_id, r.text) for r in kept.collect()))) == sorted(map(str, want))
    assert kept.columns == ["doc_id", "text", "source", "n_bytes", "node"]


def test_components(spark):
    edges = [(i, i + 1) for i in range(30)] + [(100, 101), (102, 101), (5, 5), (200, 199)]
    got = {r.node: r.root for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(got[i] == 0 for i in range(1, 31)) and got[101] == got[102] == 100 and got[200] == 199 and 5 in got


def repeats(docs, n=400):
    """Repeated strings by the windows themselves."""
    data = [(i, (t or "").encode()) for i, t in docs]
    seen = collections.Counter(b[k : k + n] for _, b in data for k in range(len(b) - n + 1))
    out = {}
    for i, b in data:
        gone = bytearray(len(b))
        for k in range(len(b) - n + 1):
            if seen[b[k : k + n]] > 1:
                gone[k : k + n] = b"\x01" * n
        kept = bytes(x for x, g in zip(b, gone) if not g)
        out[i] = (len(b), sum(gone), sum(gone[k] and (k == 0 or not gone[k - 1]) for k in range(len(gone))), hashlib.sha256(kept).hexdigest())
    return out


def test_repeats_by_brute_force(spark):
    r = random.Random(5)
    some = lambda n: "".join(r.choice("abcdé ñ") for _ in range(n))
    passages = [some(n) for n in (395, 399, 400, 401, 450, 900)]
    rows = []
    for i in range(60):
        t = ""
        for _ in range(r.randrange(0, 4)):
            k, p = r.random(), r.choice(passages)
            t += p[r.randrange(0, 60) * (k < 0.2) :] if k < 0.5 else "abcab" * r.randrange(60, 200) if k < 0.6 else "z" * r.randrange(380, 900) if k < 0.65 else some(r.randrange(0, 500))
        rows.append((i, t))
    rows += [(200, None), (201, ""), (202, rows[3][1]), (203, rows[3][1])]
    got = {x.doc_id: (x.n_bytes, x.n_removed, x.n_spans, x.kept_sha256) for x in suffix.remove_repeats(frame(spark, [(i, t, "s") for i, t in rows]).repartition(3)).collect()}
    assert got == repeats(rows)


def shared_words(docs, n=50):
    """Words covered by n words in a row that another document has."""
    rows, holders = [(i, (t or "").encode().split()) for i, t in docs], collections.defaultdict(set)
    for i, w in rows:
        for k in range(len(w) - n + 1):
            holders[tuple(w[k : k + n])].add(i)
    return {i: len({j for k in range(len(w) - n + 1) if len(holders[tuple(w[k : k + n])]) > 1 for j in range(k, k + n)}) for i, w in rows}


def test_shared_passages_by_brute_force(spark):
    r = random.Random(9)
    some = lambda n: " ".join(r.choice("ab cde fé".split(" ")) + str(r.randrange(40)) for _ in range(n))
    passages = [some(n) for n in (48, 49, 50, 51, 60, 130)]
    rows = []
    for i in range(70):
        t = [some(r.randrange(0, 60))]
        for _ in range(r.randrange(0, 3)):
            t += [r.choice(passages), some(r.randrange(0, 30))]
        rows.append((i, r.choice(" \n").join(t)))
    rows += [(100, some(60) + " " + passages[5] + " " + passages[5]), (101, "x " * 300), (102, passages[3]), (103, passages[3]), (104, None), (105, "\t"), (106, passages[4]), (107, "y z " * 80), (108, "z " + "y z " * 30)]
    got = {x.doc_id: x.n_repeat_words for x in suffix.remove_repeats(frame(spark, [(i, t, "s") for i, t in rows]).repartition(3)).collect()}
    assert got == shared_words(rows) and max(got.values()) > 130


def test_family_levels_are_powers_of_two():
    for kind in (0, 1):
        family, r = suffix.Family(kind), np.random.default_rng(2)
        for k in range(7):
            symbols = r.integers(0, 256, 2000).astype(np.uint8) if kind == 0 else r.integers(0, 1 << 60, 2000).astype(">u8")
            place = np.arange(100, 1600, 300)
            whole = suffix.suffixes(symbols, place, np.arange(5, dtype=np.uint64), kind)
            family.add(whole.view(f"V{suffix.SUFFIX}").ravel(), np.full(5, k), np.zeros(5, np.uint8))
        assert [x.batches for x in family.levels] == [4, 2, 1] and len(family.whole().keys()) == 35
        assert all(sorted(x.whole.tolist()) == x.whole.tolist() for x in family.levels)


def test_a_batch_meets_all_levels():
    r = random.Random(6)
    passage = "".join(r.choice("abcdef ") for _ in range(900))
    rows = [(i, "".join(r.choice("xyz ") for _ in range(50)) + passage[r.randrange(0, 300) :][: r.randrange(380, 600)]) for i in range(12)]
    docs = [(i, np.frombuffer(t.encode(), np.uint8)) for i, t in rows]
    powers, family = suffix.Powers(), suffix.Family()
    held = []
    for i, data in docs:
        place, key = suffix.anchors(data, suffix.HALF[0], powers)
        held.append((np.full(len(place), i), place, suffix.suffixes(data, place, key, 0).view(f"V{suffix.SUFFIX}").ravel()))
    node, place, whole = (np.concatenate(x) for x in zip(*held))
    for at in range(0, len(node), 3):
        family.add(whole[at : at + 3], node[at : at + 3], np.zeros(len(node[at : at + 3]), np.uint8))
    level = family.whole()
    at = np.searchsorted(level.whole, whole)
    lo, hi = level.lo[at], level.hi[at]
    got = collections.defaultdict(list)
    for i, p, a, b in zip(node.tolist(), place.tolist(), lo.tolist(), hi.tolist()):
        if a <= b:
            got[i].append((p - b, p + suffix.LENGTH - a))
    want = repeats(rows)
    for i, data in docs:
        found = suffix.spans(*(np.array(x) for x in zip(*got[i]))) if got[i] else []
        assert (sum(b - a for a, b in found), len(found)) == want[i][1:3]


def test_exact_dedup_keeps_the_least(spark):
    rows = [(5, "a b"), (3, "a \t\n b"), (9, "a  b"), (1, "ab"), (4, None), (2, ""), (8, "x"), (8, "x")]
    got = exact.exact_dedup(frame(spark, [(i, t, "s") for i, t in rows]).repartition(3), micro_batches=3).collect()
    by = {r.doc_id: r for r in got}
    assert len(got) == 8 and by[5].keep_id == by[9].keep_id == 3 and by[3].kept and not by[5].kept and by[5].group_size == 3
    assert by[4].keep_id == 2 and by[1].group_size == 1 and sum(r.kept for r in got if r.doc_id == 8) == 1
    assert by[5].text_sha256 == hashlib.sha256(b"a b").hexdigest()


def test_weak_digests_are_told_apart_by_bytes(spark):
    rows = [(i, f"text {i % 7}", "s") for i in range(40)]
    weak = lambda c: F.substring(F.sha2(c, 256), 1, 1)
    got = {r.doc_id: (r.keep_id, r.group_size, r.kept) for r in exact.exact_dedup(frame(spark, rows), digest=weak).collect()}
    assert got == {i: (i % 7, len(range(i % 7, 40, 7)), i < 7) for i in range(40)}


def test_dedup_keeps_columns(spark):
    df = frame(spark, [(1, "a", "s"), (2, "a ", "s"), (3, "a", "s"), (4, "b", "s"), (4, "b", "s")])
    out = exact.dedup_documents(df)
    assert out.columns == df.columns and sorted(r.doc_id for r in out.collect()) == [1, 2, 4]


def test_rows_of_one_identifier_are_deduplicated_by_row(spark):
    rows = [(1, "a b c"), (2, "a b c"), (2, "x y z"), (3, "a b c d"), (2, "x  y z"), (None, "a b c"), (None, "n"), (None, "n"), (4, None), (5, "")]
    out = exact.dedup_documents(frame(spark, [(i, t, "s") for i, t in rows]).repartition(4))
    kept = sorted(((r.doc_id, r.text) for r in out.collect()), key=str)
    want = [(None, "a b c"), (None, "n"), (3, "a b c d"), (4, None)]
    assert [x for x in kept if x[0] != 2] == sorted(want, key=str) and [x[1].split() for x in kept if x[0] == 2] == [["x", "y", "z"]]


def test_state_goes_on_over_calls(spark, tmp_path):
    first = frame(spark, [(5, "a b", "s"), (6, "c", "s"), (7, "d", "s")])
    later = frame(spark, [(3, "a  b", "s"), (8, "c", "s"), (9, "e", "s"), (10, "e", "s")])
    state = str(tmp_path / "state")
    one = {r.doc_id: (r.keep_id, r.group_size, r.kept) for r in exact.exact_dedup(first, state_dir=state).collect()}
    two = {r.doc_id: (r.keep_id, r.group_size, r.kept) for r in exact.exact_dedup(later, state_dir=state).collect()}
    assert one == {5: (5, 1, True), 6: (6, 1, True), 7: (7, 1, True)}
    assert two == {3: (3, 2, True), 8: (6, 2, False), 9: (9, 2, True), 10: (9, 2, False)}


def test_locators_name_a_row(spark, tmp_path):
    frame(spark, [(i, f"t{i % 3}", "s") for i in range(30)]).repartition(3).write.parquet(str(tmp_path / "d"))
    docs = spark.read.parquet(str(tmp_path / "d"))
    a, b = ({r.doc_id: r.locator for r in exact.exact_dedup(x).collect()} for x in (docs, docs.filter("doc_id > 4")))
    assert len(set(a.values())) == 30 and all(a[i] == b[i] for i in b)
    twice = docs.unionByName(docs)
    assert exact.dedup_documents(twice).count() == 3


@pytest.mark.parametrize("rows", ["odd", "none"])
def test_odd_tables(spark, rows):
    df = odd(spark) if rows == "odd" else odd(spark).limit(0)
    n = df.count()
    assert [f.count() for f in (jaccard.near_components(df), suffix.remove_repeats(df), exact.exact_dedup(df))] == [n, n, n]


def same_digest(text):
    """A digest that tells nothing."""
    from pyspark.sql import functions as F

    return F.concat(F.lit("d"), F.substring(text, 1, 0))


def calls(spark, tmp_path, digest, *batches):
    state, out = str(tmp_path / "calls"), {}
    for batch in batches:
        for r in exact.exact_dedup(spark.createDataFrame(batch, "doc_id long, text string"), state_dir=state, digest=digest).collect():
            out[r.doc_id] = (r.keep_id, r.group_size, r.kept)
    return out


def test_bytes_are_compared_across_calls(spark, tmp_path):
    """A constant digest: texts of later calls are told from those of earlier ones by their bytes."""
    got = calls(spark, tmp_path / "a", same_digest, [(10, "xyz")], [(11, "other")], [(12, "xyz"), (13, "third"), (9, "other")], [(14, "third"), (15, "new")])
    assert got == {10: (10, 1, True), 11: (11, 1, True), 12: (10, 2, False), 13: (13, 1, True), 9: (9, 2, True), 14: (13, 2, False), 15: (15, 1, True)}
    got = calls(spark, tmp_path / "b", same_digest, [(1, "aaa"), (2, "bbb")], [(3, "aaa"), (4, "ccc")])
    assert got == {1: (1, 1, True), 2: (2, 1, True), 3: (1, 2, False), 4: (4, 1, True)}


def test_calls_read_their_own_log_and_state(spark, tmp_path):
    """With a digest that tells texts apart, later calls find copies of all earlier ones."""
    r = random.Random(8)
    texts = [r.choice(["a", "b", "c d", "c  d", "e", None, ""]) for _ in range(40)]
    batches = [[(i, t) for i, t in enumerate(texts) if i % 4 == k] for k in range(4)]
    got = calls(spark, tmp_path, exact.sha256, *batches)
    seen = {}
    for batch in batches:
        for i, t in batch:
            seen.setdefault(" ".join((t or "").split()), []).append(i)
        for i, t in batch:
            group = seen[" ".join((t or "").split())]
            assert got[i] == (min(group), len(group), i == min(group))

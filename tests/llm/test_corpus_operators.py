import hashlib
import random
import re
import zlib
from collections import Counter

import pytest

P = pytest.importorskip("public_tokenizers")

from evalspark.llm import align, merkle, queries, token_counts  # noqa: E402

ODD = [None, "", " ", "  ", "\n\n", "a", "a" * 9000, "ab " * 3000, "é ñ 日本 👩‍👩‍👧", "\x00\x1f\x85 x", "x\n" * 50, "a ▁b", "<|endoftext|> <s> <0x41> x", "!\x1c! \xa0 y", "é a\n̈"]


def frame(spark, rows):
    """Rows with other columns whose names the operators use themselves."""
    return spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, source string, lang string, n_chars long, text string, idx int, g string")


def texts(seed, n):
    r = random.Random(seed)
    letters = "abc  \n\t.,'1é日👩▁İ́"
    words = ["the", "token", "izer's", "<|endoftext|>", "un", "believ", "able", "  ", "\n", "1234", "ſ", "日本語"]
    out = ["".join(r.choice(letters) for _ in range(r.randrange(60))) for _ in range(n // 2)]
    return out + ["".join(r.choice(words) + r.choice(["", " ", " ", "\n"]) for _ in range(r.randrange(80))) for _ in range(n - n // 2)]


def test_token_counts_are_the_library_s(spark):
    """Chunks of 40 code points with overlaps of 4, so that most texts are cut and some alignments fail at first."""
    import sentencepiece
    from tokenizers import Tokenizer

    word, byte = P.path("word_bpe_49k.json"), P.path("byte_bpe_50k.json")
    piece = P.path("piece_bpe_32k.model")
    every = [t for t in ODD if t is None or len(t) < 9000] + texts(1, 150) + ["longwordswithoutspace" * 30 + " end", "ab " * 400]
    df = frame(spark, [(i, "s", "en", 1, t) for i, t in enumerate(every)])
    libraries = {p: (lambda t, m=Tokenizer.from_file(p): len(m.encode(t, add_special_tokens=False).ids)) for p in (word, byte)}
    libraries[piece] = lambda t, m=sentencepiece.SentencePieceProcessor(model_file=piece): len(m.encode(t))
    for path, count in libraries.items():
        got = token_counts.count_tokens(df, path, limit=20, chunk=40, overlap=4).collect()
        assert len(got) == len(every)
        for row in got:
            text = every[row.doc_id] or ""
            assert (row.n_tokens, row.n_bytes) == (count(text), len(text.encode())) and row.over_limit == (row.n_tokens > 20), (path, text)


def test_token_counts_of_odd_tables(spark):
    df = frame(spark, [(None if i % 5 == 0 else i, None, None, None, t) for i, t in enumerate(ODD)] * 2)
    assert token_counts.count_tokens(df, P.path("word_bpe_49k.json")).count() == 2 * len(ODD)
    assert token_counts.count_tokens(df.limit(0), P.path("word_bpe_49k.json")).count() == 0


def test_a_tokenizer_without_proof_is_never_cut(tmp_path):
    """Unigrams of a vocabulary that spans spaces, and a normaliser that looks further, have no gap."""
    import json

    spec = json.load(open(P.path("word_bpe_49k.json"), encoding="utf-8"))
    spec["normalizer"]["normalizers"].append({"type": "Strip", "strip_left": True, "strip_right": True})
    path = tmp_path / "own.json"
    path.write_text(json.dumps(spec))
    assert token_counts.JsonTokenizer(str(path)).gap is None
    assert token_counts.JsonTokenizer(P.path("word_bpe_49k.json")).gap and token_counts.PieceTokenizer(P.path("piece_bpe_32k.model")).gap


def aligned_by_hand(every):
    """Tokens from whole texts, links by comparing all byte ranges."""
    import sentencepiece
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=P.path("piece_bpe_32k.model"))
    plain = {c: i for i, c in enumerate(align.byte_letters())}
    rows, counts = [], Counter()
    for text in every:
        ia, ib = a.encode(" " + (text or ""), add_special_tokens=False).ids, b.encode(text or "")
        da = [bytes(plain[c] for c in a.id_to_token(i)) for i in ia]
        db = [bytes([int(p[3:5], 16)]) if b.is_byte(i) else p.replace("▁", " ").encode() for i, p in ((i, b.id_to_piece(i)) for i in ib)]
        data = (" " + (text or "")).encode()
        if not text or b"".join(da) != data or b"".join(db) != data:
            rows.append(None)
            continue
        sa, sb = ([(sum(map(len, d[:i])), sum(map(len, d[: i + 1]))) for i in range(len(d))] for d in (da, db))
        links = [(i, j) for i, x in enumerate(sa) for j, y in enumerate(sb) if x[0] < y[1] and y[0] < x[1]]
        counts.update((ia[i], ib[j]) for i, j in links)
        common = sorted({e for _, e in sa} & {e for _, e in sb})
        groups, low = [], 0
        for end in common:
            groups.append(([ia[i] for i, x in enumerate(sa) if low < x[1] <= end], [ib[j] for j, y in enumerate(sb) if low < y[1] <= end]))
            low = end
        rows.append((ia, ib, links, groups))
    best = {}
    for (x, y), n in counts.items():
        best[y] = max(best.get(y, 0), n)
    out = []
    for row in rows:
        if row is None:
            out.append((0, 0, 0, 0, 0, 0, 0, ""))
            continue
        ia, ib, links, groups = row
        found = [counts[ia[i], ib[j]] for i, j in links]
        said = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups)
        out.append((len(ia), len(ib), len(groups), len(links), sum(len(x) * len(y) for x, y in groups), sum(n == best[ib[j]] for n, (_, j) in zip(found, links)), sum(found), hashlib.sha256(said.encode()).hexdigest()))
    return out


@pytest.mark.parametrize("hot", [1 << 20, 40, 0])
def test_alignment_against_all_byte_ranges(spark, hot):
    every = [t for t in ODD if t is None or len(t) < 9000][:40] + texts(2, 120) * 2
    every = [t if t is None else t[:300] for t in every]
    df = frame(spark, [(i, "s", "en", 1, t) for i, t in enumerate(every)])
    got = {r[0]: tuple(r[1:]) for r in align.align_tokenizers(df, P.path("byte_bpe_50k.json"), P.path("piece_bpe_32k.model"), hot=hot).collect()}
    want = aligned_by_hand(every)
    assert len(got) == len(every)
    for i, row in enumerate(want):
        assert got[i] == row, every[i]


def test_alignment_of_odd_tables(spark):
    df = frame(spark, [(None if i % 5 == 0 else i, None, None, None, t) for i, t in enumerate(ODD)] * 2)
    paths = P.path("byte_bpe_50k.json"), P.path("piece_bpe_32k.model")
    rows = align.align_tokenizers(df, *paths).collect()
    assert len(rows) == 2 * len(ODD) and all(r.n_links >= max(r.n_a, r.n_b) for r in rows)
    assert align.align_tokenizers(df.limit(0), *paths).count() == 0
    assert align.align_tokenizers(frame(spark, [(1, "s", "en", 1, None)]), *paths).first().groups_sha256 == ""


def H(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def tree(nodes):
    """The root of a list, and by node the list of (siblings before, siblings after) by level."""
    ways, at = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for i, way in enumerate(ways):
            start = at[i] // 3 * 3
            way.append((nodes[start : at[i]], nodes[at[i] + 1 : start + 3]))
            at[i] //= 3
        nodes = [H(*nodes[i : i + 3]) for i in range(0, len(nodes), 3)]
    return nodes[0], ways


def manifest_by_hand(rows):
    part = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    by = {}
    for doc, source, lang, n, text in rows:
        cut = text.replace("\n", "") if text is not None and doc is not None and zlib.crc32(str(doc).encode()) % 2 == 0 else text
        head = (doc, source, lang, n)
        by.setdefault(source, []).append((-1 if doc is None else doc, H(*map(part, (*head, text))), H(*map(part, (*head, cut))), doc))
    names = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    trees = {s: tree([x[1] for x in sorted(by[s])]) for s in names}
    root, tops = tree([trees[s][0] for s in names])
    out = []
    for s, top in zip(names, tops):
        for (_, leaf, seen, doc), way in zip(sorted(by[s]), trees[s][1]):
            full, h = way + top, seen
            for left, right in full:
                h = H(*left, h, *right)
            out.append((doc, leaf, trees[s][0], root, H(*[x for left, right in full for x in left + right]), h, h == root))
    return out


def key(rows):
    return sorted(tuple(r) for r in map(lambda r: [-1 if r[0] is None else r[0], *r[1:]], rows))


@pytest.mark.parametrize("levels", [6, 1, 2])
def test_manifest_against_a_plain_tree(spark, levels):
    r = random.Random(levels)
    rows = [(i, r.choice(["a", "a", "a", None, "", "é", "z", "\U00010000", "￿", "a b", "n"]), r.choice(["en", None]), r.choice([3, None]), r.choice(["x\ny", "x", None, ""])) for i in range(300)]
    rows += [(1000, "one", "en", 1, "alone\n")] + [(i, "hot", "en", i, "t\n" * (i % 3)) for i in range(2000, 2000 + 400)]
    rows += [(7, "a", "en", 1, "again\n"), (7, "a", "en", 1, "again\n"), (7, "a", "en", 1, "other"), (None, "a", None, None, "no\nidentifier"), (None, "a", None, None, None)]
    assert key(merkle.manifest(frame(spark, rows), levels=levels).collect()) == key(manifest_by_hand(rows))


def test_manifest_of_small_tables(spark):
    assert merkle.manifest(frame(spark, []).limit(0)).count() == 0
    for n in (1, 2, 3, 4, 10):
        rows = [(i, "s", "en", 1, "a\nb") for i in range(n)]
        assert key(merkle.manifest(frame(spark, rows)).collect()) == key(manifest_by_hand(rows))


def test_manifest_sql(spark, tmp_path):
    duckdb = pytest.importorskip("duckdb")
    rows = [(i, [None, "a", "b", ""][i % 4], None if i % 7 == 0 else "en", i % 5 or None, None if i % 11 == 0 else "l\n" * (i % 4)) for i in range(130)]
    frame(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
    names = [d[0] for d in con.execute(queries.OP13_SQL).description]
    got = con.fetchall()
    assert names == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"] and key(got) == key(manifest_by_hand(rows))

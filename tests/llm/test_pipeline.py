import re

import pytest

pytest.importorskip("public_tokenizers")

import corpus_pipeline  # noqa: E402
from evalspark.llm import bpe, mixing, quality_model  # noqa: E402
from test_pair_operators import alike, near  # noqa: E402
from test_text_operators import frame  # noqa: E402


def same(df):
    return sorted(map(str, ((r.doc_id, r.text, r.source) for r in df.collect())))


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, ("big", "small", None)[i % 7 % 3]) for i, t in alike(4)]
    return rows + [(1, "words of a row that repeats an identifier", "big"), (None, "no identifier", "big"), (None, rows[5][1], "big")]


@pytest.fixture()
def folder(spark, tmp_path, docs):
    frame(spark, docs).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, int(i % 4 > 0), 0) for i in range(3)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    return str(tmp_path)


def test_too_few_labels_reject_nothing(spark, folder, docs):
    table = spark.read.parquet(f"{folder}/documents.parquet")
    assert same(corpus_pipeline.quality(spark, table, folder)) == same(table)


def test_quality_drops_what_its_model_rejects(spark, docs):
    rows = [(i, ("good words here " if i % 2 else "bad stuff there ") * 5, "s") for i in range(60)]
    df = frame(spark, [*rows, (None, None, "s"), (None, rows[1][1], None)])
    model = quality_model.train(df, spark.createDataFrame([(i, 2 * (i % 2)) for i in range(60)], "doc_id long, grade int"))
    features, kept = quality_model.Features(), quality_model.keep_good(df, model)
    want = [r for r in df.collect() if model.grade(features.of(r.text or ""))[1] >= quality_model.TAIL]
    assert kept.columns == df.columns and same(kept) == sorted(map(str, ((r.doc_id, r.text, r.source) for r in want)))
    assert sum(r.doc_id is not None for r in want) == 30


def test_exact_duplicates_by_brute_force(spark, folder, docs):
    kept = {}
    for i, t, _ in docs:
        norm = re.sub(r"[\x20\x09-\x0D]+", " ", t or "")
        order = (i is not None, i or 0)
        kept[norm] = min(kept.get(norm, order), order)
    got = corpus_pipeline.exact_duplicates(spark, spark.read.parquet(f"{folder}/documents.parquet"), folder).collect()
    found = {re.sub(r"[\x20\x09-\x0D]+", " ", r.text or ""): (r.doc_id is not None, r.doc_id or 0) for r in got}
    assert len(got) == len(kept) and found == kept


def test_near_duplicates_by_brute_force(spark, folder):
    rows = alike(8)
    classes = near(rows)
    got = corpus_pipeline.near_duplicates(spark, frame(spark, [(i, t, "s") for i, t in rows]), folder).collect()
    assert sorted(r.doc_id for r in got) == sorted({root for _, root in classes.values()})


def test_mixture_repeats_rows_as_the_mix_takes_them(spark, folder, docs):
    table = spark.read.parquet(f"{folder}/documents.parquet")
    got = corpus_pipeline.mixture(spark, table, folder)
    assert got.columns == table.columns
    # The rows of a source with one identifier share a fate, so the words taken of each say how often its rows come.
    whole = {}
    for r in mixing.mix(table).collect():
        whole[r.doc_id, r.size, r.source_size] = whole.get((r.doc_id, r.size, r.source_size), 0) + r.taken
    words = sum(len(re.findall(r"[^\x20\x09-\x0D]+", r.text or "")) for r in got.collect())
    assert words == sum(whole.values())
    empty = [r for r in got.collect() if not (r.text or "").split()]
    assert len(empty) == len([1 for _, t, _ in docs if not (t or "").split()])


def test_mix_goes_by_row(spark):
    rows = [(1, "a " * 10, "x"), (1, "b " * 1000, "y"), (2, "c " * 10, "x"), (3, None, "x")]
    got = mixing.mix_documents(frame(spark, rows)).collect()
    per = {t: sum(r.text == t for r in got) for _, t, _ in rows}
    assert per["a " * 10] == per["c " * 10] == 3 and per["b " * 1000] <= 1 and per[None] == 1


def test_run_is_its_stages(spark, folder):
    import public_tokenizers

    table = spark.read.parquet(f"{folder}/documents.parquet")
    step = table
    for _, stage in corpus_pipeline.STAGES[:-1]:
        step = spark.createDataFrame(stage(spark, step, folder).collect(), table.schema)
    want = bpe.encode_decode(step, public_tokenizers.path("word_bpe_49k.json")).select("doc_id", "n_tokens", "ids")
    rows = lambda df: sorted(map(str, ((r.doc_id, r.n_tokens, bytes(r.ids)) for r in df.collect())))
    got = corpus_pipeline.run(spark, folder)
    assert got.columns == ["doc_id", "n_tokens", "ids"] and rows(got) == rows(want)


def test_empty_tables(spark, tmp_path):
    frame(spark, []).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0

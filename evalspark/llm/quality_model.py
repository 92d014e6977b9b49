"""Quality classifier: an ordinal cumulative-link regression over hashed text."""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_texts, small_batches, texts, trim

#: Labelled documents that the fit takes at most, by hash of their identifiers; all of them where there are fewer.
SAMPLE = 8000
#: A feature needs this many documents of the sample, else its weight is 0.
LEAST_DOCS = 5
#: and this z between the grades on either side of a cut.
LEAST_Z = 4.5
#: Hash space of the features. Weights are kept sparsely, so it may be large, and unseen words seldom share a weight.
SPACE = 1 << 30
#: A document stays if it is this likely to have the top grade.
TAIL = 0.5
#: Lengths of the word starts that are counted.
STARTS = (3, 5, 7)
#: Distinct words that a task remembers at most.
REMEMBER = 100_000
MARKS = ".,;:!?\"'()[]{}*#$%&|<>-"


def code(feature: str) -> int:
    return zlib.crc32(feature.encode()) & (SPACE - 1)


def share(n: int, of: int) -> int:
    """Bucket of a share: 0 to 10 by powers of two below the whole."""
    return max(0, 10 + round(math.log2(n / of))) if n else -1


def shape(word: str) -> str:
    end = word[-1]
    return ("U" if len(word) > 1 and word.isupper() else "l") + ("" if end.isalnum() else end) + ("0" if word[0].isdigit() else "")


class Features:
    """Feature codes of a text: distinct words, how many words start alike, shares of word shapes and of repeats.

    With ``wanted``, words that give none of these codes are told once, and then passed over.
    """

    def __init__(self, wanted=None):
        self.wanted, self.words = wanted, {}

    def learn(self, word: str) -> tuple:
        plain, wanted = word.strip(MARKS).lower(), self.wanted
        own, starts = code("w:" + plain), [plain[:k] for k in STARTS if len(plain) > k]
        if wanted is not None:
            own = own if own in wanted else None
            starts = [x for x in starts if code("p:" + x) in wanted or code("P:" + x) in wanted]
        found = own, shape(word), starts
        if len(word) <= 64:
            if len(self.words) >= REMEMBER:
                self.words.clear()
            self.words[word] = found
        return found

    def of(self, text: str) -> set[int]:
        counts = Counter(text.split())
        n, get, out, shapes, starts = counts.total(), self.words.get, set(), {}, {}
        for word, c in counts.items():
            own, kind, begins = get(word) or self.learn(word)
            if own is not None:
                out.add(own)
            shapes[kind] = shapes.get(kind, 0) + c
            for x in begins:
                starts[x] = starts.get(x, 0) + c
        for x, c in starts.items():
            if c > 1:
                out.add(code(f"p:{x}"))
                if c > 3:
                    out.add(code(f"P:{x}"))
        for s, c in shapes.items():
            out.add(code(f"s:{s}:{share(c, n)}"))
        if n:
            out.add(code(f"distinct:{share(len(counts), n)}:{min(n.bit_length(), 8)}"))
            out.add(code(f"most:{share(max(counts.values()), n)}:{min(n.bit_length(), 6)}"))
        return out


class Model:
    """P(grade <= k-th) = logistic(threshold_k - score); the score is the sum of the weights of a text's features.

    ``kinds`` are the grades that were fitted, in order: 0, 1, 2 and so on unless some are absent.
    """

    def __init__(self, weights: dict[int, float], thresholds: list[float], kinds: list[int] | None = None):
        self.weights, self.thresholds = weights, thresholds
        kinds = kinds or list(range(len(thresholds) + 1))
        self.least, self.gaps = kinds[0], [b - a for a, b in zip(kinds, kinds[1:])]

    def grade(self, codes: set[int]) -> tuple[float | None, float]:
        """(expected grade, probability of the top grade); fsum makes it the same in any order."""
        if not self.thresholds:
            return None, 1.0
        score = math.fsum(w for c in codes if (w := self.weights.get(c)))
        above = [1 / (1 + math.exp(min(700, max(-700, t - score)))) for t in self.thresholds]
        return round(self.least + math.fsum(g * p for g, p in zip(self.gaps, above)), 6), round(above[-1], 6)


def separation(row: np.ndarray, feature: np.ndarray, n: int, grades: np.ndarray, top: int) -> np.ndarray:
    """By feature the greatest z, over the cuts between grades, of the difference in how often either side has it."""
    out = np.zeros(n)
    total = np.bincount(feature, minlength=n)
    for cut in range(top):
        above = grades > cut
        a, b = above.sum(), (~above).sum()
        hits = np.bincount(feature, above[row].astype(float), n)
        p = total / (a + b)
        out = np.maximum(out, np.abs(hits / a - (total - hits) / b) / np.sqrt(np.maximum(p * (1 - p), 1e-12) * (1 / a + 1 / b)))
    return out


def fit(features: list[np.ndarray], grades: np.ndarray, penalty: float = 5e-4, steps: int = 300, rate: float = 0.1) -> Model:
    """Maximises the likelihood of the grades, classes weighted alike, with a squared penalty, by Adam from zero."""
    if not len(grades) or len(set(grades.tolist())) < 2:
        return Model({}, [])
    kinds, grades = np.unique(grades, return_inverse=True)
    top = len(kinds) - 1
    lengths = np.array([len(f) for f in features])
    flat = np.concatenate(features) if lengths.sum() else np.zeros(0, np.int64)
    codes, inverse, counts = np.unique(flat, return_inverse=True, return_counts=True)
    row = np.repeat(np.arange(len(grades)), lengths)
    kept = (counts >= LEAST_DOCS) & (separation(row, inverse, len(codes), grades, top) >= LEAST_Z)
    if not kept.any():  # thresholds alone would judge all texts alike
        return Model({}, [])
    codes, place = codes[kept], np.cumsum(kept) - 1
    row = row[kept[inverse]]
    col = place[inverse][kept[inverse]]
    weight = (len(grades) / (top + 1) / np.bincount(grades))[grades]
    weight /= weight.sum()
    # Thresholds stay ordered: the first is free, the others add a positive gap.
    theta = np.concatenate([np.zeros(len(codes)), [0.0], np.zeros(top - 1)])
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    sigmoid = lambda x: 0.5 * (1 + np.tanh(x / 2))
    for step in range(1, steps + 1):
        w, gaps = theta[: len(codes)], np.exp(theta[len(codes) + 1 :])
        cut = theta[len(codes)] + np.concatenate([[0.0], np.cumsum(gaps)])
        score = np.bincount(row, w[col], len(grades))
        upper = np.where(grades < top, sigmoid(cut[np.minimum(grades, top - 1)] - score), 1.0)
        lower = np.where(grades > 0, sigmoid(cut[np.maximum(grades - 1, 0)] - score), 0.0)
        p = np.maximum(upper - lower, 1e-12)
        du, dl = upper * (1 - upper) / p * weight, lower * (1 - lower) / p * weight
        g_score = du - dl
        g_cut = np.zeros(top)
        np.add.at(g_cut, np.minimum(grades, top - 1), np.where(grades < top, -du, 0))
        np.add.at(g_cut, np.maximum(grades - 1, 0), np.where(grades > 0, dl, 0))
        tail = np.cumsum(g_cut[::-1])[::-1]
        grad = np.concatenate([np.bincount(col, g_score[row], len(codes)) + penalty * w, [tail[0]], tail[1:] * gaps])
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        theta = theta - rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    w, gaps = theta[: len(codes)], np.exp(theta[len(codes) + 1 :])
    cut = theta[len(codes)] + np.concatenate([[0.0], np.cumsum(gaps)])
    return Model({int(c): float(x) for c, x in zip(codes, w) if x}, cut.tolist(), kinds.tolist())


def grades(labels: DataFrame) -> DataFrame:
    """(doc_id, grade): 0 for poor documents, 1 for good but toxic ones, 2 for good and clean ones; others have none."""
    grade = F.when(F.col("quality") == 0, 0).when((F.col("quality") == 1) & (F.col("toxic") == 1), 1).when(F.col("quality") == 1, 2)
    return labels.select("doc_id", grade.alias("grade")).filter("doc_id is not null and grade is not null")


def train(docs: DataFrame, graded: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE) -> Model:
    """Fits on at most ``sample`` graded documents, chosen by hash; their whole texts become features on the executors."""
    chosen = graded.groupBy("doc_id").agg(F.max("grade").alias("grade")).orderBy(F.md5(F.col("doc_id").cast("string")), "doc_id").limit(sample)
    # Of rows that repeat an identifier one text is fitted, so that what reaches the driver has the sample's bound.
    rows = texts(docs, id_col, text_col).join(F.broadcast(chosen), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.first("grade").alias("grade"))

    def make():
        features = Features()
        return lambda text: (np.array(sorted(features.of(text)), dtype="<i8").tobytes(),)

    found = map_texts(rows.select(F.struct("doc_id", "grade").alias("doc_id"), "text"), make, "codes binary")
    got = found.select("doc_id.doc_id", "doc_id.grade", "codes").toPandas().sort_values(["doc_id", "codes"], kind="stable")
    return fit([np.frombuffer(c, dtype="<i8") for c in got["codes"]], got["grade"].to_numpy(dtype=int))


def classify(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", tail: float = TAIL) -> DataFrame:
    """One row per row of ``docs``: doc_id, expected_grade, tail_probability, kept.

    Null and empty texts have no features, so the thresholds alone grade them. A model fitted without labels, on one
    grade, or on too few documents for any feature, grades nothing (null, 1.0) and keeps all. Row by row, so ties, repeats and other columns don't matter.
    """

    def make():
        features = Features(model.weights)
        return lambda text: model.grade(features.of(text))

    out = map_texts(texts(docs, id_col, text_col), make, "expected_grade double, tail_probability double")
    return out.withColumn("kept", F.col("tail_probability") >= tail)


def keep_good(docs: DataFrame, model: Model, text_col: str = "text", tail: float = TAIL) -> DataFrame:
    """The rows of ``docs`` that the model keeps, all columns kept; nothing is shuffled.

    Row by row, as in classify: null texts are empty ones, identifiers aren't read, an empty table stays empty.
    """

    small_batches(docs.sparkSession)

    @F.pandas_udf("double")
    def chance(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        features = Features(model.weights)
        for text in texts:
            yield text.map(lambda t: model.grade(features.of(t or ""))[1]).astype("float64")
        features.words.clear()
        trim()

    return docs.filter(chance(F.coalesce(F.col(text_col), F.lit(""))) >= tail)

"""Alignment of two tokenizers over the bytes of a text, and how often tokens of the two are linked over a corpus."""

from __future__ import annotations

import re
from functools import lru_cache
from hashlib import sha256
from struct import pack

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import _parse_datatype_string

from .bpe import byte_letters
from .common import frees, map_texts, table, texts

#: Id pairs, the most frequent ones, that each task is given with their counts, 17 bytes each; links of the others are joined.
HOT = 1 << 20
#: Stretches of text that a task remembers at least, twice as many at most; it only saves time. Longer ones aren't.
REMEMBER, LONG = 300_000, 64
#: Steps of a histogram of counts for each power of two.
STEPS = 16
#: A space after what neither tokenizer takes for one: no token of either spans it, so stretches are encoded by themselves.
#: A last space alone stays with what is before it, as B adds none to an empty text.
STRETCH = re.compile("(?s)(?<=[^\\s▁])(?= .)")


class Pair:
    """A: a byte-level file of the tokenizers library. B: a BPE file of sentencepiece, which adds a space."""

    def __init__(self, path_a: str, path_b: str):
        import sentencepiece
        from tokenizers import Tokenizer

        self.a, self.b = Tokenizer.from_file(path_a), sentencepiece.SentencePieceProcessor(model_file=path_b)
        self.a.encode_special_tokens = True
        self.a.no_truncation()
        self.a.no_padding()
        own = {x: i for i, x in enumerate(byte_letters())}
        entries = [self.a.id_to_token(i) or "" for i in range(self.a.get_vocab_size())]
        self.bytes_a = [bytes(own[c] for c in x) if all(c in own for c in x) else x.encode() for x in entries]
        pieces = [self.b.id_to_piece(i) for i in range(self.b.vocab_size())]
        self.bytes_b = [bytes([int(x[3:5], 16)]) if self.b.is_byte(i) else x.replace("▁", " ").encode() for i, x in enumerate(pieces)]
        if any(re.search("[^▁]▁", x) for x in pieces):
            raise ValueError(f"pieces of {path_b} span a space after something else")
        self.size_a, self.size_b = (np.array([len(x) for x in t], np.int64) for t in (self.bytes_a, self.bytes_b))
        # Ids in decimal, by what follows: a comma within a group's side, and what ends the side.
        self.text_a, self.text_b = (np.array([f"{i}{end}" for end in ends for i in range(len(t))], object) for t, ends in ((self.bytes_a, ",|"), (self.bytes_b, ",;")))
        #: What is remembered of stretches, in two generations: packed ids of A and B, and whether both keep the bytes.
        self.new, self.old = {}, {}

    def same(self, table: list[bytes], ids, data: bytes) -> bool:
        return b"".join(map(table.__getitem__, ids)) == data

    def encode_a(self, stretches: list[str]) -> list[bytes]:
        """Packed ids of A by stretch. All of them are encoded as one text, which is cut where they end."""
        data = [s.encode() for s in stretches]
        ids = self.a.encode("".join(stretches), add_special_tokens=False).ids
        packed = np.array(ids, "<i4")
        ends, bounds = np.cumsum(self.size_a[packed]), np.cumsum([len(d) for d in data])
        cuts = np.searchsorted(ends, bounds)
        if len(ends) and ends[-1] == bounds[-1] and (ends[cuts] == bounds).all() and self.same(self.bytes_a, ids, b"".join(data)):
            flat, cuts = packed.tobytes(), (4 * (cuts + 1)).tolist()
            return [flat[i:j] for i, j in zip([0, *cuts], cuts)]
        # Bytes that A's tokens don't keep: each stretch by itself, and what it lacks is seen when it is learnt.
        return [packed.tobytes()] if len(stretches) == 1 else [self.encode_a([s])[0] for s in stretches]

    def learn(self, stretches: list[str]) -> None:
        """Encodes stretches and remembers them; one that ends in white space stands alone, as it runs into the next."""
        joined = [s for s in stretches if not s[-1].isspace()]
        found = dict(zip(joined, self.encode_a(joined))) if len(joined) > 1 else {}
        for s, b in zip(stretches, self.b.encode([s[1:] for s in stretches], num_threads=1)):
            data = s.encode()
            kept = self.same(self.bytes_b, b, data)
            if (a := found.get(s)) is None:
                a = self.encode_a([s])[0]
                kept = kept and self.same(self.bytes_a, np.frombuffer(a, "<i4").tolist(), data)
            self.new[s] = a, pack(f"<{len(b)}i", *b), kept

    def encode(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """Ids of A and B for a space and the text; none if either's tokens are other bytes than these."""
        none = np.zeros(0, np.int32)
        if not text:
            return none, none
        if len(self.new) > REMEMBER:
            self.new, self.old = {}, self.new
        parts, new, old = STRETCH.split(" " + text), self.new, self.old
        missing = []
        for s in set(parts).difference(new):
            if (known := old.get(s)) is None:
                missing.append(s)
            else:
                new[s] = known
        if missing:
            self.learn(missing)
        a, b, kept = zip(*map(new.__getitem__, parts))
        for s in missing:
            if len(s) > LONG:
                del new[s]
        if not all(kept):
            return none, none
        return np.frombuffer(b"".join(a), "<i4"), np.frombuffer(b"".join(b), "<i4")

    def align(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(token of A, token of B) by link, and by shared end the link that it closes a group with.

        The ends of either side cut the bytes into elementary intervals; each lies in one token of A and one of B, and is
        what these two overlap in. An end of both closes a group.
        """
        ends_a, ends_b = np.cumsum(self.size_a[a]), np.cumsum(self.size_b[b])
        ends = np.union1d(ends_a, ends_b)
        own_a, own_b = np.searchsorted(ends_a, ends), np.searchsorted(ends_b, ends)
        return own_a, own_b, np.flatnonzero((ends_a[own_a] == ends) & (ends_b[own_b] == ends))

    def groups(self, a: np.ndarray, b: np.ndarray, last_a: np.ndarray, last_b: np.ndarray) -> str:
        """``a1,a2|b1;a3|b2,b3``; last_a and last_b are the last tokens of the groups."""
        ends_a, ends_b = np.zeros(len(a), np.int64), np.zeros(len(b), np.int64)
        ends_a[last_a] = ends_b[last_b] = 1
        out = np.empty(len(a) + len(b), object)
        # A token follows its own side's earlier ones, and the other side's of earlier groups; B's follow those of A in theirs too.
        group_a, group_b = np.cumsum(ends_a) - ends_a, np.cumsum(ends_b) - ends_b
        before = np.concatenate([[0], last_b + 1])
        out[np.arange(len(a)) + before[group_a]] = self.text_a[a + ends_a * len(self.size_a)]
        out[np.arange(len(b)) + last_a[group_b] + 1] = self.text_b[b + ends_b * len(self.size_b)]
        return "".join(out.tolist())[:-1]


@lru_cache(maxsize=2)
def load(path_a: str, path_b: str) -> Pair:
    return Pair(path_a, path_b)


LINKS = "n_a bigint, n_b bigint, n_groups bigint, n_links bigint, n_products bigint, groups_sha256 string, pairs array<bigint>, times array<bigint>"


def links(docs: DataFrame, path_a: str, path_b: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, n_a, n_b, n_groups, n_links, n_products, groups_sha256, pairs, times.

    pairs are the distinct linked id pairs, A's id in the upper 32 bits, and times how many links of the text hold each.
    n_products is how many pairs there are if all of a group's tokens are linked with one another.
    """

    def make():
        pair = load(path_a, path_b)

        def one(text):
            a, b = pair.encode(text)
            if not len(a):
                return 0, 0, 0, 0, 0, "", [], []
            own_a, own_b, closed = pair.align(a, b)
            last_a, last_b = own_a[closed], own_b[closed]
            products = int((np.diff(last_a, prepend=-1) * np.diff(last_b, prepend=-1)).sum())
            codes, times = np.unique(a[own_a].astype(np.int64) << 32 | b[own_b], return_counts=True)
            return len(a), len(b), len(closed), len(own_a), products, sha256(pair.groups(a, b, last_a, last_b).encode()).hexdigest(), codes, times

        return one

    return map_texts(texts(docs, id_col, text_col), make, LINKS)


def pair_counts(found: DataFrame) -> DataFrame:
    """(pair, n, best): links by id pair over all rows, and whether none of its B id's pairs has more."""
    each = found.select(F.explode(F.arrays_zip("pairs", "times")).alias("x")).groupBy(F.col("x.pairs").alias("pair")).agg(F.sum("x.times").alias("n"))
    counts = table(each, "align-counts")
    # One row for each id of B, so no more than its vocabulary has.
    most = counts.groupBy(F.col("pair").bitwiseAND((1 << 32) - 1).alias("b")).agg(F.max("n").alias("most"))
    return counts.join(F.broadcast(most), counts["pair"].bitwiseAND((1 << 32) - 1) == most["b"]).select("pair", "n", (F.col("n") == F.col("most")).alias("best"))


def frequent(counts: DataFrame, hot: int) -> tuple[DataFrame, DataFrame | None]:
    """The most frequent pairs, ``hot`` of them at most, and the others if there are any: split at a step of a histogram."""
    step = F.floor(F.log2("n") * STEPS)
    bars = sorted(counts.groupBy(step.alias("step")).agg(F.count(F.lit(1)).alias("pairs")).collect(), reverse=True)
    least, room = None, hot
    for bar in bars:
        if (room := room - bar.pairs) < 0:
            break
        least = bar.step
    if least is None:
        return counts.limit(0), counts if bars else None
    return counts.filter(step >= least), counts.filter(step < least) if least != bars[-1].step else None


def align_tokenizers(docs: DataFrame, path_a: str, path_b: str, id_col: str = "doc_id", text_col: str = "text", hot: int = HOT) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_a, n_b, n_groups, n_links, n_products, n_best, count_sum, groups_sha256.

    A space and the text are encoded by a byte-level file of tokenizers (A) and a BPE file of sentencepiece (B); tokens
    whose bytes overlap are linked. A pair of ids counts as often as the corpus links it: count_sum adds up the counts
    over a text's links, and n_best are those whose pair is its B id's most frequent one, or as frequent as that.

    Null and empty texts, and those whose tokens are other bytes than theirs, have zeros and an empty groups_sha256. Rows
    that repeat an identifier or a text are rows of their own and count each; other columns aren't read; an empty table
    gives no rows. Counts of the most frequent pairs go to each task, ``hot`` of them at most; links of rarer ones are
    joined with theirs, one row for each text and pair.
    """
    spark = docs.sparkSession
    found = table(links(docs, path_a, path_b, id_col, text_col).withColumn("row", F.monotonically_increasing_id()), "align-links")
    counts = table(pair_counts(found), "align-pairs")
    top, rare = frequent(counts, hot)
    got = top.toPandas().sort_values("pair")
    shared = spark.sparkContext.broadcast(tuple(got[c].to_numpy(t) for c, t in (("pair", np.int64), ("n", np.int64), ("best", bool))))
    schema = "row bigint, n_best bigint, count_sum bigint, rare array<struct<pair:bigint,times:bigint>>"
    arrow = to_arrow_schema(_parse_datatype_string(schema))

    def run(batches):
        pairs, n, best = shared.value
        for batch in batches:
            rows = batch.column(0)
            sizes = np.diff(batch.column(1).offsets.to_numpy())
            code, times = (batch.column(i).flatten().to_numpy() for i in (1, 2))
            row = np.repeat(np.arange(len(rows)), sizes)
            at = np.minimum(np.searchsorted(pairs, code), max(len(pairs) - 1, 0))
            known = pairs[at] == code if len(pairs) else np.zeros(len(code), bool)
            add = lambda x: np.bincount(row[known], x, len(rows)).astype(np.int64)
            one, two = add(times[known] * best[at[known]]), exact_sums(row[known], times[known] * n[at[known]], len(rows))
            left = np.bincount(row[~known], minlength=len(rows))
            offsets = pa.array(np.concatenate([[0], np.cumsum(left)]), pa.int32())
            rest = pa.StructArray.from_arrays([pa.array(code[~known]), pa.array(times[~known])], names=["pair", "times"])
            yield pa.RecordBatch.from_arrays([rows, pa.array(one), pa.array(two), pa.ListArray.from_arrays(offsets, rest)], schema=arrow)

    sums = found.select("row", "pairs", "times").mapInArrow(frees(run), schema)
    if rare is not None:
        sums = table(sums, "align-sums")
        others = sums.select("row", F.explode("rare").alias("x")).select("row", "x.*").join(rare, "pair")
        more = others.select("row", F.when(F.col("best"), F.col("times")).otherwise(0).alias("n_best"), (F.col("times") * F.col("n")).alias("count_sum"))
        sums = sums.select("row", "n_best", "count_sum").unionByName(more).groupBy("row").agg(F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))
    return found.join(sums, "row").select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_products", "n_best", "count_sum", "groups_sha256")


def exact_sums(at: np.ndarray, values: np.ndarray, n: int) -> np.ndarray:
    """Sums of integers by place, without floats."""
    out = np.zeros(n, np.int64)
    np.add.at(out, at, values)
    return out

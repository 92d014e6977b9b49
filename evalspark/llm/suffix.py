"""Suffix-array deduplication: bytes covered by long strings that also start elsewhere, and words of passages that other texts share.

A suffix of every byte would take eight bytes a byte of text. Here only suffixes at anchors are indexed: positions
that the text itself picks, at least one within each string of the length asked for. Anchors whose first half string
occurs once can't lie in a repeat and go at once; the others are dealt by it to logarithmic families of suffix
arrays, where each new batch is scanned against the levels that are there and levels of equal size merge.

A string is one of symbols: LENGTH bytes, or LENGTH_WORDS words, each a 64-bit hash. Both take as many bytes.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WORD, frees, frees_group, table
from .jaccard import arrow_schema
from .words import WordHashes, mix

#: Lengths of the strings. An anchor's hash spans half of one, and an anchor lies within each half + 1 places.
LENGTH, LENGTH_WORDS = 400, 50
#: By kind of symbol, bytes and words: bytes of a symbol, symbols in half a string.
UNIT, HALF = (1, 8), (LENGTH // 2, LENGTH_WORDS // 2)
#: Bytes of half a string, and of a suffix: its key, what follows the hashed half, what lies before it, how much of either is text.
SIDE = LENGTH // 2
SUFFIX = 8 + 2 * SIDE + 2
#: Bytes of the shortest text that holds a string of either kind.
SHORTEST = min(LENGTH, 2 * LENGTH_WORDS - 1)
BASE = 0x9E3779B97F4A7C15 | 1
#: A text is looked through in pieces of this size, which overlap.
PIECE = 1_000_000
#: Suffixes in a batch of a family; anchors and contexts that a task holds before it hands them on.
BATCH, HOLD, HOLD_CONTEXTS = 4096, 1_000_000, 50_000


class Powers:
    """Powers of BASE and of its inverse, modulo 2 ** 64."""

    def __init__(self):
        n = PIECE + LENGTH
        inverse = pow(BASE, -1, 1 << 64)
        one = np.ones(1, np.uint64)
        self.up, self.down = (np.cumprod(np.concatenate([one, np.full(n - 1, x, np.uint64)]), dtype=np.uint64) for x in (BASE, inverse))
        self.letter = mix(np.arange(1, 257, dtype=np.uint64))
        self.words = WordHashes()

    def symbols(self, data: bytes, kind: int) -> np.ndarray:
        """The symbols of a text, in a type whose bytes compare as the symbols do."""
        return self.words.of(data.split()).astype(">u8") if kind else np.frombuffer(data, np.uint8)


def anchors(symbols: np.ndarray, half: int, powers: Powers) -> tuple[np.ndarray, np.ndarray]:
    """Places among the symbols and the hashes of the ``half`` of them from each.

    Of the half + 1 places at which so many start within a string twice as long, the one with the least hash is an
    anchor, the first of equals: equal strings have it at equal places.
    """
    at, keys = [], []
    for first in range(0, max(1, len(symbols) - 2 * half + 1), PIECE - 2 * half + 1):
        piece = symbols[first : first + PIECE]
        if len(piece) < 2 * half:
            break
        n = len(piece)
        letters = powers.letter[piece] if piece.dtype == np.uint8 else piece.astype(np.uint64)
        run = np.concatenate([np.zeros(1, np.uint64), np.cumsum(letters * powers.up[:n], dtype=np.uint64)])
        h = mix((run[half:] - run[:-half]) * powers.down[: n - half + 1])
        w, m = half + 1, len(h)
        v = (h & np.uint64(0xFFFFFFFFFFF00000)) | np.arange(m, dtype=np.uint64)
        rows = -(-m // w)
        block = np.full(rows * w, np.uint64(0xFFFFFFFFFFFFFFFF))
        block[:m] = v
        block = block.reshape(rows, w)
        left = np.minimum.accumulate(block, axis=1).ravel()
        right = np.minimum.accumulate(block[:, ::-1], axis=1)[:, ::-1].ravel()
        least = np.minimum(right[: m - w + 1], left[w - 1 : m])
        place = np.unique((least[np.concatenate([[True], least[1:] != least[:-1]])] & np.uint64(0xFFFFF)).astype(np.int64))
        at.append(place + first)
        keys.append(h[place])
    if not at:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    at, keys = np.concatenate(at), np.concatenate(keys)
    at, new = np.unique(at, return_index=True)
    return at, keys[new]


def split(key: np.ndarray, buckets: int) -> list[tuple[int, np.ndarray]]:
    """By bucket the rows whose keys, mixed once more, fall into it."""
    if not len(key):
        return []
    place = (mix(key) & np.uint64(buckets - 1)).astype(np.int64)
    order = np.argsort(place, kind="stable")
    edge = np.flatnonzero(np.concatenate([[True], place[order][1:] != place[order][:-1], [True]]))
    return [(int(place[order[s]]), order[s:e]) for s, e in zip(edge[:-1], edge[1:])]


def batches_of(rows: list[tuple], schema: pa.Schema, every: int = 256):
    for at in range(0, len(rows), every):
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows[at : at + every]), schema.types)], schema=schema)


def anchor_keys(docs: DataFrame, buckets: int) -> DataFrame:
    """Anchor hashes of (node, text), once a text, packed by bucket with whether the text has them twice.

    Buckets from ``buckets`` on are those of words, of which only other texts make a repeat.
    """
    schema = "bucket int, keys binary, nodes binary, twice binary"
    arrow = arrow_schema(schema)

    def run(batches):
        powers, held, sent, n = Powers(), ([], []), set(), 0

        def flush():
            rows = []
            for kind in (0, 1):
                if held[kind]:
                    keys, nodes, twice = (np.concatenate(x) for x in zip(*held[kind]))
                    rows += [(kind * buckets + b, keys[i].tobytes(), nodes[i].tobytes(), twice[i].tobytes()) for b, i in split(keys, buckets)]
                held[kind].clear()
            sent.clear()
            yield from batches_of(rows, arrow)

        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                for node, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                    if node in sent:
                        continue
                    sent.add(node)
                    data = text.encode()
                    for kind in (0, 1):
                        keys, count = np.unique(anchors(powers.symbols(data, kind), HALF[kind], powers)[1], return_counts=True)
                        held[kind].append((keys, np.full(len(keys), node, np.int64), (count > 1 if kind == 0 else np.zeros(len(keys))).astype(np.uint8)))
                        n += len(keys)
                    if n >= HOLD:
                        yield from flush()
                        n = 0
        yield from flush()

    return docs.mapInArrow(frees(run), schema)


def repeated(packed: DataFrame, buckets: int) -> DataFrame:
    """(node, kind, keys): the anchor hashes of a text that occur twice, in one text or in two."""
    schema = "node bigint, kind int, keys binary"

    def one(group: pa.Table) -> pa.Table:
        kind = int(group.column("bucket")[0].as_py() >= buckets)
        cols = [np.frombuffer(b"".join(group.column(c).to_pylist()), t) for c, t in (("keys", np.uint64), ("nodes", np.int64), ("twice", np.uint8))]
        keys, nodes, twice = cols
        order = np.lexsort((nodes, keys))
        keys, nodes, twice = keys[order], nodes[order], twice[order]
        same = (keys[1:] == keys[:-1]) & (nodes[1:] != nodes[:-1])
        more = twice > 0
        more[1:] |= same
        more[:-1] |= same
        # A text's copies from several tasks stand side by side, so others of its hash needn't be its neighbours.
        first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
        if len(first):
            any_ = np.logical_or.reduceat(more, first)
            more = np.repeat(any_, np.diff(np.append(first, len(keys))))
        keys, nodes = keys[more], nodes[more]
        order = np.lexsort((keys, nodes))
        keys, nodes = keys[order], nodes[order]
        new = np.concatenate([[True], (keys[1:] != keys[:-1]) | (nodes[1:] != nodes[:-1])])[: len(keys)]
        keys, nodes = keys[new], nodes[new]
        edge = np.flatnonzero(np.concatenate([[True], nodes[1:] != nodes[:-1], [True]])) if len(nodes) else np.zeros(1, np.int64)
        return pa.table({"node": pa.array(nodes[edge[:-1]], pa.int64()), "kind": pa.array([kind] * (len(edge) - 1), pa.int32()), "keys": pa.array([keys[s:e].tobytes() for s, e in zip(edge[:-1], edge[1:])], pa.binary())})

    return packed.groupBy("bucket").applyInArrow(frees_group(one), schema)


def suffixes(symbols: np.ndarray, place: np.ndarray, key: np.ndarray, kind: int) -> np.ndarray:
    """Rows of bytes of SUFFIX: the anchor's key, the half string after the hashed one, that before it, outward, and sides.

    The sides are the numbers of symbols that the text has there; nothing follows or precedes its ends.
    """
    half = HALF[kind]
    wide = np.concatenate([np.zeros(half, symbols.dtype), symbols, np.zeros(half, symbols.dtype)])
    step = np.arange(half)
    left = wide[place[:, None] + (half - 1 - step)]
    right = wide[place[:, None] + (2 * half + step)]
    sides = np.stack([np.minimum(place, half), np.minimum(len(symbols) - place - half, half)], axis=1).astype(np.uint8)
    return np.concatenate([key.astype(">u8").view(np.uint8).reshape(-1, 8), *(np.ascontiguousarray(x).view(np.uint8).reshape(len(place), SIDE) for x in (right, left)), sides], axis=1)


def cuts(rows: np.ndarray, kind: int) -> tuple[np.ndarray, np.ndarray]:
    """The least and the greatest cut of the strings that a suffix's text holds; none if the first is the greater.

    The cut of a string is how many of its symbols lie before the anchor, so 0 to half.
    """
    return HALF[kind] - rows[:, -1].astype(np.int64), rows[:, -2].astype(np.int64)


def contexts(rows: DataFrame, buckets: int) -> DataFrame:
    """Suffixes at the wanted anchors of (node, keys, word_keys, text), packed by bucket.

    Of bytes, equal suffixes within a text are one, marked; the places that it stands for have the intervals that their
    equality gives already.
    """
    schema = "bucket int, nodes binary, places binary, suffixes binary, twice binary, starts binary, ends binary"
    arrow = arrow_schema(schema)

    def run(batches):
        powers, held, done, n = Powers(), ([], []), [], 0

        def flush():
            rows = [(node % buckets, np.full(len(s), node, np.int64).tobytes(), None, None, None, s.tobytes(), e.tobytes()) for node, s, e in done]
            for kind in (0, 1):
                if held[kind]:
                    keys, nodes, places, twice, data = (np.concatenate(x) for x in zip(*held[kind]))
                    rows += [(kind * buckets + b, nodes[i].tobytes(), places[i].tobytes(), data[i].tobytes(), twice[i].tobytes(), None, None) for b, i in split(keys, buckets)]
                held[kind].clear()
            done.clear()
            yield from batches_of(rows, arrow)

        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                part = batch.slice(at, 64).to_pydict()
                for node, text, *wanted in zip(part["node"], part["text"], part["keys"], part["word_keys"]):
                    data = text.encode()
                    for kind in (0, 1):
                        if not wanted[kind]:
                            continue
                        symbols = powers.symbols(data, kind)
                        place, key = anchors(symbols, HALF[kind], powers)
                        mine = np.isin(key, np.frombuffer(b"".join(wanted[kind]), np.uint64))
                        place, key = place[mine], key[mine]
                        if not len(place):
                            continue
                        found = suffixes(symbols, place, key, kind)
                        twice = np.zeros(len(place), np.uint8)
                        if kind == 0:
                            _, one, which, count = np.unique(found.view(f"V{SUFFIX}").ravel(), return_index=True, return_inverse=True, return_counts=True)
                            lo, hi = cuts(found, kind)
                            again = (count[which] > 1) & (lo <= hi)
                            if again.any():
                                done.append((node, (place - hi)[again], (place + LENGTH - lo)[again]))
                            place, key, found, twice = place[one], key[one], found[one], (count > 1).astype(np.uint8)
                        held[kind].append((key, np.full(len(place), node, np.int64), place, twice, found))
                        n += len(place)
                    if n >= HOLD_CONTEXTS:
                        yield from flush()
                        n = 0
        yield from flush()

    return rows.mapInArrow(frees(run), schema)


class Level:
    """A suffix array: distinct suffixes in the order of their bytes, for each the range of cuts at which a repeat was
    met, and the least and the greatest node that has it."""

    def __init__(self, whole, lo, hi, least, most, batches=1):
        self.whole, self.lo, self.hi, self.least, self.most, self.batches = whole, lo, hi, least, most, batches

    def columns(self):
        return self.whole, self.lo, self.hi, self.least, self.most

    def keys(self) -> np.ndarray:
        return self.whole.view(np.uint8).reshape(-1, SUFFIX)[:, :8].copy().view(np.uint64).ravel()


def joined(a: Level, b: Level) -> Level:
    """Merges two levels, two sorted runs; suffixes in both are one, with the wider range."""
    whole, lo, hi, least, most = (np.concatenate(x) for x in zip(a.columns(), b.columns()))
    order = np.argsort(whole, kind="stable")
    whole = whole[order]
    first = np.flatnonzero(np.concatenate([[True], whole[1:] != whole[:-1]]))
    down, up = (lambda x: np.minimum.reduceat(x[order], first)), (lambda x: np.maximum.reduceat(x[order], first))
    return Level(whole[first], down(lo), up(hi), down(least), up(most), a.batches + b.batches)


def shared(order: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """By place in an order of rows of bytes, how many first bytes each has in common with the one before it."""
    rows = rows[order]
    differ = rows[1:] != rows[:-1]
    found = np.where(differ.any(axis=1), differ.argmax(axis=1), rows.shape[1])
    return np.concatenate([[-1], found])


class Family:
    """Levels whose batches are distinct powers of two."""

    def __init__(self, kind: int = 0):
        self.levels: list[Level] = []
        self.kind = kind

    def scan(self, a: Level, b: Level | None = None) -> None:
        """Widens the ranges of suffixes of ``a`` (and ``b``) by the strings that two of them share.

        The suffixes of common keys are merged; those that agree on so many bytes lie side by side in their order, and
        in the order of the bytes before their anchors, so that a string shared at a cut is a pair of runs.
        """
        if b is None:
            key = a.keys()
            _, which, count = np.unique(key, return_inverse=True, return_counts=True)
            picked = [(a, np.flatnonzero(count[which] > 1))]
        else:
            ka, kb = a.keys(), b.keys()
            picked = [(a, np.flatnonzero(np.isin(ka, kb))), (b, np.flatnonzero(np.isin(kb, ka)))]
        whole, lo, hi, least, most = (np.concatenate(x) for x in zip(*([c[rows] for c in level.columns()] for level, rows in picked)))
        n, unit, half = len(whole), UNIT[self.kind], HALF[self.kind]
        if n < 2:
            return
        data = whole.view(np.uint8).reshape(-1, SUFFIX)
        before = np.ascontiguousarray(np.concatenate([data[:, :8], data[:, 8 + SIDE : 8 + 2 * SIDE]], axis=1))
        by_right, by_left = np.argsort(whole, kind="stable"), np.argsort(before.view(f"V{8 + SIDE}").ravel())
        right, left = shared(by_right, data[:, : 8 + SIDE]), shared(by_left, before)
        first, last = cuts(data, self.kind)
        run_right, run_left = np.zeros(n, np.int64), np.zeros(n, np.int64)
        for cut in range(half + 1):
            fits = np.flatnonzero((first <= cut) & (cut <= last))
            if len(fits) < 2:
                continue
            run_right[by_right] = np.cumsum(right < 8 + (half - cut) * unit)
            run_left[by_left] = np.cumsum(left < 8 + cut * unit)
            both = run_right[fits] * (n + 1) + run_left[fits]
            order = np.argsort(both)
            both, rows = both[order], fits[order]
            edge = np.flatnonzero(np.concatenate([[True], both[1:] != both[:-1]]))
            size = np.diff(np.append(edge, len(both)))
            met = size > 1 if self.kind == 0 else np.minimum.reduceat(least[rows], edge) != np.maximum.reduceat(most[rows], edge)
            rows = rows[np.repeat(met, size)]
            lo[rows], hi[rows] = np.minimum(lo[rows], cut), np.maximum(hi[rows], cut)
        at = 0
        for level, rows in picked:
            level.lo[rows], level.hi[rows] = lo[at : at + len(rows)], hi[at : at + len(rows)]
            at += len(rows)

    def add(self, whole: np.ndarray, nodes: np.ndarray, twice: np.ndarray) -> None:
        """One batch of suffixes of nodes: its suffix array is scanned, alone and against each level, and then a level itself."""
        order = np.argsort(whole, kind="stable")
        whole, nodes = whole[order], nodes[order]
        first = np.flatnonzero(np.concatenate([[True], whole[1:] != whole[:-1]]))
        least, most = np.minimum.reduceat(nodes, first), np.maximum.reduceat(nodes, first)
        many = least != most if self.kind else np.add.reduceat(1 + twice[order].astype(np.int64), first) > 1
        whole = whole[first]
        lo, hi = cuts(whole.view(np.uint8).reshape(-1, SUFFIX), self.kind)
        met = many & (lo <= hi)
        new = Level(whole, np.where(met, lo, HALF[self.kind] + 1), np.where(met, hi, -1), least, most)
        self.scan(new)
        for level in self.levels:
            self.scan(new, level)
        while self.levels and self.levels[-1].batches <= new.batches:
            new = joined(self.levels.pop(), new)
        self.levels.append(new)

    def whole(self) -> Level:
        out = self.levels[0]
        for level in self.levels[1:]:
            out = joined(out, level)
        return out


def intervals(packed: DataFrame, buckets: int) -> DataFrame:
    """(node, kind, starts, ends) of repeated strings, in symbols, from a family of levels for each bucket."""
    schema = "node bigint, kind int, starts binary, ends binary"

    def one(group: pa.Table) -> pa.Table:
        kind = int(group.column("bucket")[0].as_py() >= buckets)
        family, node, start, end, seen = Family(kind), [], [], [], []
        for r in group.to_pylist():
            nodes = np.frombuffer(r["nodes"], np.int64)
            if r["suffixes"] is None:
                node.append(nodes), start.append(np.frombuffer(r["starts"], np.int64)), end.append(np.frombuffer(r["ends"], np.int64))
            else:
                seen.append((nodes, np.frombuffer(r["places"], np.int64), np.frombuffer(r["suffixes"], f"V{SUFFIX}"), np.frombuffer(r["twice"], np.uint8)))
        if seen:
            nodes, places, whole, twice = (np.concatenate(x) for x in zip(*seen))
            # A text that two tasks have seen is there twice; it is one.
            _, rows = np.unique(np.stack([nodes, places], axis=1), axis=0, return_index=True)
            nodes, places, whole, twice = (x[rows] for x in (nodes, places, whole, twice))
            for at in range(0, len(whole), BATCH):
                family.add(*(x[at : at + BATCH] for x in (whole, nodes, twice)))
            level = family.whole()
            at = np.searchsorted(level.whole, whole)
            lo, hi = level.lo[at], level.hi[at]
            met = lo <= hi
            node.append(nodes[met]), start.append((places - hi)[met]), end.append((places + 2 * HALF[kind] - lo)[met])
        node, start, end = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (node, start, end))
        order = np.argsort(node, kind="stable")
        node, start, end = node[order], start[order], end[order]
        edge = np.flatnonzero(np.concatenate([[True], node[1:] != node[:-1], [True]])) if len(node) else np.zeros(1, np.int64)
        pieces = list(zip(edge[:-1], edge[1:]))
        return pa.table({"node": pa.array(node[edge[:-1]], pa.int64()), "kind": pa.array([kind] * len(pieces), pa.int32()), "starts": pa.array([start[s:e].tobytes() for s, e in pieces], pa.binary()), "ends": pa.array([end[s:e].tobytes() for s, e in pieces], pa.binary())})

    return packed.groupBy("bucket").applyInArrow(frees_group(one), schema)


def spans(starts: np.ndarray, ends: np.ndarray) -> list[tuple[int, int]]:
    """Maximal runs of the union, in order."""
    if not len(starts):
        return []
    order = np.argsort(starts, kind="stable")
    s, e = starts[order], np.maximum.accumulate(ends[order])
    first = np.flatnonzero(np.concatenate([[True], s[1:] > e[:-1]]))
    return list(zip(s[first].tolist(), e[np.append(first[1:], len(s)) - 1].tolist()))


def cut(rows: DataFrame) -> DataFrame:
    """(node, n_removed, n_spans, kept_sha256, kept, n_repeat_words) of (node, text, starts, ends, word_starts, word_ends)."""
    schema = "node bigint, n_removed bigint, n_spans bigint, kept_sha256 string, kept binary, n_repeat_words bigint"
    arrow = arrow_schema(schema)
    numbers = lambda packed: np.frombuffer(b"".join(packed), np.int64)

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                part, out = batch.slice(at, 64).to_pydict(), []
                for node, text, *found in zip(*(part[c] for c in ("node", "text", "starts", "ends", "word_starts", "word_ends"))):
                    data, gone = text.encode(), spans(*map(numbers, found[:2]))
                    kept, last = [], 0
                    for s, e in gone:
                        kept.append(data[last:s])
                        last = e
                    kept = b"".join([*kept, data[last:]])
                    out.append((node, len(data) - len(kept), len(gone), hashlib.sha256(kept).hexdigest(), kept, sum(e - s for s, e in spans(*map(numbers, found[2:])))))
                yield from batches_of(out, arrow)

    return rows.mapInArrow(frees(run), schema)


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, n_bytes, n_removed, n_spans, n_repeat_words, kept_sha256, kept (bytes; null where all stay).

    Bytes go that a string of LENGTH bytes covers which also starts elsewhere in the input, in the same text or another;
    strings don't cross texts. Equal texts are one node: of two copies with LENGTH bytes or more nothing stays.
    n_repeat_words counts the words that LENGTH_WORDS words in a row cover which another row's text has too; they stay.

    Null and shorter texts keep all. Rows that repeat an identifier are rows of their own; an empty table gives none.
    Texts are told apart by 64-bit hash and length, words and the half string of an anchor by 64-bit hash, what lies
    beside it by its bytes.
    """
    spark = docs.sparkSession
    buckets = 1 << max(4, (4 * int(spark.conf.get("spark.sql.shuffle.partitions")) - 1).bit_length())
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    plain = docs.select(F.col(id_col).alias("doc_id"), text.alias("text")).select("doc_id", F.xxhash64("text", F.octet_length("text")).alias("node"), "text")
    long = plain.filter(F.octet_length("text") >= SHORTEST)
    rows = table(plain.select("doc_id", "node", F.octet_length("text").cast("bigint").alias("n_bytes"), F.regexp_count("text", F.lit(WORD)).cast("bigint").alias("n_words"), F.sha2("text", 256).alias("sha")), "suffix-rows")
    nodes = table(rows.filter(F.col("n_bytes") >= SHORTEST).groupBy("node").agg(F.min("doc_id").alias("of"), F.count(F.lit(1)).alias("copies")), "suffix-nodes")

    of_kind = lambda name, kind: F.collect_list(F.when(F.col("kind") == kind, F.col(name)))
    wanted = repeated(anchor_keys(long.select("node", "text"), buckets), buckets).groupBy("node").agg(of_kind("keys", 0).alias("keys"), of_kind("keys", 1).alias("word_keys"))
    wanted = wanted.join(nodes.select("node", "of"), "node").withColumnRenamed("node", "n")
    # One text a node, by its identifier, so that copies aren't gathered.
    found = long.join(wanted.hint("shuffle_hash"), (F.col("node") == F.col("n")) & F.col("doc_id").eqNullSafe(F.col("of"))).select("node", "keys", "word_keys", "text")
    found = table(found, "suffix-found")
    gone = table(intervals(contexts(found, buckets), buckets), "suffix-gone")
    gone = gone.groupBy("node").agg(*[of_kind(name, kind).alias(("", "word_")[kind] + name) for kind in (0, 1) for name in ("starts", "ends")])
    alone = nodes.filter("copies = 1").select("node")
    parts = table(cut(found.select("node", "text").join(gone.join(alone, "node", "left_semi"), "node").select("node", "text", "starts", "ends", "word_starts", "word_ends")).dropDuplicates(["node"]), "suffix-parts")
    copied = table(nodes.filter("copies > 1").select("node", F.lit(True).alias("copied")), "suffix-copied")
    out = rows.join(copied, "node", "left").join(parts, "node", "left")
    all_, none = F.col("copied") & (F.col("n_bytes") >= LENGTH), F.lit(hashlib.sha256(b"").hexdigest())
    words = F.when(F.col("copied") & (F.col("n_words") >= LENGTH_WORDS), F.col("n_words")).otherwise(F.coalesce("n_repeat_words", F.lit(0)))
    return out.select("doc_id", "n_bytes", F.when(all_, F.col("n_bytes")).otherwise(F.coalesce("n_removed", F.lit(0))).cast("bigint").alias("n_removed"), F.when(all_, 1).otherwise(F.coalesce("n_spans", F.lit(0))).cast("bigint").alias("n_spans"), words.cast("bigint").alias("n_repeat_words"), F.when(all_, none).otherwise(F.coalesce("kept_sha256", "sha")).alias("kept_sha256"), F.when(all_, F.lit(b"")).otherwise(F.col("kept")).alias("kept"))

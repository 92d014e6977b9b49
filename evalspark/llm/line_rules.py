"""Quality rules: counts within a document, and lines that many documents of a host share."""

from __future__ import annotations

import hashlib
import re

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import map_texts, table
from .words import WordHashes, windows

SYMBOLS = re.compile(r"[#*$%&|<>]")
WINDOW = 8
#: Base rules: least words, and the percentage of repeated words allowed.
LEAST_WORDS, MOST_REPEATED = 20, 30
#: A line is boilerplate of its host if more distinct documents have it than this number; or, in hosts too small for that,
#: than this share of the host's and than a handful.
MOST_DOCS, MOST_SHARE, HANDFUL = 100, 0.05, 10
#: Boilerplate lines up to which all of them go to each task; beyond, texts are joined with the lines that they lose.
MOST_LINES = 500_000
#: Bits that tell each task which texts may lose lines, at most: 64 MB.
MOST_BITS = 1 << 29
#: A document of which boilerplate leaves less than this share of its words is depleted.
LEAST_LEFT = 0.2


def line_key(line: bytes) -> int:
    """Hash of a line after lower case, one space between words and 0 for each digit."""
    norm = re.sub(rb"[0-9]", b"0", b" ".join(line.lower().split()))
    return int.from_bytes(hashlib.blake2b(norm, digest_size=8).digest(), "little", signed=True)


def line_keys(text: str) -> list[int]:
    """Keys of the distinct lines that aren't blank."""
    return list({line_key(x) for x in text.encode().split(b"\n") if x and not x.isspace()})


def measure(text: str, hashes: WordHashes) -> tuple:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    data = text.encode()
    words = data.split()
    n = len(words)
    word_chars = len(text) - sum(map(text.count, " \t\n\v\f\r"))
    n_symbols = sum(map(text.count, "#*$%&|<>"))
    seen, dup = set(), 0
    for line in data.split(b"\n"):
        if not line or line.isspace():
            continue
        dup += line in seen
        seen.add(line)
    repeat = 0
    if n > WINDOW:
        w = windows(hashes.of(words), WINDOW)
        order = np.argsort(w, kind="stable")
        same = w[order][1:] == w[order][:-1]
        twice = np.zeros(len(w), bool)
        twice[order[1:][same]] = True
        twice[order[:-1][same]] = True
        if same.any():
            edge = np.zeros(n + 1, np.int64)
            at = np.flatnonzero(twice)
            np.add.at(edge, at, 1)
            np.add.at(edge, at + WINDOW, -1)
            repeat = int((np.cumsum(edge[:n]) > 0).sum())
    return n, word_chars, n_symbols, dup, repeat


def without(text: str, gone) -> str | None:
    """The text without the lines that have these keys; None if it has none of them."""
    keys, lines = set(gone) if isinstance(gone, list) else gone, text.encode().split(b"\n")
    kept = [x for x in lines if not x or x.isspace() or line_key(x) not in keys]
    return b"\n".join(kept).decode() if len(kept) < len(lines) else None


def bit_of(keys: list[str], bits: int) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(bits))


def members(rows: DataFrame, keys: list[str], most_bits: int) -> tuple[DataFrame, int]:
    """((__bucket, bits), how many bits): a bit for the hash of each row's keys, 32,768 to a bucket.

    There are sixteen bits a row, but ``most_bits`` at most, so that the buckets can go to each task: what isn't set is no
    member, and what is set may be none, the more often the more rows there are to a bit.
    """
    n = 1 << 15
    while n < min(16 * rows.count(), most_bits):
        n *= 2
    bit = rows.select(bit_of(keys, n).alias("b"))
    return bit.groupBy(F.bitmap_bucket_number("b").alias("__bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("b")).alias("bits")), n


def is_set(bits: Column, position: Column) -> Column:
    """Whether a position is set in a bucket; not where there is no bucket."""
    byte = F.conv(F.hex(F.substr(bits, F.floor(position / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    return F.coalesce(F.floor(byte / F.pow(F.lit(2), position % 8)) % 2 == 1, F.lit(False))


def measured(text: str, cleaned: str | None, hashes: WordHashes) -> tuple:
    n, *rest = measure(text, hashes)
    return n, *rest, 0 if cleaned is None else n - len(cleaned.encode().split()), text if cleaned is None else cleaned


def by_lines(every: DataFrame, boiler: DataFrame):
    """(rows, what is made of a task's rows) where boilerplate lines are few: all of them go to each task."""
    hosts: dict[str, set[int]] = {}
    for host, line in boiler.collect():
        hosts.setdefault(host, set()).add(line)
    shared = every.sparkSession.sparkContext.broadcast(hosts)

    def make():
        hashes, known = WordHashes(), shared.value

        def one(row):
            text, gone = row["text"], known.get(row["host"])
            return measured(text, without(text, gone) if gone else None, hashes)

        return one

    return every.select(F.col("id").alias("doc_id"), F.struct("text", "host").alias("text")), make


def by_texts(every: DataFrame, lines: DataFrame, boiler: DataFrame, most_bits: int):
    """The same where they are many: each text that may lose lines is joined with those it loses.

    These texts grow as the input does, so they are never broadcast; the others, told by bits, aren't shuffled.
    """
    gone = table(lines.join(boiler, ["host", "line"]).groupBy("host", "text_key").agg(F.collect_list("line").alias("gone")), "lines-gone")
    known = members(gone, ["host", "text_key"], most_bits)
    told = every.withColumn("__bit", bit_of(["host", "text_key"], known[1])).withColumn("__bucket", F.bitmap_bucket_number("__bit"))
    told = told.join(F.broadcast(known[0]), "__bucket", "left").withColumn("maybe", is_set(F.col("bits"), F.bitmap_bit_position("__bit"))).drop("__bucket", "__bit", "bits")
    none = F.lit(None).cast("array<bigint>").alias("gone")
    with_lines = told.filter("maybe").drop("maybe").join(gone.hint("merge"), ["host", "text_key"], "left").select("id", "text", "gone")
    both = told.filter(~F.col("maybe")).select("id", "text", none).unionByName(with_lines).select(F.col("id").alias("doc_id"), F.struct("text", "gone").alias("text"))

    def make():
        hashes = WordHashes()

        def one(row):
            text, gone = row["text"], row["gone"]
            return measured(text, without(text, gone) if gone else None, hashes)

        return one

    return both, make


def quality_rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", most_docs: int = MOST_DOCS, most_share: float = MOST_SHARE, least_left: float = LEAST_LEFT, most_bits: int = MOST_BITS, most_lines: int = MOST_LINES) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_boiler_words,
    base_failed, kept, cleaned.

    Lines are hashed after normalising; distinct documents (by text, so that copies count once) are counted by host and
    line. Lines in more than ``most_docs`` are boilerplate, however large the host; so are, in small hosts, lines above
    ``most_share`` and HANDFUL. cleaned is the text without them; n_boiler_words is what it lacks, and a document of
    which too few words remain is depleted. kept is false for documents that fail the base rules or are depleted.

    Null text has no words, so it fails; null hosts are one host. Rows with the same identifier are rows of their own.
    An empty table gives no rows. Line counts are combined before the shuffle; a hot host is spread over its lines.
    Texts are read for their lines and again to clean them, rather than written with the lines. Where boilerplate lines
    are ``most_lines`` at most they go to each task, and no text is shuffled; beyond, texts that surely lose none, by a bit
    for the hash of those that do, aren't.
    """
    host = F.coalesce(F.concat(F.lit("s"), F.col(host_col).cast("string")), F.lit("n"))
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    every = docs.select(F.col(id_col).alias("id"), host.alias("host"), F.xxhash64(text).alias("text_key"), text.alias("text"))

    found = map_texts(every.select(F.struct("host", "text_key").alias("doc_id"), "text"), lambda: lambda text: (line_keys(text),), "line_keys array<bigint>")
    rows = table(found.select("doc_id.host", "doc_id.text_key", "line_keys").withColumn("row", F.monotonically_increasing_id()), "lines")
    once = rows.groupBy("host", "text_key").agg(F.min("row").alias("row"))
    first = table(once.select("row", F.col("host").alias("h")), "lines-first")
    of_host = first.groupBy(F.col("h").alias("host")).agg(F.count(F.lit(1)).alias("docs"))
    lines = rows.join(first.select("row"), "row", "left_semi").select("host", "text_key", F.explode("line_keys").alias("line"))
    many = lines.groupBy("host", "line").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > min(most_docs, HANDFUL))
    common = (F.col("n") > most_docs) | ((F.col("n") > HANDFUL) & (F.col("n") > F.col("docs") * most_share))
    boiler = table(many.join(of_host, "host").filter(common).select("host", "line"), "lines-boiler")
    if boiler.count() <= most_lines:
        both, make = by_lines(every, boiler)
    else:
        both, make = by_texts(every, lines, boiler, most_bits)

    schema = "n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, n_boiler_words bigint, cleaned string"
    failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))
    depleted = F.col("n_words") - F.col("n_boiler_words") < least_left * F.col("n_words")
    out = map_texts(both, make, schema)
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_boiler_words", failed.alias("base_failed"), (~failed & ~depleted).alias("kept"), "cleaned")

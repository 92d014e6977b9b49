"""Token counts with a vocabulary file of a public tokenizer; huge documents are encoded in overlapping chunks."""

from __future__ import annotations

import json
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import _parse_datatype_string

from .bpe import Memory
from .common import frees, located, map_texts, small_batches, table

#: Code points up to which a document is encoded as a whole, and that a chunk of a longer one takes.
CHUNK = 32_768
#: Code points by which chunks first reach over the cuts between them on either side, and by how much a failure widens that.
OVERLAP, WIDER = 256, 8
LIMIT = 2048

#: Before white space of ASCII and after what no table calls white space.
GAP = re.compile(r"(?<=\S)(?=[\t-\r ])")
PIECE_GAP = re.compile("(?<=[^ ▁])(?= )")


class JsonTokenizer:
    """A file of the tokenizers library.

    ``gap`` finds places that no token spans and at which either side's tokens don't depend on the other: before white
    space that follows something else. That holds if pieces hold no white space at all (``drops``), or only as their
    first characters, as the byte-level pattern has it; if normalising goes by single characters, or by marks after them;
    and if no added token may take white space. Otherwise there is no gap, and a document is encoded as a whole.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.model, spec = Tokenizer.from_file(path), json.load(open(path, encoding="utf-8"))
        self.model.no_truncation()
        self.model.no_padding()
        steps = spec.get("pre_tokenizer") or {}
        steps = steps.get("pretokenizers", [steps])
        first = steps[0]
        cut = lambda text: [x for x, _ in self.model.pre_tokenizer.pre_tokenize_str(text)]
        split = first.get("type") == "Split" and first.get("behavior") == "Removed" and first.get("invert")
        self.drops = bool(split) and all(cut(f"a{x}b") == ["a", "b"] and not cut(x) for x in "\t\n\v\f\r ")
        by_bytes = first.get("type") == "ByteLevel" and first.get("use_regex", True) and not first.get("add_prefix_space")
        norm = spec.get("normalizer") or {}
        known = all(self.plain(x) for x in norm.get("normalizers", [norm]) if x)
        bare = not any(t["lstrip"] or t["rstrip"] or t["single_word"] or t["normalized"] or re.search(r"\s", t["content"]) for t in spec.get("added_tokens", []))
        alone = spec.get("post_processor") is None or by_bytes
        self.gap = GAP if (self.drops or by_bytes) and known and bare and alone else None
        self.counts = Memory(self.encoded)

    @staticmethod
    def plain(step: dict) -> bool:
        """Normalising steps that don't look across white space."""
        return step["type"] in ("NFC", "NFD", "Lowercase") or step["type"] == "Replace" and step["pattern"] == {"Regex": r"\s+"} and step["content"] == " "

    def encoded(self, text) -> int:
        return len(self.model.encode(text if isinstance(text, str) else text.decode(), add_special_tokens=False).ids)

    def count(self, text: str) -> int:
        """Tokens of a text; where white space has none, those of its stretches without any, which are remembered."""
        if self.drops and self.gap:
            return sum(map(self.counts.__getitem__, text.encode().split()))
        return self.encoded(text)

    def spans(self, text: str) -> np.ndarray:
        """Starts and ends of the tokens, in code points."""
        return np.array(self.model.encode(text, add_special_tokens=False).offsets, np.int64).reshape(-1, 2)


class PieceTokenizer:
    """A file of sentencepiece. A place before a space that follows something else is a gap if no piece of the vocabulary
    holds such a place, since merges never make anything else, and if normalising keeps spaces."""

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = (self.model.id_to_piece(i) for i in range(self.model.vocab_size()))
        keeps = self.model.encode("a  b ", out_type=str) == ["▁a", "▁", "▁b", "▁"]
        self.gap = PIECE_GAP if keeps and not any(re.search("[^▁]▁", p) for p in pieces) else None

    def count(self, text: str) -> int:
        return len(self.model.encode(text))

    def spans(self, text: str) -> np.ndarray:
        found = np.array([(p.begin, p.end) for p in self.model.encode(text, return_type="proto").pieces], np.int64).reshape(-1, 2)
        data = np.frombuffer(text.encode(), np.uint8)
        return np.concatenate([[0], np.cumsum(data & 0xC0 != 0x80)])[found]  # from bytes to code points


@lru_cache(maxsize=4)
def load(path: str):
    return JsonTokenizer(path) if path.endswith(".json") else PieceTokenizer(path)


def boundaries(gap, text: str, spans: np.ndarray, low: int, high: int) -> list[tuple[int, int]]:
    """(place, tokens before it) for the gaps of ``text`` within [low, high) at which one token ends and the next starts."""
    places = np.array([m.start() for m in gap.finditer(text, low, min(len(text), high))] if gap else [], np.int64)
    ended, begun = np.searchsorted(np.maximum.accumulate(spans[:, 1]), places, "right"), np.searchsorted(spans[:, 0], places, "left")
    return [(int(p), int(e)) for p, e, b in zip(places, ended, begun) if e == b]


def chunks_of(docs: DataFrame, chunk: int, overlap: int) -> DataFrame:
    """(__file, __place, chunk, chunks, start, piece) of (__file, __place, text), dealt evenly."""

    def run(batches):
        for batch in batches:
            for file, place, text in zip(*(c.to_pylist() for c in batch.columns)):
                many = max(1, -(-len(text) // chunk))
                for i in range(many):
                    start = max(0, i * chunk - overlap)
                    piece = text[start : (i + 1) * chunk + overlap] if i < many - 1 else text[start:]
                    yield pa.RecordBatch.from_pylist([{"__file": file, "__place": place, "chunk": i, "chunks": many, "start": start, "piece": piece}], schema=arrow)

    schema = "__file string, __place bigint, chunk int, chunks int, start bigint, piece string"
    arrow = to_arrow_schema(_parse_datatype_string(schema))
    cut = docs.mapInArrow(frees(run), schema)
    return cut.repartition("__file", "__place", "chunk")


def spliced(docs: DataFrame, path: str, chunk: int, overlap: int) -> DataFrame:
    """(__file, __place, n_tokens) of (__file, __place, text); null where two chunks have no common boundary.

    Each chunk is encoded with offsets. A cut's two chunks share the text around it; of the gaps in it at which both have
    a token boundary, the one nearest to the cut joins them: tokens before it are the first's, those after it the second's.
    """

    def run(batches):
        model = load(path)
        for batch in batches:
            for row in batch.to_pylist():
                i, many, start, piece = row["chunk"], row["chunks"], row.pop("start"), row.pop("piece")
                spans = model.spans(piece)
                cuts = [(i - 1, i * chunk, -1)] * (i > 0) + [(i, (i + 1) * chunk, 1)] * (i < many - 1)
                row["total"] = len(spans)
                row["marks"] = [
                    {"cut": cut, "at": p + start, "far": abs(p + start - mid), "n": n * side, "side": side}
                    for cut, mid, side in cuts
                    for p, n in boundaries(model.gap, piece, spans, mid - overlap + 1 - start, mid + overlap - start)
                ]
                yield pa.RecordBatch.from_pylist([row], schema=arrow)

    mark = "struct<cut:int,at:bigint,far:bigint,n:bigint,side:int>"
    schema = f"__file string, __place bigint, chunk int, chunks int, total bigint, marks array<{mark}>"
    arrow = to_arrow_schema(_parse_datatype_string(schema))
    encoded = table(chunks_of(docs, chunk, overlap).mapInArrow(frees(run), schema), "token-chunks")
    key = ["__file", "__place"]
    both = encoded.select(*key, F.explode("marks").alias("m")).groupBy(*key, "m.cut", "m.at", "m.far").agg(F.sum("m.n").alias("n"), F.sum("m.side").alias("sides"), F.count(F.lit(1)).alias("seen"))
    joints = both.filter("seen = 2 and sides = 0").groupBy(*key, "cut").agg(F.min(F.struct("far", "at", "n")).alias("best"))
    parts = joints.select(*key, F.lit(1).alias("joint"), F.col("best.n").alias("n"), F.lit(0).alias("cuts"))
    ends = encoded.filter("chunk = chunks - 1").select(*key, F.lit(0).alias("joint"), F.col("total").alias("n"), (F.col("chunks") - 1).alias("cuts"))
    sums = parts.unionByName(ends).groupBy(*key).agg(F.sum("n").alias("n"), F.sum("joint").alias("joints"), F.sum("cuts").alias("cuts"))
    return sums.select(*key, F.when(F.col("joints") == F.col("cuts"), F.col("n")).alias("n_tokens"))


def count_tokens(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", limit: int = LIMIT, chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_bytes (of UTF-8), n_tokens, over_limit.

    The counts are those of the library for the file at ``path`` (tokenizers for .json, sentencepiece for .model), which
    each executor can read. Documents above ``chunk`` code points are cut, so that one of them may be many tasks; where
    two chunks of a document have no common boundary (text without white space, say), it is cut again with chunks and
    overlaps that grow by WIDER, at the last into one chunk.

    Null and empty texts have 0 bytes and tokens. Row by row, so ties, repeated rows and other columns don't matter, and
    an empty table gives no rows.
    """
    spark = docs.sparkSession
    small_batches(spark)
    held = located(docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text")), "token-docs")
    long = F.length("text") > chunk
    few = map_texts(held.filter(~long).select("doc_id", "text"), lambda: lambda text, m=load(path): (len(text.encode()), m.count(text)), "n_bytes bigint, n_tokens bigint")
    huge = held.filter(long)
    todo, done, key = huge.select("__file", "__place", "text"), [], ["__file", "__place"]
    while True:
        found = table(spliced(todo, path, chunk, overlap), "token-sums")
        done.append(found.filter("n_tokens is not null"))
        failed = found.filter("n_tokens is null").select(*key)
        if failed.isEmpty():
            break
        overlap *= WIDER
        chunk = max(chunk, 4 * overlap)
        todo = huge.join(failed, key, "left_semi").select(*key, "text")
    sums = done[0]
    for more in done[1:]:
        sums = sums.unionByName(more)
    many = huge.select("doc_id", F.octet_length("text").cast("bigint").alias("n_bytes"), *key).join(sums, key).select("doc_id", "n_bytes", "n_tokens")
    return few.unionByName(many).withColumn("over_limit", F.col("n_tokens") > limit)

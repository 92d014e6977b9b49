"""BPE encoding and decoding with a vocabulary file of a public tokenizer."""

from __future__ import annotations

import json
import unicodedata
from functools import lru_cache
from heapq import heapify, heappop, heappush
from struct import pack

import numpy as np
import regex
from pyspark.sql import DataFrame

from .common import map_texts, texts

#: Stretches of text that a task remembers at least, twice as many at most; it only saves time.
REMEMBER = 200_000
#: Longer ones aren't remembered.
LONG = 64
#: Marks that often follow a word.
MARKS = "!#$%&*,.:;?"
#: Bits for a symbol id in a pair, and for a place in a queue entry.
ID, PLACE = 17, 40


def byte_letters() -> list[str]:
    """Byte-level alphabet: printable Latin-1 bytes stand for themselves, the rest follow from U+0100 on in order."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    letters, extra = {b: chr(b) for b in plain}, 0x100
    for b in range(256):
        if b not in letters:
            letters[b] = chr(extra)
            extra += 1
    return [letters[b] for b in range(256)]


class Memory(dict):
    """Results of a function by argument, in two generations: when the new one is full, the old one goes."""

    def __init__(self, f):
        self.f, self.old = f, {}

    def __missing__(self, key):
        out = self.old.get(key)
        if out is None:
            out = self.f(key)
        if len(key) <= LONG:
            if len(self) >= REMEMBER:
                self.old = dict(self)
                self.clear()
            self[key] = out
        return out


class Bpe:
    """The model of a vocabulary file: NFC, lower case, a pattern that splits, byte letters, merges with a word end."""

    def __init__(self, path: str):
        self.path, spec = path, json.load(open(path, encoding="utf-8"))
        model = spec["model"]
        vocab, end, letters = model["vocab"], model.get("end_of_word_suffix") or "", byte_letters()
        self.strings = {i: s for s, i in vocab.items()}
        #: By pair of ids its rank, and by rank the id that the pair becomes.
        self.rank, self.made = {}, []
        for rank, pair in enumerate(model["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            self.rank[vocab[a] << ID | vocab[b]] = rank
            self.made.append(vocab[a + b])
        self.inner, self.last = [vocab.get(x, -1) for x in letters], [vocab.get(x + end, -1) for x in letters]
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        self.strings.update({i: s for s, i in self.special.items()})
        steps = spec["pre_tokenizer"]["pretokenizers"]
        self.split = regex.compile(next(s["pattern"]["Regex"] for s in steps if s["type"] == "Split"))
        self.specials = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.stretches = Memory(self.stretch)

    def piece(self, piece: str) -> bytes:
        """Ids of one piece, as little-endian unsigned 32-bit integers; bytes that the vocabulary lacks have none."""
        data = piece.encode()
        ids = [self.inner[b] for b in data[:-1]]
        ids.append(self.last[data[-1]])
        if min(ids) < 0:
            ids = [x for x in ids if x >= 0]
        if len(ids) > 1:
            ids = self.merge(ids)
        return pack(f"<{len(ids)}I", *ids)

    def merge(self, ids: list[int]) -> list[int]:
        """Merges symbols: a priority queue of (rank, place) over a doubly linked list; stale entries are skipped."""
        n, get, made = len(ids), self.rank.get, self.made
        before, after = list(range(-1, n - 1)), [*range(1, n), -1]
        queue, mask, a = [], (1 << PLACE) - 1, ids[0]
        for i in range(n - 1):
            b = ids[i + 1]
            if (r := get(a << ID | b)) is not None:
                queue.append(r << PLACE | i)
            a = b
        heapify(queue)
        while queue:
            entry = heappop(queue)
            i, new = entry & mask, made[entry >> PLACE]
            a, j = ids[i], after[i]
            if a < 0 or j < 0 or (r := get(a << ID | ids[j])) is None or made[r] != new:
                continue
            ids[i], ids[j] = new, -1
            after[i] = k = after[j]
            if k >= 0:
                before[k] = i
                if (r := get(new << ID | ids[k])) is not None:
                    heappush(queue, r << PLACE | i)
            if (h := before[i]) >= 0 and (r := get(ids[h] << ID | new)) is not None:
                heappush(queue, r << PLACE | h)
        return [x for x in ids if x >= 0]

    def stretch(self, text: str) -> bytes:
        """Ids of text without white space."""
        if text.isalpha() and text.isascii():
            return self.piece(text)
        word = text.rstrip(MARKS)
        if word.isalpha() and word.isascii():  # then the marks are one piece
            return self.stretches[word] + self.stretches[text[len(word) :]]
        if not text.isascii() and any(unicodedata.category(c) == "Cn" for c in text):
            return b"".join(map(self.piece, self.pieces_of_library(text)))
        pieces = self.split.findall(text)
        if len(pieces) == 1:
            return self.piece(pieces[0])
        return b"".join(map(self.stretches.__getitem__, pieces))

    def tokenizer(self):
        from tokenizers import Tokenizer

        if not hasattr(self, "library"):
            self.library = Tokenizer.from_file(self.path)
        return self.library

    def pieces_of_library(self, text: str) -> list[str]:
        """Pieces of text with letters newer than Python's Unicode tables, by the tables of the tokenizers library."""
        own = {x: b for b, x in enumerate(byte_letters())}
        found = self.tokenizer().pre_tokenizer.pre_tokenize_str(self.tokenizer().normalizer.normalize_str(text))
        return [bytes(own[c] for c in piece).decode() for piece, _ in found]

    def encode(self, text: str) -> bytes:
        """Ids of a whole text, packed. No piece spans white space, so stretches without any are looked up."""
        if self.specials and "<|" in text:
            return b"".join(pack("<I", self.special[p]) if p in self.special else self.plain(p) for p in self.specials.split(text) if p)
        return self.plain(text)

    def plain(self, text: str) -> bytes:
        if not text.isascii():
            if not unicodedata.is_normalized("NFC", text):  # by the library's tables, which aren't Python's
                text = self.tokenizer().normalizer.normalize_str(text)
            # Lower case is letter by letter: a final sigma isn't told apart.
            text = text.replace("Σ", "σ")
        text = text.lower()
        if any(c in text for c in "\x1c\x1d\x1e\x1f"):  # white space to split(), not to the pattern
            return b"".join(map(self.stretches.__getitem__, regex.findall(r"[^\t-\r \x85\p{Z}]+", text)))
        return b"".join(map(self.stretches.__getitem__, text.split()))

    def decode(self, ids: bytes) -> str:
        """The vocabulary strings of the ids; the file names no decoder, so a space goes between them."""
        return " ".join(map(self.strings.__getitem__, np.frombuffer(ids, dtype="<u4").tolist()))


@lru_cache(maxsize=4)
def load(path: str) -> Bpe:
    return Bpe(path)


def encode_decode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, n_tokens, ids (packed little-endian unsigned 32-bit), decoded.

    ``path`` is a vocabulary file that each executor can read. Null and empty texts have no ids and decode to an empty
    text; special tokens in a text get their own ids. Row by row, so ties, repeats and other columns don't matter, and
    an empty table gives no rows. A text without white space is merged as one, in n log n.
    """

    def make():
        model = load(path)

        def one(text):
            ids = model.encode(text)
            return len(ids) // 4, ids, model.decode(ids)

        return one

    return map_texts(texts(docs, id_col, text_col), make, "n_tokens bigint, ids binary, decoded string")

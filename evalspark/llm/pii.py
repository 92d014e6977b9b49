"""Personal data: fixed patterns, and a semi-Markov conditional random field over stretches of digits and addresses."""

from __future__ import annotations

import bisect
import math
import random
import re
from collections import defaultdict
from functools import lru_cache

from pyspark.sql import DataFrame

from .common import map_texts, joined_spans, texts

KINDS = ("email", "ip", "card", "phone")
# The base patterns.
DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
#: A match starts with its run of digits and takes runs whole, so it can be told in one pass.
IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
DIGIT = re.compile(r"[0-9]")
#: Stretches that the model looks at: digits with marks between them, and addresses with a spelt-out sign. The parts of an
#: address are as long as they may be by its standard; a bare "at" needs a bare "dot" after it.
REGION = re.compile(r"[+(]?[0-9][0-9\x20().+/:-]{5,}[0-9]|[A-Za-z0-9._%+-]{1,64}(?:\x20?(?:\[at\]|\(at\))\x20?[A-Za-z0-9-]{1,63}(?:\x20?(?:\.|\[dot\]|\(dot\))\x20?[A-Za-z0-9-]{1,63})+|\x20at\x20[A-Za-z0-9-]{1,63}(?:\x20dot\x20[A-Za-z0-9-]{1,63})+)")
TOKEN = re.compile(r"[0-9]+|[A-Za-z]+|\x20+|.", re.S)
#: Tokens of a segment at most.
WIDEST = 16


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def digits_of(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def base_spans(text: str) -> list:
    """Spans of the patterns, leftmost and without overlap for each kind; those that fail their test are dropped."""
    out, end, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in LOCAL:
            start -= 1
        if start < at and (m := DOMAIN.match(text, at + 1)):
            out.append(("email", start, m.end()))
            end = m.end()
        at = text.find("@", max(at + 1, end))
    if DIGIT.search(text):
        out += [("ip", m.start(), m.end()) for m in IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split("."))]
        for m in CARD.finditer(text):
            if m.end() - m.start() >= 14 and 14 <= len(d := digits_of(m[0])) <= 19 and luhn(d):
                out.append(("card", m.start(), m.end()))
        if "+" in text:
            out += [("phone", m.start(), m.end()) for m in PHONE.finditer(text) if 10 <= len(digits_of(m[0])) <= 15]
    return sorted(out, key=lambda s: (s[1], KINDS.index(s[0])))


def features(segment: str, before: str, after: str) -> list[str]:
    """Features of a whole segment and of the characters beside it."""
    groups = re.findall("[0-9]+", segment)
    digits = "".join(groups)
    marks = "".join(sorted(set(re.sub("[0-9A-Za-z]+", "", segment))))
    n = len(digits)
    out = ["bias", f"n={min(n, 20)}", "groups=" + "-".join(str(len(g)) for g in groups[:6]), f"marks={marks}", f"first={segment[0] if not segment[0].isalnum() else 'd' if segment[0].isdigit() else 'a'}", f"last={'d' if segment[-1].isdigit() else 'a' if segment[-1].isalpha() else segment[-1]}"]
    if len(groups) == 4 and marks == ".":
        out.append(f"quad={all(len(g) <= 3 and int(g) <= 255 for g in groups)}")
    if 13 <= n <= 19:
        out.append(f"luhn={luhn(digits)}")
    if segment.count("(") != segment.count(")"):
        out.append("unpaired")
    if re.search(r"[\[(\x20]at[\])\x20]", segment):
        out.append("at")
    if n:
        out.append(f"zero={digits[0] == '0'}{len(groups[0])}")
    out.append(f"tight={before[-1:].isalnum()}{after[:1].isalnum()}")
    return out


def places(tokens: list[str]) -> list[int]:
    """Where each token starts, and where the last ends."""
    out = [0]
    for t in tokens:
        out.append(out[-1] + len(t))
    return out


class SemiCrf:
    """Scores segments (start, end, kind) of a token row; kind None is one token outside any entity."""

    def __init__(self):
        self.weights: dict[tuple, float] = defaultdict(float)

    def ending(self, end: int, tokens: list[str], place: list[int], text: str, before: str, after: str) -> list[tuple]:
        """(start, kind, features) of the segments that end there, at most WIDEST tokens each. Entities start and end with
        a letter or digit, or start with + or (."""
        last = tokens[end - 1]
        out = [(end - 1, None, ["out", "out:" + ("d" if last.isdigit() else last if len(last) == 1 else "a")])]
        if last.isalnum():
            follows = text[place[end]] if place[end] < len(text) else after[:1]
            for start in range(max(0, end - WIDEST), end):
                if (tokens[start].isalnum() or tokens[start] in "+(") and place[end] - place[start] >= 7:
                    f = features(text[place[start] : place[end]], text[place[start] - 1] if start else before[-1:], follows)
                    out.extend((start, kind, f) for kind in KINDS)
        return out

    def segments(self, tokens: list[str], before: str, after: str) -> list[list]:
        """By end token the segments that end there."""
        text, place = "".join(tokens), places(tokens)
        return [[], *(self.ending(end, tokens, place, text, before, after) for end in range(1, len(tokens) + 1))]

    def score(self, kind, f) -> float:
        get = self.weights.get
        return sum(get((kind, x), 0.0) for x in f)

    def best(self, tokens: list[str], before: str = "", after: str = "") -> list[tuple]:
        """The best segmentation's entities, as (kind, start token, end token); of equals the first.

        A segment is bounded, so each token costs the same; what is kept of it is a score and a way back.
        """
        n, text, place = len(tokens), "".join(tokens), places(tokens)
        top, back = [0.0] + [-math.inf] * n, [None] * (n + 1)
        for end in range(1, n + 1):
            for start, kind, f in self.ending(end, tokens, place, text, before, after):
                s = top[start] + self.score(kind, f)
                if s > top[end]:
                    top[end], back[end] = s, (start, kind)
        out, at = [], n
        while at:
            start, kind = back[at]
            if kind:
                out.append((kind, start, at))
            at = start
        return out[::-1]

    def step(self, tokens: list[str], gold: list[tuple], rate: float, decay: float) -> None:
        """One gradient step on the log-likelihood: features of the gold segments less their expectation."""
        rows, n = self.segments(tokens, "", ""), len(tokens)
        scored = [[(start, kind, f, self.score(kind, f)) for start, kind, f in r] for r in rows]
        alpha, beta = [0.0] + [-math.inf] * n, [-math.inf] * n + [0.0]
        for end in range(1, n + 1):
            xs = [alpha[s] + v for s, _, _, v in scored[end]]
            m = max(xs)
            alpha[end] = m + math.log(sum(math.exp(x - m) for x in xs))
        into = defaultdict(list)
        for end in range(n, 0, -1):
            if end < n:
                xs = into[end]
                m = max(xs)
                beta[end] = m + math.log(sum(math.exp(x - m) for x in xs))
            for s, _, _, v in scored[end]:
                into[s].append(beta[end] + v)
        inside = {i for _, a, b in gold for i in range(a, b)}
        wanted = {(a, b, kind) for kind, a, b in gold} | {(i, i + 1, None) for i in range(n) if i not in inside}
        grad = defaultdict(float)
        for end in range(1, n + 1):
            for s, kind, f, v in scored[end]:
                g = ((s, end, kind) in wanted) - math.exp(alpha[s] + v + beta[end] - alpha[n])
                if abs(g) > 1e-4:
                    for x in f:
                        grad[kind, x] += g
        for k, g in grad.items():
            self.weights[k] += rate * (g - decay * self.weights[k])


def examples(count: int, seed: int = 7) -> list[tuple[list[str], list[tuple]]]:
    """Made examples: (tokens, entities). Decoys are dates, times, amounts, versions, ranges and bare numbers."""
    r = random.Random(seed)
    num = lambda n: "".join(r.choice("0123456789") for _ in range(n))

    def card():
        n = r.choice((15, 16))
        body = r.choice("3456") + num(n - 2)
        d = next(c for c in "0123456789" if luhn(body + c))
        s = body + d
        return s if r.random() < 0.3 or n == 15 else r.choice(" -").join(s[i : i + 4] for i in range(0, 16, 4))

    def phone():
        a, b, c = num(3), num(3), num(4)
        return r.choice((f"({a}) {b}-{c}", f"{a}-{b}-{c}", f"{a}.{b}.{c}", f"+1 ({a}) {b}-{c}", f"+{num(2)} {num(3)} {num(3)} {num(4)}", f"1-{a}-{b}-{c}", f"0{num(2)} {num(7)}", f"0{num(3)} {num(6)}", f"0{num(3)}/{num(6)}", f"0{num(1)} {num(2)} {num(2)} {num(2)} {num(2)}"))

    def email():
        words = [r.choice(("ann", "post", "info", "sales", "team", "mail", "site", "house")) + r.choice(("", num(2))) for _ in range(2)]
        if r.random() < 0.3:
            return words[0] + " at " + words[1] + " dot " + r.choice(("org", "com", "net"))
        return words[0] + r.choice((" [at] ", "(at)", " (at) ", "[at]")) + words[1] + r.choice((".", " [dot] ", " (dot) ")) + r.choice(("org", "com", "net"))

    ip = lambda: ".".join(str(r.randrange(256)) for _ in range(4))
    decoys = (lambda: f"{r.randrange(1900, 2100)}-{r.randrange(1, 13):02}-{r.randrange(1, 29):02}", lambda: f"{r.randrange(24):02}:{r.randrange(60):02}:{r.randrange(60):02}", lambda: f"{num(3)}.{num(3)}.{num(3)}", lambda: num(r.randrange(7, 14)), lambda: f"{num(4)} {num(4)}", lambda: f"{num(4)}-{num(4)}", lambda: f"{r.randrange(1, 29)}/{r.randrange(1, 13)}/{num(4)}", lambda: " ".join(num(r.randrange(1, 5)) for _ in range(r.randrange(3, 7))), lambda: f"{num(2)}.{num(6)}", lambda: num(16), lambda: f"{num(1)}.{num(1)}.{num(2)} {num(2)}", lambda: f"{r.randrange(1, 10)}{num(2)} {num(7)}", lambda: " ".join([str(r.randrange(1, 10)), *(num(2) for _ in range(4))]), lambda: f"{r.randrange(1, 10)}{num(3)}/{num(6)}")
    out = []
    for _ in range(count):
        tokens, gold = [], []
        for _ in range(r.choice((1, 1, 1, 2))):
            kind = r.choice((*KINDS, None, None, None))
            text = {"email": email, "ip": ip, "card": card, "phone": phone, None: r.choice(decoys)}[kind]()
            if tokens:
                tokens += [" "]
            own = TOKEN.findall(text)
            if kind:
                gold.append((kind, len(tokens), len(tokens) + len(own)))
            tokens += own
        if all(b - a <= WIDEST for _, a, b in gold):
            out.append((tokens, gold))
    return out


@lru_cache(maxsize=2)
def trained(count: int = 800, rounds: int = 6, seed: int = 7) -> SemiCrf:
    """The model fitted to ``count`` made examples; the same each time."""
    model, made = SemiCrf(), examples(count, seed)
    for k in range(rounds):
        for tokens, gold in made:
            model.step(tokens, gold, 0.3 / (1 + k), 1e-3)
    return model


def merged(spans: list) -> tuple[list[int], list[int]]:
    """Starts and ends of the runs that spans, by start, cover."""
    starts, ends = [], []
    for _, s, e in spans:
        if ends and s <= ends[-1]:
            ends[-1] = max(ends[-1], e)
        else:
            starts.append(s), ends.append(e)
    return starts, ends


def overlaps(runs: tuple[list[int], list[int]], start: int, end: int) -> bool:
    i = bisect.bisect_right(runs[1], start)
    return i < len(runs[0]) and runs[0][i] < end


def scan(text: str, model: SemiCrf) -> tuple[list, list]:
    """(base spans, all spans); the model adds entities that overlap no base span."""
    base, more = base_spans(text), []
    taken = merged(base)
    for m in REGION.finditer(text) if DIGIT.search(text) or "at" in text else ():
        tokens = TOKEN.findall(m[0])
        place = [m.start() + x for x in places(tokens)]
        for kind, a, b in model.best(tokens, text[max(0, m.start() - 1) : m.start()], text[m.end() : m.end() + 1]):
            if not overlaps(taken, place[a], place[b]):
                more.append((kind, place[a], place[b]))
    return base, sorted(base + more, key=lambda s: (s[1], KINDS.index(s[0])))


def scan_pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", model: SemiCrf | None = None) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_email, n_ip, n_card, n_phone (base spans), n_spans (all), base, spans.

    base and spans are kind:start:end, comma-joined, in code points with the end exclusive. Null and empty texts have
    none. Row by row, so ties, repeats and other columns don't matter; a long text costs time in proportion.
    """
    weights = dict((model or trained()).weights)

    def make():
        own = SemiCrf()
        own.weights = weights

        def one(text):
            base, spans = scan(text, own)
            n = [sum(k == kind for k, _, _ in base) for kind in KINDS]
            return (*n, len(spans), joined_spans(base), joined_spans(spans))

        return one

    return map_texts(texts(docs, id_col, text_col), make, "n_email bigint, n_ip bigint, n_card bigint, n_phone bigint, n_spans bigint, base string, spans string")

"""Secret scans: fixed patterns, and a battery of randomness tests on runs of code-like characters."""

from __future__ import annotations

import bisect
import math
import re

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import joined_spans, map_texts, table, texts

# The base patterns.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
KINDS = ("assign", "access", "hex", "random")

#: Candidates of the battery: runs that could be an encoded key. Words of ordinary text are shorter or of letters alone.
RUN = re.compile(r"[A-Za-z0-9+/_=-]{20,}")
#: What a run consists of: names and values between equals signs; those at the end of the run are padding.
PART = re.compile(r"[A-Za-z0-9+/_-]+(?:=*\Z)?")
#: Parts in no single alphabet are cut at one kind of separators, at the other, and at both: a key may hold either kind.
PIECES = [re.compile(p) for p in (r"[A-Za-z0-9+/]+=*", r"[A-Za-z0-9_-]+=*", r"[A-Za-z0-9]+=*")]
LEAST_RUN = 20
LONG_HEX = re.compile(r"[0-9a-f]{32}")
CUE = re.compile(r"passw|secret|token|api_?key", re.I | re.A)

#: Alphabets by name, least first; a run is taken to be in the first that holds all its characters.
DIGITS, LOWER, UPPER = "0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
ALPHABETS = {"hex": DIGITS + "abcdef", "HEX": DIGITS + "ABCDEF", "base32": UPPER + "234567", "base36": DIGITS + LOWER, "base62": DIGITS + UPPER + LOWER, "base64": UPPER + LOWER + DIGITS + "+/", "base64url": UPPER + LOWER + DIGITS + "-_"}
PLACES = {name: {c: i for i, c in enumerate(letters)} for name, letters in ALPHABETS.items()}
#: Level below which one test calls a run of a single text uneven, and the rate of false discoveries, over the corpus'
#: runs or, for a text by itself, over its own.
LEVEL, RATE = 0.001, 0.01
#: Bars of a histogram of p for each halving of it, and a bar beyond all.
GRADES, NONE = 32, 1 << 30
#: By how much, a character, chi-squared of ordinary text over an alphabet exceeds that of random text: the square sum
#: of relative excess frequencies. Letters of prose alone give about 0.7; digits counted up, paths and names give more.
EXCESS = 0.7
#: How often, at most, two neighbours in ordinary names and codes differ in kind (small letter, capital, digit), a capital
#: before a small letter and marks not counted; in random runs nearly half do.
CHANGES = 0.2


def normal_tail(z: float) -> float:
    return 0.5 * math.erfc(z / math.sqrt(2))


def kind_changes(run: str) -> tuple[int, int]:
    """(neighbours that differ in kind, neighbours looked at); a small letter after a capital and marks are passed over."""
    kinds = ["d" if "0" <= c <= "9" else "u" if "A" <= c <= "Z" else "l" if "a" <= c <= "z" else "" for c in run]
    pairs = [(x, y) for x, y in zip(kinds, kinds[1:]) if x and y]
    return sum(x != y and (x, y) != ("u", "l") for x, y in pairs), len(pairs)


def binomial_tail(k: int, n: int, p: float) -> float:
    """Chance of k or more of n."""
    if n > 400:
        return normal_tail((k - 0.5 - n * p) / math.sqrt(n * p * (1 - p)))
    return min(1.0, math.fsum(math.comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(k, n + 1)))


def battery(run: str) -> tuple[str, float, float, float, float] | None:
    """(encoding, p of uniformity, p of runs, p of serial correlation, p of looking so even as ordinary text).

    None if the run fits no alphabet. Chi-squared takes Wilson and Hilferty's cube root; runs above and below the middle
    of the alphabet and the lag-one correlation of places take their normal limits. The last p joins, by Fisher's way,
    how even the letters are and how often their kinds change.
    """
    run = run.rstrip("=")
    chars = set(run)
    name = next((n for n, places in PLACES.items() if chars <= places.keys()), None)
    n = len(run)
    if name is None or n < 16:
        return None
    places, k = PLACES[name], len(ALPHABETS[name])
    at = [places[c] for c in run]
    counts = [0] * k
    for x in at:
        counts[x] += 1
    df, chi = k - 1, sum(c * c for c in counts) * k / n - n
    z = ((max(chi, 0) / df) ** (1 / 3) - (1 - 2 / (9 * df))) / math.sqrt(2 / (9 * df))
    p_chi = normal_tail(z)
    high = [2 * x >= k for x in at]
    a = sum(high)
    b = n - a
    if a and b:
        mean = 1 + 2 * a * b / n
        var = max((mean - 1) * (mean - 2) / (n - 1), 1e-9)
        p_runs = 2 * normal_tail(abs(1 + sum(x != y for x, y in zip(high, high[1:])) - mean) / math.sqrt(var))
    else:
        p_runs = 2.0 ** (1 - n)
    mid = sum(at) / n
    total = sum((x - mid) ** 2 for x in at)
    serial = sum((x - mid) * (y - mid) for x, y in zip(at, at[1:])) / total if total else 1.0
    p_serial = 2 * normal_tail(abs(serial + 1 / n) * math.sqrt(n))
    # Ordinary text of this length: a non-central chi-squared, whose excess grows with the length.
    over = n * EXCESS
    p_even = normal_tail((df + over - chi) / math.sqrt(2 * df + 4 * over))
    changes, pairs = kind_changes(run)
    both = max(p_even * binomial_tail(changes, pairs, CHANGES), 1e-300)
    return name, p_chi, p_runs, p_serial, both * (1 - math.log(both))


def random_runs(runs: list[str]) -> list[bool]:
    """Which runs of a text are called random.

    A run stands if no test of the battery calls it uneven and if, by Benjamini and Hochberg over the runs of the text,
    it is too even for ordinary text of its length. The shorter a run, the less can be told.
    """
    found = []
    for i, run in enumerate(runs):
        if is_mixed(run) and (b := battery(run)) and min(b[1:4]) >= LEVEL:
            found.append((b[4], i))
    found.sort()
    last = max((j for j, (p, _) in enumerate(found) if p <= RATE * (j + 1) / len(runs)), default=-1)
    out = [False] * len(runs)
    for _, i in found[: last + 1]:
        out[i] = True
    return out


def is_mixed(run: str) -> bool:
    return any(c.isdigit() for c in run) and any(c.isalpha() for c in run)


def candidates(text: str) -> list[tuple[int, int]]:
    """Spans of the strings that the battery is asked about.

    A run is one, unless it holds an equals sign that isn't padding or fits no alphabet. Then its parts are, where they
    are as long as a run must be and have letters and digits; pieces of a part may overlap.
    """
    out = []
    for m in RUN.finditer(text):
        run = m[0]
        inner = "=" in run.rstrip("=")
        if not inner and not ({"+", "/"} & (chars := set(run)) and {"-", "_"} & chars):
            out.append(m.span())
            continue
        found = {}
        for part in PART.finditer(run):
            chars = set(part[0])
            pieces = [part] if not ({"+", "/"} & chars and {"-", "_"} & chars) else [x for p in PIECES for x in p.finditer(run, *part.span())]
            found |= {x.span(): None for x in pieces if len(x[0]) >= LEAST_RUN and is_mixed(x[0])}
        out += [(m.start() + a, m.start() + b) for a, b in sorted(found)]
    return out


def apart(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Spans of which none overlap: of those that do, the longest, and of these the first."""
    out = []
    for a, b in sorted(spans, key=lambda s: (s[0] - s[1], s[0])):
        i = bisect.bisect(out, (a, b))
        if (not i or out[i - 1][1] <= a) and (i == len(out) or b <= out[i][0]):
            out.insert(i, (a, b))
    return out


def order(span) -> tuple:
    return span[1], KINDS.index(span[0])


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) of the fixed patterns, by start and then kind as listed."""
    base = []
    if CUE.search(text):
        base += [("assign", m.start(), m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    if "AKIA" in text:
        base += [("access", m.start(), m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 16]
    if LONG_HEX.search(text):
        base += [("hex", m.start(), m.end()) for m in HEX.finditer(text) if m.end() - m.start() >= 32]
    return sorted(base, key=order)


def outside(spans: list[tuple[int, int]], base: list) -> list[tuple[int, int]]:
    """Spans that overlap no base span."""
    return [s for s in spans if not any(b[1] < s[1] and s[0] < b[2] for b in base)] if base else spans


def scan(text: str) -> tuple[list, list]:
    """(base spans, all spans) of a text by itself, each a list of (kind, start, end) by start and then kind as listed."""
    base, runs = base_spans(text), candidates(text)
    found = [s for s, yes in zip(runs, random_runs([text[a:b] for a, b in runs])) if yes] if runs else []
    return base, sorted(base + [("random", *s) for s in apart(outside(found, base))], key=order)


def step(p: float) -> int:
    """Bar of a histogram of p: GRADES for each halving, so that bars from one on hold what is at most its edge."""
    return math.floor(-math.log2(max(p, 1e-300)) * GRADES)


def measured(text: str, base: list) -> list[tuple[int, int, int, int]]:
    """(start, end, bar of the battery, bar of evenness) of a text's candidates outside base spans.

    The battery's p is three times the least of its tests'; that of evenness tells a run from ordinary text.
    """
    out = []
    for a, b in outside(candidates(text), base):
        run = text[a:b]
        if is_mixed(run) and (p := battery(run)):
            out.append((a, b, step(min(1.0, 3 * min(p[1:4]))), step(p[4])))
    return out


def first_bar(bars: list[tuple[int, int]], rate: float) -> int | None:
    """The bar from which on all runs are discoveries, by Benjamini and Hochberg over (bar, runs): the lowest one whose
    edge is at most the rate's share of the runs in it and beyond. None if there is none."""
    total, beyond, best = sum(n for _, n in bars), 0, None
    for bar, n in sorted(bars, reverse=True):
        beyond += n
        if 2 ** (-bar / GRADES) <= rate * beyond / total:
            best = bar
    return best


def scan_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rate: float = RATE) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_assign, n_access, n_hex, n_random, n_spans, base, spans.

    base and spans are kind:start:end, comma-joined, in code points with the end exclusive. The method adds runs that
    overlap no base span. False discoveries are controlled over the whole corpus, twice, by histograms of p: runs that the
    battery calls uneven by its own p are none, and of the others those are random that are too even for ordinary text of
    their length. So a run's verdict depends on how many others there are.

    Null and empty texts have none, an empty table gives no rows; ties, repeated rows and other columns don't matter.
    """

    def make():
        def one(text):
            base = base_spans(text)
            n = [sum(k == kind for k, _, _ in base) for kind in KINDS[:3]]
            runs = [dict(zip(("a", "b", "uneven", "even"), r)) for r in measured(text, base)]
            return (*n, joined_spans(base), runs)

        return one

    found = table(map_texts(texts(docs, id_col, text_col), make, "n_assign bigint, n_access bigint, n_hex bigint, base string, runs array<struct<a:int,b:int,uneven:int,even:int>>"), "secrets")
    bars = found.select(F.explode("runs").alias("r")).select(F.explode(F.array(*[F.struct(F.lit(k).alias("test"), F.col(f"r.{k}").alias("bar")) for k in ("uneven", "even")])).alias("x"))
    counts = bars.groupBy("x.test", "x.bar").agg(F.count(F.lit(1)).alias("n")).collect()  # bars are some 32,000 a test at most
    uneven, even = (first_bar([(c.bar, c.n) for c in counts if c.test == test], rate) for test in ("uneven", "even"))
    lone = F.filter("runs", lambda r: (r["even"] >= (NONE if even is None else even)) & (r["uneven"] < (NONE if uneven is None else uneven)))

    @F.pandas_udf("struct<spans:string,n_random:bigint>")
    def whole(base: pd.Series, runs: pd.Series) -> pd.DataFrame:
        rows = []
        for text, found in zip(base, runs):
            old = [(k, int(a), int(b)) for k, a, b in (x.split(":") for x in text.split(",") if x)]
            new = [("random", *x) for x in apart([(r["a"], r["b"]) for r in found])]
            rows.append((joined_spans(sorted(old + new, key=order)), len(new)))
        return pd.DataFrame(rows, columns=["spans", "n_random"])

    out = found.withColumn("w", whole(F.col("base"), lone))
    n = F.col("n_assign") + F.col("n_access") + F.col("n_hex") + F.col("w.n_random")
    return out.select("doc_id", "n_assign", "n_access", "n_hex", F.col("w.n_random").alias("n_random"), n.alias("n_spans"), "base", F.col("w.spans").alias("spans"))

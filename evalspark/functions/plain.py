"""Plain functions that the Arrow UDFs call; executors import this module alone."""

from __future__ import annotations

import ast
import math
import operator
import re
from collections import Counter
from functools import lru_cache


def lcs(a: list, b: list) -> int:
    """Length of the longest common subsequence: a row of the table is one long integer, a bit for each place of ``b``
    at which it grows by one, and each token of ``a`` changes it by an addition that carries."""
    places = {}
    for i, x in enumerate(b):
        places[x] = places.get(x, 0) | 1 << i
    full = (1 << len(b)) - 1
    row = full
    for x in a:
        if m := places.get(x):
            hit = row & m
            row = (row + hit | row - hit) & full
    return len(b) - row.bit_count()


def overlap(a, b) -> int:
    """Size of the intersection of two multisets."""
    return sum((Counter(a) & Counter(b)).values())


#: Rows whose values are Python objects at a time.
SLICE = 200


def in_slices(f, kind, *columns):
    """A function of rows over Arrow columns, few of whose rows are Python objects at a time: a batch has thousands, of which
    each token would be an object of its own."""
    import pyarrow as pa

    out = [pa.array([f(*row) for row in zip(*(c.slice(i, SLICE).to_pylist() for c in columns))], kind) for i in range(0, len(columns[0]), SLICE)]
    return pa.concat_arrays(out) if out else pa.array([], kind)


#: Bytes that may end a sentence: as numbers they are found in bytes ten times as fast as strings of one byte.
STOP, CALL, ASK = b".!?"
#: Distinct tokens and pairs that a task counts before it passes them on.
COUNTED = 1 << 18


def token_counts(texts, most: int = COUNTED):
    """Lists of (tokens, what follows, counts) of texts in UTF-8: each token by itself, followed by nothing, and each with a
    full stop beside the next. Bytes are split at the six ASCII white spaces alone."""
    alone, pairs = Counter(), Counter()
    for text in texts:
        words = (text or b"").split()
        alone.update(words)
        pairs.update((a, b) for a, b in zip(words, words[1:]) if STOP in a)
        if len(alone) + len(pairs) >= most:
            yield [*alone, *(a for a, _ in pairs)], [*[None] * len(alone), *(b for _, b in pairs)], [*alone.values(), *pairs.values()]
            alone, pairs = Counter(), Counter()
    if alone:
        yield [*alone, *(a for a, _ in pairs)], [*[None] * len(alone), *(b for _, b in pairs)], [*alone.values(), *pairs.values()]


def stops(text: bytes | None) -> dict | None:
    """A text's tokens with a mark that may end a sentence, each with the next, and whether it has any token."""
    if text is None:
        return None
    words = text.split()
    return {"some": bool(words), "near": [{"m": a, "next": b} for a, b in zip(words, words[1:]) if STOP in a or CALL in a or ASK in a]}


def grams(tokens: list, n: int) -> list:
    return list(zip(*(tokens[i:] for i in range(n))))


def nested_entities(text: str) -> list[tuple[str, str]]:
    """(tag, text) of nested <TAG>...</TAG> marks, by an explicit stack; marks without a partner are passed over."""
    marks = list(re.finditer(r"<(/?)([\w-]+)>", text))
    plain = "".join(re.split(r"</?[\w-]+>", text))
    out, stack, gone = [], [], 0
    for m in marks:
        at = m.start() - gone  # its place in the text without marks
        gone += len(m[0])
        if not m[1]:
            stack.append((m[2], at))
            continue
        for k in range(len(stack) - 1, -1, -1):
            if stack[k][0] == m[2]:
                out.append((m[2], plain[stack[k][1] : at]))
                del stack[k:]
                break
    return out


def boxed(text: str) -> str | None:
    """Content of the last \\boxed{...}, braces paired."""
    at = text.rfind("\\boxed{")
    if at < 0:
        return None
    depth, start = 0, at + 7
    for i in range(start - 1, len(text)):
        depth += (text[i] == "{") - (text[i] == "}")
        if not depth:
            return text[start:i]
    return None


#: Functions and constants that an answer may use.
NAMES = {"sqrt": math.sqrt, "pi": math.pi, "e": math.e, "ln": math.log, "log": math.log10, "sin": math.sin, "cos": math.cos, "tan": math.tan}


def argument(text: str, at: int) -> tuple[str, int]:
    """What stands in braces from a place, or the one character there, and where it ends."""
    if at < len(text) and text[at] == "{":
        depth = 0
        for i in range(at, len(text)):
            depth += (text[i] == "{") - (text[i] == "}")
            if not depth:
                return text[at + 1 : i], i + 1
    return text[at : at + 1], at + 1


def without_latex(text: str) -> str:
    """LaTeX fractions, roots, products and powers as plain arithmetic."""
    for name in ("\\dfrac", "\\tfrac", "\\frac"):
        while (at := text.find(name)) >= 0:
            top, i = argument(text, at + len(name))
            low, i = argument(text, i)
            text = f"{text[:at]}(({without_latex(top)})/({without_latex(low)})){text[i:]}"
    while (at := text.find("\\sqrt")) >= 0:
        i, degree = at + 5, "2"
        if text[i : i + 1] == "[":
            degree, i = text[i + 1 : text.index("]", i)] if "]" in text[i:] else "2", text.find("]", i) + 1 or i + 1
        body, i = argument(text, i)
        text = f"{text[:at]}(({without_latex(body)})**(1/({degree}))){text[i:]}"
    text = re.sub(r"\\(?:cdot|times)", "*", text).replace("^", "**").replace("{", "(").replace("}", ")").replace("\\", "")
    return re.sub(r"(\d|\))(?=\(|pi|sqrt)", r"\1*", text)


def arithmetic(text: str) -> float | None:
    """The value of an arithmetic expression, whose tree is walked; None if it is anything else, or over 200 characters:
    :func:`algebra.same_answer` compares those without a tree."""
    ops = {ast.Add: operator.add, ast.Sub: operator.sub, ast.Mult: operator.mul, ast.Div: operator.truediv}

    def value(n):
        if isinstance(n, ast.Constant) and isinstance(n.value, int | float):
            return float(n.value)
        if isinstance(n, ast.Name):
            return float(NAMES[n.id])
        if isinstance(n, ast.UnaryOp) and isinstance(n.op, ast.USub | ast.UAdd):
            return -value(n.operand) if isinstance(n.op, ast.USub) else value(n.operand)
        if isinstance(n, ast.BinOp) and isinstance(n.op, ast.Pow):
            base, power = value(n.left), value(n.right)
            if abs(power) > 64:
                raise ValueError
            return float(base**power)
        if isinstance(n, ast.BinOp):
            return ops[type(n.op)](value(n.left), value(n.right))
        if isinstance(n, ast.Call) and len(n.args) == 1 and not n.keywords and isinstance(n.func, ast.Name):
            return NAMES[n.func.id](value(n.args[0]))
        raise ValueError

    try:
        return value(ast.parse(text, mode="eval").body) if len(text) <= 200 else None
    except (SyntaxError, ValueError, KeyError, TypeError, ZeroDivisionError, OverflowError, RecursionError, MemoryError):
        return None


#: Numbers that need no tree: :func:`arithmetic` gives these the same value.
DECIMAL = re.compile(r"-?(?:0|[1-9][0-9]{0,17})(?:\.[0-9]{1,17})?")


@lru_cache(maxsize=20_000)
def math_value(text: str):
    """A number where the text is one or arithmetic that gives one, a tuple of such where it is a list, or else the text
    without spaces and size marks."""
    if DECIMAL.fullmatch(text):
        return round(float(text), 9)
    plain = re.sub(r"\\left|\\right|\\,|\\!|\\;|\s|\$", "", text).rstrip(".")
    plain = re.sub(r"\\(?:text|mathrm)\{[^{}]*\}|\\circ|\^\{\\circ\}|\\?%$", "", plain)
    if re.fullmatch(r"-?\d+,\d+", plain):
        plain = plain.replace(",", ".")
    found = arithmetic(without_latex(plain)) if plain else None
    if found is not None:
        return round(found, 9)
    parts = re.split(r"[;,]", plain.strip("()[]{}\\"))
    if len(parts) > 1:
        values = [arithmetic(without_latex(p)) for p in parts]
        if all(v is not None for v in values):
            return tuple(round(v, 9) for v in values)
    return plain


def suffix_match(a: str, b: str) -> tuple[int, int, int]:
    """The longest common string, as :func:`longest_match` has it, by a suffix automaton of ``b``: in linear time."""
    step, link, size, first, last = [{}], [-1], [0], [0], 0
    for j, c in enumerate(b):
        new = len(step)
        step.append({}), link.append(0), size.append(size[last] + 1), first.append(j + 1)
        p = last
        while p >= 0 and c not in step[p]:
            step[p][c] = new
            p = link[p]
        if p >= 0:
            q = step[p][c]
            if size[p] + 1 < size[q]:
                copy = len(step)
                step.append(dict(step[q])), link.append(link[q]), size.append(size[p] + 1), first.append(first[q])
                while p >= 0 and step[p].get(c) == q:
                    step[p][c] = copy
                    p = link[p]
                link[q] = copy
                q = copy
            link[new] = q
        last = new
    best, at, n = (0, 0, 0), 0, 0
    for i, c in enumerate(a):
        while at and c not in step[at]:
            at = link[at]
            n = size[at]
        if c in step[at]:
            at, n = step[at][c], n + 1
        if n > best[2]:
            best = (i + 1 - n, first[at] - n, n)
    return best


def longest_match(a: str, b: str, alo: int, ahi: int, blo: int, bhi: int) -> tuple[int, int, int]:
    """(place in a, place in b, length) of the longest common string; of several the first in a, and then in b.

    As ``difflib.SequenceMatcher(None, a, b, False).find_longest_match``.
    """
    if (ahi - alo) * (bhi - blo) > 10**8:
        i, j, n = suffix_match(a[alo:ahi], b[blo:bhi])
        return alo + i, blo + j, n
    best, i = (alo, blo, 0), alo
    while i + best[2] < ahi:
        n = best[2] + 1
        j = b.find(a[i : i + n], blo, bhi)
        if j < 0:
            i += 1
            continue
        while i + n < ahi and j + n < bhi and a[i + n] == b[j + n]:
            n += 1
        best = (i, j, n)
    return best


def blocks_cover(a: str, b: str, share: float) -> bool:
    """Whether the matching blocks of ``difflib`` (without junk) cover this share of ``a``.

    Exact: it stops early only where the characters that can't be matched any more already settle it.
    """
    if not a or a in b:
        return bool(a)

    def least(alo, ahi, blo, bhi):
        """Characters of a region that surely stay unmatched: those that the other side has too few of."""
        part = a[alo:ahi]
        return sum(max(0, part.count(c) - b.count(c, blo, bhi)) for c in set(part))

    todo = [(least(0, len(a), 0, len(b)), 0, len(a), 0, len(b))]
    lost = todo[0][0]
    while todo and (len(a) - lost) / len(a) >= share:
        known, alo, ahi, blo, bhi = todo.pop()
        i, j, n = longest_match(a, b, alo, ahi, blo, bhi)
        lost -= known
        if not n:
            lost += ahi - alo
            continue
        parts = [(least(*r), *r) for r in ((alo, i, blo, j), (i + n, ahi, j + n, bhi)) if r[0] < r[1]]
        lost += sum(p[0] for p in parts)
        # The smaller region first: it is settled soonest.
        todo += sorted(parts, key=lambda p: p[1] - p[2])
    return (len(a) - lost) / len(a) >= share


def rouge_words(text: str) -> list[str]:
    """Tokens as :func:`text.rouge_tokens` has them."""
    return re.sub(r"[!-/:-@\[-`{-~]", " ", text.lower()).split()


def tagged_entities(tokens: list[str], tags: list[str]) -> tuple[list[tuple[str, str]], list[str]]:
    """((tag, entity) of tokens with tags B-X, I-X and O; the tokens, those of an entity as one between its marks)."""
    found, out, last = [], [], None
    for token, tag in zip(tokens, tags):
        kind = tag[2:] if tag[1:2] == "-" else None
        if kind is None:
            out.append(token)
        elif tag[0] == "I" and last == kind:
            found[-1] = (kind, f"{found[-1][1]} {token}")
            out[-1] = f"<{kind}>{found[-1][1]}</{kind}>"
        else:
            found.append((kind, token))
            out.append(f"<{kind}>{token}</{kind}>")
        last = kind
    return found, out


def marked(text: str, spans: list[tuple[int, int, str]]) -> str:
    """A text with (begin, end, tag) marked; spans may lie in one another, the outer ones' marks outside."""
    opens, closes = {}, {}
    for begin, end, tag in sorted(spans, key=lambda s: (s[0], -s[1])):
        opens.setdefault(begin, []).append(f"<{tag}>")
        closes.setdefault(end, []).insert(0, f"</{tag}>")
    at = sorted({*opens, *closes, 0, len(text)})
    out = []
    for i, j in zip(at, [*at[1:], len(text)]):
        out += [*closes.get(i, ()), *opens.get(i, ()), text[i:j]]
    return "".join(out)


def tag_counts(gold: list[tuple[str, str]], found: list[tuple[str, str]], tags) -> list[tuple[str, int, int, int]]:
    """(tag, tp, fn, fp) of two lists of (tag, entity) as multisets, for the tags that occur."""
    g, p = Counter(gold), Counter(found)
    out = {}
    for tag, entity in g.keys() | p.keys():
        if tag in tags:
            a, b = g[tag, entity], p[tag, entity]
            old = out.get(tag, (0, 0, 0))
            out[tag] = old[0] + min(a, b), old[1] + max(a - b, 0), old[2] + max(b - a, 0)
    return [(t, *n) for t, n in sorted(out.items())]

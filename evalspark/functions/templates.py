"""Chat templates as columns: the loops, conditions and outputs that templates of conversations use."""

from __future__ import annotations

import ast
import re

from pyspark.sql import Column
from pyspark.sql import functions as F

MARK = re.compile(r"({%-?.*?-?%}|{{-?.*?-?}}|{#.*?#})", re.S)


class Unknown(ValueError):
    """A part of a template that isn't one of those in use."""


def pieces(template: str) -> list[tuple[str, str]]:
    """(kind, body) of a template: text, out, tag. A line feed after a tag goes, as does white space before a tag that
    begins a line, and white space beside a mark with a minus."""
    out = []
    parts = MARK.split(template)
    for i, part in enumerate(parts):
        if i % 2 == 0:
            before, after = parts[i - 1] if i else "", parts[i + 1] if i + 1 < len(parts) else ""
            if before.startswith(("{%", "{#")) and part.startswith("\n"):
                part = part[1:]
            if before.endswith(("-%}", "-}}")):
                part = part.lstrip()
            if after.startswith(("{%-", "{{-")):
                part = part.rstrip()
            elif after.startswith(("{%", "{#")):
                line = part.rstrip(" \t")
                if line.endswith("\n") or (not line and (i == 0 or before.startswith("{%"))):
                    part = line
            if part:
                out.append(("text", part))
        elif not part.startswith("{#"):
            out.append(("tag" if part.startswith("{%") else "out", part[2:-2].strip("-").strip()))
    return out


def tree(template: str) -> list:
    """Nested nodes: (text, s), (out, s), (for, name, list, nodes), (if, [(condition, nodes), ...])."""
    root: list = []
    stack = [("root", root)]
    for kind, body in pieces(template):
        here = stack[-1][1]
        if kind != "tag":
            here.append((kind, body))
        elif m := re.fullmatch(r"for\s+(\w+)\s+in\s+(\w+)", body):
            node = ("for", m[1], m[2], [])
            here.append(node)
            stack.append(("for", node[3]))
        elif body.startswith("if "):
            node = ("if", [(body[3:], [])])
            here.append(node)
            stack.append(("if", node[1][0][1], node))
        elif (body.startswith("elif ") or body == "else") and stack[-1][0] == "if":
            node = stack.pop()[2]
            node[1].append((body[5:] or "true", []))
            stack.append(("if", node[1][-1][1], node))
        elif body in ("endif", "endfor") and stack[-1][0] == body[3:]:
            stack.pop()
        else:
            raise Unknown(body)
    if len(stack) > 1:
        raise Unknown(f"{stack[-1][0]} without an end")
    return root


def value(text: str, names: dict) -> Column:
    """An expression over names: fields, comparisons, and, or, not, in, +, strings and numbers, ``| trim``."""
    body, *filters = re.split(r"\s*\|\s*(?=\w+(?:\s*\||$))", text)
    words = {"true": True, "false": False, "none": None}

    def of(n):
        if isinstance(n, ast.Constant):
            return F.lit(n.value)
        if isinstance(n, ast.Name) and n.id in words:
            return F.lit(words[n.id])
        if isinstance(n, ast.Name) and n.id in names:
            return names[n.id]
        if isinstance(n, ast.Subscript) and isinstance(n.slice, ast.Constant) and isinstance(n.slice.value, int):
            return F.get(of(n.value), F.lit(n.slice.value)) if n.slice.value >= 0 else F.try_element_at(of(n.value), F.lit(n.slice.value))
        if isinstance(n, ast.Subscript) and isinstance(n.slice, ast.Constant):
            return field(of(n.value), n.slice.value)
        if isinstance(n, ast.Attribute):
            return field(of(n.value), n.attr)
        if isinstance(n, ast.Call) and isinstance(n.func, ast.Attribute) and n.func.attr in ("strip", "trim") and not n.args:
            return F.regexp_replace(of(n.func.value), r"^\s+|\s+$", "")
        if isinstance(n, ast.UnaryOp) and isinstance(n.op, ast.Not):
            return ~of(n.operand)
        if isinstance(n, ast.BoolOp):
            out, *rest = map(of, n.values)
            for x in rest:
                out = out & x if isinstance(n.op, ast.And) else out | x
            return out
        if isinstance(n, ast.BinOp) and isinstance(n.op, ast.Add):
            return F.concat(of(n.left), of(n.right))
        if isinstance(n, ast.BinOp) and isinstance(n.op, ast.Mod):
            return of(n.left) % of(n.right)
        if isinstance(n, ast.Compare) and len(n.ops) == 1:
            a, op = of(n.left), n.ops[0]
            if isinstance(op, ast.In | ast.NotIn):
                yes = a.isin(*[x.value for x in n.comparators[0].elts])
                return yes if isinstance(op, ast.In) else ~yes
            b = of(n.comparators[0])
            return {ast.Eq: lambda: a == b, ast.NotEq: lambda: a != b, ast.Lt: lambda: a < b, ast.Gt: lambda: a > b, ast.LtE: lambda: a <= b, ast.GtE: lambda: a >= b}[type(op)]()
        raise Unknown(text)

    def field(x, name):
        return x[name] if isinstance(x, dict) else x.getField(name)

    try:
        out = of(ast.parse(body.strip(), mode="eval").body)
    except (SyntaxError, KeyError, AttributeError) as e:
        raise Unknown(text) from e
    for f in filters:
        if f.strip() != "trim":
            raise Unknown(text)
        out = F.regexp_replace(out, r"^\s+|\s+$", "")
    return out


def compiled(nodes: list, names: dict) -> Column:
    """The text of nodes as a column; an absent value is an empty text, an absent condition is false."""

    def one(node):
        if node[0] == "text":
            return F.lit(node[1])
        if node[0] == "out":
            return F.coalesce(value(node[1], names).cast("string"), F.lit(""))
        if node[0] == "if":
            out = None
            for condition, body in node[1]:
                yes = F.coalesce(value(condition, names).cast("boolean"), F.lit(False))
                out = F.when(yes, compiled(body, names)) if out is None else out.when(yes, compiled(body, names))
            return out.otherwise("")
        _, name, of, body = node
        items = names[of]

        def turn(x, i):
            loop = {"first": i == 0, "last": i == F.size(items) - 1, "index0": i, "index": i + 1}
            return compiled(body, names | {name: x, "loop": loop})

        return F.array_join(F.transform(items, turn), "")

    return F.concat(*map(one, nodes)) if nodes else F.lit("")


def chat(messages: Column, template: str, generate: bool | Column = True, **names) -> Column:
    """A conversation, an array of (role, content), as a template has it: {{ }} of expressions, {% for %} over messages,
    {% if %}, elif and else, and ``add_generation_prompt``. Other names are given as columns or values; anything else in
    a template is an error when it is read, not on some row."""
    known = {k: v if isinstance(v, Column) else F.lit(v) for k, v in names.items()}
    start = generate if isinstance(generate, Column) else F.lit(generate)
    return compiled(tree(template), {"bos_token": F.lit(""), "eos_token": F.lit("")} | known | {"messages": messages, "add_generation_prompt": start})

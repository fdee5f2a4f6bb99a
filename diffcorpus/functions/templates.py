"""Q1: a model's own chat template, compiled to one Column expression.

The templates that come with tokenizers are small text programs: a loop over
the messages, conditions on roles and places, string joins.  Each part of one
has a Spark expression (loop: ``transform``, condition: ``when``), so a
template is translated once, on the driver, and runs in the JVM.
"""

from __future__ import annotations

import ast
import re
from dataclasses import dataclass, field
from functools import reduce
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import _c, py_strip

_TAGS = re.compile(r"(\{%.*?%\}|\{\{.*?\}\}|\{#.*?#\})", re.S)
_QUOTED = re.compile(r"""('(?:\\.|[^'\\])*'|"(?:\\.|[^"\\])*")""", re.S)

# Layouts in public use, by what surrounds a turn.
#: Turns between start and end marks, with a system text of its own where the record has none.
CHATML_WITH_DEFAULT = """\
{%- if messages[0]['role'] == 'system' %}
    {{- '<|im_start|>system\\n' + messages[0]['content'] + '<|im_end|>\\n' }}
{%- else %}
    {{- '<|im_start|>system\\n' + default_system + '<|im_end|>\\n' }}
{%- endif %}
{%- for message in messages %}
    {%- if message.role == 'user' or (message.role == 'system' and not loop.first) or (message.role == 'assistant' and not message.tool_calls) %}
        {{- '<|im_start|>' + message.role + '\\n' + message.content + '<|im_end|>' + '\\n' }}
    {%- endif %}
{%- endfor %}
{%- if add_generation_prompt %}
    {{- '<|im_start|>assistant\\n' }}
{%- endif %}
"""
#: Instructions in brackets; the system text goes into the first one, and roles have to alternate.
INST = """\
{% if messages[0]['role'] == 'system' %}{% set turns = messages[1:] %}{% set system = messages[0]['content'] %}
{% else %}{% set turns = messages %}{% set system = false %}{% endif %}
{% for message in turns %}
{% if (message['role'] == 'user') != (loop.index0 % 2 == 0) %}{{ raise_exception('roles must alternate') }}{% endif %}
{% if loop.first and system != false %}{% set content = '<<SYS>>\\n' ~ system ~ '\\n<</SYS>>\\n\\n' ~ message['content'] %}
{% else %}{% set content = message['content'] %}{% endif %}
{% if message['role'] == 'user' %}{{ bos_token + '[INST] ' + content | trim + ' [/INST]' }}
{%- else %}{{ ' ' + content | trim + ' ' + eos_token }}{% endif %}
{% endfor %}"""


@dataclass
class _Val:
    """A translated value; ``kind`` is text, bool, int, message or messages."""

    kind: str
    col: Column


_NOTHING = (None, False)  # undefined, none and false


def _lift(v: Any) -> _Val:
    if isinstance(v, _Val):
        return v
    if isinstance(v, bool):
        return _Val("bool", F.lit(v))
    if isinstance(v, int):
        return _Val("int", F.lit(v))
    return _Val("text", F.lit(v).cast("string"))


def _true(v: Any) -> Any:
    """A condition as a bool that is known now, or as a Column."""
    if not isinstance(v, _Val):
        return bool(v)
    if v.kind == "text":
        return F.coalesce(v.col != "", F.lit(False))
    if v.kind == "int":
        return v.col != 0
    if v.kind == "messages":
        return F.size(v.col) > 0
    return F.coalesce(v.col, F.lit(False)) if v.kind == "bool" else v.col.isNotNull()


def _printed(v: Any) -> Column:
    if v is None:
        return F.lit("")
    if isinstance(v, _Val) and v.kind not in ("text", "int"):
        raise ValueError(f"template: a {v.kind} is printed")
    return F.coalesce(_lift(v).col.cast("string"), F.lit(""))


def _either(cond: Any, a: Any, b: Any) -> Any:
    """The value that a name has after a condition whose branches set it."""
    if isinstance(cond, bool):
        return a if cond else b
    kind = next((_lift(x).kind for x in (a, b) if not any(x is n for n in _NOTHING)), "text")
    a, b = (F.lit(None) if any(x is n for n in _NOTHING) and kind != "bool" else _lift(x).col for x in (a, b))
    return _Val(kind, F.when(cond, a).otherwise(b))


def _operators(text: str) -> str:
    """Filters and joins spelt as operators of the same rank that Python knows; quoted text stays."""
    parts = _QUOTED.split(text)
    parts[::2] = [p.replace("|", "@").replace("~", "+") for p in parts[::2]]
    return "".join(parts).strip()


class _Expression:
    def __init__(self, names: dict[str, Any]):
        self.names = names

    def value(self, text: str) -> Any:
        try:
            return self.walk(ast.parse(_operators(text), mode="eval").body)
        except SyntaxError as e:
            raise ValueError(f"template: cannot read {text!r}") from e

    def walk(self, node: ast.expr) -> Any:
        step = getattr(self, f"_{type(node).__name__.lower()}", None)
        if step is None:
            raise ValueError(f"template: {ast.unparse(node)!r} is not supported")
        return step(node)

    def _constant(self, node: ast.Constant) -> Any:
        return node.value

    def _name(self, node: ast.Name) -> Any:
        fixed = {"true": True, "false": False, "none": None}
        return fixed[node.id.lower()] if node.id.lower() in fixed else self.names.get(node.id)

    def _attribute(self, node: ast.Attribute) -> Any:
        return self.part(self.walk(node.value), node.attr)

    def _subscript(self, node: ast.Subscript) -> Any:
        held = self.walk(node.value)
        if isinstance(node.slice, ast.Slice):
            at = self.walk(node.slice.lower) if node.slice.lower else 0
            if getattr(held, "kind", None) != "messages" or node.slice.upper or node.slice.step or not isinstance(at, int) or at < 0:
                raise ValueError(f"template: {ast.unparse(node)!r} is not supported")
            return _Val("messages", F.slice(held.col, at + 1, F.size(held.col)))
        return self.part(held, self.walk(node.slice))

    @staticmethod
    def part(held: Any, key: Any) -> Any:
        if isinstance(held, dict):  # loop
            return held.get(key)
        kind = getattr(held, "kind", None)
        if kind == "message":
            return _Val("text", held.col[key]) if key in ("role", "content") else None
        if kind == "messages" and isinstance(key, int):
            return _Val("message", F.try_element_at(held.col, F.lit(key + 1 if key >= 0 else key)))
        if held is None:
            return None
        raise ValueError(f"template: no {key!r} in a {kind or type(held).__name__}")

    def _unaryop(self, node: ast.UnaryOp) -> Any:
        v = self.walk(node.operand)
        if isinstance(node.op, ast.Not):
            v = _true(v)
            return not v if isinstance(v, bool) else _Val("bool", ~v)
        if isinstance(node.op, ast.USub) and isinstance(v, int):
            return -v
        raise ValueError(f"template: {ast.unparse(node)!r} is not supported")

    def _boolop(self, node: ast.BoolOp) -> Any:
        both = isinstance(node.op, ast.And)
        open_ones = []
        for part in node.values:
            v = _true(self.walk(part))
            if not isinstance(v, bool):
                open_ones.append(v)
            elif v != both:  # settles the whole
                return v
        if not open_ones:
            return both
        return _Val("bool", reduce(lambda a, b: a & b if both else a | b, open_ones))

    def _ifexp(self, node: ast.IfExp) -> Any:
        return _either(_true(self.walk(node.test)), self.walk(node.body), self.walk(node.orelse))

    def _compare(self, node: ast.Compare) -> Any:
        if len(node.ops) > 1:
            raise ValueError(f"template: {ast.unparse(node)!r} is not supported")
        a, op, right = self.walk(node.left), node.ops[0], node.comparators[0]
        if isinstance(op, (ast.Is, ast.IsNot)):
            tests = {"defined": a is not None, "undefined": a is None}
            word = ast.unparse(right)
            if word in ("none", "None"):
                return _either(a.col.isNull(), True, False) if isinstance(a, _Val) else a is None
            if word not in tests:
                raise ValueError(f"template: test {word!r} is not supported")
            return tests[word] == isinstance(op, ast.Is)
        b = self.walk(right)
        if not isinstance(a, _Val) and not isinstance(b, _Val):
            return {ast.Eq: lambda: a == b, ast.NotEq: lambda: a != b, ast.Gt: lambda: a > b, ast.Lt: lambda: a < b, ast.In: lambda: a in b}[type(op)]()
        if isinstance(op, ast.In):
            if isinstance(b, tuple | list):
                return _Val("bool", _lift(a).col.isin(list(b)))
            return _Val("bool", F.contains(_lift(b).col, _lift(a).col))
        for x, y in ((a, b), (b, a)):  # a text that a branch left unset
            if any(y is n for n in _NOTHING) and x.kind != "bool":
                same = x.col.isNull()
                break
        else:
            x, y = _lift(a), _lift(b)
            if isinstance(op, (ast.Gt, ast.Lt)):
                return _Val("bool", x.col > y.col if isinstance(op, ast.Gt) else x.col < y.col)
            same = x.col.eqNullSafe(y.col)
        return _Val("bool", same if isinstance(op, ast.Eq) else ~same)

    def _list(self, node: ast.List) -> Any:
        return [self.walk(x) for x in node.elts]

    _tuple = _list

    def _binop(self, node: ast.BinOp) -> Any:
        a = self.walk(node.left)
        if isinstance(node.op, ast.MatMult):
            return self.filtered(a, ast.unparse(node.right))
        b = self.walk(node.right)
        if isinstance(node.op, ast.Mod):
            return a % b if not isinstance(a, _Val) else _Val("int", a.col % _lift(b).col)
        if not isinstance(node.op, ast.Add):
            raise ValueError(f"template: {ast.unparse(node)!r} is not supported")
        if all(_lift(v).kind == "int" for v in (a, b)):
            return a + b if not isinstance(a, _Val) and not isinstance(b, _Val) else _Val("int", _lift(a).col + _lift(b).col)
        return _Val("text", F.concat(_printed(a), _printed(b)))

    @staticmethod
    def filtered(v: Any, name: str) -> Any:
        if name == "trim":
            return _Val("text", py_strip(_printed(v)))
        if name in ("length", "count"):
            held = _lift(v)
            return _Val("int", F.size(held.col) if held.kind == "messages" else F.length(held.col))
        raise ValueError(f"template: filter {name!r} is not supported")

    def _call(self, node: ast.Call) -> Any:
        if isinstance(node.func, ast.Name) and node.func.id == "raise_exception":
            return _Val("text", F.raise_error(_printed(self.walk(node.args[0]))).cast("string"))
        if isinstance(node.func, ast.Attribute) and node.func.attr == "strip" and not node.args:
            return self.filtered(self.walk(node.func.value), "trim")
        raise ValueError(f"template: {ast.unparse(node)!r} is not supported")


def _pieces(source: str) -> list[tuple[str, str]]:
    """(text, statement or print, body) parts; white space around tags goes as tokenizers have it.

    A minus sign in a tag takes all white space on its side; a statement takes
    the blanks before it on its line and one line end after it.
    """
    parts = _TAGS.split(source.removesuffix("\n"))
    out: list[tuple[str, str]] = []
    for k in range(0, len(parts), 2):
        text = parts[k]
        before, after = parts[k - 1] if k else "", parts[k + 1] if k + 1 < len(parts) else ""
        if before.endswith(("-%}", "-}}", "-#}")):
            text = text.lstrip()
        elif before.endswith(("%}", "#}")):
            text = text.removeprefix("\n")
        if after.startswith(("{%-", "{{-", "{#-")):
            text = text.rstrip()
        elif after.startswith(("{%", "{#")):
            line = text.rstrip(" \t")
            if line.endswith("\n") or not line and (not k or parts[k].startswith("\n")):
                text = line
        if text:
            out.append(("text", text))
        if after and not after.startswith("{#"):
            out.append(("do" if after.startswith("{%") else "print", after[2:-2].removeprefix("-").removesuffix("-").strip()))
    return out


class _Compiler:
    def __init__(self, source: str):
        self.pieces, self.at = _pieces(source), 0

    def block(self, names: dict[str, Any], run: bool = True) -> list[Column]:
        """Columns of the parts up to the tag that ends the block; ``run`` is off in branches known not to be taken."""
        out: list[Column] = []
        while self.at < len(self.pieces):
            what, body = self.pieces[self.at]
            word, _, rest = body.partition(" ") if what == "do" else ("", "", "")
            if word in ("else", "elif", "endif", "endfor"):
                return out
            self.at += 1
            if what == "text":
                out.append(F.lit(body))
            elif what == "print":
                if run:
                    out.append(_printed(_Expression(names).value(body)))
            elif word == "set":
                name, eq, said = rest.partition("=")
                if not eq or not name.strip().isidentifier():
                    raise ValueError(f"template: {body!r} is not supported")
                names[name.strip()] = _Expression(names).value(said) if run else None
            elif word == "if":
                self.branches(names, rest, run, out)
            elif word == "for":
                out += self.loop(names, rest, run)
            else:
                raise ValueError(f"template: {body!r} is not supported")
        return out

    def expect(self, *words: str) -> tuple[str, str]:
        if self.at >= len(self.pieces) or self.pieces[self.at][1].partition(" ")[0] not in words:
            raise ValueError(f"template: one of {', '.join(words)} is missing")
        self.at += 1
        word, _, rest = self.pieces[self.at - 1][1].partition(" ")
        return word, rest

    def branches(self, names: dict[str, Any], test: str, run: bool, out: list[Column]) -> None:
        cond = _true(_Expression(names).value(test)) if run else False
        mine, other = dict(names), dict(names)
        took = _joined(self.block(mine, run and cond is not False))
        word, rest = self.expect("elif", "else", "endif")
        open_still = run and cond is not True
        rests: list[Column] = []
        if word == "elif":
            self.branches(other, rest, open_still, rests)
        elif word == "else":
            rests = self.block(other, open_still)
            self.expect("endif")
        if not run:
            return
        if isinstance(cond, bool):
            out.append(took if cond else _joined(rests))
        else:
            out.append(F.when(cond, took).otherwise(_joined(rests)))
        for name in mine.keys() | other.keys():
            a, b = mine.get(name), other.get(name)
            names[name] = a if a is b else _either(cond, a, b)

    def loop(self, names: dict[str, Any], head: str, run: bool) -> list[Column]:
        name, _, over = head.partition(" in ")
        rows = _Expression(names).value(over) if run else None
        if run and getattr(rows, "kind", None) != "messages":
            raise ValueError(f"template: a loop over {over!r} is not supported")
        start = self.at
        if not run:
            self.block(dict(names), False)
            self.expect("endfor")
            return []

        def body(m: Column, i: Column) -> Column:
            self.at = start
            turn = {"index0": _Val("int", i), "index": _Val("int", i + 1), "first": _Val("bool", i == 0), "last": _Val("bool", i + 1 == F.size(rows.col))}
            return _joined(self.block(names | {name.strip(): _Val("message", m), "loop": turn}))

        said = F.array_join(F.transform(rows.col, body), "")
        self.expect("endfor")
        return [said]


def _joined(parts: list[Column]) -> Column:
    return F.concat(*parts) if parts else F.lit("")


@dataclass(frozen=True)
class ModelTemplate:
    """A template as tokenizers carry it, with the values of its names (``bos_token`` and the like).

    It may hold ``for`` over messages, ``if`` / ``elif`` / ``else``, ``set``,
    ``loop``, ``trim``, ``length``, ``strip()``, ``raise_exception`` and
    comparisons; anything else is refused when it is compiled.  Names without
    a value count as undefined, so branches for tools fall away.  Null
    content, and a null role, print as empty text.
    """

    source: str
    names: dict[str, Any] = field(default_factory=dict)

    def render(self, messages: Column | str, add_generation_prompt: bool = False) -> Column:
        compiler = _Compiler(self.source)
        given = {**self.names, "messages": _Val("messages", _c(messages)), "add_generation_prompt": add_generation_prompt}
        text = _joined(compiler.block(given))
        if compiler.at < len(compiler.pieces):
            raise ValueError(f"template: {compiler.pieces[compiler.at][1]!r} has no beginning")
        return F.when(_c(messages).isNotNull(), text)

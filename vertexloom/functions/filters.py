"""Predicates as s-expressions, compiled once to a Spark column.

``(and (> vertex.age 30) (= (get edge "role") "Lucius Fox"))``

Forms: ``= != < <= > >= and or not + - * / if nil? in get``, ``vertex.f``, ``edge.f``, numbers,
strings, ``true``, ``false``, ``nil``. Only a boolean TRUE passes: a comparison with nil is nil. This subset is the engine's
own. Undeclared fields take the type of what they are compared with.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..plans.types import EXTRA, FilterError

_TOKEN = re.compile(r'\s*(?:;[^\n]*|(\()|(\))|"((?:[^"\\]|\\.)*)"|([^\s()";]+))')


@dataclass(frozen=True)
class Symbol:
    name: str


def parse(text: str) -> list:
    """All forms of a text: lists, Symbols, str, int, float, bool and None."""
    stack, at, text = [[]], 0, text.strip()
    while at < len(text):
        m = _TOKEN.match(text, at)
        if not m:
            raise FilterError(f"cannot read: {text[at:at + 40]}")
        at = m.end()
        if m[1]:
            stack.append([])
        elif m[2]:
            if len(stack) == 1:
                raise FilterError("a ) without its (")
            done = stack.pop()
            stack[-1].append(done)
        elif m[3] is not None:
            stack[-1].append(re.sub(r"\\(.)", r"\1", m[3]))
        elif m[4]:
            stack[-1].append(_atom(m[4]))
    if len(stack) > 1:
        raise FilterError("a ( is not closed")
    return stack[0]


def _atom(word: str):
    if word in ("true", "false"):
        return word == "true"
    if word in ("nil", "null"):
        return None
    for kind in (int, float):
        try:
            return kind(word.rstrip("ui") if kind is int and word[:1].isdigit() else word)
        except ValueError:
            pass
    return Symbol(word)


@dataclass(frozen=True)
class Undeclared:
    """A field of the JSON column, typed by what it meets."""

    json: Column
    name: str

    def typed(self, like) -> Column:
        kind = "boolean" if isinstance(like, bool) else "bigint" if isinstance(like, int) else "double" if isinstance(like, float) else "string"
        return F.try_variant_get(F.parse_json(self.json), "$." + self.name, kind)


class Cell:
    """What a symbol is bound to: a struct column and the names of its fields, or nothing."""

    def __init__(self, struct: Column | None, fields: list[str]):
        self.struct, self.fields = struct, fields

    def get(self, name: str):
        if self.struct is None:
            return F.lit(None)
        if name in self.fields:
            return self.struct[name]
        if EXTRA in self.fields:
            return Undeclared(self.struct[EXTRA], name)
        raise FilterError(f"no field {name}")


_COMPARE: dict[str, Callable] = {
    "=": lambda a, b: a == b, "!=": lambda a, b: a != b, "<": lambda a, b: a < b, "<=": lambda a, b: a <= b, ">": lambda a, b: a > b, ">=": lambda a, b: a >= b,
}
_ARITHMETIC: dict[str, Callable] = {"+": lambda a, b: a + b, "-": lambda a, b: a - b, "*": lambda a, b: a * b, "/": lambda a, b: a / b}


def compile_filter(expr, bound: dict[str, Cell]) -> Column:
    """A filter as a column that is true for the rows to keep. None keeps all; a Column is kept as it is."""
    if expr is None:
        return F.lit(True)
    if isinstance(expr, Column):
        return expr
    forms = parse(expr) if isinstance(expr, str) else expr
    if isinstance(expr, str) and len(forms) != 1:
        raise FilterError("a filter is one expression")
    form = forms[0] if isinstance(expr, str) else forms
    return _column(_compile(form, bound))


def _column(value, like=None) -> Column:
    if isinstance(value, Undeclared):
        return value.typed(like)
    return value if isinstance(value, Column) else F.lit(value)


def _pair(a, b) -> tuple[Column, Column]:
    plain = lambda v: None if isinstance(v, (Column, Undeclared)) else v
    return _column(a, plain(b)), _column(b, plain(a))


def _compile(form, bound: dict[str, Cell]):
    if isinstance(form, Symbol):
        name, dot, rest = form.name.partition(".")
        if name not in bound:
            raise FilterError(f"{name} is not bound here")
        if not dot:
            raise FilterError(f"{name} is a cell, not a value")
        return bound[name].get(rest)
    if not isinstance(form, list):
        return form
    if not form or not isinstance(form[0], Symbol):
        raise FilterError(f"not a form: {form}")
    op, rest = form[0].name, form[1:]
    if op == "get":
        if len(rest) != 2 or not isinstance(rest[0], Symbol) or not isinstance(rest[1], (str, Symbol)):
            raise FilterError("(get cell field)")
        if rest[0].name not in bound:
            raise FilterError(f"{rest[0].name} is not bound here")
        return bound[rest[0].name].get(rest[1] if isinstance(rest[1], str) else rest[1].name)
    args = [_compile(a, bound) for a in rest]
    need = {"not": 1, "nil?": 1, "if": 3}.get(op)
    if need and len(args) != need or not args:
        raise FilterError(f"{op} takes {need or 'more'} arguments")
    if op in _COMPARE:
        if len(args) < 2:
            raise FilterError(f"{op} takes two arguments or more")
        return reduce(lambda x, y: x & y, [_COMPARE[op](*_pair(a, b)) for a, b in zip(args, args[1:], strict=False)])
    if op in _ARITHMETIC:
        cols = [_column(a, next((x for x in args if isinstance(x, (int, float))), 0.0)) for a in args]
        return -cols[0] if op == "-" and len(cols) == 1 else reduce(_ARITHMETIC[op], cols)
    if op in ("and", "or"):
        return reduce((lambda x, y: x & y) if op == "and" else (lambda x, y: x | y), [_column(a, True) for a in args])
    if op == "not":
        return ~_column(args[0], True)
    if op == "nil?":
        return _column(args[0]).isNull()
    if op == "in":
        return reduce(lambda x, y: x | y, [_COMPARE["="](*_pair(args[0], a)) for a in args[1:]])
    if op == "if":
        return F.when(_column(args[0], True), _column(args[1])).otherwise(_column(args[2]))
    raise FilterError(f"no function {op}")

"""The attribute filter language, parsed into a column.

    price = 3 AND (tag IN [1, 2] OR city != "Rome")      AND and OR bind alike and group from the left
    multi_in(tag, "1|2|3", "|")    NOT_IN, MULTI_NOTIN    !(...)    price + 1 >= 4    # comment

Fields hold one value or an array of values. `=` and IN are true if any value fits, `!=` and NOT_IN if none does,
which a row without values passes. Comparisons, arithmetic and ! are an extension; a comparison is true if any value
fits. Unknown fields raise.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from nearfield.errors import InvalidArgument, UnknownField

_TOKEN = re.compile(
    r"""\s+|\#[^\n]*
    |(?P<number>-?(?:(?:0|[1-9][0-9]*)(?:\.[0-9]*)?|\.[0-9]+)(?:[eE][+-]?[0-9]+)?(?![0-9A-Za-z_.]))
    |(?P<string>"(?:[^"\\]|\\.)*"|'(?:[^'\\]|\\.)*')
    |(?P<op>&&|\|\||!=|>=|<=|==|[=<>!()\[\],+\-*/])
    |(?P<name>[A-Za-z_][A-Za-z0-9_]*(?:\.[A-Za-z_][A-Za-z0-9_]*)*)""",
    re.X,
)
_IN = {"in", "multi_in"}
_NOT_IN = {"not_in", "notin", "multi_notin", "multi_not_in"}
_AND, _OR = {"and", "&&"}, {"or", "||"}


@dataclass
class _Field:
    values: Column  # an array
    kind: T.DataType


class _Parser:
    def __init__(self, text: str, schema: T.StructType) -> None:
        self.schema, self.tokens, at = schema, [], 0
        while at < len(text):
            m = _TOKEN.match(text, at)
            if not m:
                raise InvalidArgument(f"unexpected {text[at:at + 10]!r} at {at}")
            if m.lastgroup:
                if m.lastgroup == "number" and self.tokens[-1:] == [("op", "+")] and (len(self.tokens) == 1 or self.tokens[-2][0] == "op" and self.tokens[-2][1] not in (")", "]")):
                    self.tokens.pop()  # a sign, as no operand stands before it
                self.tokens.append((m.lastgroup, m[0]))
            at = m.end()
        self.tokens.append(("end", ""))
        self.at = 0

    def peek(self) -> str:
        return self.tokens[self.at][1].lower() if self.tokens[self.at][0] != "string" else self.tokens[self.at][1]

    def next(self) -> tuple[str, str]:
        self.at += 1
        return self.tokens[self.at - 1]

    def want(self, text: str) -> None:
        got = self.next()
        if got[1] != text:
            raise InvalidArgument(f"expected {text!r}, found {got[1]!r}")

    def expression(self) -> Column:
        left = self.term()
        while self.tokens[self.at][0] in ("op", "name") and self.peek() in _AND | _OR:
            op = self.next()[1].lower()
            right = self.term()
            left = (left & right) if op in _AND else (left | right)
        return left

    def term(self) -> Column:
        if self.peek() == "!":
            self.next()
            self.want("(")
            inner = self.expression()
            self.want(")")
            return ~inner
        if self.peek() == "(":
            mark = self.at
            try:
                self.next()
                inner = self.expression()
                self.want(")")
                if self.peek() not in ("=", "==", "!=", "<", ">", "<=", ">=", "+", "-", "*", "/"):
                    return inner
            except InvalidArgument:
                pass
            self.at = mark
        return self.predicate()

    def field(self, name: str) -> _Field:
        found = next((f for f in self.schema.fields if f.name == name), None)
        if found is None:
            raise UnknownField(f"no field {name!r}")
        if isinstance(found.dataType, T.ArrayType):
            return _Field(F.coalesce(F.col(f"`{name}`"), F.array().cast(found.dataType)), found.dataType.elementType)
        return _Field(F.when(F.col(f"`{name}`").isNull(), F.array().cast(T.ArrayType(found.dataType))).otherwise(F.array(f"`{name}`")), found.dataType)

    def operand(self) -> _Field:
        """A field, or a field with numbers added and so on, left to right by precedence."""
        left = self.product()
        while self.peek() in ("+", "-") or (self.tokens[self.at][0] == "number" and self.peek()[0] == "-"):
            op = self.next()[1] if self.peek() in ("+", "-") else "+"
            left = self.combine(left, self.product(), op)
        return left

    def product(self):
        left = self.atom()
        while self.peek() in ("*", "/"):
            op = self.next()[1]
            left = self.combine(left, self.atom(), op)
        return left

    def atom(self):
        kind, text = self.next()
        if text == "(":
            inner = self.operand()
            self.want(")")
            return inner
        if kind == "name":
            return self.field(text)
        if kind == "number":
            return _number(text)
        raise InvalidArgument(f"unexpected {text!r}")

    @staticmethod
    def combine(a, b, op: str):
        do = {"+": lambda x, y: x + y, "-": lambda x, y: x - y, "*": lambda x, y: x * y, "/": lambda x, y: F.try_divide(x, y)}[op]
        if isinstance(a, _Field) and isinstance(b, _Field):
            raise InvalidArgument("arithmetic takes one field")
        if isinstance(a, _Field):
            return _Field(F.transform(a.values, lambda x: do(x, F.lit(b))), T.DoubleType())
        if isinstance(b, _Field):
            return _Field(F.transform(b.values, lambda x: do(F.lit(a), x)), T.DoubleType())
        return a / b if op == "/" else do(a, b)

    def literal(self, f: _Field) -> Column:
        kind, text = self.next()
        if kind == "string":
            return self.coerced(f, re.sub(r"\\(.)", r"\1", text[1:-1]), True)
        if kind == "number":
            return self.coerced(f, text, False)
        raise InvalidArgument(f"expected a value, found {text!r}")

    @staticmethod
    def coerced(f: _Field, text: str, quoted: bool) -> Column:
        if isinstance(f.kind, T.StringType):
            return F.lit(text)
        if quoted and not re.fullmatch(r"[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?", text):
            raise InvalidArgument(f"{text!r} is no number")
        return F.lit(_number(text))

    def values(self, f: _Field) -> Column:
        """[a, b] or "a|b" with an optional separator."""
        if self.peek() == "[":
            self.next()
            out = [self.literal(f)]
            while self.peek() == ",":
                self.next()
                out.append(self.literal(f))
            self.want("]")
            return F.array(*out)
        kind, text = self.next()
        if kind != "string":
            raise InvalidArgument(f"expected a list, found {text!r}")
        split = "|"
        if self.peek() == ",":
            self.next()
            split = self.next()[1][1:-1]
        return F.array(*(self.coerced(f, x, True) for x in text[1:-1].split(split) if x != ""))

    def predicate(self) -> Column:
        if self.tokens[self.at][0] == "name" and self.peek() in _IN | _NOT_IN and self.tokens[self.at + 1][1] == "(":
            word = self.next()[1].lower()
            self.want("(")
            f = self.field(self.next()[1])
            self.want(",")
            out = _overlap(f, self.values(f))
            self.want(")")
            return out if word in _IN else ~out
        f = self.operand()
        if not isinstance(f, _Field):
            raise InvalidArgument("a condition starts with a field")
        op = self.next()[1].lower()
        if op in _IN | _NOT_IN:
            out = _overlap(f, self.values(f))
            return out if op in _IN else ~out
        if op in ("=", "==", "!="):
            value = self.literal(f)
            out = F.coalesce(F.exists(f.values, lambda x: x == value), F.lit(False))
            return ~out if op == "!=" else out
        if op in ("<", ">", "<=", ">="):
            value = self.literal(f)
            test = {"<": lambda x: x < value, ">": lambda x: x > value, "<=": lambda x: x <= value, ">=": lambda x: x >= value}[op]
            return F.coalesce(F.exists(f.values, test), F.lit(False))
        raise InvalidArgument(f"unexpected {op!r}")


def _number(text: str) -> float | int:
    return float(text) if any(c in text for c in ".eE") else int(text)


def _overlap(f: _Field, values: Column) -> Column:
    return F.coalesce(F.exists(f.values, lambda x: F.array_contains(values, x)), F.lit(False))


def parse(text: str, schema: T.StructType) -> Column:
    """The condition as a boolean column, never null."""
    p = _Parser(text, schema)
    out = p.expression()
    if p.tokens[p.at][0] != "end":
        raise InvalidArgument(f"unexpected {p.tokens[p.at][1]!r}")
    return out


def excluded(column: str, bits: list[int]) -> Column:
    """Rows whose whole id is not among the set bits of an exclusion set (small; otherwise use an anti join)."""
    return ~F.col(column).isin(bits)


def all_of(*conditions: Column | None) -> Column | None:
    """Every condition that is given, ANDed."""
    out = None
    for c in conditions:
        if c is not None:
            out = c if out is None else out & c
    return out

"""Typed equality filters over nested content.

The grammar has five nodes: equality at a dotted path, any-element equality,
and, or, and a custom predicate over the content's JSON. Equality is typed and
case-sensitive: a literal of another type, or a path that does not lead to a
value, is false and never NULL. NULL equals only an explicit NULL.
"""

from __future__ import annotations

import json
import math
from collections.abc import Callable
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

_BITS = {T.ByteType: 8, T.ShortType: 16, T.IntegerType: 32, T.LongType: 64}
_INTEGRAL = tuple(_BITS)


class Filter:
    def __and__(self, other: Filter) -> Filter:
        return And(self, other)

    def __or__(self, other: Filter) -> Filter:
        return Or(self, other)

    def __bool__(self) -> bool:
        raise ValueError("combine filters with & and |")


@dataclass(frozen=True, eq=False)
class Equals(Filter):
    path: str
    value: object

    def __repr__(self) -> str:
        return f"{self.path} == {_shown(self.value)}"


@dataclass(frozen=True, eq=False)
class AnyEquals(Filter):
    path: str
    value: object

    def __repr__(self) -> str:
        return f"{self.path}.Any(x => x == {_shown(self.value)})"


@dataclass(frozen=True, eq=False)
class And(Filter):
    left: Filter
    right: Filter

    def __repr__(self) -> str:
        return f"({self.left} && {self.right})"


@dataclass(frozen=True, eq=False)
class Or(Filter):
    left: Filter
    right: Filter

    def __repr__(self) -> str:
        return f"({self.left} || {self.right})"


@dataclass(frozen=True, eq=False)
class Custom(Filter):
    """``test(document)`` on the parsed JSON of the content; an exception is false."""

    test: Callable[[object], bool]

    def __repr__(self) -> str:
        return f"custom({getattr(self.test, '__name__', 'predicate')})"


def _shown(v: object) -> str:
    return "null" if v is None else str(v)


class field:  # noqa: N801 - reads as a word of the query
    """``field("a.b") == 1``, ``field("tags").any("x")``; other comparisons raise ValueError."""

    def __init__(self, path: str) -> None:
        self.path = path

    def __eq__(self, value: object) -> Filter:  # type: ignore[override]
        return Equals(self.path, value)

    def any(self, value: object) -> Filter:
        return AnyEquals(self.path, value)

    def _unsupported(self, *_: object) -> Filter:
        raise ValueError("filters support equality only")

    __lt__ = __le__ = __gt__ = __ge__ = __ne__ = __contains__ = _unsupported  # type: ignore[assignment]
    __hash__ = None  # type: ignore[assignment]


def folded(f: Filter | bool | None) -> Filter | bool | None:
    """A tree with constant branches folded; None (no filter) matches everything."""
    if isinstance(f, (And, Or)):
        left, right = folded(f.left), folded(f.right)
        left, right = (True if x is None else x for x in (left, right))
        stop = isinstance(f, Or)
        if left is stop or right is stop:
            return stop
        if isinstance(left, bool):
            return right
        if isinstance(right, bool):
            return left
        return type(f)(left, right)
    return f


# -- wire form


def to_wire(f: Filter | None) -> str | None:
    """JSON of a tree; None has none. Custom predicates have no wire form."""

    def node(x: Filter) -> dict:
        if isinstance(x, (Equals, AnyEquals)):
            if x.value is not None and type(x.value) not in (str, int, float, bool):
                raise ValueError(f"no wire form for {type(x.value).__name__}")
            return {"op": "eq" if isinstance(x, Equals) else "any", "path": x.path, "value": x.value}
        if isinstance(x, (And, Or)):
            return {"op": "and" if isinstance(x, And) else "or", "left": node(x.left), "right": node(x.right)}
        raise ValueError(f"no wire form for {x!r}")

    return None if f is None else json.dumps(node(f))


def from_wire(text: str | None) -> Filter | None:
    def node(d: dict) -> Filter:
        match d.get("op"):
            case "eq":
                return Equals(d["path"], d["value"])
            case "any":
                return AnyEquals(d["path"], d["value"])
            case "and":
                return And(node(d["left"]), node(d["right"]))
            case "or":
                return Or(node(d["left"]), node(d["right"]))
        raise ValueError(f"unknown node {d!r}")

    return node(json.loads(text)) if text else None


# -- struct content


def _typed(c: Column, kind: T.DataType, value: object) -> Column:
    """``c == value`` in the column's own type, which a scan can take over; false where the types differ."""
    if value is None:
        return c.isNull()
    hit: Column | None = None
    if isinstance(value, float) and isinstance(kind, _INTEGRAL) and value.is_integer() and abs(value) <= 2**53:
        value = int(value)
    if isinstance(value, bool):
        hit = c == value if isinstance(kind, T.BooleanType) else None
    elif isinstance(value, str):
        hit = c == value if isinstance(kind, T.StringType) else None
    elif isinstance(value, int):
        half = 1 << (_BITS.get(type(kind), 1) - 1)
        hit = c == F.lit(value).cast(kind) if isinstance(kind, _INTEGRAL) and -half <= value < half else None
    elif isinstance(value, float) and not math.isnan(value):
        if isinstance(kind, (T.FloatType, T.DoubleType)):
            hit = c == F.lit(value).cast(kind)
        elif isinstance(kind, (*_INTEGRAL, T.DecimalType)):
            hit = c.cast("double") == F.lit(value)
    return F.lit(False) if hit is None else hit


def _walk(schema: T.StructType, path: str, base: Column | None) -> tuple[Column, T.DataType, Column] | None:
    """(column, type, whether all parents are there) at an exact, case-sensitive path."""
    at, kind, there = base, schema, base.isNotNull() if base is not None else F.lit(True)
    names = path.split(".")
    for i, name in enumerate(names):
        if not isinstance(kind, T.StructType) or name not in kind.names:
            return None
        at = F.col(f"`{name}`") if at is None else at.getField(name)
        kind = kind[name].dataType
        if i < len(names) - 1:
            there = there & at.isNotNull()
    return at, kind, there


def on_struct(f: Filter | None, schema: T.StructType, content: str | None = None) -> Column:
    """A WHERE predicate over columns (or the struct column ``content``) of ``schema``.

    Leaves are plain comparisons in the columns' types, so Catalyst prunes nested
    fields and pushes them to the scan. They may be NULL where there is no value; the
    grammar has no NOT, so WHERE takes that for false. ``matches`` is never NULL.
    """
    base = F.col(content) if content else None

    def node(x: Filter | bool) -> Column:
        if isinstance(x, bool):
            return F.lit(x)
        if isinstance(x, (And, Or)):
            a, b = node(x.left), node(x.right)
            return a & b if isinstance(x, And) else a | b
        if isinstance(x, Custom):
            doc = F.to_json(F.struct("*") if base is None else base)
            return _custom(x.test)(doc)
        found = _walk(schema, x.path, base)
        if found is None:
            return F.lit(False)
        c, kind, there = found
        if isinstance(x, Equals):
            return there & _typed(c, kind, x.value) if x.value is None else _typed(c, kind, x.value)
        if not isinstance(kind, T.ArrayType):
            return F.lit(False)
        return F.exists(c, lambda e: _typed(e, kind.elementType, x.value))

    f = folded(f)
    return F.lit(True) if f is None else node(f)


def matches(f: Filter | None, schema: T.StructType, content: str | None = None) -> Column:
    """``on_struct`` as a value to select: true or false."""
    return F.coalesce(on_struct(f, schema, content), F.lit(False))


# -- variant content


def _variant_typed(v: Column, value: object) -> Column:
    if value is None:
        return F.coalesce(F.is_variant_null(v), F.lit(False))
    kind = F.schema_of_variant(v)
    get = lambda t: F.try_variant_get(v, "$", t)
    if isinstance(value, bool):
        hit = (kind == "BOOLEAN") & (get("boolean") == value)
    elif isinstance(value, str):
        hit = (kind == "STRING") & (get("string") == value)
    elif isinstance(value, int):
        hit = (kind == "BIGINT") & (get("bigint") == F.lit(value).cast("long")) if -(2**63) <= value < 2**63 else F.lit(False)
    elif isinstance(value, float):
        near = F.when(kind == "FLOAT", get("float") == F.lit(value).cast("float")).otherwise(get("double") == F.lit(value))
        hit = (kind.isin("BIGINT", "DOUBLE", "FLOAT") | kind.startswith("DECIMAL")) & near
    else:
        hit = F.lit(False)
    return F.coalesce(hit, F.lit(False))


def on_variant(f: Filter | None, content: str = "content") -> Column:
    """The same predicate over a VARIANT column of parsed JSON; NULL content never matches."""
    v = F.col(content)

    def at(path: str) -> Column:
        return F.try_variant_get(v, "$" + "".join(f"['{p}']" for p in path.split(".")), "variant")

    def node(x: Filter | bool) -> Column:
        if isinstance(x, bool):
            return F.lit(x)
        if isinstance(x, (And, Or)):
            a, b = node(x.left), node(x.right)
            return a & b if isinstance(x, And) else a | b
        if isinstance(x, Custom):
            return _custom(x.test)(F.to_json(v))
        if isinstance(x, Equals):
            return _variant_typed(at(x.path), x.value)
        items = F.try_variant_get(at(x.path), "$", "array<variant>")
        array = F.coalesce(F.schema_of_variant(at(x.path)).startswith("ARRAY"), F.lit(False))
        return array & F.coalesce(F.exists(items, lambda e: _variant_typed(e, x.value)), F.lit(False))

    f = folded(f)
    return F.lit(True) if f is None else node(f)


def _custom(test: Callable[[object], bool]) -> Callable[[Column], Column]:
    @F.pandas_udf("boolean")
    def run(docs: pd.Series) -> pd.Series:
        out = []
        for d in docs:
            try:
                out.append(bool(test(json.loads(d))))
            except Exception:  # noqa: BLE001 - a predicate that fails doesn't match
                out.append(False)
        return pd.Series(out, dtype=bool)

    return run

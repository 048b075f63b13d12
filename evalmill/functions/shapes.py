"""Declared shapes of JSON values: what a document must look like at any depth, and the Spark type it is read with.

A shape is made of the classes below. ``shaped(shape)`` compiles it to one column expression over JSON text, an Arrow UDF, that gives

- ``error``: why the text is no JSON by Python's rules, else null;
- ``issues``: (path, code) of everything in it that breaks the shape, in the document's order;
- ``value``: the document with the shape's Spark type. Values of free form keep their JSON types as canonical JSON text, so 30, 30.0, "30" and null stay apart. What has another kind than declared is null.

Codes: missing, extra, wrong_type, not_allowed, pattern, too_short, not_unique, not_a_time, no_zone.
"""

from __future__ import annotations

import datetime
import json
import re
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from evalmill.functions.jsonx import BAD, dumps, fault, plain

Issues = list[tuple[str, str]]


class Shape:
    """A kind of value: its Spark type, what is wrong with a value, and how it is read."""

    ddl = "string"

    def check(self, value, path: str, out: Issues) -> None:
        raise NotImplementedError

    def read(self, value):
        raise NotImplementedError


@dataclass(frozen=True)
class Text(Shape):
    """A string, of at least so many characters, that a pattern matches as a whole, or one of some."""

    pattern: str | None = None
    least: int = 0
    one_of: tuple[str, ...] | None = None

    def check(self, value, path, out):
        if not isinstance(value, str):
            out.append((path, "wrong_type" if self.one_of is None else "not_allowed"))
        elif self.one_of is not None and value not in self.one_of:
            out.append((path, "not_allowed"))
        elif len(value) < self.least:
            out.append((path, "too_short"))
        elif self.pattern is not None and not re.fullmatch(self.pattern, value):
            out.append((path, "pattern"))

    def read(self, value):
        return plain(value) if isinstance(value, str) else None


_TIME = re.compile(r"(\d{4}-\d{2}-\d{2})(?:[Tt _](\d{2}:\d{2})(:\d{2}(?:\.\d{1,6}\d*)?)?([Zz]|[+-]\d{2}:?\d{2})?)?", re.ASCII)


@dataclass(frozen=True)
class Time(Shape):
    """A point in time with its zone; a number, also as text, is seconds since 1970 in UTC. Kept as it is written."""

    def check(self, value, path, out):
        if isinstance(value, bool) or not isinstance(value, (str, int, float)):
            out.append((path, "wrong_type"))
            return
        if not isinstance(value, str) or re.fullmatch(r"[+-]?\d+(\.\d+)?", value, re.ASCII):
            return
        m = _TIME.fullmatch(value)
        try:
            if m is None:
                raise ValueError
            datetime.datetime.fromisoformat(f"{m[1]}T{m[2] or '00:00'}{(m[3] or '')[:10]}")
            if m[4] and m[4] not in "Zz" and (int(m[4][1:3]) > 23 or int(m[4][-2:]) > 59):
                raise ValueError
        except ValueError:
            out.append((path, "not_a_time"))
            return
        if m[4] is None:
            out.append((path, "no_zone"))

    def read(self, value):
        return plain(value) if isinstance(value, str) else None if value is None else dumps(value)


@dataclass(frozen=True)
class Anything(Shape):
    """Any value, kept as canonical JSON."""

    def check(self, value, path, out):
        pass

    def read(self, value):
        return dumps(value)


@dataclass(frozen=True)
class Maybe(Shape):
    """Null or a value of the inner shape."""

    inner: Shape

    @property
    def ddl(self):
        return self.inner.ddl

    def check(self, value, path, out):
        if value is not None:
            self.inner.check(value, path, out)

    def read(self, value):
        return None if value is None else self.inner.read(value)


@dataclass(frozen=True)
class Keyed(Shape):
    """An object of any keys, its values of one shape."""

    item: Shape = field(default_factory=Anything)

    @property
    def ddl(self):
        return f"map<string,{self.item.ddl}>"

    def check(self, value, path, out):
        if not isinstance(value, dict):
            out.append((path, "wrong_type"))
            return
        for k, v in value.items():
            self.item.check(v, f"{path}.{k}" if path else k, out)

    def read(self, value):
        return [(plain(k), self.item.read(v)) for k, v in value.items()] if isinstance(value, dict) else None


@dataclass(frozen=True)
class Listed(Shape):
    """A list of values of one shape, of at least so many, or all different."""

    item: Shape
    least: int = 0
    unique: bool = False

    @property
    def ddl(self):
        return f"array<{self.item.ddl}>"

    def check(self, value, path, out):
        if not isinstance(value, list):
            out.append((path, "wrong_type"))
            return
        before = len(out)
        for i, v in enumerate(value):
            self.item.check(v, f"{path}[{i}]", out)
        if len(value) < self.least:
            out.append((path, "too_short"))
        if self.unique and len(out) == before and len({dumps(v) for v in value}) < len(value):
            out.append((path, "not_unique"))

    def read(self, value):
        return [self.item.read(v) for v in value] if isinstance(value, list) else None


@dataclass(frozen=True)
class Obj(Shape):
    """An object of named fields; those in ``optional`` may be missing, and a closed one has no others."""

    fields: dict[str, Shape]
    optional: tuple[str, ...] = ()
    closed: bool = True

    @property
    def ddl(self):
        return f"struct<{','.join(f'`{k}`:{s.ddl}' for k, s in self.fields.items())}>"

    def check(self, value, path, out):
        if not isinstance(value, dict):
            out.append((path, "wrong_type"))
            return
        at = lambda k: f"{path}.{k}" if path else k
        for k, shape in self.fields.items():
            if k in value:
                shape.check(value[k], at(k), out)
            elif k not in self.optional:
                out.append((at(k), "missing"))
        if self.closed:
            out.extend((at(k), "extra") for k in value if k not in self.fields)

    def read(self, value):
        return {k: s.read(value[k]) if k in value else None for k, s in self.fields.items()} if isinstance(value, dict) else None


@dataclass(frozen=True)
class OneOf(Shape):
    """An object whose shape the value of the key ``by`` names; read with the fields of all shapes."""

    by: str
    shapes: dict[str, Obj]

    @property
    def ddl(self):
        return self._every().ddl

    def _every(self) -> Obj:
        return Obj({self.by: Text()} | {k: s for shape in self.shapes.values() for k, s in shape.fields.items()}, closed=False)

    def check(self, value, path, out):
        tag = f"{path}.{self.by}" if path else self.by
        if not isinstance(value, dict):
            out.append((path, "wrong_type"))
        elif self.by not in value:
            out.append((tag, "missing"))
        elif not isinstance(value[self.by], str) or value[self.by] not in self.shapes:
            out.append((tag, "not_allowed"))
        else:
            self.shapes[value[self.by]].check(value, path, out)

    def read(self, value):
        return self._every().read(value)


def issues_of(shape: Shape, text: str) -> tuple[object, Issues, str | None]:
    """(value, issues, error) of one text."""
    try:
        value, out = json.loads(text), []
        shape.check(value, "", out)
        return shape.read(value), [(plain(p), c) for p, c in out], None
    except BAD as error:
        return None, [], fault(error)


def shaped(shape: Shape):
    """A column function: JSON text to struct(value, issues, error); of a null text all three are null."""
    from pyspark.sql.pandas.types import to_arrow_type
    from pyspark.sql.types import _parse_datatype_string

    ddl = f"struct<value:{shape.ddl},issues:array<struct<path:string,code:string>>,error:string>"

    @F.arrow_udf(ddl)
    def work(texts: pa.Array) -> pa.Array:
        out = []
        for text in texts.to_pylist():
            value, issues, error = (None, None, None) if text is None else issues_of(shape, text)
            out.append({"value": value, "issues": None if issues is None else [{"path": p, "code": c} for p, c in issues], "error": error})
        return pa.array(out, arrow)

    arrow = to_arrow_type(_parse_datatype_string(ddl))

    def column(text: Column | str) -> Column:
        return work(text)

    return column

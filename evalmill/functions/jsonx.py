"""JSON and case folding by Python's rules, in Arrow batches.

Spark's JSON parser accepts and rejects other texts than the data's producers do, and its ``lower`` is not case
folding, so these few functions are pandas UDFs; all else in the library is built-in expressions.
"""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

_STRING, _STRINGS = T.StringType(), T.ArrayType(T.StringType())
_PARSED = T.StructType([T.StructField(n, _STRING) for n in ("value", "kind", "error")])
_CHECKS = T.ArrayType(T.ArrayType(T.StructType([T.StructField(n, _STRING) for n in ("key", "same", "text")])))
_CALL = T.StructType([T.StructField("tool", _STRING), T.StructField("arguments", T.MapType(_STRING, _STRING))])
_RESPONSE = T.StructType([T.StructField("tool_calls", T.ArrayType(_CALL)), T.StructField("message", _STRING)])
_KINDS = ((bool, "bool"), (dict, "dict"), (list, "list"), (str, "str"), (int, "int"), (float, "float"), (type(None), "null"))


#: What reading, walking or writing a value can raise: no JSON, or more levels than the stack holds.
BAD = (ValueError, RecursionError)
_LONE = re.compile("[\ud800-\udfff]")


def plain(text: str) -> str:
    """Halves of surrogate pairs, which no column can hold, written as escapes."""
    return _LONE.sub(lambda m: f"\\u{ord(m[0]):04x}", text)


def dumps(value) -> str:
    """Sorted keys, no spaces, other scripts kept, halves of surrogate pairs escaped."""
    return plain(json.dumps(value, ensure_ascii=False, sort_keys=True, separators=(",", ":")))


def fault(error: Exception) -> str:
    """The words of what is wrong with a text."""
    if isinstance(error, RecursionError):
        return "invalid JSON at char 0: nested too deep"
    return f"invalid JSON at char {getattr(error, 'pos', 0)}: {getattr(error, 'msg', error)}"


def kind_of(value) -> str:
    return next(name for kind, name in _KINDS if isinstance(value, kind))


def _strict(text: str | None) -> tuple:
    if text is None:
        return None, "missing", None
    try:
        value = json.loads(text)
        return dumps(value), kind_of(value), None
    except BAD as error:
        return None, None, fault(error)


@F.pandas_udf(_PARSED)
def strict_json(texts: pd.Series) -> pd.DataFrame:
    """(canonical text, kind of the value, error). A null text has the kind ``missing`` and no error."""
    return pd.DataFrame([_strict(t) for t in texts], columns=["value", "kind", "error"])


def _fold_numbers(value):
    """Values that compare equal become the same: true and 1, 120.0 and 120, at any depth."""
    if isinstance(value, bool):
        return int(value)
    if isinstance(value, float) and value.is_integer():
        return int(value)
    if isinstance(value, list):
        return [_fold_numbers(v) for v in value]
    if isinstance(value, dict):
        return {k: _fold_numbers(v) for k, v in value.items()}
    return value


def equality_text(text: str | None) -> str | None:
    if text is None:
        return None
    try:
        return dumps(_fold_numbers(json.loads(text)))
    except BAD:
        return text


@F.pandas_udf(_STRING)
def equality_key(texts: pd.Series) -> pd.Series:
    return texts.map(equality_text, na_action="ignore")


@F.pandas_udf(_STRING)
def fold(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: t.casefold(), na_action="ignore")


@F.pandas_udf(_STRINGS)
def fold_all(texts: pd.Series) -> pd.Series:
    return texts.map(lambda a: None if a is None else [None if t is None else t.casefold() for t in a])


def _string_of(text: str | None) -> str | None:
    try:
        value = json.loads(text) if text is not None else None
    except BAD:
        return None
    return plain(value.casefold()) if isinstance(value, str) else None


def _arguments(items) -> list[tuple[str, str | None, str | None]]:
    pairs = items.items() if isinstance(items, dict) else items
    return [(k, equality_text(v), _string_of(v)) for k, v in pairs]


@F.pandas_udf(_CHECKS)
def comparable(arguments: pd.Series) -> pd.Series:
    """Each map of canonical JSON values as (key, text for equality, folded text of a string value)."""
    return arguments.map(lambda calls: None if calls is None else [[
        {"key": k, "same": s, "text": t} for k, s, t in _arguments(c if c is not None else {})
    ] for c in calls])


#: Parts of key names whose values are hidden, and what stands for them.
SECRET_KEYS = ("token", "api_key", "apikey", "password", "secret", "authorization")
HIDDEN = "***REDACTED***"


def _hide(value):
    if isinstance(value, dict):
        return {k: HIDDEN if any(s in k.lower() for s in SECRET_KEYS) else _hide(v) for k, v in value.items()}
    return [_hide(v) for v in value] if isinstance(value, list) else value


@F.pandas_udf(_STRING)
def redact_json(texts: pd.Series) -> pd.Series:
    """Values under secret keys hidden at any depth; a text that is not JSON stays. What is nested too deep to be looked through is hidden as a whole."""

    def one(text: str) -> str:
        try:
            return dumps(_hide(json.loads(text)))
        except RecursionError:
            return dumps(HIDDEN)
        except ValueError:
            return text

    return texts.map(one, na_action="ignore")


_KEY = re.compile(r'"((?:[^"\\]|\\.)*)"\s*:')


@F.pandas_udf(_STRINGS)
def keys_at_any_depth(texts: pd.Series) -> pd.Series:
    """The sorted keys of all objects in each text, none if it is no JSON; of what is nested too deep, whatever stands in quotes before a colon."""

    def one(text: str) -> list:
        try:
            found, left = set(), [json.loads(text)]
        except RecursionError:
            return sorted(set(_KEY.findall(text)))
        except ValueError:
            return []
        while left:
            value = left.pop()
            if isinstance(value, dict):
                found.update(map(plain, value))
                left.extend(value.values())
            elif isinstance(value, list):
                left.extend(value)
        return sorted(found)

    return texts.map(one, na_action="ignore")


@F.pandas_udf(_STRINGS)
def top_keys(texts: pd.Series) -> pd.Series:
    """The keys of each text's object, null if it has none."""

    def one(text: str) -> list | None:
        try:
            value = json.loads(text)
        except BAD:
            return None
        return sorted(map(plain, value)) if isinstance(value, dict) else None

    return texts.map(one, na_action="ignore")


#: Keys under which models put a call's name and arguments.
NAME_KEYS = ("name", "tool", "tool_name", "function_name", "functionName", "function_key", "method", "action")
ARGUMENT_KEYS = ("arguments", "parameters", "params")
TOOL_NAME = re.compile(r"[a-z][a-z0-9_]*\.[a-z][a-z0-9_]*\Z")
_FENCE = re.compile(r"```(?:json)?\s*(.*?)\s*```", re.DOTALL)
_SPECIAL = re.compile(r'[\[\]{}"\\]')
_CLOSES = {"]": "[", "}": "{"}


class _Waiting:
    """Brackets that wait for their ends and see the text in one state of the scanner.

    A bracket counts those of its own kind only. Its depth is its kind's ``count`` less the base it is kept under; of those with one base, which
    end together, the first counts.
    """

    def __init__(self):
        self.count, self.first = {"[": 0, "{": 0}, {"[": {}, "{": {}}

    def open(self, kind: str, at: int):
        self.first[kind].setdefault(self.count[kind], at)
        self.count[kind] += 1

    def close(self, kind: str) -> int | None:
        self.count[kind] -= 1
        return self.first[kind].pop(self.count[kind], None)

    def joined(self, other: _Waiting) -> _Waiting:
        """Both together; the smaller one's bases are moved."""
        for kind in "[{":
            few, many = sorted((self.first[kind], other.first[kind]), key=len)
            here, there = (self, other) if many is self.first[kind] else (other, self)
            for base, at in few.items():
                base += here.count[kind] - there.count[kind]
                many[base] = min(many.get(base, at), at)
            self.first[kind], self.count[kind] = many, here.count[kind]
        return self

    def __bool__(self) -> bool:
        return any(self.first.values())


def first_json(text: str) -> str | None:
    """The first balanced list or object of a text, looked for inside a fence if there is one.

    Every bracket is a possible beginning, from which the text is read anew, outside of quotes. As readings differ in nothing but whether they
    are inside quotes, those in the same state go on together: one pass for all beginnings.
    """
    body = text.strip()
    if fenced := _FENCE.search(body):
        body = fenced[1].strip()
    plain, quoted, escaped, escape, top, best = _Waiting(), _Waiting(), _Waiting(), -1, None, None
    for m in _SPECIAL.finditer(body):
        at, c = m.start(), m[0]
        skipped = escaped if at == escape + 1 else None  # what stands behind a backslash in quotes counts for nothing
        if escaped and skipped is None:
            quoted = quoted.joined(escaped)
        if skipped is not None or escaped:
            escaped = _Waiting()
        if c == '"':
            plain, quoted = quoted, plain
        elif c == "\\":
            escaped, quoted, escape = quoted, _Waiting(), at
        elif c in "[{":
            top = at if top is None else top
            plain.open(c, at)
        elif (begin := plain.close(_CLOSES[c])) is not None and (best is None or begin < best[0]):
            best = begin, at + 1
            if begin == top:
                break
        if skipped:
            quoted = quoted.joined(skipped)
    return body[best[0] : best[1]] if best else None


def call_of(value) -> tuple[str, dict] | None:
    """Name and arguments of one call in any of the known shapes."""
    if not isinstance(value, dict):
        return None
    inner = value.get("function")
    if isinstance(inner, dict):
        name, given = inner.get("name"), inner.get("arguments", {})
    else:
        name = next((value[k] for k in NAME_KEYS if isinstance(value.get(k), str)), None)
        named = value.get("named_inputs")
        given = named if isinstance(named, dict) else next((value[k] for k in ARGUMENT_KEYS if k in value), {})
    if not isinstance(name, str):
        return None
    if isinstance(given, str):
        try:
            given = json.loads(given)
        except BAD:
            given = {}
        return name, given if isinstance(given, dict) else {}
    if isinstance(given, list):
        merged: dict = {}
        for part in given:
            merged |= part if isinstance(part, dict) else {}
        return name, merged
    return name, given if isinstance(given, dict) else {}


def response_of(raw: str | None) -> tuple[list[tuple[str, dict]], str | None]:
    """Tool calls and message of a model's raw text; what can't be read as calls is the message."""
    raw = raw or ""
    whole = raw or None
    found = first_json(raw)
    try:
        value = json.loads(found) if found is not None else None
    except BAD:
        return [], whole
    if found is None:
        return [], whole
    structured = isinstance(value, dict) and ("tool_calls" in value or "message" in value)
    if structured:
        listed = value.get("tool_calls", [])
        values = listed if isinstance(listed, list) else []
        message = value["message"] if isinstance(value.get("message"), str) else whole
    else:
        values, message = value if isinstance(value, list) else [value], None
        pairs = list(zip(values[::2], values[1::2], strict=False))
        if values and len(values) % 2 == 0 and all(isinstance(a, str) and isinstance(b, dict) for a, b in pairs):
            values = [{"name": a, "arguments": b} for a, b in pairs]
    calls = []
    for name, arguments in filter(None, map(call_of, values)):
        if not structured and name == "request_clarification":
            question = arguments.get("question")
            message = (question if isinstance(question, str) else None) or whole
        elif not structured and name == "refuse_request":
            reason = arguments.get("reason")
            if not isinstance(reason, str) or not reason.strip():
                message = raw or "I cannot comply with this request."
            else:
                message = reason if re.search("cannot|can't", reason.casefold()) else f"I cannot comply with this request: {reason}"
        elif TOOL_NAME.match(name):
            calls.append((name, arguments))
    return calls, message


@F.pandas_udf(_RESPONSE)
def parse_response(raw: pd.Series) -> pd.DataFrame:
    """Raw model text to calls (argument values as canonical JSON) and message; a text nested too deep to be written again is the message."""
    rows = []
    for text in raw:
        try:
            calls, message = response_of(text)
            rows.append(([{"tool": t, "arguments": {plain(k): dumps(v) for k, v in a.items()}} for t, a in calls], message and plain(message)))
        except RecursionError:
            rows.append(([], text))
    return pd.DataFrame(rows, columns=["tool_calls", "message"])

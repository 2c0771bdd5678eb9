"""Typed predicates over the event log, compiled to one Column.

The same compiled Column serves batch, stream and rules, so a stored query and
a live rule can never disagree.
"""

from __future__ import annotations

import json
from dataclasses import dataclass
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Short names a user may type for an event-log column.
FIELD_ALIASES = {
    "timestamp": "timestamp_ns",
    "type": "event_type",
    "freq": "freq_mhz",
    "tg": "talkgroup",
    "uid": "source_unit",
    "enc": "encrypted",
    "device": "device_key",
    "cls": "classification",
    "lat": "receiver_lat",
    "lon": "receiver_lon",
}
EVENT_COLUMNS = {
    "id", "timestamp_ns", "ts", "ts_bucket", "severity", "source", "event_type", "body", "freq_mhz", "talkgroup",
    "source_unit", "nac", "encrypted", "band", "device_key", "classification", "trace_id", "span_id",
    "operation_id", "site_session_id", "receiver_lat", "receiver_lon",
}


def attribute(key: str, attributes: str = "attributes") -> Column:
    """One value of the open JSON attribute map; keys may hold dots."""
    return F.get_json_object(attributes, f"$['{key}']")


def resolve_field(name: str) -> tuple[Column, bool]:
    """The Column for a field name or alias, and whether it is an attribute."""
    column = FIELD_ALIASES.get(name, name)
    if column in EVENT_COLUMNS:
        return F.col(column), False
    return attribute(name), True


@dataclass(frozen=True)
class Filter:
    """A predicate tree: a leaf on one field, or a combination of children."""

    op: str
    field: str = ""
    value: Any = None
    children: tuple[Filter, ...] = ()

    def to_json(self) -> str:
        return json.dumps(self._plain())

    def _plain(self) -> dict:
        out: dict = {"op": self.op}
        if self.field:
            out["field"] = self.field
        if self.value is not None:
            out["value"] = list(self.value) if isinstance(self.value, tuple) else self.value
        if self.children:
            out["children"] = [c._plain() for c in self.children]
        return out

    @staticmethod
    def from_json(text: str | dict) -> "Filter":
        d = json.loads(text) if isinstance(text, str) else text
        value = tuple(d["value"]) if isinstance(d.get("value"), list) else d.get("value")
        kids = tuple(Filter.from_json(c) for c in d.get("children", ()))
        return Filter(d["op"], d.get("field", ""), value, kids)


def leaf(op: str):
    return lambda name, value=None: Filter(op, name, value)


Eq, Ne, Gt, Gte, Lt, Lte = (leaf(o) for o in ("eq", "ne", "gt", "gte", "lt", "lte"))
Contains, NotContains, Like, Regex = (leaf(o) for o in ("contains", "not_contains", "like", "regex"))
Exists, NotExists = leaf("exists"), leaf("not_exists")


def In(name: str, values) -> Filter:
    return Filter("in", name, tuple(values))


def NotIn(name: str, values) -> Filter:
    return Filter("not_in", name, tuple(values))


def Not(f: Filter) -> Filter:
    return Filter("not", children=(f,))


def And(*fs: Filter) -> Filter:
    return Filter("and", children=fs)


def Or(*fs: Filter) -> Filter:
    return Filter("or", children=fs)


_COMPARE = {
    "eq": lambda c, v: c == v,
    "ne": lambda c, v: c != v,
    "gt": lambda c, v: c > v,
    "gte": lambda c, v: c >= v,
    "lt": lambda c, v: c < v,
    "lte": lambda c, v: c <= v,
    "in": lambda c, v: c.isin(list(v)),
    "not_in": lambda c, v: ~c.isin(list(v)),
    "contains": lambda c, v: c.ilike(f"%{v}%"),
    "not_contains": lambda c, v: ~c.ilike(f"%{v}%"),
    "like": lambda c, v: c.ilike(v),
    "regex": lambda c, v: c.rlike(v),
}
_NEGATIVE = {"ne", "not_in", "not_contains"}
_TEXT_OPS = {"contains", "not_contains", "like", "regex"}


def compile_filter(f: Filter, null_passes: bool = False) -> Column:
    """``null_passes`` lets negative predicates keep rows without a value."""
    if f.op == "and":
        return reduce(lambda a, b: a & b, (compile_filter(c, null_passes) for c in f.children), F.lit(True))
    if f.op == "or":
        return reduce(lambda a, b: a | b, (compile_filter(c, null_passes) for c in f.children), F.lit(False))
    if f.op == "not":
        return ~compile_filter(f.children[0], null_passes)
    column, is_attribute = resolve_field(f.field)
    if f.op == "exists":
        return column.isNotNull()
    if f.op == "not_exists":
        return column.isNull()
    sample = f.value[0] if isinstance(f.value, tuple) and f.value else f.value
    if f.op in _TEXT_OPS:
        column = column.cast("string")
    elif is_attribute and isinstance(sample, bool):
        column = column.cast("boolean")
    elif is_attribute and isinstance(sample, (int, float)):
        column = column.cast("double")
    test = _COMPARE[f.op](column, f.value)
    if null_passes and f.op in _NEGATIVE:
        return column.isNull() | test
    return test


def all_of(filters, null_passes: bool = False) -> Column:
    return compile_filter(And(*filters), null_passes)


def apply_optional(df: DataFrame, **given) -> DataFrame:
    """Keep rows equal to every argument that is not None; ``x__ge`` means >=, ``x__or_unset`` equal or NULL."""
    for name, value in given.items():
        if value is None:
            continue
        if name.endswith("__ge"):
            df = df.where(F.col(name[:-4]) >= value)
        elif name.endswith("__or_unset"):
            column = F.col(name.removesuffix("__or_unset"))
            df = df.where((column == value) | column.isNull())
        else:
            df = df.where(F.col(name) == value)
    return df


def in_any_range(column: Column, ranges) -> Column:
    """Whether a value lies in one of a fixed list of closed ranges."""
    return reduce(lambda a, b: a | b, (column.between(lo, hi) for lo, hi in ranges))

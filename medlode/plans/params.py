"""Requests as parsed searches: limits, filters, page and order."""

from __future__ import annotations

import base64
import hashlib
import json
from dataclasses import dataclass, field
from datetime import datetime, timezone
from urllib.parse import parse_qsl

from pyspark.sql import Column
from pyspark.sql import functions as F

from medlode.errors import Invalid
from medlode.functions import values
from medlode.functions.dates import sought
from medlode.plans.compile import executable
from medlode.plans.registry import Param, builtin

DEFAULT_COUNT, MAX_COUNT = 128, 2048
MAX_PAIRS, MAX_BYTES, MAX_ALTERNATIVES, MAX_VALUES = 128, 64 * 1024, 128, 512
SORTS = {"_id": "id", "_lastUpdated": "last_updated"}
_MANY = ("token", "string", "date", "reference")


@dataclass(frozen=True)
class SortKey:
    name: str
    down: bool = False

    @property
    def column(self) -> str:
        return SORTS[self.name]


@dataclass
class Search:
    filters: list[tuple[Param, list[str]]] = field(default_factory=list)
    count: int = DEFAULT_COUNT
    after: str | None = None
    sort: list[SortKey] = field(default_factory=list)
    mark: str = ""

    @property
    def order(self) -> list[SortKey]:
        """The order made total: by id last."""
        return self.sort if any(k.name == "_id" for k in self.sort) else [*self.sort, SortKey("_id")]


def pairs(query: str) -> list[tuple[str, str]]:
    found = parse_qsl(query, keep_blank_values=True)
    if len(found) > MAX_PAIRS or sum(len(k.encode()) + len(v.encode()) for k, v in found) > MAX_BYTES:
        raise Invalid("the query is too complex")
    return found


def whole_number(text: str, least: int, most: int) -> int:
    if not text.isascii() or not text.isdigit() or not least <= int(text) <= most:
        raise Invalid(f"a number from {least} to {most} is needed")
    return int(text)


def parse_sort(text: str) -> list[SortKey]:
    keys = [SortKey(x.removeprefix("-"), x.startswith("-")) for x in text.split(",")]
    if any(k.name not in SORTS for k in keys) or len({k.name for k in keys}) < len(keys):
        raise Invalid("_sort takes _id and _lastUpdated, each once")
    return keys


def check_value(param: Param, value: str) -> None:
    if param.kind == "date":
        sought(values.plain(value))
    elif param.kind == "number":
        values.number(value)
    elif param.kind == "quantity":
        values.quantity(value)
    elif param.kind == "special":
        values.near(value)
    elif param.code == "identifier":
        values.check_identifier(value)


def parse(kind: str, query: str, registry: dict[str, dict[str, Param]] | None = None) -> Search:
    """A search of a type. Unknown parameters and modifiers are refused."""
    known = (registry or builtin()).get(kind, {})
    out, seen, total = Search(), set(), 0
    for name, value in pairs(query):
        if name in ("_count", "_after_id", "_sort"):
            if name in seen:
                raise Invalid(f"{name} may come once")
            seen.add(name)
            if name == "_count":
                out.count = whole_number(value, 0, MAX_COUNT)
            elif name == "_sort":
                out.sort = parse_sort(value)
            elif not value:
                raise Invalid("_after_id is empty")
            else:
                out.after = value
            continue
        if name == "_offset":
            raise Invalid("_offset is not supported; use _after_id")
        if name not in known or not executable(known[name]):
            raise Invalid(f"unknown parameter {name}")
        param, found = known[name], values.alternatives(value)
        total += len(found)
        if len(found) > MAX_ALTERNATIVES or total > MAX_VALUES:
            raise Invalid("the query is too complex")
        if len(found) > 1 and param.kind not in _MANY:
            raise Invalid(f"{name} takes one value")
        for x in found:
            check_value(param, x)
        out.filters.append((param, found))
    canon = sorted((p.code, sorted(xs)) for p, xs in out.filters)
    out.mark = hashlib.sha256(json.dumps([kind, canon, [(k.name, k.down) for k in out.order]]).encode()).hexdigest()[:24]
    return out


def encode_cursor(search: Search, row: dict) -> str:
    parts = ["v1", search.mark]
    for k in search.order:
        v = row[k.column]
        parts.append(v.replace(tzinfo=timezone.utc).isoformat(timespec="microseconds") if isinstance(v, datetime) else v)
    return base64.urlsafe_b64encode("\x1f".join(parts).encode()).decode()


def decode_cursor(search: Search, text: str) -> list:
    try:
        version, mark, *found = base64.urlsafe_b64decode(text.encode()).decode().split("\x1f")
        out = [datetime.fromisoformat(v) if k.name == "_lastUpdated" else v for k, v in zip(search.order, found, strict=True)]
    except ValueError:
        raise Invalid("not a cursor") from None
    if version != "v1" or mark != search.mark:
        raise Invalid("this cursor belongs to another search")
    return out


def beyond(search: Search) -> Column:
    """Rows after the cursor in the order of the search."""
    if not search.after:
        return F.lit(True)
    if not search.sort:
        return F.col("id") > search.after
    out, same = F.lit(False), F.lit(True)
    for k, v in zip(search.order, decode_cursor(search, search.after), strict=True):
        c, v = F.col(k.column), F.lit(v)
        out = out | (same & ((c < v) if k.down else (c > v)))
        same = same & (c == v)
    return out

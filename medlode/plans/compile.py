"""Search filters as predicates over VARIANT documents."""

from __future__ import annotations

import math
from functools import reduce
from operator import and_, or_

from pyspark.sql import Column
from pyspark.sql import functions as F

from medlode.errors import Invalid
from medlode.functions import values
from medlode.functions.dates import interval, matches, sought
from medlode.functions.variant import items, node, some, spread, text, true
from medlode.plans.registry import Param, Path

EARTH = 6_371_000.0
#: Which path shapes each kind can read.
READS = {
    "string": {"field", "where"},
    "token": {"field", "where", "exists"},
    "reference": {"field", "where"},
    "date": {"field", "where", "alternatives"},
    "uri": {"field"},
    "number": {"field"},
    "quantity": {"field"},
    "special": {"position"},
}


def executable(param: Param) -> bool:
    return param.path.shape in READS.get(param.kind, ())


def _where(v: Column, p: Path, holds) -> Column:
    return some(spread(v, *p.segments), lambda x: true(text(x, p.field) == p.value) & true(holds(x)))


def _string(v: Column, p: Path, value: str) -> Column:
    pattern = values.like_pattern(value)
    like = lambda c: F.lower(c).like(pattern)
    if p.shape == "where":
        return _where(v, p, lambda x: like(text(x, *p.suffix)))
    first, *rest = p.segments
    if not rest:
        return true(like(text(v, first))) | some(spread(v, first), lambda x: like(F.to_json(x)))
    if len(rest) == 1:
        return some(spread(v, first), lambda x: some(spread(x, rest[0]), lambda y: like(text(y))))
    return some(spread(v, first), lambda x: like(text(x, *rest[:2])))


def _coded(x: Column, system: str | None, code: str, key: str = "code") -> Column:
    own = text(x, key) == code
    return own if system is None else own & (text(x, "system") == system)


def _token(v: Column, p: Path, value: str, name: str) -> Column:
    if p.shape == "exists":
        n, t = node(v, *p.segments), text(v, *p.segments)
        there = n.isNotNull() & true(~F.is_variant_null(n)) & true(t != "false")
        return ~there if values.plain(value) == "false" else there
    system, code = values.token(value)
    if p.shape == "where":
        if p.suffix:
            return _where(v, p, lambda x: text(x, *p.suffix) == code)
        return _where(v, p, lambda x: _coded(x, system, code, "value") | (text(x) == code))
    first, *rest = p.segments
    if name == "identifier":
        return some(items(v, first), lambda x: _coded(x, system, code, "value"))
    if not rest:
        concept = lambda x: some(items(x, "coding"), lambda y: _coded(y, system, code))
        return (
            true(text(v, first) == code)
            | some(items(v, first, "coding"), lambda y: _coded(y, system, code))
            | some(items(v, first), concept)
            | some(spread(v, first), lambda x: _coded(x, system, code, "value"))
        )
    if len(rest) == 1:
        return some(spread(v, first), lambda x: true(text(x, rest[0]) == code) | some(items(x, rest[0], "coding"), lambda y: _coded(y, system, code)))
    return true(text(v, *p.segments) == code)


def _reference(v: Column, p: Path, value: str) -> Column:
    value = values.plain(value)
    if p.shape == "where":
        return _where(v, p, lambda x: (text(x, *p.suffix, "reference") == value) | (text(x, *p.suffix) == value))
    if len(p.segments) > 1 and p.segments[-1] == "reference":
        return true(text(v, *p.segments) == value)
    return true(text(v, *p.segments, "reference") == value) | some(items(v, *p.segments), lambda x: text(x, "reference") == value)


def _date(v: Column, p: Path, value: str) -> Column:
    q = sought(values.plain(value))
    holds = lambda x: matches(*interval(x), q)
    if p.shape == "alternatives":
        return reduce(or_, (_date(v, Path("field", tuple(o.split("."))), value) for o in p.options))
    if p.shape == "where":
        return some(spread(v, *p.segments), lambda x: true(text(x, p.field) == p.value) & some(spread(x, *p.suffix), holds))
    first, *rest = p.segments
    if not rest:
        return some(spread(v, first), holds)
    return some(spread(v, first), lambda x: some(spread(x, *rest), holds))


def _decimal(c: Column) -> Column:
    return c.try_cast("decimal(38,18)")


def _quantity(v: Column, p: Path, value: str) -> Column:
    amount, system, code = values.quantity(value)
    parts = [node(v, *p.segments).isNotNull()]
    if amount is not None:
        parts.append(_decimal(text(v, *p.segments, "value")) == F.lit(str(amount)).cast("decimal(38,18)"))
    if system is not None:
        parts.append(text(v, *p.segments, "system") == system)
    if code is not None:
        parts.append(true(text(v, *p.segments, "code") == code) | true(text(v, *p.segments, "unit") == code))
    return true(reduce(and_, parts))


def near_columns(latitude: Column, longitude: Column, q: values.Near) -> Column:
    """A box that pushes down to plain columns, and the exact distance on the sphere."""
    reach = math.degrees(q.metres / EARTH)
    low, high = q.latitude - reach, q.latitude + reach
    box = latitude.between(low - 1e-9, high + 1e-9)
    if low > -90 and high < 90 and math.sin(math.radians(reach)) < math.cos(math.radians(q.latitude)) and reach < 90:
        wide = math.degrees(math.asin(math.sin(math.radians(reach)) / math.cos(math.radians(q.latitude)))) + 1e-9
        a, z = q.longitude - wide, q.longitude + wide
        if a < -180:
            box &= (longitude >= a + 360) | (longitude <= z)
        elif z > 180:
            box &= (longitude >= a) | (longitude <= z - 360)
        else:
            box &= longitude.between(a, z)
    dlat, dlon = F.radians(latitude - q.latitude), F.radians(longitude - q.longitude)
    h = F.pow(F.sin(dlat / 2), 2) + math.cos(math.radians(q.latitude)) * F.cos(F.radians(latitude)) * F.pow(F.sin(dlon / 2), 2)
    return box & (2 * EARTH * F.asin(F.least(F.sqrt(h), F.lit(1.0))) <= q.metres)


def _near(v: Column, p: Path, value: str) -> Column:
    at = lambda k: text(v, *p.segments, k).try_cast("double")
    return true(near_columns(at("latitude"), at("longitude"), values.near(value)))


def predicate(v: Column, param: Param, value: str) -> Column:
    """Whether a document matches one value of a parameter."""
    if not executable(param):
        raise Invalid(f"{param.code} can't be searched")
    p = param.path
    if param.kind == "token":
        return _token(v, p, value, param.code)
    if param.kind == "uri":
        return true(text(v, *p.segments) == values.plain(value))
    if param.kind == "number":
        return true(_decimal(text(v, *p.segments)) == F.lit(str(values.number(value))).cast("decimal(38,18)"))
    return {"string": _string, "reference": _reference, "date": _date, "quantity": _quantity, "special": _near}[param.kind](v, p, value)


def condition(v: Column, filters: list[tuple[Param, list[str]]]) -> Column:
    """All filters, each by any of its values."""
    return reduce(and_, (reduce(or_, (predicate(v, p, x) for x in xs)) for p, xs in filters), F.lit(True))

"""Datatype rules as columns: each gives an issue text or null."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from medlode.functions.dates import primitive_end, primitive_start
from medlode.functions.variant import node, spread, text

_URI = r"^[A-Za-z][A-Za-z0-9+.-]*:\S+$"


def _bad(wrong: Column, issue: str) -> Column:
    return F.when(F.coalesce(wrong, F.lit(False)), issue)


def whole(value: Column, low: int, high: int) -> Column:
    number = value.try_cast("decimal(38,18)")
    return value.isNotNull() & (number.isNull() | (number != F.floor(number)) | ~number.between(low, high))


#: Datatypes by name: when a text is wrong for it.
WRONG = {
    "date": lambda s: s.isNotNull() & (~s.rlike(r"^\d{4}(-\d\d(-\d\d)?)?$") | primitive_start(s).isNull()),
    "dateTime": lambda s: s.isNotNull() & primitive_start(s).isNull(),
    "instant": lambda s: s.isNotNull() & (~s.rlike(r"T\d\d:\d\d:\d\d(\.\d+)?(Z|[+-]\d\d:\d\d)$") | primitive_start(s).isNull()),
    "integer": lambda s: whole(s, -(1 << 31), (1 << 31) - 1),
    "positiveInt": lambda s: whole(s, 1, (1 << 31) - 1),
    "unsignedInt": lambda s: whole(s, 0, (1 << 31) - 1),
    "integer64": lambda s: s.isNotNull() & s.try_cast("bigint").isNull(),
    "uri": lambda s: s.isNotNull() & ((s == "") | s.rlike(r"\s")),
    "url": lambda s: s.isNotNull() & ~s.rlike(_URI),
    "canonical": lambda s: s.isNotNull() & ~F.regexp_replace(s, r"\|.*$", "").rlike(rf"{_URI}|^#\S+$"),
}


def primitive(v: Column, kind: str, *path: str) -> Column:
    return _bad(WRONG[kind](text(v, *path)), f"{'.'.join(path)}: not a valid {kind}")


def implies(v: Column, path: tuple[str, ...], given: str, needed: str) -> Column:
    """For each element at path: one member needs another (Attachment, ContactPoint, Quantity)."""
    wrong = F.exists(spread(v, *path), lambda x: node(x, given).isNotNull() & node(x, needed).isNull())
    return _bad(wrong, f"{'.'.join(path)}: {given} needs {needed}")


def period(v: Column, *path: str) -> Column:
    """The start may not be after the end; parts that aren't dates are other rules' issues."""
    wrong = F.exists(spread(v, *path), lambda x: primitive_start(text(x, "start")) >= primitive_end(text(x, "end")))
    return _bad(wrong, f"{'.'.join(path)}: start is after end")


def envelope(v: Column, kind: str, key: Column) -> Column:
    wrong = F.coalesce(F.lower(text(v, "resourceType")) != kind.lower(), F.lit(True)) | (text(v, "id") != key)
    return _bad(wrong, "the document is of another type or id")


def issues(resources: DataFrame, rules: list[Column]) -> DataFrame:
    """One row per issue of each resource, all of them."""
    found = F.array_compact(F.array(*rules))
    return resources.select("id", F.explode(found).alias("issue"))

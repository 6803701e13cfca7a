"""VARIANT helpers: paths, safe arrays and existence over elements of unknown shape."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def path(*segments: str) -> str:
    return "$" + "".join(f".{s}" for s in segments)


def node(v: Column, *segments: str) -> Column:
    return F.try_variant_get(v, path(*segments), "variant")


def text(v: Column, *segments: str) -> Column:
    """The value as text; an object or array as JSON; null if absent."""
    return F.try_variant_get(v, path(*segments), "string")


def items(v: Column, *segments: str) -> Column:
    """The elements if it is an array, else null."""
    return F.try_variant_get(v, path(*segments), "array<variant>")


def spread(v: Column, *segments: str) -> Column:
    """The elements of an array, or anything else that is there as a single element; null if absent."""
    return F.coalesce(items(v, *segments), F.when(node(v, *segments).isNotNull(), F.array(node(v, *segments))))


def some(array: Column, holds: Callable[[Column], Column]) -> Column:
    """Whether it holds for an element; false for no array."""
    return F.coalesce(F.exists(array, lambda x: F.coalesce(holds(x), F.lit(False))), F.lit(False))


def true(c: Column) -> Column:
    return F.coalesce(c, F.lit(False))

"""Search values: escapes, alternatives, tokens, quantities and places."""

from __future__ import annotations

import re
from dataclasses import dataclass
from decimal import Decimal, InvalidOperation

from medlode.errors import Invalid

_ESCAPABLE = "$,|\\"


def valid_type(kind: str) -> bool:
    """Whether a type of this name exists."""
    from medlode.plans.registry import TYPES

    return kind in TYPES


def pieces(value: str, by: str) -> list[str]:
    """Splits at unescaped delimiters; other escapes stay for later splits."""
    out, part, k = [], "", 0
    while k < len(value):
        c = value[k]
        if c == "\\":
            if k + 1 >= len(value) or value[k + 1] not in _ESCAPABLE:
                raise Invalid("a backslash may only escape $ , | or itself")
            part, k = part + value[k : k + 2], k + 2
            continue
        if c == by:
            out.append(part)
            part = ""
        else:
            part += c
        k += 1
    return [*out, part]


def plain(value: str) -> str:
    """Takes one level of backslashes off."""
    return re.sub(r"\\(.)", r"\1", value, flags=re.DOTALL)


def alternatives(value: str) -> list[str]:
    found = pieces(value, ",")
    if any(not x for x in found):
        raise Invalid("an alternative is empty")
    return found


def token(value: str) -> tuple[str | None, str]:
    """code, system|code, or |code with the system ''; further bars belong to the code."""
    parts = pieces(value, "|")
    if len(parts) == 1:
        return None, plain(parts[0])
    return plain(parts[0]), plain("|".join(parts[1:]))


def check_identifier(value: str) -> None:
    parts = pieces(value, "|")
    if len(parts) > 2 or any(not p for p in parts):
        raise Invalid("an identifier is value or system|value")


def number(value: str) -> Decimal:
    if value[:2] in ("eq", "ne", "gt", "lt", "ge", "le", "sa", "eb", "ap"):
        raise Invalid("comparators are not supported here")
    try:
        found = Decimal(value)
    except InvalidOperation:
        raise Invalid("not a number") from None
    if not found.is_finite():
        raise Invalid("not a number")
    return found


def quantity(value: str) -> tuple[Decimal | None, str | None, str | None]:
    parts = [*value.split("|"), "", ""][:3]
    return number(parts[0]) if parts[0] else None, parts[1] or None, parts[2] or None


@dataclass(frozen=True)
class Near:
    latitude: float
    longitude: float
    metres: float


def near(value: str) -> Near:
    parts = [*value.split("|"), "", ""]
    try:
        latitude, longitude = float(parts[0]), float(parts[1])
    except ValueError:
        raise Invalid("near is latitude|longitude[|distance[|unit]]") from None
    if not (-90 <= latitude <= 90 and -180 <= longitude <= 180):
        raise Invalid("no such place")
    try:
        distance = float(parts[2])
    except ValueError:
        distance = 5.0
    if not distance > 0:
        raise Invalid("a distance is above 0")
    return Near(latitude, longitude, distance * (1609.344 if parts[3] == "mi" else 1000.0))


def like_pattern(value: str) -> str:
    """The text as a LIKE pattern that contains it; % and _ stay wildcards, lone backslashes go."""
    return "%" + re.sub(r"\\(?![%_\\])", "", plain(value).lower()) + "%"

"""Search: filter, total, order, page and bundle."""

from __future__ import annotations

from dataclasses import dataclass
from urllib.parse import quote, urlencode

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from medlode.errors import Invalid
from medlode.operators.access import Access
from medlode.plans.compile import condition
from medlode.plans.params import Search, beyond, encode_cursor, pairs, parse


@dataclass
class Page:
    total: int
    rows: list
    next: str | None


def scan(resources: DataFrame, access: Access, kind: str) -> DataFrame:
    """The tenant's resources of a type; both columns are partition columns of the table."""
    access.check(kind, "read")
    return resources.where((F.col("tenant_id") == access.tenant) & (F.col("resource_type") == kind))


def matching(resources: DataFrame, access: Access, kind: str, search: Search) -> DataFrame:
    return scan(resources, access, kind).where(condition(F.col("resource"), search.filters))


def ordered(rows: DataFrame, search: Search) -> DataFrame:
    """One row more than a page holds, after the cursor: a top-k, not a sort of all."""
    keys = [F.col(k.column).desc() if k.down else F.col(k.column).asc() for k in search.order]
    return rows.where(beyond(search)).orderBy(*keys).limit(search.count + 1)


def find(resources: DataFrame, access: Access, kind: str, query: str, registry=None) -> Page:
    """Total without the cursor, and a page."""
    search = parse(kind, query, registry)
    rows = matching(resources, access, kind, search)
    total = rows.count()
    if search.count == 0:
        return Page(total, [], None)
    found = ordered(rows, search).select("id", "version_id", "last_updated", F.to_json("resource").alias("resource")).collect()
    kept = found[: search.count]
    more = len(found) > search.count
    after = (encode_cursor(search, kept[-1].asDict()) if search.sort else kept[-1].id) if more else None
    return Page(total, kept, after)


def bundle(page: Page, base: str, kind: str, query: str) -> dict:
    """A searchset with self and next links; order and repeats of parameters stay."""
    own = [p for p in pairs(query) if p[0] != "_after_id"]
    url = lambda ps: f"{base}/{kind}" + (f"?{urlencode(ps, quote_via=quote)}" if ps else "")
    links = [{"relation": "self", "url": url(pairs(query))}]
    if page.next:
        links.append({"relation": "next", "url": url([*own, ("_after_id", page.next)])})
    entries = [{"fullUrl": f"{base}/{kind}/{r.id}", "resource": r.resource, "search": {"mode": "match"}} for r in page.rows]
    return {"resourceType": "Bundle", "type": "searchset", "total": page.total, "link": links, "entry": entries}


def conditional(kind: str, query: str, registry=None) -> Search:
    """The search of a conditional create; one without filters would match everything and is refused."""
    search = parse(kind, query, registry)
    if not search.filters:
        raise Invalid("a condition needs a search parameter")
    return search


def matches_of(resources: DataFrame, access: Access, kind: str, query: str) -> list:
    """At most two ids: enough to tell none, one and many."""
    found = matching(resources, access, kind, conditional(kind, query)).orderBy("id").select("id").limit(2)
    return [r.id for r in found.collect()]

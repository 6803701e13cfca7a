"""Audit events: search, classification and resources."""

from __future__ import annotations

from datetime import datetime, timezone

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from medlode.errors import Invalid
from medlode.functions.dates import FIRST, LAST, sought
from medlode.operators.access import Access
from medlode.plans.params import DEFAULT_COUNT, MAX_COUNT, pairs, whole_number

AUDIT_SCHEMA = "tenant_id string, id string, parent_audit_id string, action string, outcome string, http_status int, subject_id string, resource_type string, resource_id string, interaction string, recorded_at timestamp"
#: The status of a mutation's outcome.
STATUS_OF = {"created": 201, "updated": 200, "patched": 200, "deleted": 204, "existing": 200, "exists": 409, "not-found": 404, "mismatch": 412, "multiple": 412, "invalid": 422}
# Why a child of a bundle failed, by its status.
REASONS = {400: "bad-request", 403: "forbidden", 404: "not-found", 405: "method-not-allowed", 409: "conflict", 412: "precondition-failed"}
_EQUAL = {"_id": "id", "action": "action", "outcome": "outcome", "agent": "subject_id", "code": "interaction"}


def date_range(texts: list[str]) -> tuple[datetime, datetime]:
    """The intersection of eq, ge, gt, le and lt, as [from, to)."""
    low, high = FIRST, LAST
    for t in texts:
        q = sought(t)
        if q.prefix not in ("eq", "ge", "gt", "le", "lt"):
            raise Invalid(f"{q.prefix} is not supported for audit dates")
        if q.prefix in ("eq", "ge", "gt"):
            low = max(low, q.end if q.prefix == "gt" else q.start)
        if q.prefix in ("eq", "le", "lt"):
            high = min(high, q.start if q.prefix == "lt" else q.end)
    if low >= high:
        raise Invalid("the dates leave nothing")
    return low, high


def condition(query: str) -> tuple[Column, int, str | None]:
    """Predicate, count and cursor of an audit query; of repeats other than dates the last counts."""
    out, dates, count, after, given = F.lit(True), [], DEFAULT_COUNT, None, {}
    for name, value in pairs(query):
        if name == "date":
            dates.append(value)
        elif name == "_count":
            count = whole_number(value, 1, MAX_COUNT)
        elif name == "_after_id":
            after = value
        elif name in _EQUAL or name == "entity":
            given[name] = value
        else:
            raise Invalid(f"unknown parameter {name}")
    for name, value in given.items():
        if name == "entity":
            kind, slash, key = value.partition("/")
            out &= F.col("resource_type") == kind
            out = out & (F.col("resource_id") == key) if slash else out
        else:
            out &= F.col(_EQUAL[name]) == value
    if dates:
        low, high = date_range(dates)
        at = F.col("recorded_at").cast("timestamp")
        out &= (at >= F.lit(low.replace(tzinfo=timezone.utc))) & (at < F.lit(high.replace(tzinfo=timezone.utc)))
    return out, count, after


def find(events: DataFrame, access: Access, query: str) -> DataFrame:
    """A page of the tenant's events in order of ids, and one more."""
    access.check("AuditEvent", "auditlog")
    holds, count, after = condition(query)
    own = events.where((F.col("tenant_id") == access.tenant) & holds)
    own = own if after is None else own.where(F.col("id") > after)
    return own.orderBy("id").limit(count + 1)


def outcome_name(status: int) -> str:
    return "success" if status < 400 else "minor-failure" if status < 500 else "serious-failure"


def reason_of(status: Column) -> Column:
    """Why a child of a bundle failed; null if it didn't."""
    known = F.create_map(*[F.lit(x) for kv in REASONS.items() for x in kv])
    return F.when(status >= 400, F.coalesce(known[status.cast("int")], F.lit("server-error")))


def outcome_of(status: Column) -> Column:
    return F.when(status < 400, "success").when(status < 500, "minor-failure").otherwise("serious-failure")


def action_of(method: Column, is_search: Column) -> Column:
    return F.when(is_search, "E").when(method == "POST", "C").when(method == "GET", "R").when(method.isin("PUT", "PATCH"), "U").when(method == "DELETE", "D")


def classify(requests: DataFrame) -> DataFrame:
    """method and path of requests: resource_type, resource_id, action and interaction."""
    part = lambda k: F.nullif(F.get(F.split(F.regexp_replace("path", "^/+fhir/*", ""), "/"), k), F.lit(""))
    out = requests.withColumns({"resource_type": part(0), "resource_id": part(1), "rest": part(2)})
    history = (F.col("rest") == "_history") & F.col("resource_id").isNotNull()
    search = (F.col("method") == "GET") & F.col("resource_id").isNull() & F.col("resource_type").isNotNull()
    names = F.when(history, "history").when(search, "search").when(F.col("resource_type").isNull(), "batch")
    for method, name in (("POST", "create"), ("GET", "read"), ("PUT", "update"), ("PATCH", "patch"), ("DELETE", "delete")):
        names = names.when(F.col("method") == method, name)
    return out.withColumn("interaction", names).withColumn("action", action_of(F.col("method"), search | F.col("resource_type").isNull())).drop("rest")


def resource(events: DataFrame) -> DataFrame:
    """Events as AuditEvent documents (JSON text)."""
    body = F.struct(
        F.lit("AuditEvent").alias("resourceType"),
        "id",
        "action",
        F.date_format("recorded_at", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'").alias("recorded"),
        F.struct(F.struct(F.col("outcome").alias("code")).alias("code")).alias("outcome"),
        F.array(F.struct(F.struct(F.struct(F.col("subject_id").alias("value")).alias("identifier")).alias("who"))).alias("agent"),
        F.array(F.struct(F.struct(F.concat_ws("/", "resource_type", "resource_id").alias("reference")).alias("what"))).alias("entity"),
    )
    return events.select("id", F.to_json(body).alias("resource"))


def of_outcomes(outcomes: DataFrame, method: str, access: Access, at: Column) -> DataFrame:
    """An audit row for each outcome of a mutation, to append in one commit with its history rows."""
    status = F.create_map(*[F.lit(x) for kv in STATUS_OF.items() for x in kv])[F.col("outcome")]
    name = {"POST": "create", "PUT": "update", "PATCH": "patch", "DELETE": "delete"}[method]
    key = F.sha2(F.concat_ws("/", F.lit(access.tenant), "resource_type", "id", F.lit(name), at.cast("string")), 256)
    return outcomes.select(
        F.lit(access.tenant).alias("tenant_id"), key.alias("id"), F.lit(None).cast("string").alias("parent_audit_id"), action_of(F.lit(method), F.lit(False)).alias("action"), outcome_of(status).alias("outcome"),
        status.alias("http_status"), F.lit(access.subject).alias("subject_id"), "resource_type", F.col("id").alias("resource_id"), F.lit(name).alias("interaction"), at.alias("recorded_at"),
    )


def family(events: DataFrame) -> DataFrame:
    """Parents with the number of their children and how many of these failed."""
    kids = events.where(F.col("parent_audit_id").isNotNull()).groupBy(F.col("parent_audit_id").alias("id")).agg(F.count(F.lit(1)).alias("children"), F.count(F.when(F.col("http_status") >= 400, 1)).alias("failed"))
    return events.where("parent_audit_id is null").join(kids, "id", "left").select("id", F.coalesce("children", F.lit(0)).alias("children"), F.coalesce("failed", F.lit(0)).alias("failed"))

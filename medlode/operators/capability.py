"""What can be searched, as a table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from medlode.plans.compile import executable
from medlode.plans.registry import TYPES, builtin

#: What each type's pages take, and what audit events can be searched by.
PAGING = (("_count", "number"), ("_after_id", "string"), ("_sort", "string"))
AUDIT = (("_id", "token"), ("action", "token"), ("code", "token"), ("outcome", "token"), ("agent", "reference"), ("entity", "reference"), ("date", "date"), ("_count", "number"), ("_after_id", "string"))


def capabilities(spark: SparkSession, registry=None) -> DataFrame:
    """A row a type and parameter: generic types with paging and what the registry can run, and the audit log."""
    known = registry or builtin()
    generic = [t for t in TYPES if t != "AuditEvent"]
    rows = [(t, code, kind, "page") for t in generic for code, kind in PAGING]
    rows += [(t, p.code, p.kind, p.path.shape) for t in generic for p in known.get(t, {}).values() if executable(p)]
    rows += [("AuditEvent", code, kind, "column") for code, kind in AUDIT]
    return spark.createDataFrame(rows, "resource_type string, code string, kind string, shape string")


def interactions(spark: SparkSession, registry=None) -> DataFrame:
    """A row a type: what can be done with it, and whether it can be created on a condition."""
    known = registry or builtin()
    every = ["create", "read", "history-instance", "update", "patch", "delete", "search-type"]
    rows = [(t, every, any(map(executable, known.get(t, {}).values())), True) for t in TYPES if t != "AuditEvent"]
    rows.append(("AuditEvent", ["read", "search-type"], False, False))
    return spark.createDataFrame(rows, "resource_type string, interactions array<string>, conditional_create boolean, update_create boolean")

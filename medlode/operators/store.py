"""Versioned mutations over an append-only history; what is current is derived from it.

A history row is tenant_id, resource_type, id, version_id, last_updated, deleted, resource. Each operator takes
the history and a frame of operations (tenant_id, resource_type, id, resource, and version_id where one is
expected; one operation a key) and gives an outcome a key, with the row to append where it succeeded. Only the
history of the operations' tenants, types and keys is read and grouped: tenants and types prune folders, keys
are a semi-join. Large tables meet in as many tasks as their rows need (`tables.dealt`), and many operations are
not broadcast, whatever their estimated size. `commit` appends history and audit rows together. One writer commits
at a time.
"""

from __future__ import annotations

import json
import uuid
from datetime import timezone
from functools import reduce
from operator import or_
from urllib.parse import urlencode

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from medlode.errors import Gone, Invalid, NotFound, Unprocessable
from medlode.plans.params import DEFAULT_COUNT, MAX_COUNT, pairs, whole_number
from medlode.sources import tables
from medlode.sources.tables import dealt

KEY = ["tenant_id", "resource_type", "id"]


def heads(history: DataFrame, *more: Column, by: list[str] = KEY) -> DataFrame:
    """The latest version of each key: version and whether it is a tombstone; and more of its aggregates."""
    out = history.groupBy(*by).agg(F.max(F.struct("version_id", "deleted")).alias("head"), *more)
    return out.select(*by, F.col("head.version_id").alias("head_version"), F.col("head.deleted").alias("head_deleted"), *out.columns[len(by) + 1 :])


def current(history: DataFrame) -> DataFrame:
    """The live resources: the latest version of each key that isn't deleted."""
    rest = [c for c in history.columns if c not in KEY]
    last = history.groupBy(*KEY).agg(F.max_by(F.struct(*rest), "version_id").alias("last"))
    return last.where(~F.col("last.deleted")).select(*KEY, *[F.col(f"last.{c}").alias(c) for c in rest if c != "deleted"])


def touched(history: DataFrame, ops: DataFrame, most: int = 1000) -> tuple[DataFrame, list[str]]:
    """The history of the operations' keys, and the columns that tell these keys apart.

    Up to `most` tenants and types go to the scan as a filter; one that all operations share is no part of the join.
    Spark takes constants out of a join's keys, so rows dealt by them as well would be dealt again. Operations are
    what is dealt, as Spark puts a semi-join below a repartition of its left side; history follows them. Where they are
    more than a task's rows, both this join and a later one with what comes from its rows are merges: estimates of
    pruned columns (a VARIANT counts for 2 KB) are a small part of what a broadcast would hold. Where both sides are mere
    shuffles, Spark deals them anew to the session's partitions if these are more; grouped keys keep the tasks dealt.
    """
    kinds, on = ops.groupBy(*KEY[:2]).count().limit(most + 1).collect(), KEY
    if len(kinds) <= most:
        by: dict[str, set[str]] = {}
        for r in kinds:
            by.setdefault(r.tenant_id, set()).add(r.resource_type)
        history = history.where(reduce(or_, ((F.col("tenant_id") == t) & F.col("resource_type").isin(sorted(ks)) for t, ks in by.items()), F.lit(False)))
        on = [c for c in KEY[:2] if len({r[c] for r in kinds}) > 1] + KEY[2:]
    n = ops.count() if len(kinds) > most else sum(r["count"] for r in kinds)
    keys = dealt(ops.select(*on), history.count() + n, *on)
    if int(ops.sparkSession.conf.get("spark.sql.shuffle.partitions")) > tables.UNHELD:
        keys = keys.distinct()
    return (history.join(keys.hint("merge"), on, "left_semi").hint("merge") if n > tables.TASK_ROWS else history.join(keys, on, "left_semi")), on


def _with(ops: DataFrame, found: DataFrame, on: list[str]) -> DataFrame:
    """Operations with what was found of their keys, if anything."""
    out = ops.join(found, on, "left")
    return out.select(*KEY, *[c for c in out.columns if c not in KEY])


def _met(history: DataFrame, ops: DataFrame) -> DataFrame:
    own, on = touched(history, ops)
    return _with(ops, heads(own, by=on), on).withColumn("live", F.coalesce(~F.col("head_deleted"), F.lit(False)))


def _outcome(met: DataFrame, outcome: Column, version: Column, done: tuple[str, ...]) -> DataFrame:
    met = met.withColumn("outcome", outcome)
    return met.withColumn("new_version", F.when(F.col("outcome").isin(*done), version).cast("long")).drop("head_version", "head_deleted", "live")


def create(history: DataFrame, ops: DataFrame) -> DataFrame:
    """Version 1, refused if the key is or ever was there."""
    ever = F.col("head_version").isNotNull()
    return _outcome(_met(history, ops), F.when(ever, "exists").otherwise("created"), F.lit(1), ("created",))


def upsert(history: DataFrame, ops: DataFrame) -> DataFrame:
    """The next version; created if nothing is live, also after a deletion."""
    return _outcome(_met(history, ops), F.when(F.col("live"), "updated").otherwise("created"), F.coalesce("head_version", F.lit(0)) + 1, ("created", "updated"))


def update(history: DataFrame, ops: DataFrame) -> DataFrame:
    return _outcome(_met(history, ops), F.when(F.col("live"), "updated").otherwise("not-found"), F.col("head_version") + 1, ("updated",))


def compare_and_update(history: DataFrame, ops: DataFrame) -> DataFrame:
    """Updates where version_id is the live version, else a mismatch; so it is for what isn't there."""
    same = F.col("live") & (F.col("version_id") == F.col("head_version"))
    return _outcome(_met(history, ops), F.when(same, "updated").otherwise("mismatch"), F.col("head_version") + 1, ("updated",))


def delete(history: DataFrame, ops: DataFrame) -> DataFrame:
    return _outcome(_met(history, ops), F.when(F.col("live"), "deleted").otherwise("not-found"), F.col("head_version") + 1, ("deleted",))


def compare_and_delete(history: DataFrame, ops: DataFrame) -> DataFrame:
    outcome = F.when(~F.col("live"), "not-found").when(F.col("version_id") == F.col("head_version"), "deleted").otherwise("mismatch")
    return _outcome(_met(history, ops), outcome, F.col("head_version") + 1, ("deleted",))


def appended(history: DataFrame, outcomes: DataFrame, at: Column) -> DataFrame:
    """The history rows of the outcomes that succeeded; a tombstone keeps the last body."""
    done = outcomes.where(F.col("new_version").isNotNull())
    gone = F.col("outcome") == "deleted"
    # bodies of what is deleted alone are read
    own, on = touched(history, done.where(gone))
    done = _with(done, own.groupBy(*on).agg(F.max_by("resource", "version_id").alias("last_body")), on)
    body = F.when(gone, F.col("last_body")).otherwise(F.col("resource"))
    return done.select(*KEY, F.col("new_version").alias("version_id"), at.alias("last_updated"), gone.alias("deleted"), body.alias("resource"))


def read(history: DataFrame, tenant: str, kind: str, key: str):
    """The live resource as a row; deleted and unknown ones are errors."""
    own = history.where((F.col("tenant_id") == tenant) & (F.col("resource_type") == kind) & (F.col("id") == key))
    row = own.orderBy(F.col("version_id").desc()).select("id", "version_id", "last_updated", "deleted", F.to_json("resource").alias("resource")).first()
    if row is None:
        raise NotFound(f"no {kind}/{key}")
    if row.deleted:
        raise Gone(f"{kind}/{key} was deleted")
    return row


def history_query(query: str) -> tuple[int, int | None]:
    """Count and cursor of a history query; nothing else is known, and each may come once."""
    given: dict[str, str] = {}
    for name, value in pairs(query):
        if name not in ("_count", "_after_id"):
            raise Invalid(f"unknown history parameter {name}")
        if name in given:
            raise Invalid(f"{name} may come once")
        given[name] = value
    after = given.get("_after_id")
    return whole_number(given.get("_count", str(DEFAULT_COUNT)), 1, MAX_COUNT), None if after is None else whole_number(after, 1, (1 << 63) - 1)


def version_rows(history: DataFrame, tenant: str, kind: str, key: str, query: str = "") -> DataFrame:
    """A page of the versions of a resource, newest first, and one more: a top-k of one key's rows."""
    count, after = history_query(query)
    own = history.where((F.col("tenant_id") == tenant) & (F.col("resource_type") == kind) & (F.col("id") == key))
    page = own if after is None else own.where(F.col("version_id") < after)
    return page.orderBy(F.col("version_id").desc()).limit(count + 1)


def versions(history: DataFrame, tenant: str, kind: str, key: str, query: str = "") -> tuple[list, int | None]:
    """A page of the versions of a resource, newest first, and the next cursor."""
    count, after = history_query(query)
    rows = version_rows(history, tenant, kind, key, query).select("id", "version_id", "last_updated", "deleted", F.to_json("resource").alias("resource")).collect()
    known = (F.col("tenant_id") == tenant) & (F.col("resource_type") == kind) & (F.col("id") == key)
    if not rows and (after is None or history.where(known).isEmpty()):
        raise NotFound(f"no {kind}/{key}")
    return rows[:count], rows[count - 1].version_id if len(rows) > count else None


def history_bundle(rows: list, kind: str, key: str, base: str, query: str = "", next_cursor: int | None = None) -> dict:
    """A history bundle of a page, with self and next links and without a total."""
    base = base.rstrip("/")
    count, after = history_query(query)
    url = lambda cursor: f"{base}/{kind}/{key}/_history?" + urlencode([("_count", count), *([] if cursor is None else [("_after_id", cursor)])])
    links = [{"relation": "self", "url": url(after)}]
    if next_cursor is not None:
        links.append({"relation": "next", "url": url(next_cursor)})
    entry = lambda r: {
        "fullUrl": f"{base}/{kind}/{r.id}/_history/{r.version_id}",
        "resource": json.loads(r.resource),
        "request": {"method": "DELETE" if r.deleted else "PUT", "url": f"{kind}/{r.id}"},
        "response": {"status": "410 Gone" if r.deleted else "200 OK", "etag": f'W/"{r.version_id}"', "lastModified": r.last_updated.astimezone(timezone.utc).isoformat()},
    }
    return {"resourceType": "Bundle", "type": "history", "link": links, "entry": [entry(r) for r in rows]}


def conditional_create(history: DataFrame, matches: DataFrame, ops: DataFrame) -> DataFrame:
    """Creates what no live resource matches yet.

    matches has a row (op_id, id) for each resource that an operation's search finds; ops have op_id besides the
    key under which they would be created. None creates, one is what exists already, several are refused. Of
    operations with one lock key (see lock_key) the first by op_id decides for the others: they find what it created.
    """
    found = matches.groupBy("op_id").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("found"))
    met = ops.join(found, "op_id", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    first = met.where("n = 0").groupBy("lock").agg(F.min_by("id", "op_id").alias("made"))
    met = met.join(first, "lock", "left")
    late = (F.col("n") == 0) & (F.col("id") != F.col("made"))
    out = met.withColumn("found", F.when(F.col("n") == 1, F.col("found")).when(late, F.col("made")))
    state = F.when(F.col("n") > 1, "multiple").when(F.col("found").isNotNull(), "existing").when(F.col("head_version").isNotNull(), "exists").otherwise("created")
    own, on = touched(history, ops)
    out = _with(out, heads(own, by=on), on).withColumn("live", F.lit(False))
    return _outcome(out, state, F.lit(1), ("created",)).drop("n", "made")


def patch(history: DataFrame, ops: DataFrame) -> DataFrame:
    """JSON Patch over rows: `steps` (JSON text) are applied to live bodies; version_id, if given, has to be live.

    A document that can't be patched, or would change its type or id, is `invalid`; its row stays as it is.
    """
    own, on = touched(history, ops)
    own = _with(ops, heads(own, F.max_by("resource", "version_id").alias("body"), by=on), on)
    own = own.withColumn("live", F.coalesce(~F.col("head_deleted"), F.lit(False))).withColumn("body", F.to_json("body"))
    own = own.withColumn("patched", F.when(F.col("live"), _patched("body", "steps")))
    other = F.col("version_id").isNotNull() & (F.col("version_id") != F.col("head_version"))
    state = F.when(~F.col("live"), "not-found").when(other, "mismatch").when(F.col("patched").isNull(), "invalid").otherwise("patched")
    own = own.withColumn("resource", F.try_parse_json("patched"))
    return _outcome(own, state, F.col("head_version") + 1, ("patched",)).drop("body", "patched")


@F.pandas_udf(StringType())
def _patched(body: pd.Series, steps: pd.Series) -> pd.Series:
    from medlode.operators.bundle import patch as one

    def applied(document, own):
        try:
            return json.dumps(one(json.loads(document), json.loads(own)))
        except (Unprocessable, KeyError, TypeError, ValueError):
            return None

    return pd.Series([applied(d, s) if d and s else None for d, s in zip(body, steps, strict=True)], dtype=object)


def commit(path: str, history_rows: DataFrame, audit_rows: DataFrame) -> str:
    """Appends history rows and their audit rows, both or neither, and returns the commit's id.

    Each commit writes folders of its own; a last write of one row makes them visible, so a writer that dies
    before it leaves nothing that `committed` reads. Current resources are derived from the history.
    """
    key = f"{uuid.uuid4().hex}"
    history_rows.write.partitionBy("tenant_id", "resource_type").parquet(f"{path}/history/commit={key}")
    audit_rows.write.parquet(f"{path}/audit/commit={key}")
    spark = history_rows.sparkSession
    spark.createDataFrame([(key,)], "commit string").coalesce(1).write.mode("append").parquet(f"{path}/commits")
    return key


def committed(spark, path: str, table: str) -> DataFrame:
    """The rows of `history` or `audit` of all commits that were completed."""
    done = spark.read.schema("commit string").parquet(f"{path}/commits").distinct()
    return spark.read.parquet(f"{path}/{table}").join(F.broadcast(done), "commit", "left_semi").drop("commit")


def lock_key(tenant: Column, kind: Column, filters: Column) -> Column:
    """A key for conditional creates: filters are an array of (code, values), put in order."""
    return F.xxhash64(tenant, kind, F.to_json(F.array_sort(F.transform(filters, lambda f: F.struct(f["code"].alias("code"), F.array_sort(f["values"]).alias("values"))))))

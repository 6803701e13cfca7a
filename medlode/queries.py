"""One query for each operator of the engine, over projected resources, and SQL over the raw tables."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from medlode.functions.values import near
from medlode.functions.variant import items, text
from medlode.operators import audit, bundle, capability, search, store, validate
from medlode.operators.access import Access
from medlode.plans.compile import condition, near_columns
from medlode.plans.params import encode_cursor, parse
from medlode.plans.registry import TYPES, Param, Path, builtin, parse_path
from medlode.sources import fixtures as fx
from medlode.sources.tables import shared_dir, stored

MAIN = Access("main")
_Q: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}


def _pad(letter: str, key: str) -> str:
    return f"'{letter}' || lpad(CAST({key} AS VARCHAR), 9, '0')"


def _kept(source, spark: SparkSession, sf_dir: str) -> DataFrame:
    """Projected resources as the table that a user would query: written once, a folder a tenant and type."""
    return stored(source(spark, sf_dir), f"{source.__name__}:{sf_dir}")


def _find(name: str, source, kind: str, query: str, sql: str, tenant: str | None = "main") -> None:
    """Registers a search that gives the ids of all matches."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        rows = _kept(source, spark, sf_dir)
        if tenant:
            return search.matching(rows, Access(tenant), kind, parse(kind, query)).select("id")
        return rows.where(condition(F.col("resource"), parse(kind, query).filters)).select("id")

    _Q[name], _SQL[name] = run, sql


# dates: the interval of a birth date of year, month or day precision
_BIRTH = """
SELECT 'c' || lpad(CAST(c_custkey AS VARCHAR), 9, '0') AS id FROM (
  SELECT c_custkey, CASE c_custkey % 3 WHEN 0 THEN date_trunc('year', d) WHEN 1 THEN date_trunc('month', d) ELSE d END AS s,
         CASE c_custkey % 3 WHEN 0 THEN date_trunc('year', d) + INTERVAL 1 YEAR WHEN 1 THEN date_trunc('month', d) + INTERVAL 1 MONTH ELSE d + INTERVAL 1 DAY END AS e
  FROM (SELECT c_custkey, DATE '1940-01-01' + CAST(c_custkey * 37 % 25000 AS INTEGER) AS d FROM customer)
) WHERE """
for _p, _w in {
    "eq": "s >= DATE '1974-01-01' AND e <= DATE '1975-01-01'",
    "ne": "s < DATE '1974-01-01' OR e > DATE '1975-01-01'",
    "gt": "e > DATE '1975-01-01'",
    "ge": "e > DATE '1974-01-01'",
    "lt": "s < DATE '1974-01-01'",
    "le": "s < DATE '1975-01-01'",
    "sa": "s >= DATE '1975-01-01'",
    "eb": "e <= DATE '1974-01-01'",
    "ap": "s < TIMESTAMP '1975-02-06 12:00:00' AND e > TIMESTAMP '1973-11-25 12:00:00'",
}.items():
    _find(f"date_{_p}", fx.patients, "Patient", f"birthdate={_p}1974", _BIRTH + _w, tenant=None)
_find("date_eq_day", fx.patients, "Patient", "birthdate=le1974-12-25&birthdate=ge1974-12", _BIRTH + "s < DATE '1974-12-26' AND e > DATE '1974-12-01'", tenant=None)

_EVENT, _ORDER, _CUST, _PART, _SUPP = (_pad(a, k) for a, k in (("e", "event_id"), ("o", "o_orderkey"), ("c", "c_custkey"), ("p", "p_partkey"), ("s", "s_suppkey")))
_END = "CASE WHEN o_orderstatus = 'O' THEN DATE '9999-12-31' ELSE CAST(o_orderdate AS DATE) + 8 END"
_find("date_datetime_offset", fx.observations, "Observation", "date=ge2024-01-10T12:30:15%2B01:00", f"SELECT {_EVENT} AS id FROM events WHERE date_trunc('second', ts) + INTERVAL 1 SECOND > TIMESTAMP '2024-01-10 11:30:15'")
_find("date_period_closed", fx.encounters, "Encounter", "date=eq1998", f"SELECT {_ORDER} AS id FROM orders WHERE CAST(o_orderdate AS DATE) >= DATE '1998-01-01' AND {_END} <= DATE '1999-01-01'")
_find("date_period_open", fx.encounters, "Encounter", "date=ge2001-01-01", f"SELECT {_ORDER} AS id FROM orders WHERE {_END} > DATE '2001-01-01'")
_find("date_nested_start", fx.encounters, "Encounter", "date-start=1998-03", f"SELECT {_ORDER} AS id FROM orders WHERE date_trunc('month', o_orderdate) = DATE '1998-03-01'")
_find("date_timing_events", fx.timings, "Observation", "date=gt2024-01-29", f"SELECT {_pad('u', 'user_id')} AS id FROM events GROUP BY user_id HAVING max(date_trunc('second', ts)) + INTERVAL 1 SECOND > TIMESTAMP '2024-01-30'")
_find("date_choice_alternatives", fx.conditions, "Condition", "onset-date=eq1999-06", f"SELECT {_ORDER} AS id FROM orders WHERE CAST(o_orderdate AS DATE) >= DATE '1999-06-01' AND CAST(o_orderdate AS DATE) + CASE WHEN o_orderkey % 2 = 1 THEN 1 ELSE 31 END <= DATE '1999-07-01'")

# strings
_find("string_depth1_contains", fx.organizations, "Organization", "name=0001", f"SELECT {_SUPP} AS id FROM supplier WHERE lower(s_name) LIKE '%0001%'")
_find("string_depth1_json", fx.patients, "Patient", "name=building", f"SELECT {_CUST} AS id FROM customer WHERE lower(c_mktsegment) LIKE '%building%' OR lower(c_name) LIKE '%building%'", tenant=None)
_find("string_depth2_array", fx.patients, "Patient", "given=AUTO", f"SELECT {_CUST} AS id FROM customer WHERE lower(c_mktsegment) LIKE '%auto%'", tenant=None)
_find("string_depth2_scalar", fx.patients, "Patient", "family=0007", f"SELECT {_CUST} AS id FROM customer WHERE lower(c_name) LIKE '%0007%'", tenant=None)
_find("string_wildcard", fx.patients, "Patient", "family=1_3", f"SELECT {_CUST} AS id FROM customer WHERE lower(c_name) LIKE '%1_3%'", tenant=None)
_find("string_depth3", fx.organizations, "Organization", "address-city=1", f"SELECT {_SUPP} AS id FROM supplier JOIN nation ON s_nationkey = n_nationkey WHERE lower(n_name) LIKE '%1%'")
_find("string_or", fx.patients, "Patient", "address-city=nation_1,nation_2", f"SELECT {_CUST} AS id FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE c_custkey % 7 <> 0 AND (lower(n_name) LIKE '%nation_1%' OR lower(n_name) LIKE '%nation_2%')", tenant=None)

# tokens
_find("token_scalar", fx.encounters, "Encounter", "status=F", f"SELECT {_ORDER} AS id FROM orders WHERE o_orderstatus = 'F'")
_find("token_boolean", fx.patients, "Patient", "active=true", f"SELECT {_CUST} AS id FROM customer WHERE c_acctbal >= 0", tenant=None)
_find("token_concept_code", fx.observations, "Observation", "code=click", f"SELECT {_EVENT} AS id FROM events WHERE event_type = 'click'")
_find("token_concept_system", fx.observations, "Observation", "code=urn:event|view,urn:other|click", f"SELECT {_EVENT} AS id FROM events WHERE event_type = 'view'")
_find("token_array_concept", fx.devices, "Device", "type=PROMO", f"SELECT {_PART} AS id FROM part WHERE p_type = 'PROMO'")
_find("token_identifier", fx.patients, "Patient", "identifier=urn:cust|42", f"SELECT {_CUST} AS id FROM customer WHERE c_custkey = 42", tenant=None)
_find("token_identifier_value", fx.patients, "Patient", "identifier=7,8,urn:no|9", f"SELECT {_CUST} AS id FROM customer WHERE c_custkey IN (7, 8)", tenant=None)
_find("token_nested_concept", fx.observations, "Observation", "component-code=urn:part|k3", f"SELECT {_EVENT} AS id FROM events WHERE event_id % 10 = 3")
_find("token_deep", fx.references, "DocumentReference", "language=en", f"SELECT {_pad('d', 'page_id')} AS id FROM pages WHERE page_id % 2 = 0 AND page_id % 4 <> 0")
_find("token_where_email", fx.patients, "Patient", "email=c5@x.org", f"SELECT {_CUST} AS id FROM customer WHERE c_custkey % 100 = 5", tenant=None)
_find("token_exists_true", fx.appointments, "Appointment", "has-recurrence-template=true", f"SELECT {_ORDER} AS id FROM orders WHERE o_orderkey % 4 = 0")
_find("token_exists_false", fx.appointments, "Appointment", "has-recurrence-template=false", f"SELECT {_ORDER} AS id FROM orders WHERE o_orderkey % 4 <> 0")

# references, uris, numbers, quantities, places
_find("reference_single", fx.encounters, "Encounter", "subject=Patient/c000000042", f"SELECT {_ORDER} AS id FROM orders WHERE o_custkey = 42")
_find("reference_array", fx.observations, "Observation", "performer=Practitioner/p3", f"SELECT {_EVENT} AS id FROM events WHERE event_id % 20 = 3")
_find("reference_suffix", fx.encounters, "Encounter", "patient=Patient/c000000007,Patient/c000000008", f"SELECT {_ORDER} AS id FROM orders WHERE o_custkey IN (7, 8)")
_find("reference_where", fx.libraries, "Library", "depends-on=Library/l4", f"SELECT {_PART} AS id FROM part WHERE p_partkey % 2 = 0 AND p_partkey % 9 = 4")
_find("uri_exact", fx.references, "DocumentReference", "location=https://thther.example.org/en/685", f"SELECT {_pad('d', 'page_id')} AS id FROM pages WHERE page_id % 4 <> 0 AND url = 'https://thther.example.org/en/685'")
_find("number_eq", fx.studies, "ResearchStudy", "recruitment-target=11.0", f"SELECT {_PART} AS id FROM part WHERE p_size = 11")
_find("quantity_value", fx.observations, "Observation", "value-quantity=42", f"SELECT {_EVENT} AS id FROM events WHERE event_id % 100 = 42")
_find("quantity_system_code", fx.observations, "Observation", "value-quantity=42.0|urn:unit|pt", f"SELECT {_EVENT} AS id FROM events WHERE event_id % 100 = 42 AND event_id % 3 = 0")
_find("quantity_unit", fx.observations, "Observation", "value-quantity=|urn:unit|points&code=error", f"SELECT {_EVENT} AS id FROM events WHERE event_type = 'error'")
_LAT, _LON = "(s_suppkey * 37 % 180 - 90)", "(s_suppkey * 73 % 360 - 180)"


def _km(lat: float, lon: float) -> str:
    return f"2 * 6371.0 * asin(sqrt(least(1.0, pow(sin(radians({_LAT} - {lat}) / 2), 2) + cos(radians({lat})) * cos(radians({_LAT})) * pow(sin(radians({_LON} - {lon}) / 2), 2))))"


_find("near_km", fx.locations, "Location", "near=10|20|3000|km", f"SELECT {_SUPP} AS id FROM supplier WHERE s_suppkey % 10 <> 0 AND {_km(10, 20)} <= 3000")
_find("near_mi_antimeridian", fx.locations, "Location", "near=5|178|3000|mi", f"SELECT {_SUPP} AS id FROM supplier WHERE s_suppkey % 10 <> 0 AND {_km(5, 178)} <= 4828.032")
_find("near_pole", fx.locations, "Location", "near=85|0|2500", f"SELECT {_SUPP} AS id FROM supplier WHERE s_suppkey % 10 <> 0 AND {_km(85, 0)} <= 2500")
_find("and_repeats", fx.encounters, "Encounter", "status=F&class=IMP&date-start=ge1999", f"SELECT {_ORDER} AS id FROM orders WHERE o_orderstatus = 'F' AND o_orderkey % 2 = 0 AND o_orderdate >= DATE '1999-01-01'")
_find("or_values", fx.encounters, "Encounter", "status=F,P", f"SELECT {_ORDER} AS id FROM orders WHERE o_orderstatus IN ('F', 'P')")
_find("tenant_isolation", fx.patients, "Patient", "active=true,false", f"SELECT {_CUST} AS id FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE r_name = 'ASIA'", tenant="ASIA")


def _query(sql: str | None):
    def keep(f):
        _Q[f.__name__] = f
        if sql:
            _SQL[f.__name__] = sql
        return f

    return keep


# pages and order
@_query(f"SELECT {_ORDER} AS id FROM orders WHERE o_orderstatus = 'F' ORDER BY o_orderkey LIMIT 129")
def page_default(spark, sf_dir):
    s = parse("Encounter", "status=F")
    return search.ordered(search.matching(_kept(fx.encounters, spark, sf_dir), MAIN, "Encounter", s), s).select("id")


@_query(f"SELECT {_ORDER} AS id FROM orders WHERE {_ORDER} > 'o000000100' ORDER BY o_orderkey LIMIT 11")
def page_after_id(spark, sf_dir):
    s = parse("Encounter", "_count=10&_after_id=o000000100")
    return search.ordered(search.matching(_kept(fx.encounters, spark, sf_dir), MAIN, "Encounter", s), s).select("id")


@_query("SELECT count(*) AS total FROM orders WHERE o_orderstatus = 'P'")
def total_only(spark, sf_dir):
    s = parse("Encounter", "status=P&_count=0")
    return search.matching(_kept(fx.encounters, spark, sf_dir), MAIN, "Encounter", s).agg(F.count(F.lit(1)).alias("total"))


@_query(f"SELECT {_ORDER} AS id FROM orders ORDER BY o_orderdate DESC, o_orderkey LIMIT 21")
def sort_lastupdated_desc(spark, sf_dir):
    s = parse("Encounter", "_sort=-_lastUpdated&_count=20")
    return search.ordered(search.matching(_kept(fx.encounters, spark, sf_dir), MAIN, "Encounter", s), s).select("id")


@_query(f"SELECT {_ORDER} AS id FROM orders ORDER BY o_orderdate, o_orderkey DESC LIMIT 31")
def sort_multi_key(spark, sf_dir):
    s = parse("Encounter", "_sort=_lastUpdated,-_id&_count=30")
    return search.ordered(search.matching(_kept(fx.encounters, spark, sf_dir), MAIN, "Encounter", s), s).select("id")


@_query(f"SELECT {_ORDER} AS id FROM orders ORDER BY o_orderdate DESC, o_orderkey LIMIT 11 OFFSET 10")
def keyset_page2(spark, sf_dir):
    rows = _kept(fx.encounters, spark, sf_dir)
    s = parse("Encounter", "_sort=-_lastUpdated&_count=10")
    last = search.ordered(rows, s).select("id", "last_updated").collect()[s.count - 1]
    s.after = encode_cursor(s, last.asDict())
    return search.ordered(rows, s).select("id")


# versions
_LINES = """
WITH v AS (
  SELECT l_orderkey, l_returnflag,
         row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_shipdate, l_extendedprice) AS version_id,
         count(*) OVER (PARTITION BY l_orderkey) AS n
  FROM lineitem),
h AS (SELECT l_orderkey, version_id, l_returnflag, version_id = n AND l_orderkey % 5 = 0 AS deleted FROM v),
heads AS (SELECT l_orderkey, max(version_id) AS head, l_orderkey % 5 = 0 AS gone FROM h GROUP BY l_orderkey)
"""
_LID = _pad("o", "l_orderkey")


@_query(_LINES + f"SELECT {_LID} AS id, version_id FROM h WHERE l_orderkey = 7 ORDER BY version_id DESC LIMIT 3")
def history_page(spark, sf_dir):
    return store.version_rows(_kept(fx.history, spark, sf_dir), "main", "Encounter", "o000000007", "_count=2").select("id", "version_id")


@_query(_LINES + f"SELECT {_LID} AS id, version_id, l_returnflag AS status FROM h JOIN heads USING (l_orderkey) WHERE version_id = head AND NOT gone")
def current_state(spark, sf_dir):
    return store.current(_kept(fx.history, spark, sf_dir)).select("id", "version_id", text(F.col("resource"), "status").alias("status"))


@_query(_LINES + f"SELECT {_LID} AS id, head AS version_id FROM heads WHERE gone")
def tombstones(spark, sf_dir):
    h = store.heads(_kept(fx.history, spark, sf_dir)).where("head_deleted")
    return h.select("id", F.col("head_version").alias("version_id"))


def _ops(spark, sf_dir):
    """An operation for each order; the version expected is 3."""
    o = fx.table(spark, sf_dir, "orders")
    body = F.parse_json(F.to_json(F.struct(F.lit("Encounter").alias("resourceType"), fx.name_of("o", "o_orderkey").alias("id"))))
    return o.select(F.lit("main").alias("tenant_id"), F.lit("Encounter").alias("resource_type"), fx.name_of("o", "o_orderkey").alias("id"), F.lit(3).cast("long").alias("version_id"), body.alias("resource"))


def _mutate(name: str, f, outcome: str, version: str) -> None:
    _Q[name] = lambda spark, sf_dir: f(_kept(fx.history, spark, sf_dir), _ops(spark, sf_dir)).select("id", "outcome", F.coalesce("new_version", F.lit(0)).cast("long").alias("new_version"))
    _SQL[name] = _LINES + f"SELECT {_ORDER} AS id, {outcome} AS outcome, CAST(coalesce({version}, 0) AS BIGINT) AS new_version FROM orders LEFT JOIN heads ON l_orderkey = o_orderkey"


_mutate("create_guard", store.create, "CASE WHEN head IS NULL THEN 'created' ELSE 'exists' END", "CASE WHEN head IS NULL THEN 1 END")
_mutate("upsert_versions", store.upsert, "CASE WHEN head IS NULL OR gone THEN 'created' ELSE 'updated' END", "coalesce(head, 0) + 1")
_mutate("update_existing", store.update, "CASE WHEN head IS NULL OR gone THEN 'not-found' ELSE 'updated' END", "CASE WHEN NOT gone THEN head + 1 END")
_mutate("cas_update_outcomes", store.compare_and_update, "CASE WHEN head = 3 AND NOT gone THEN 'updated' ELSE 'mismatch' END", "CASE WHEN head = 3 AND NOT gone THEN 4 END")
_mutate("delete_outcomes", store.delete, "CASE WHEN head IS NULL OR gone THEN 'not-found' ELSE 'deleted' END", "CASE WHEN NOT gone THEN head + 1 END")
_mutate("cas_delete_outcomes", store.compare_and_delete, "CASE WHEN head IS NULL OR gone THEN 'not-found' WHEN head = 3 THEN 'deleted' ELSE 'mismatch' END", "CASE WHEN head = 3 AND NOT gone THEN 4 END")


@_query(_LINES + f"SELECT {_LID} AS id, head + 1 AS version_id, true AS deleted, l_returnflag AS status FROM heads JOIN h USING (l_orderkey) JOIN orders ON o_orderkey = l_orderkey WHERE version_id = head AND NOT gone")
def appended_tombstones(spark, sf_dir):
    h = _kept(fx.history, spark, sf_dir)
    rows = store.appended(h, store.delete(h, _ops(spark, sf_dir)), F.current_timestamp())
    return rows.select("id", "version_id", "deleted", text(F.col("resource"), "status").alias("status"))


@_query("SELECT name, least(n, 2) AS matches FROM (SELECT 'none' AS name, 0 AS n UNION ALL SELECT 'one', count(*) FROM customer WHERE c_custkey = 42 UNION ALL SELECT 'many', count(*) FROM customer WHERE c_custkey IN (7, 8))")
def conditional_create_matches(spark, sf_dir):
    rows = _kept(fx.patients, spark, sf_dir).withColumn("tenant_id", F.lit("main"))
    found = [(n, len(search.matches_of(rows, MAIN, "Patient", q))) for n, q in (("none", "identifier=no"), ("one", "identifier=42"), ("many", "identifier=7,8"))]
    return spark.createDataFrame(found, "name string, matches bigint")


# audit
@_query(f"SELECT {_EVENT} AS id FROM events WHERE event_type = 'purchase' AND event_id % 10 <> 0")
def audit_action_outcome(spark, sf_dir):
    return fx.audit_events(spark, sf_dir).where(audit.condition("action=U&outcome=success")[0]).select("id")


@_query(f"SELECT {_EVENT} AS id FROM events WHERE ts >= TIMESTAMP '2024-01-05' AND ts < TIMESTAMP '2024-01-08'")
def audit_date_range(spark, sf_dir):
    return fx.audit_events(spark, sf_dir).where(audit.condition("date=ge2024-01-05&date=le2024-01-07&date=gt2024-01-01")[0]).select("id")


@_query(f"SELECT {_EVENT} AS id FROM events WHERE user_id = 7 ORDER BY event_id LIMIT 6")
def audit_entity_page(spark, sf_dir):
    return audit.find(fx.audit_events(spark, sf_dir), MAIN, "entity=Patient/c000000007&_count=5").select("id")


@_query(f"SELECT {_pad('e', 'p.event_id')} AS id, count(c.event_id) AS children, count(CASE WHEN c.event_type = 'error' OR c.event_id % 10 = 0 THEN 1 END) AS failed FROM events p LEFT JOIN events c ON c.event_id - c.event_id % 8 = p.event_id AND c.event_id % 8 <> 0 WHERE p.event_id % 8 = 0 GROUP BY p.event_id")
def audit_parent_children(spark, sf_dir):
    return audit.family(fx.audit_events(spark, sf_dir))


_AUDITED = """
SELECT {id} AS id, '{{"resourceType":"AuditEvent","id":"' || {id} || '","action":"' ||
  CASE event_type WHEN 'signup' THEN 'C' WHEN 'view' THEN 'R' WHEN 'purchase' THEN 'U' WHEN 'click' THEN 'E' ELSE 'D' END ||
  '","recorded":"' || strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') || 'Z","outcome":{{"code":{{"code":"' ||
  CASE WHEN event_type = 'error' THEN 'serious-failure' WHEN event_id % 10 = 0 THEN 'minor-failure' ELSE 'success' END ||
  '"}}}},"agent":[{{"who":{{"identifier":{{"value":"user' || user_id || '"}}}}}}],"entity":[{{"what":{{"reference":"Patient/' || {user} || '"}}}}]}}' AS resource
FROM events
"""


@_query(_AUDITED.format(id=_EVENT, user=_pad("c", "user_id")))
def audit_resources(spark, sf_dir):
    return audit.resource(fx.audit_events(spark, sf_dir))


# validation: rules over projected members, some of them wrong by key
def _checked(spark, sf_dir, fields, rules):
    o = fx.table(spark, sf_dir, "orders")
    rows = fx._resources(o, "Basic", fx.name_of("o", "o_orderkey"), fields)
    return validate.issues(rows, rules(F.col("resource")))


@_query(f"SELECT {_ORDER} AS id, 'period: start is after end' AS issue FROM orders WHERE o_orderkey % 6 = 0")
def validate_period(spark, sf_dir):
    start = F.when(F.col("o_orderkey") % 6 == 0, "2020-06-02").otherwise("2020-06")
    return _checked(spark, sf_dir, {"period": F.struct(start.alias("start"), F.lit("2020-06-01").alias("end"))}, lambda v: [validate.period(v, "period")])


@_query(f"SELECT {_ORDER} AS id, 'telecom: value needs system' AS issue FROM orders WHERE o_orderkey % 5 = 0 UNION ALL SELECT {_ORDER}, 'amount: code needs system' FROM orders WHERE o_orderkey % 4 = 0")
def validate_members(spark, sf_dir):
    k = F.col("o_orderkey")
    fields = {
        "telecom": F.array(F.struct(F.lit("1").alias("value"), F.when(k % 5 != 0, "phone").alias("system"))),
        "amount": F.struct(F.lit("kg").alias("code"), F.when(k % 4 != 0, "urn:u").alias("system")),
    }
    return _checked(spark, sf_dir, fields, lambda v: [validate.implies(v, ("telecom",), "value", "system"), validate.implies(v, ("amount",), "code", "system")])


@_query(f"SELECT {_ORDER} AS id, 'rank: not a valid positiveInt' AS issue FROM orders WHERE o_orderkey % 3 - 1 < 1")
def validate_ints(spark, sf_dir):
    return _checked(spark, sf_dir, {"rank": F.col("o_orderkey") % 3 - 1}, lambda v: [validate.primitive(v, "positiveInt", "rank")])


@_query(f"SELECT {_ORDER} AS id, 'day: not a valid date' AS issue FROM orders WHERE o_orderkey % 40 NOT BETWEEN 1 AND 28")
def validate_date(spark, sf_dir):
    day = F.concat(F.lit("2023-02-"), F.lpad((F.col("o_orderkey") % 40).cast("string"), 2, "0"))
    return _checked(spark, sf_dir, {"day": day}, lambda v: [validate.primitive(v, "date", "day")])


def _capability_sql() -> str:
    """Counts by type and kind: three paging parameters a generic type, and the registry's."""
    typed = ", ".join(f"('{t}', '{p.kind}')" for t, ps in builtin().items() for p in ps.values())
    names = ", ".join(f"('{t}')" for t in TYPES if t != "AuditEvent")
    audited = ", ".join(f"('AuditEvent', '{kind}', {n})" for kind, n in (("token", 4), ("reference", 2), ("date", 1), ("number", 1), ("string", 1)))
    return f"""
    SELECT resource_type, kind, CAST(count(*) AS BIGINT) AS params FROM (
      SELECT * FROM (VALUES {typed}) p(resource_type, kind)
      UNION ALL SELECT resource_type, kind FROM (VALUES {names}) t(resource_type), (VALUES ('number'), ('string'), ('string')) k(kind)
    ) GROUP BY resource_type, kind
    UNION ALL SELECT * FROM (VALUES {audited}) a(resource_type, kind, params)
    """


@_query(_capability_sql())
def capability_counts(spark, sf_dir):
    return capability.capabilities(spark).groupBy("resource_type", "kind").agg(F.count(F.lit(1)).alias("params"))


@_query(f"SELECT resource_type, CASE WHEN resource_type = 'AuditEvent' THEN 2 ELSE 7 END AS n, resource_type IN ({', '.join(repr(t) for t in builtin())}) AS conditional_create FROM (VALUES {', '.join(f'({t!r})' for t in TYPES)}) t(resource_type)")
def capability_interactions(spark, sf_dir):
    return capability.interactions(spark).select("resource_type", F.size("interactions").alias("n"), "conditional_create")


# bundles: a few entries over the history of all orders
def _put(kind: str, key: str, body: dict, version: int | None = None) -> dict:
    match = {"ifMatch": f'W/"{version}"'} if version else {}
    return {"request": {"method": "PUT", "url": f"{kind}/{key}", **match}, "resource": {"resourceType": kind, **body}}


def _transaction(spark, sf_dir):
    ids = iter(["n1", "n2", "audit"])
    entries = [
        {"fullUrl": "urn:uuid:a", "request": {"method": "POST", "url": "Patient"}, "resource": {"resourceType": "Patient"}},
        {"request": {"method": "POST", "url": "Encounter"}, "resource": {"resourceType": "Encounter", "subject": {"reference": "urn:uuid:a"}}},
        {"request": {"method": "DELETE", "url": "Encounter/o000000007"}},
    ]
    return bundle.process(_kept(fx.history, spark, sf_dir), MAIN, "transaction", entries, lambda: next(ids))


@_query(_LINES + f"SELECT 'Patient' AS resource_type, 'n1' AS id, 1 AS version_id, false AS deleted, NULL AS subject UNION ALL SELECT 'Encounter', 'n2', 1, false, 'Patient/n1' UNION ALL SELECT 'Encounter', {_LID}, head + 1, true, NULL FROM heads WHERE l_orderkey = 7")
def bundle_transaction(spark, sf_dir):
    _, rows, _ = _transaction(spark, sf_dir)
    return rows.select("resource_type", "id", "version_id", "deleted", text(F.col("resource"), "subject", "reference").alias("subject"))


@_query("SELECT * FROM (VALUES ('audit', NULL, 'E', 'transaction', 'success'), ('audit.0', 'audit', 'C', 'create', 'success'), ('audit.1', 'audit', 'C', 'create', 'success'), ('audit.2', 'audit', 'D', 'delete', 'success')) a(id, parent_audit_id, action, interaction, outcome)")
def bundle_audit(spark, sf_dir):
    _, _, rows = _transaction(spark, sf_dir)
    return rows.select("id", "parent_audit_id", "action", "interaction", "outcome")


@_query(_LINES + "SELECT * FROM (VALUES (0, '200 OK'), (1, '404 Not Found'), (2, '404 Not Found'), (3, '412 Precondition Failed'), (4, '201 Created'), (5, '410 Gone'), (6, '201 Created'), (7, '400 Bad Request')) r(entry, status)")
def bundle_batch(spark, sf_dir):
    """A live version read, unknown ones read and deleted, a stale version, a new key, deleted ones read and put again, no type."""
    entries = [
        {"request": {"method": "GET", "url": "Encounter/o000000007"}},
        {"request": {"method": "GET", "url": "Encounter/none"}},
        {"request": {"method": "DELETE", "url": "Encounter/none"}},
        _put("Encounter", "o000000007", {}, 999),
        _put("Encounter", "new", {"status": "planned"}),
        {"request": {"method": "GET", "url": "Encounter/o000000005"}},
        _put("Encounter", "o000000005", {}),
        {"request": {"method": "GET", "url": "Nothing/1"}},
    ]
    out, _, _ = bundle.process(_kept(fx.history, spark, sf_dir), MAIN, "batch", entries)
    return spark.createDataFrame([(k, r["response"]["status"]) for k, r in enumerate(out)], "entry int, status string")


# conditional creates, patches and commits
def _creates(spark, sf_dir):
    """Two operations a part: each looks for patients whose number ends like the part's."""
    parts = fx.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("k")).crossJoin(spark.range(2).select(F.col("id").alias("again")))
    ops = parts.select((F.col("k") * 2 + F.col("again")).alias("op_id"), F.lit("ASIA").alias("tenant_id"), F.lit("Patient").alias("resource_type"), F.concat(F.lit("x"), F.col("k") * 2 + F.col("again")).alias("id"), "k")
    ops = ops.withColumn("lock", store.lock_key(F.col("tenant_id"), F.col("resource_type"), F.array(F.struct(F.lit("identifier").alias("code"), F.array(F.col("k").cast("string")).alias("values")))))
    body = F.parse_json(F.to_json(F.struct(F.lit("Patient").alias("resourceType"), F.col("id").alias("id"))))
    found = _kept(fx.patients, spark, sf_dir).select(F.col("id").alias("found"), F.explode(items(F.col("resource"), "identifier")).alias("x"))
    found = found.select("found", F.pmod(text(F.col("x"), "value").cast("long"), F.lit(1200)).alias("number"))
    matches = ops.join(found, F.col("k") == F.col("number")).select("op_id", F.col("found").alias("id"))
    return matches, ops.withColumn("resource", body).drop("k")


@_query(f"""
WITH found AS (SELECT p_partkey AS k, count(c_custkey) AS n, min({_CUST}) AS one FROM part LEFT JOIN customer ON c_custkey % 1200 = p_partkey GROUP BY p_partkey)
SELECT k * 2 + again AS op_id, CASE WHEN n > 1 THEN 'multiple' WHEN n = 1 OR again = 1 THEN 'existing' ELSE 'created' END AS outcome,
       CASE WHEN n = 1 THEN one WHEN n = 0 AND again = 1 THEN 'x' || (k * 2) END AS found, CAST(CASE WHEN n = 0 AND again = 0 THEN 1 END AS BIGINT) AS new_version
FROM found, (VALUES (0), (1)) v(again)
""")
def conditional_create_outcomes(spark, sf_dir):
    matches, ops = _creates(spark, sf_dir)
    return store.conditional_create(_kept(fx.history, spark, sf_dir), matches, ops).select("op_id", "outcome", "found", "new_version")


@_query(_LINES + f"""
SELECT {_ORDER} AS id, CASE WHEN head IS NULL OR gone THEN 'not-found' WHEN o_orderkey % 3 = 0 THEN 'invalid' ELSE 'patched' END AS outcome,
       CAST(CASE WHEN NOT gone AND o_orderkey % 3 <> 0 THEN head + 1 END AS BIGINT) AS new_version, CASE WHEN NOT gone AND o_orderkey % 3 <> 0 THEN 'done' END AS status
FROM orders LEFT JOIN heads ON l_orderkey = o_orderkey
""")
def patch_rows(spark, sf_dir):
    """A patch of each order's status; for each third one a test fails."""
    steps = F.when(F.col("o_orderkey") % 3 == 0, '[{"op":"test","path":"/id","value":"?"}]').otherwise('[{"op":"replace","path":"/status","value":"done"}]')
    ops = fx.table(spark, sf_dir, "orders").select(F.lit("main").alias("tenant_id"), F.lit("Encounter").alias("resource_type"), fx.name_of("o", "o_orderkey").alias("id"), F.lit(None).cast("long").alias("version_id"), steps.alias("steps"))
    return store.patch(_kept(fx.history, spark, sf_dir), ops).select("id", "outcome", "new_version", text(F.col("resource"), "status").alias("status"))


@_query(_LINES + "SELECT 'history' AS kind, count(*) AS n FROM heads JOIN orders ON l_orderkey = o_orderkey WHERE NOT gone UNION ALL SELECT 'audit ' || CASE WHEN head IS NULL OR gone THEN 'minor-failure' ELSE 'success' END, count(*) FROM orders LEFT JOIN heads ON l_orderkey = o_orderkey GROUP BY ALL")
def committed_deletes(spark, sf_dir):
    """Deletes of all orders, committed with their audit rows and read back."""
    history = _kept(fx.history, spark, sf_dir)
    outcomes = store.delete(history, _ops(spark, sf_dir))
    at = F.lit("2024-05-01T00:00:00Z").cast("timestamp")
    path = f"{shared_dir(spark)}/log-{uuid.uuid4().hex}"
    store.commit(path, store.appended(history, outcomes, at), audit.of_outcomes(outcomes, "DELETE", MAIN, at))
    rows = store.committed(spark, path, "history").select(F.lit("history").alias("kind"))
    rows = rows.unionByName(store.committed(spark, path, "audit").select(F.concat(F.lit("audit "), "outcome").alias("kind")))
    return rows.groupBy("kind").agg(F.count(F.lit(1)).alias("n"))


# point reads, searchsets and requests
@_query(f"SELECT {_EVENT} AS id, 'U' AS action FROM events WHERE event_id = 7 AND event_type = 'purchase' UNION ALL SELECT {_EVENT}, CASE event_type WHEN 'signup' THEN 'C' WHEN 'view' THEN 'R' WHEN 'click' THEN 'E' ELSE 'D' END FROM events WHERE event_id = 7 AND event_type <> 'purchase'")
def audit_point_read(spark, sf_dir):
    return audit.find(fx.audit_events(spark, sf_dir), MAIN, "_id=e000000007").select("id", "action")


@_query(_LINES + f"SELECT {_LID} AS id, head AS version_id, l_returnflag AS status FROM heads JOIN h USING (l_orderkey) WHERE l_orderkey = 7 AND version_id = head")
def point_read(spark, sf_dir):
    row = store.read(_kept(fx.history, spark, sf_dir), "main", "Encounter", "o000000007")
    return spark.createDataFrame([(row.id, row.version_id, row.resource)], "id string, version_id bigint, body string").select("id", "version_id", F.get_json_object("body", "$.status").alias("status"))


@_query(f"SELECT 'total' AS part, CAST(count(*) AS VARCHAR) AS value FROM orders WHERE o_orderstatus = 'P' UNION ALL SELECT 'self', 'https://x/Encounter?status=P&_count=2&status=P%2CP' UNION ALL (SELECT 'entry', 'https://x/Encounter/' || {_ORDER} FROM orders WHERE o_orderstatus = 'P' ORDER BY o_orderkey LIMIT 2) UNION ALL SELECT 'next', 'https://x/Encounter?status=P&_count=2&status=P%2CP&_after_id=' || max(id) FROM (SELECT {_ORDER} AS id FROM orders WHERE o_orderstatus = 'P' ORDER BY o_orderkey LIMIT 2)")
def searchset(spark, sf_dir):
    """A page's total, links and entries; parameters keep their order and repeats."""
    query = "status=P&_count=2&status=P,P"
    page = search.find(_kept(fx.encounters, spark, sf_dir), MAIN, "Encounter", query)
    found = search.bundle(page, "https://x", "Encounter", query)
    rows = [("total", str(found["total"]))] + [(x["relation"], x["url"]) for x in found["link"]] + [("entry", x["fullUrl"]) for x in found["entry"]]
    return spark.createDataFrame(rows, "part string, value string")


@_query(f"SELECT {_EVENT} AS id, CASE event_id % 5 WHEN 0 THEN 'search' WHEN 1 THEN 'read' WHEN 2 THEN 'history' WHEN 3 THEN 'delete' ELSE 'batch' END AS interaction, CASE event_id % 5 WHEN 0 THEN 'E' WHEN 1 THEN 'R' WHEN 2 THEN 'R' WHEN 3 THEN 'D' ELSE 'E' END AS action FROM events")
def classified_requests(spark, sf_dir):
    k = F.col("event_id") % 5
    method = F.when(k == 3, "DELETE").when(k == 4, "POST").otherwise("GET")
    path = F.when(k == 0, "/fhir/Patient").when(k == 2, "/fhir/Patient/1/_history").when(k == 4, "/fhir").otherwise("/fhir/Patient/1")
    rows = fx.table(spark, sf_dir, "events").select(fx.name_of("e", "event_id").alias("id"), method.alias("method"), path.alias("path"))
    return audit.classify(rows).select("id", "interaction", "action")


# shapes that no entry of the registry has
def _shape(name: str, param: Param, value: str, fields, sql: str) -> None:
    def run(spark, sf_dir):
        rows = fx._resources(fx.table(spark, sf_dir, "orders"), "Basic", fx.name_of("o", "o_orderkey"), fields())
        return stored(rows, f"{name}:{sf_dir}").where(condition(F.col("resource"), [(param, [value])])).select("id")

    _Q[name], _SQL[name] = run, sql


def _stages() -> dict:
    day = lambda n: F.date_format(F.date_add(F.col("o_orderdate").cast("date"), n), "yyyy-MM-dd")
    return {"stage": F.array(*[F.struct(F.lit(kind).alias("kind"), day(n).alias("when"), F.concat(F.lit(f"{kind} "), F.col("o_orderpriority")).alias("note")) for kind, n in (("start", 0), ("end", 8))])}


_shape("string_where", Param("note", "string", parse_path("where:stage[kind=end].note")), "END 1", _stages, f"SELECT {_ORDER} AS id FROM orders WHERE lower('end ' || o_orderpriority) LIKE '%end 1%'")
_shape("date_where", Param("ended", "date", parse_path("where:stage[kind=end].when")), "ge1998-03", _stages, f"SELECT {_ORDER} AS id FROM orders WHERE CAST(o_orderdate AS DATE) + 8 >= DATE '1998-03-01'")
_shape(
    "reference_deep_array",
    Param("team", "reference", Path("field", ("care", "team"))),
    "Practitioner/p3",
    lambda: {"care": F.struct(F.array(*[F.struct(F.concat(F.lit("Practitioner/p"), (F.col("o_orderkey") % n).cast("string")).alias("reference")) for n in (50, 7)]).alias("team"))},
    f"SELECT {_ORDER} AS id FROM orders WHERE o_orderkey % 50 = 3 OR o_orderkey % 7 = 3",
)


@_query(f"SELECT {_SUPP} AS id FROM supplier WHERE s_suppkey % 10 <> 0 AND {_km(10, 20)} <= 3000")
def near_indexed(spark, sf_dir):
    """Typed coordinates: the box reaches the scan."""
    key = F.col("s_suppkey")
    places = fx.table(spark, sf_dir, "supplier").where(key % 10 != 0).select(F.lit("main").alias("tenant_id"), F.lit("Location").alias("resource_type"), fx.name_of("s", "s_suppkey").alias("id"), (key * 37 % 180 - 90).cast("double").alias("latitude"), (key * 73 % 360 - 180).cast("double").alias("longitude"))
    return stored(places, f"places:{sf_dir}").where(near_columns(F.col("latitude"), F.col("longitude"), near("10|20|3000|km"))).select("id")


@_query(f"""
SELECT {_ORDER} AS id, 'big: not a valid integer64' AS issue FROM orders WHERE o_orderkey % 3 = 0
UNION ALL SELECT {_ORDER}, 'link: not a valid url' FROM orders WHERE o_orderkey % 4 = 0
UNION ALL SELECT {_ORDER}, 'photo: data needs contentType' FROM orders WHERE o_orderkey % 5 = 0
""")
def validate_texts(spark, sf_dir):
    k = F.col("o_orderkey")
    fields = {
        "big": F.when(k % 3 == 0, "9223372036854775808").otherwise("9223372036854775807"),
        "link": F.when(k % 4 == 0, "no scheme").otherwise("https://a/b"),
        "photo": F.struct(F.lit("aGk=").alias("data"), F.when(k % 5 != 0, "text/plain").alias("contentType")),
    }
    return _checked(spark, sf_dir, fields, lambda v: [validate.primitive(v, "integer64", "big"), validate.primitive(v, "url", "link"), validate.implies(v, ("photo",), "data", "contentType")])


def load(spark: SparkSession, sf_dir: str) -> None:
    """Writes the resource tables that searches and versions read; else the first query of each does."""
    for source in (fx.patients, fx.encounters, fx.observations, fx.organizations, fx.conditions, fx.timings, fx.locations, fx.devices, fx.studies, fx.libraries, fx.references, fx.appointments, fx.history):
        _kept(source, spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_Q)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)

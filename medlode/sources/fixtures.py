"""Resources projected from the star-schema tables; all derived values are integer arithmetic."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from medlode.sources.tables import dealt


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def name_of(letter: str, key: str) -> Column:
    return F.concat(F.lit(letter), F.lpad(F.col(key).cast("string"), 9, "0"))


def _resources(rows: DataFrame, kind: str, key: Column, fields: dict[str, Column], tenant: Column | None = None, updated: Column | None = None) -> DataFrame:
    body = F.to_json(F.struct(F.lit(kind).alias("resourceType"), key.alias("id"), *[c.alias(n) for n, c in fields.items()]))
    return rows.select((F.lit("main") if tenant is None else tenant).alias("tenant_id"), F.lit(kind).alias("resource_type"), key.alias("id"), F.lit(1).cast("long").alias("version_id"), (F.lit("2024-01-01T00:00:00Z").cast("timestamp") if updated is None else updated.cast("timestamp")).alias("last_updated"), F.parse_json(body).alias("resource"))


def _coding(system: str, code: Column) -> Column:
    return F.struct(F.array(F.struct(F.lit(system).alias("system"), code.alias("code"))).alias("coding"))


def patients(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer").join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    key = F.col("c_custkey")
    day = F.date_add(F.lit("1940-01-01").cast("date"), (key * 37 % 25000).cast("int"))
    birth = F.when(key % 3 == 0, F.date_format(day, "yyyy")).when(key % 3 == 1, F.date_format(day, "yyyy-MM")).otherwise(F.date_format(day, "yyyy-MM-dd"))
    fields = {
        "name": F.array(F.struct(F.col("c_name").alias("family"), F.array("c_mktsegment").alias("given"))),
        "active": F.col("c_acctbal") >= 0,
        "identifier": F.array(F.struct(F.lit("urn:cust").alias("system"), key.cast("string").alias("value"))),
        "telecom": F.array(F.struct(F.lit("phone").alias("system"), F.concat(F.lit("+1-"), key.cast("string")).alias("value")), F.struct(F.lit("email").alias("system"), F.concat(F.lit("c"), (key % 100).cast("string"), F.lit("@x.org")).alias("value"))),
        "address": F.when(key % 7 != 0, F.array(F.struct(F.col("n_name").alias("city"), F.col("r_name").alias("country")))),
        "birthDate": birth,
    }
    return _resources(c, "Patient", name_of("c", "c_custkey"), fields, F.col("r_name"))


def encounters(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    end = F.when(F.col("o_orderstatus") != "O", F.date_format(F.date_add(F.col("o_orderdate").cast("date"), 7), "yyyy-MM-dd"))
    fields = {
        "status": F.col("o_orderstatus"),
        "subject": F.struct(F.concat(F.lit("Patient/"), name_of("c", "o_custkey")).alias("reference")),
        "type": F.array(_coding("urn:priority", F.col("o_orderpriority"))),
        "class": F.array(_coding("urn:class", F.when(F.col("o_orderkey") % 2 == 0, "IMP").otherwise("AMB"))),
        "participant": F.array(F.struct(F.struct(F.concat(F.lit("Practitioner/p"), (F.col("o_orderkey") % 50).cast("string")).alias("reference")).alias("actor"))),
        "actualPeriod": F.struct(F.date_format("o_orderdate", "yyyy-MM-dd").alias("start"), end.alias("end")),
    }
    return _resources(o, "Encounter", name_of("o", "o_orderkey"), fields, updated=F.col("o_orderdate"))


def observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    shifted = F.date_format(F.col("ts") + F.expr("INTERVAL 1 HOUR"), "yyyy-MM-dd'T'HH:mm:ss'+01:00'")
    when = F.when(F.col("event_id") % 2 == 0, F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'")).otherwise(shifted)
    cents = F.round(F.col("value") * 100).cast("long")
    fields = {
        "status": F.lit("final"),
        "code": _coding("urn:event", F.col("event_type")),
        "subject": F.struct(F.concat(F.lit("Patient/"), name_of("c", "user_id")).alias("reference")),
        "effectiveDateTime": when,
        "valueQuantity": F.struct((F.col("event_id") % 100).alias("value"), F.lit("points").alias("unit"), F.lit("urn:unit").alias("system"), F.when(F.col("event_id") % 3 == 0, "pt").otherwise("sc").alias("code")),
        "component": F.array(F.struct(_coding("urn:part", F.concat(F.lit("k"), (F.col("event_id") % 10).cast("string"))).alias("code"))),
        "performer": F.array(F.struct(F.concat(F.lit("Practitioner/p"), (F.col("event_id") % 20).cast("string")).alias("reference"))),
        "valueString": cents.cast("string"),
    }
    return _resources(e, "Observation", name_of("e", "event_id"), fields)


def timings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One Observation a user, with the times of up to all of the user's events of a day in January."""
    e = table(spark, sf_dir, "events").groupBy("user_id").agg(F.collect_list(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'")).alias("event"))
    return _resources(e, "Observation", name_of("u", "user_id"), {"effectiveTiming": F.struct("event")})


def conditions(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    day = F.date_format("o_orderdate", "yyyy-MM-dd")
    odd = F.col("o_orderkey") % 2 == 1
    fields = {"onsetDateTime": F.when(odd, day), "onsetPeriod": F.when(~odd, F.struct(day.alias("start"), F.date_format(F.date_add(F.col("o_orderdate").cast("date"), 30), "yyyy-MM-dd").alias("end")))}
    return _resources(o, "Condition", name_of("o", "o_orderkey"), fields)


def locations(spark: SparkSession, sf_dir: str) -> DataFrame:
    s, key = table(spark, sf_dir, "supplier"), F.col("s_suppkey")
    at = F.when(key % 10 != 0, F.struct((key * 37 % 180 - 90).alias("latitude"), (key * 73 % 360 - 180).alias("longitude")))
    return _resources(s, "Location", name_of("s", "s_suppkey"), {"name": F.col("s_name"), "position": at})


def organizations(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "supplier").join(table(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    return _resources(s, "Organization", name_of("s", "s_suppkey"), {"name": F.col("s_name"), "contact": F.array(F.struct(F.struct(F.col("n_name").alias("city")).alias("address")))})


def devices(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _resources(table(spark, sf_dir, "part"), "Device", name_of("p", "p_partkey"), {"type": F.array(_coding("urn:type", F.col("p_type"))), "manufacturer": F.col("p_brand")})


def studies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _resources(table(spark, sf_dir, "part"), "ResearchStudy", name_of("p", "p_partkey"), {"recruitment": F.struct(F.col("p_size").alias("targetNumber"))})


def libraries(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("p_partkey")
    kind = F.when(key % 2 == 0, "depends-on").otherwise("composed-of")
    return _resources(table(spark, sf_dir, "part"), "Library", name_of("p", "p_partkey"), {"relatedArtifact": F.array(F.struct(kind.alias("type"), F.concat(F.lit("Library/l"), (key % 9).cast("string")).alias("resource")))})


def references(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents of pages; the content is an object, or for each fourth an array, which deep paths don't enter."""
    p = table(spark, sf_dir, "pages")
    one = F.struct(F.struct("url", F.when(F.col("page_id") % 2 == 0, "en").otherwise("de").alias("language")).alias("attachment"))
    body = F.when(F.col("page_id") % 4 != 0, F.parse_json(F.to_json(one))).otherwise(F.parse_json(F.to_json(F.array(one))))
    return _resources(p, "DocumentReference", name_of("d", "page_id"), {"content": body})


def appointments(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey") % 4
    state = F.when(k == 0, F.parse_json(F.lit('{"a":1}'))).when(k == 1, F.parse_json(F.lit("false"))).when(k == 2, F.parse_json(F.lit("null")))
    return _resources(table(spark, sf_dir, "orders"), "Appointment", name_of("o", "o_orderkey"), {"recurrenceTemplate": state})


def history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Versions of Encounters: lines of an order by rank; the last is a tombstone for each fifth order."""
    from pyspark.sql import Window

    line = table(spark, sf_dir, "lineitem")
    line = dealt(line, line.count(), "l_orderkey")
    by = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", "l_extendedprice")
    v = line.withColumn("version_id", F.row_number().over(by).cast("long")).withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("l_orderkey")))
    gone = (F.col("version_id") == F.col("n")) & (F.col("l_orderkey") % 5 == 0)
    body = F.to_json(F.struct(F.lit("Encounter").alias("resourceType"), name_of("o", "l_orderkey").alias("id"), F.col("l_returnflag").alias("status")))
    return v.select(F.lit("main").alias("tenant_id"), F.lit("Encounter").alias("resource_type"), name_of("o", "l_orderkey").alias("id"), "version_id", F.col("l_shipdate").cast("timestamp").alias("last_updated"), gone.alias("deleted"), F.parse_json(body).alias("resource"))


def audit_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    e, key = table(spark, sf_dir, "events"), F.col("event_id")
    action = F.when(F.col("event_type") == "signup", "C").when(F.col("event_type") == "view", "R").when(F.col("event_type") == "purchase", "U").when(F.col("event_type") == "click", "E").otherwise("D")
    status = F.when(F.col("event_type") == "error", 500).when(key % 10 == 0, 404).otherwise(200).cast("short")
    outcome = F.when(status < 400, "success").when(status < 500, "minor-failure").otherwise("serious-failure")
    parent = F.when(key % 8 != 0, F.concat(F.lit("e"), F.lpad((key - key % 8).cast("string"), 9, "0")))
    return e.select(F.lit("main").alias("tenant_id"), name_of("e", "event_id").alias("id"), parent.alias("parent_audit_id"), action.alias("action"), outcome.alias("outcome"), status.alias("http_status"), F.concat(F.lit("user"), F.col("user_id").cast("string")).alias("subject_id"), F.lit("Patient").alias("resource_type"), name_of("c", "user_id").alias("resource_id"), F.lit("read").alias("interaction"), F.col("ts").cast("timestamp").alias("recorded_at"))

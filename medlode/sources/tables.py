"""Reading and writing resources: JSON lines in, partitioned VARIANT tables out."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from medlode.functions.variant import text

LARGEST = 10 * 1024 * 1024
#: Rows that a task gets, about at most, where rows meet by key.
TASK_ROWS = 1 << 18
#: Tasks to which a task deals its rows without holding them: Spark's spark.shuffle.sort.bypassMergeThreshold.
UNHELD = 200


def dealt(rows: DataFrame, n: int, *keys: str) -> DataFrame:
    """Rows for a step that brings n rows together by these keys: dealt to a fixed number of tasks where one would get over TASK_ROWS.

    The session's number of partitions alone doesn't bound a task's rows, as Spark puts its partitions together until
    there are about as many as cores. It is kept where it is enough; what exceeds it is a power of two, so that steps
    of about as many rows deal alike and meet without another shuffle. Over UNHELD tasks, each of those that read would
    hold all rows of its part of a file (671 MB of 72M lines), so there are more only from 8 x TASK_ROWS rows a task on,
    also where the session has more partitions.
    """
    need, own = -(-n // TASK_ROWS), int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    if need <= min(own, rows.sparkSession.sparkContext.defaultParallelism):
        return rows
    held, kept = -(-n // (8 * TASK_ROWS)), min(own, UNHELD)
    tasks = _power(held) if held > UNHELD else kept if need <= kept else min(_power(need), UNHELD)
    return rows.repartition(tasks, *keys)


def _power(n: int) -> int:
    return 1 << (n - 1).bit_length()


def ingest_json(spark: SparkSession, path: str, tenant: str) -> DataFrame:
    """Resources from JSON lines; lines that are too large, or no objects with type and id, are left out."""
    v = F.try_parse_json("value")
    own = spark.read.text(path).where(F.octet_length("value") <= LARGEST).select(v.alias("resource"))
    own = own.select(F.lit(tenant).alias("tenant_id"), text(F.col("resource"), "resourceType").alias("resource_type"), text(F.col("resource"), "id").alias("id"), "resource")
    return own.where(F.col("resource_type").isNotNull() & F.col("id").isNotNull())


def refused_lines(spark: SparkSession, path: str) -> DataFrame:
    """How many lines ingest_json leaves out, by reason."""
    line, v = F.col("value"), F.try_parse_json("value")
    why = F.when(F.octet_length(line) > LARGEST, "too large").when(v.isNull(), "not JSON").when(text(v, "resourceType").isNull(), "no type").when(text(v, "id").isNull(), "no id")
    return spark.read.text(path).select(why.alias("reason")).where("reason is not null").groupBy("reason").agg(F.count(F.lit(1)).alias("lines"))


def write_resources(resources: DataFrame, path: str, mode: str = "append") -> None:
    """One folder a tenant and type, so that both prune; each type's rows go to few files, and a task to which many fall is split.

    Spark splits by size, which bounds no rows where they are small on disk. So a table of more than a share of
    TASK_ROWS for each core is dealt by rows: tenants and types of more than a share to as many tasks as they have
    shares, versions of one id too, and others to one task each.
    """
    kind = ["tenant_id", "resource_type"]
    counted, large = resources.groupBy(*kind).count(), F.col("count") > TASK_ROWS
    # a row for each large one, which are few, and one for all others
    shares = counted.groupBy(large.alias("large"), *[F.when(large, F.col(c)).alias(c) for c in kind]).agg(F.sum("count").alias("n")).collect()
    tasks = [-(-r.n // TASK_ROWS) for r in shares]
    if sum(tasks) <= resources.sparkSession.sparkContext.defaultParallelism:
        pieces = resources.withColumn("_piece", F.pmod(F.xxhash64("id"), F.lit(32))).hint("rebalance", *kind, "_piece").drop("_piece")
    else:
        own, at = F.xxhash64(*[c for c in ("id", "version_id") if c in resources.columns]), F.lit(0)
        starts = [(r, sum(tasks[:i]), n) for i, (r, n) in enumerate(zip(shares, tasks, strict=True))]
        for r, start, n in sorted(starts, key=lambda s: s[0].large):
            place = start + F.pmod(own if r.large else F.xxhash64(*kind), F.lit(n))
            at = F.when(F.col(kind[0]).eqNullSafe(r.tenant_id) & F.col(kind[1]).eqNullSafe(r.resource_type), place).otherwise(at) if r.large else place
        pieces = resources.repartitionById(sum(tasks), at.cast("int"))
    # sorted as a partitioned write needs it, which would sort again else
    pieces.sortWithinPartitions(*kind, "id").write.mode(mode).partitionBy(*kind).parquet(path)


def read_resources(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, else one in the warehouse."""
    own = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    return own or spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_medlode"


_written: dict[tuple[str, str], str] = {}


def stored(resources: DataFrame, name: str) -> DataFrame:
    """The table of this name, written on its first use in a session: documents are parsed once, not per predicate."""
    spark = resources.sparkSession
    key = (spark.sparkContext.applicationId, name)
    if key not in _written:
        path = f"{shared_dir(spark)}/resources-{uuid.uuid4().hex}"
        write_resources(resources, path, "errorifexists")
        _written[key] = path
    return spark.read.schema(resources.schema).parquet(_written[key])


def export_json(resources: DataFrame, path: str) -> None:
    resources.select(F.to_json("resource")).write.mode("overwrite").text(path)

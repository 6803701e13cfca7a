"""A stream of JSON resources into the history: first versions as they arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from medlode.functions.variant import text


def resources(spark: SparkSession, folder: str, tenant: str) -> DataFrame:
    """Resources of JSON-lines files that come into a folder."""
    own = spark.readStream.text(folder).select(F.try_parse_json("value").alias("resource"))
    own = own.select(F.lit(tenant).alias("tenant_id"), text(F.col("resource"), "resourceType").alias("resource_type"), text(F.col("resource"), "id").alias("id"), "resource")
    return own.where(F.col("resource_type").isNotNull() & F.col("id").isNotNull())


def append(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    rows = stream.withColumn("version_id", F.lit(1).cast("long")).withColumn("last_updated", F.current_timestamp()).withColumn("deleted", F.lit(False))
    return rows.writeStream.format("parquet").option("checkpointLocation", checkpoint).partitionBy("tenant_id", "resource_type").start(path)

"""A corpus pipeline of five stages; each reads all that the one before it kept.

Language ID drops documents without a language or between two; the n-gram join keeps one document of each
class; decontamination drops documents that hold a window of ten words of a benchmark item; the mix repeats or
leaves out documents until sources have their shares; sharding deals what is left into shards.
Ids needn't differ between rows, as the mix repeats documents. Rows with null texts, or texts without letters, go
with the first stage; other columns may be null. Repeated rows are copies, of which the join keeps one. An empty
table stays empty. Documents may have any other columns, of any names: stages carry them packed as one. Those named
like a result of sharding get doc_ before their name.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from medlode.llm import decontaminate, language_id, mixing, ngram_join, sharding
from medlode.llm.common import clear, delete, shared_dir
from medlode.llm.queries import learns_language, table


def packed(docs: DataFrame) -> DataFrame:
    """The id, the text, and all columns as `doc`, where no name clashes with a stage's own."""
    return docs.select("doc_id", "text", F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"))


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = language_id.train(docs, learns_language())
    found = language_id.languages(packed(docs), model, keep=("doc",))
    return found.where((F.col("lang_pred") != "und") & ~F.col("ambiguous")).select("doc.*")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return ngram_join.deduplicated(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    found = decontaminate.contamination(packed(docs), table(spark, sf_dir, "benchmark"), keep=("doc",))
    return found.where(~F.col("contaminated")).select("doc.*")


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mix(docs)


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return sharding.shards(docs, carry=True)


STAGES = [
    ("language ID", language),
    ("n-gram join", near_duplicates),
    ("decontamination", decontamination),
    ("mixing", mixture),
    ("sharding", shard),
]

#: The first two stages train a model and join by similarity, so there is no SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage. Once a stage is written, what it and the one before it wrote is deleted."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    base = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{base}/{k}")
        docs = spark.read.parquet(f"{base}/{k}")
        clear(spark)
        if k:
            delete(spark, f"{base}/{k - 1}")
    return docs

"""The queries of the operators, as __spark_entry__.py registers them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from medlode.llm import decontaminate, exact_dedup, language_id, mixing, ngram_join, repeats, sharding, token_file, toxicity, url_filter
from medlode.llm.common import stash


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _bucket(n: int):
    return F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(n))


def learns_language():
    """The rows from which a language model may learn."""
    return F.coalesce(_bucket(5), F.lit(1)) != 0


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    sized = docs.select("doc_id", F.col("source").cast("string").alias("source"), mixing.word_count(F.col("text")).alias("size"))
    return mixing.drawn(stash(mixing.ranked(sized, "doc_id", "size"), "sized")).select("doc_id", "size", "source_size", "target", "taken", "shards")


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_groups(table(spark, sf_dir, "documents"))


def op3_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.linked(table(spark, sf_dir, "documents"))


def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.without_repeats(table(spark, sf_dir, "documents"))


def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shards(table(spark, sf_dir, "documents"))


def op6_token_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = token_file.fresh_path(spark)
    token_file.write_tokens(table(spark, sf_dir, "documents"), path, public_tokenizers.path("byte_bpe_50k.json"))
    return token_file.read_documents(spark, path)


def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = toxicity.train(docs, table(spark, sf_dir, "labels"), _bucket(3) != 1)
    found = toxicity.scores(docs, model)
    return found.select("doc_id", (F.coalesce(_bucket(3), F.lit(0)) == 1).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = language_id.train(docs, learns_language())
    found = language_id.languages(docs, model)
    return found.select("doc_id", (~learns_language()).alias("held_out"), "lang_pred", "score", "ambiguous")


def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(table(spark, sf_dir, "pages"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_mixing, op2_exact_dedup, op3_ngram_join, op4_suffix_dedup, op5_sharding, op6_token_file, op7_decontaminate, op8_toxicity, op9_language_id, op10_url_filter)}


OP2_SQL = """
WITH t AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS norm FROM documents)
SELECT doc_id, max(doc_id) OVER (PARTITION BY norm) AS keep_id, count(*) OVER (PARTITION BY norm) AS group_size,
       doc_id = max(doc_id) OVER (PARTITION BY norm) AS kept, sha256(norm) AS text_sha256
FROM t
"""


def oracle_sql() -> dict[str, str]:
    return {"op2_exact_dedup": OP2_SQL}

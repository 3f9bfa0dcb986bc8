"""Token counts with a digest cache.

The cache is a Parquet table of (tokenizer version, content digest, bytes, tokens), partitioned by version. A run joins
its texts' digests to it, encodes one text of each distinct digest that is missing, appends those and takes every
count from the cache. Content is normalised only as far as no count changes: a null text is the empty text.

The texts that are encoded are found by (digest, id), which few rows share, so a text with very many copies makes no
large group; the digests alone are aggregated before they are shuffled.

Defined results: null and empty texts have 0 tokens; copies, also with equal ids, have equal counts; null ids pass
through; other columns are not carried; a cache that holds a digest twice (a run that was repeated) gives the same result.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from .common import scratch, slices, texts
from .token_words import shared_encoder, tokenizer_version

CACHE = "digest binary, n_bytes long, n_tokens long, version string"


def read_cache(spark: SparkSession, path: str, version: str) -> DataFrame:
    """digest and n_tokens of a tokenizer version; no rows where there is no cache yet."""
    try:
        cache = spark.read.schema(CACHE).parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        cache = spark.createDataFrame([], CACHE)
    return cache.filter(F.col("version") == version).groupBy("digest").agg(F.max("n_tokens").alias("n_tokens"))


def count_texts(rows: DataFrame, tokenizer: str) -> DataFrame:
    """digest, n_bytes and n_tokens of rows with digest, n_bytes and text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = shared_encoder(tokenizer)
        for whole in batches:
            for b in slices(whole, "text"):
                counts = encoder.counts(texts(b.column("text")))
                yield pa.RecordBatch.from_arrays([b.column("digest"), b.column("n_bytes"), pa.array(counts, pa.int64())], ["digest", "n_bytes", "n_tokens"])

    return rows.select("digest", "n_bytes", "text").mapInArrow(run, "digest binary, n_bytes long, n_tokens long")


def token_counts(docs: DataFrame, tokenizer: str, cache: str | None = None, limit: int = 512, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_tokens and over_limit (more than `limit` tokens) of each row; `cache` is the cache table's path, a new one if None."""
    spark, version = docs.sparkSession, tokenizer_version(tokenizer)
    cache = cache or scratch(spark, "token-cache")
    text = F.coalesce(F.col(text_col), F.lit(""))
    keyed = docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text")).withColumns({"digest": F.unhex(F.sha2("text", 256)), "n_bytes": F.octet_length("text").cast("long")})

    known = read_cache(spark, cache, version)
    missing = keyed.groupBy("digest").agg(F.min("doc_id").alias("first_id")).join(known, "digest", "left_anti")
    unseen = keyed.join(missing.withColumnRenamed("digest", "first_digest"), (F.col("digest") == F.col("first_digest")) & F.col("doc_id").eqNullSafe(F.col("first_id")), "left_semi")
    # repeated rows, with one id and text, are counted in one task, and appended once
    fresh = count_texts(unseen, tokenizer).groupBy("digest").agg(F.first("n_bytes").alias("n_bytes"), F.first("n_tokens").alias("n_tokens"))
    fresh.withColumn("version", F.lit(version)).write.mode("append").partitionBy("version").parquet(cache)

    counted = read_cache(spark, cache, version)
    return keyed.drop("text").join(counted, "digest", "left").select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))

"""Capture tables: one row per URL and check."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from pagewatch import schemas


def read_captures(spark: SparkSession, path: str) -> DataFrame:
    return normalize_captures(spark.read.schema(schemas.CAPTURES).parquet(path))


def stream_captures(spark: SparkSession, path: str, **options: str) -> DataFrame:
    reader = spark.readStream.schema(schemas.CAPTURES).options(**options)
    return normalize_captures(reader.parquet(path))


#: Tasks that a scan's rows are dealt to: so many for each core, or for each split if these are more. A split has 128 MB
#: by default, which are some minutes of work.
TASKS_PER_CORE, TASKS_PER_SPLIT = 4, 8


def spread(df: DataFrame) -> DataFrame:
    """Deal a scan out to all cores, in small tasks, before per-row work that is heavy on CPU.

    The splits of a file tell nothing about its rows: a row group is read whole by one task, and the other
    splits that it covers are empty. So the rows are always dealt out, whatever the number of splits.
    """
    cores, splits = df.sparkSession.sparkContext.defaultParallelism, df.rdd.getNumPartitions()
    return df.repartition(max(TASKS_PER_CORE * cores, TASKS_PER_SPLIT * splits))


def normalize_captures(captures: DataFrame) -> DataFrame:
    """Fill what a capture row leaves open.

    The content length is the byte length of the body. A capture that failed has no
    headers, length 0, and its own URL as final URL.
    """
    failed = F.col("error").isNotNull()
    no_headers = F.map_from_arrays(
        F.array().cast("array<string>"), F.array().cast("array<string>")
    )
    return captures.withColumns(
        {
            "headers": F.when(failed, no_headers).otherwise(F.coalesce("headers", no_headers)),
            "final_url": F.when(failed, F.col("url")).otherwise(F.col("final_url")),
            "content_length": F.when(failed, F.lit(0))
            .otherwise(F.coalesce(F.octet_length("html"), F.lit(0)))
            .cast("bigint"),
            "response_time": F.coalesce("response_time", F.lit(0.0)),
        }
    )

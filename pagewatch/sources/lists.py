"""Inputs kept as files of their own: watchlist documents, and the bodies of linked documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from pagewatch import schemas
from pagewatch.operators.watchlist import watchlist_of_documents

#: Bodies above this are not read: a body has to fit in a task.
MAX_BODY_BYTES = 256 << 20


def read_watchlist(spark: SparkSession, path: str) -> DataFrame:
    """Entries of all watchlist documents below ``path``: one JSON object per file, over as many lines as it likes.

    An entry's ``ordinal`` is the name of its file and its place in it, so documents count in the order of their names. An
    empty file is a document without entries. A file that is no JSON, or is not of the schema, ends the job: an entry that is
    left out without a sign would never be checked again.
    """
    texts = spark.read.option("recursiveFileLookup", True).text(path, wholetext=True)
    parsed = F.from_json("value", schemas.WATCHLIST_DOCUMENT, {"mode": "FAILFAST"})
    return watchlist_of_documents(
        texts.where(F.trim("value") != "").select(F.col("_metadata.file_path").alias("document"), parsed.alias("d"))
        .select("document", "d.*")
    )


def read_linked_documents(listing: DataFrame, root: str, max_bytes: int = MAX_BODY_BYTES) -> DataFrame:
    """Linked documents whose bodies lie as files below ``root``: ``listing`` with ``hash``, ``length`` and ``error``.

    ``listing`` has a row per fetch: ``cycle_id, link, content_type, status_code, declared_length``, ``file``, the body's
    path below ``root``, and ``stored_length``, the bytes that the fetch wrote; it may have an ``error``, which is kept. A file is
    hashed once, next to its scan, however many rows list it, and only its name, length and hash are shuffled. A row without a file,
    or whose file is missing, too long, of another length than stored, or cannot be read, has an error and neither hash nor
    length. Spark's file sources do not show empty files, so a body is empty if 0 bytes were stored and no file is seen; with
    an unknown stored length such a row is an error. Files that no row lists are left out.
    """
    spark = listing.sparkSession
    files = (
        spark.read.format("binaryFile").option("recursiveFileLookup", True).option("ignoreCorruptFiles", True).load(root)
    )
    name = _below(spark, root)
    found = files.select(name.alias("file"), F.col("length").alias("_bytes"))
    hashed = files.where(F.col("length") <= max_bytes).select(name.alias("file"), F.sha2("content", 256).alias("hash"))
    given = F.col("error") if "error" in listing.columns else F.lit(None)
    stored, seen = F.col("stored_length"), F.col("_bytes")
    empty = F.col("file").isNotNull() & seen.isNull() & F.coalesce(stored == 0, F.lit(False))
    error = F.coalesce(
        given.cast("string"),
        F.when(F.col("file").isNull(), "no body")
        .when(empty, None)
        .when(seen.isNull(), F.when(stored.isNull(), "missing or empty").otherwise("missing"))
        .when(seen > max_bytes, f"longer than {max_bytes} bytes")
        .when(seen != stored, F.concat(seen.cast("string"), F.lit(" of "), stored.cast("string"), F.lit(" bytes")))
        .when(F.col("hash").isNull(), "cannot be read"),
    )
    kept = [c for c in listing.columns if c not in ("file", "error", "stored_length")]
    rows = listing.join(found, "file", "left").join(hashed, "file", "left").withColumn("error", error)
    whole = F.col("error").isNull()
    return rows.select(
        *kept,
        F.when(whole, F.when(empty, F.sha2(F.lit(b""), 256)).otherwise(F.col("hash"))).alias("hash"),
        F.when(whole, F.when(empty, 0).otherwise(seen)).alias("length"),
        "error",
    )


def _below(spark: SparkSession, root: str) -> Column:
    """The path of a file below ``root``, which the scan names in full."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(root)
    full = folder.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(folder).toString().rstrip("/")
    return F.substr("path", F.lit(len(full) + 2))

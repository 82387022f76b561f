"""Tables in the shared folder: intermediate results and the versioned page state."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from pagewatch.operators.history import latest_records
from pagewatch.session import materialize as materialize

BUCKETS = 64
#: Versions whose folders stay readable. A batch that runs again reads the version before its own.
KEPT_VERSIONS = 2


class PageState:
    """Last record per history key, in folders below ``root`` that commit files name.

    A batch writes the records of its own keys as one folder, in ``buckets`` parts by a hash of the key, and then a commit
    file with its version and all folders that make up the state. Only that file makes a version exist, so a batch
    that failed half-way leaves the state as it was, and one that runs again replaces its version. ``compact`` replaces the
    folders of a version by one. Folders that none of the last ``KEPT_VERSIONS`` versions names are removed.
    Of the folders, a batch reads the buckets its keys are in. One writer at a time.
    """

    def __init__(self, spark: SparkSession, root: str, buckets: int = BUCKETS):
        self.spark = spark
        self.root = root.rstrip("/")
        self.buckets = buckets

    # -- files

    def _fs(self):
        path = self._path("")
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _path(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}" if name else self.root)

    def _names(self, folder: str) -> list[str]:
        found = self._fs().globStatus(self._path(f"{folder}/*")) or []
        return sorted(s.getPath().getName() for s in found)

    def versions(self) -> list[int]:
        return sorted(int(n.removesuffix(".json")) for n in self._names("commits") if n.endswith(".json"))

    def folders(self, before: int | None = None) -> list[str]:
        """Folders that make up the last version below ``before``."""
        usable = [v for v in self.versions() if before is None or v < before]
        return self._folders_of(usable[-1]) if usable else []

    def _folders_of(self, version: int) -> list[str]:
        # A commit file is a few hundred bytes: its size is bounded by the versions between two compactions.
        stream = self._fs().open(self._path(f"commits/{version}.json"))
        try:
            return json.loads(bytes(stream.readAllBytes()).decode())["folders"]
        finally:
            stream.close()

    def _commit(self, version: int, folders: list[str]) -> None:
        """Name the folders of a version. The file appears whole, under a new name first."""
        fs = self._fs()
        made, final = self._path(f"commits/_{uuid.uuid4().hex}"), self._path(f"commits/{version}.json")
        stream = fs.create(made, True)
        stream.write(json.dumps({"version": version, "folders": folders}).encode())
        stream.close()
        fs.delete(final, False)
        if not fs.rename(made, final):
            raise OSError(f"version {version} of {self.root} was not committed")
        self._clean()

    def _clean(self) -> None:
        fs, versions = self._fs(), self.versions()
        kept = versions[-KEPT_VERSIONS:]
        named = {f for v in kept for f in self._folders_of(v)}
        for version in set(versions) - set(kept):
            fs.delete(self._path(f"commits/{version}.json"), False)
        for folder in self._names("data"):
            if folder not in named:
                fs.delete(self._path(f"data/{folder}"), True)

    # -- rows

    def _bucket(self, key: Column) -> Column:
        return F.pmod(F.xxhash64(key), F.lit(self.buckets)).cast("int")

    def read(self, before: int | None = None, keys: DataFrame | None = None) -> DataFrame | None:
        """State from versions below ``before``; None if nothing is stored yet.

        With ``keys`` (``history_key``), only their buckets are read; the state of other keys may come along. At most
        ``buckets`` numbers come to the driver.
        """
        folders = self.folders(before)
        if not folders:
            return None
        paths = [f"{self.root}/data/{f}" for f in folders]
        # All folders were written with one schema, or with more columns later: the last one tells it.
        schema = self.spark.read.option("basePath", f"{self.root}/data").parquet(paths[-1]).schema
        rows = self.spark.read.schema(schema).option("basePath", f"{self.root}/data").parquet(*paths)
        if keys is not None:
            touched = keys.select(self._bucket(F.col("history_key")).alias("bucket")).distinct()
            rows = rows.where(F.col("bucket").isin([r.bucket for r in touched.collect()]))
        rows = rows.drop("bucket", "batch")
        return rows if len(folders) == 1 else _newest(rows)

    def _store(self, rows: DataFrame, version: int) -> str:
        folder = f"batch={version}-{uuid.uuid4().hex}"
        # One file per bucket and part: a bucket's rows meet in one task unless adaptive execution splits it.
        placed = rows.withColumn("bucket", self._bucket(F.col("history_key")))
        placed.repartition("bucket").write.partitionBy("bucket").parquet(f"{self.root}/data/{folder}")
        return folder

    def write(self, records: DataFrame, version: int) -> None:
        """Store the records of one batch. Writing a version again replaces it."""
        folder = self._store(latest_records(records), version)
        empty = not self._names(f"data/{folder}/bucket=*")
        self._commit(version, self.folders(version) + ([] if empty else [folder]))

    def compact(self, version: int) -> None:
        """Fold the state up to and including ``version`` into one folder."""
        state = self.read(before=version + 1)
        if state is not None:
            self._commit(version, [self._store(state, version)])


def _newest(rows: DataFrame) -> DataFrame:
    first = ("first_captured_at", "first_ordinal")
    payload = [c for c in rows.columns if c not in ("history_key", *first)]
    return (
        rows.groupBy("history_key")
        .agg(
            F.max_by(F.struct(*payload), F.struct("captured_at", "ordinal")).alias("last"),
            F.min(F.struct(*first)).alias("first"),
        )
        .select("history_key", "last.*", "first.*")
    )

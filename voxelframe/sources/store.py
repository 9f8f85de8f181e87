"""A result store of versions: one folder per write, named by a manifest that is written last."""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MANIFEST = "folders array<string>, number long"


class VersionedStore:
    """Rows by key; a write replaces all earlier rows of the keys it holds and leaves the others.

    A write goes to a folder of its own and is seen once the next manifest, a single small file that lists the live folders, stands
    beside the earlier ones. A write that fails at any point leaves the state before it; nothing is rewritten in place, so readers that began
    before a write go on. Reading takes each key's rows from the last folder that has the key. After ``most`` folders
    the state is written as one folder (:meth:`compact`); folders no manifest names any more are left to the store's owner to remove.
    All writes have the same columns, and there is one writer at a time. Null is a key like any other.
    """

    def __init__(self, spark: SparkSession, path: str, key: str = "pid", most: int = 16):
        self.spark, self.path, self.key, self.most = spark, path.rstrip("/"), key, most

    def manifest(self) -> tuple[int, list[str]]:
        """Number and live folders, oldest first; (0, []) of a new store."""
        try:
            rows = self.spark.read.schema(MANIFEST).parquet(f"{self.path}/manifest")
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            return 0, []
        last = rows.orderBy(F.desc("number")).first()
        return (last.number, list(last.folders)) if last else (0, [])

    def _publish(self, number: int, folders: list[str]) -> None:
        # a manifest of this number without a row is what a failed writer left
        self.spark.createDataFrame([(folders,)], "folders array<string>").coalesce(1).write.mode("overwrite").parquet(f"{self.path}/manifest/number={number}")

    def _write(self, df: DataFrame, number: int) -> str:
        name = f"v{number:09d}-{uuid.uuid4().hex}"
        df.write.mode("error").parquet(f"{self.path}/data/{name}")
        return name

    def write(self, df: DataFrame) -> None:
        number, folders = self.manifest()
        self._publish(number + 1, [*folders, self._write(df, number + 1)])
        if len(folders) + 1 > self.most:
            self.compact()

    def compact(self) -> None:
        """The state as one folder."""
        number, folders = self.manifest()
        if len(folders) > 1:
            self._publish(number + 1, [self._write(self.read(), number + 1)])

    def read(self) -> DataFrame:
        """The rows of the last write of each key."""
        _, folders = self.manifest()
        if not folders:
            raise ValueError(f"nothing was written to {self.path}")
        rows = self.spark.read.parquet(*[f"{self.path}/data/{f}" for f in folders])
        if len(folders) == 1:
            return rows
        version = F.regexp_extract(F.col("_metadata.file_path"), r"/data/v(\d+)-", 1).cast("long")
        tagged = rows.withColumn("__version", version)
        # one row per key and task before the shuffle
        last = tagged.groupBy(F.col(self.key).alias("__key")).agg(F.max("__version").alias("__last"))
        live = F.col(self.key).eqNullSafe(F.col("__key")) & (F.col("__version") == F.col("__last"))
        return tagged.join(last, live, "left_semi").drop("__version")

    def keys(self) -> DataFrame:
        """The keys present; no join is needed."""
        _, folders = self.manifest()
        if not folders:
            raise ValueError(f"nothing was written to {self.path}")
        return self.spark.read.parquet(*[f"{self.path}/data/{f}" for f in folders]).select(self.key).distinct()

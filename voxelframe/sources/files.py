"""Readers and writers of labels, annotations, candidates, results and submissions."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from voxelframe import schemas
from voxelframe.session import cut

LINE = "__line"
LISTING_TASKS = "spark.sql.sources.parallelPartitionDiscovery.parallelism"


def with_line_order(df: DataFrame) -> DataFrame:
    """Add a sortable position of each row in its files.

    File, then block, then a number that rises within a block: the order of the lines without
    bringing them together to count them.
    """
    return df.select(
        "*",
        F.struct(
            F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"),
            F.monotonically_increasing_id().alias("row"),
        ).alias(LINE),
    )


def read_csv_ordered(spark: SparkSession, path: str, schema: T.StructType, sep: str = ",") -> DataFrame:
    return with_line_order(
        spark.read.csv(path, schema=schema, header=True, sep=sep, mode="FAILFAST", enforceSchema=True)
    )


def read_labels(spark: SparkSession, path: str, sep: str = ",") -> DataFrame:
    """(pid, label); of a repeated id the last line counts."""
    rows = read_csv_ordered(spark, path, schemas.LABELS_CSV, sep)
    return rows.groupBy(F.col("id").alias("pid")).agg(F.max_by("cancer", LINE).alias("label"))


def read_annotations(spark: SparkSession, path: str) -> DataFrame:
    """(pid, z, y, x, d, line order): the file has x, y, z."""
    rows = read_csv_ordered(spark, path, schemas.POINTS_CSV)
    return rows.select(F.col("id").alias("pid"), "z", "y", "x", "d", LINE)


def read_negative_candidates(spark: SparkSession, path: str) -> DataFrame:
    """Points whose last column (the class) is 0."""
    return read_annotations(spark, path).filter(F.col("d") == 0)


def read_properties(spark: SparkSession, path: str) -> DataFrame:
    """(pid, z, y, x, d, props): the ten named properties as a map."""
    rows = read_csv_ordered(spark, path, schemas.PROPERTIES_CSV)
    props = F.create_map(*[c for p in schemas.PROPERTY_COLUMNS for c in (F.lit(p), F.col(p))])
    return rows.select(F.col("id").alias("pid"), "z", "y", "x", F.col("diameter").alias("d"), props.alias("props"), LINE)


def explode_reader_marks(scans: DataFrame, readers: str = "readers") -> DataFrame:
    """One row per located mark from rows with readers -> nodules nested arrays.

    A nodule is a struct with ``centroid_xyz`` (may be NULL: the mark is dropped) and
    ``characteristics``.
    """
    per_reader = scans.select("*", F.posexplode(readers).alias("reader", "__nodules")).drop(readers)
    marks = per_reader.select("*", F.explode("__nodules").alias("__m")).drop("__nodules")
    xyz = F.col("__m.centroid_xyz")
    return (
        marks.filter(xyz.isNotNull())
        .withColumns({"cx": xyz[0], "cy": xyz[1], "cz": xyz[2], "characteristics": F.col("__m.characteristics")})
        .drop("__m")
    )


# --- result store ----------------------------------------------------------------------------


def bucket_of(pid: str | Column, buckets: int) -> Column:
    c = F.col(pid) if isinstance(pid, str) else pid
    return F.pmod(F.xxhash64(c.cast("string")), F.lit(buckets)).cast("int")


def generated(spark: SparkSession, path: str, pid: str = "pid") -> DataFrame:
    """Ids present in a result store; no row when the store does not exist yet."""
    try:
        return spark.read.parquet(path).select(pid).distinct()
    except AnalysisException as e:
        if e.getCondition() == "PATH_NOT_FOUND":
            return spark.createDataFrame([], T.StructType([T.StructField(pid, T.StringType())]))
        raise


def write_results(df: DataFrame, path: str, pid: str = "pid", buckets: int = 64) -> None:
    """Write results so that each patient's earlier result is replaced and all others stay.

    The store is partitioned by a hash bucket of the patient. Only touched buckets are rewritten, and
    their other patients are carried over. The rebalance hint splits a bucket that holds a very
    large patient over several tasks and files.
    """
    spark = df.sparkSession
    fresh = df.withColumn("bucket", bucket_of(pid, buckets))
    try:
        old = spark.read.parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        old = None
    if old is not None:
        touched = fresh.select("bucket").distinct()
        kept = old.join(touched, "bucket", "left_semi").join(fresh.select(pid).distinct(), pid, "left_anti")
        # the rows come from the folder that is about to be overwritten
        fresh = cut(fresh.unionByName(kept))
    (
        fresh.hint("rebalance", "bucket").write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(path)
    )


def candidate_files(spark: SparkSession, path: str, pid: str = "pid") -> DataFrame:
    """(pid, file) of a candidate store, from the file metadata of the scan."""
    return spark.read.parquet(path).select(pid, F.col("_metadata.file_path").alias("file")).distinct()


def scan_folders(spark: SparkSession, path: str) -> DataFrame:
    """Folders below a root that hold files, sorted by path; file contents are not read.

    Folders are listed, and their files looked at, by as many tasks as a shuffle has partitions. Spark alone takes a task for each
    folder up to 10 000 of them and one for every few files, and the driver is then busy with starting tasks.
    """
    n = spark.conf.get("spark.sql.shuffle.partitions")
    before = spark.conf.get(LISTING_TASKS, None)
    spark.conf.set(LISTING_TASKS, n)
    try:  # load lists the folders
        files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path")
    finally:
        if before is None:
            spark.conf.unset(LISTING_TASKS)
        else:
            spark.conf.set(LISTING_TASKS, before)
    folder = F.regexp_replace("path", "/[^/]*$", "")
    return files.coalesce(int(n)).select(folder.alias("folder")).distinct().orderBy("folder")


# --- submissions and model catalog -----------------------------------------------------------


def write_submission(predictions: DataFrame, path: str, pid: str = "pid", p: str = "p") -> None:
    """``id,cancer`` CSV, in parts that are sorted by id one after the other."""
    out = predictions.select(F.col(pid).cast("string").alias("id"), F.col(p).cast("double").alias("cancer"))
    out.orderBy("id").write.mode("overwrite").csv(path, header=True)


def read_submission(spark: SparkSession, path: str) -> DataFrame:
    rows = spark.read.csv(path, schema=schemas.SUBMISSION_CSV, header=True, mode="FAILFAST")
    return rows.select(F.col("id").alias("pid"), F.col("cancer").alias("p"))


def lookup_one(catalog: DataFrame, wanted: DataFrame, key: str = "config") -> DataFrame:
    """The single catalog row of each wanted name; the job fails on none or several."""
    counts = catalog.groupBy(key).agg(F.count(F.lit(1)).alias("__n"))
    checked = wanted.select(key).distinct().join(counts, key, "left").withColumn(
        "__ok",
        F.when(F.col("__n") == 1, F.lit(True)).otherwise(
            F.raise_error(F.concat(
                F.lit("expected one model of "), F.col(key), F.lit(", found "),
                F.coalesce("__n", F.lit(0)).cast("string"),
            )).cast("boolean")
        ),
    )
    return catalog.join(checked.filter("__ok").select(key), key, "left_semi")


def lookup_counts(catalog: DataFrame, wanted: DataFrame, key: str = "config") -> DataFrame:
    """Number of catalog rows per wanted name, 0 included."""
    counts = catalog.groupBy(key).agg(F.count(F.lit(1)).alias("n_models"))
    return wanted.select(key).distinct().join(counts, key, "left").fillna(0, ["n_models"])

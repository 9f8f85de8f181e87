"""The versioned result store."""

import pytest
from pyspark.sql import functions as F

from voxelframe.session import scratch_path
from voxelframe.sources.store import VersionedStore


def rows(spark, *pairs):
    return spark.createDataFrame(list(pairs), "pid string, v int")


def state(store):
    return sorted((str(r.pid), r.v) for r in store.read().collect())


def test_last_write_of_a_key_counts(spark):
    store = VersionedStore(spark, scratch_path(spark, "store"))
    with pytest.raises(ValueError, match="nothing was written"):
        store.read()
    store.write(rows(spark, ("a", 1), ("a", 2), ("b", 1), (None, 1), ("c", 1)))
    first = set(store.read().inputFiles())
    store.write(rows(spark, ("a", 7), (None, 5), ("d", 1)))
    store.write(rows(spark))
    assert state(store) == [("None", 5), ("a", 7), ("b", 1), ("c", 1), ("d", 1)]
    assert {r.pid for r in store.keys().collect()} == {"a", "b", "c", "d", None}
    # nothing was rewritten: the first write's files are still what is read
    assert first and first <= set(store.read().inputFiles())
    before = store.read()
    store.compact()
    assert len(store.manifest()[1]) == 1 and state(store) == sorted((str(r.pid), r.v) for r in before.collect())


def test_failed_write_leaves_the_old_state(spark):
    store = VersionedStore(spark, scratch_path(spark, "store"))
    store.write(rows(spark, ("a", 1), ("b", 1)))
    bad = rows(spark, ("a", 2), ("b", 2), ("c", 2)).repartition(3, "pid").withColumn(
        "v", F.when(F.col("pid") == "c", F.raise_error(F.lit("lost")).cast("int")).otherwise(F.col("v"))
    )
    with pytest.raises(Exception, match="lost"):
        store.write(bad)
    assert state(store) == [("a", 1), ("b", 1)] and store.manifest()[0] == 1
    # a writer that stopped between its data and its manifest leaves no trace either
    store._write(rows(spark, ("a", 9)), 2)
    assert state(store) == [("a", 1), ("b", 1)]
    store.write(rows(spark, ("b", 3)))
    assert state(store) == [("a", 1), ("b", 3)]


def test_many_writes_are_compacted(spark):
    store = VersionedStore(spark, scratch_path(spark, "store"), most=3)
    for k in range(6):
        store.write(rows(spark, ("a", k), (f"p{k}", k)))
    assert len(store.manifest()[1]) <= 3
    assert state(store) == sorted([("a", 5), *[(f"p{k}", k) for k in range(6)]])


def test_a_result_computed_from_the_store_can_be_written_back(spark):
    store = VersionedStore(spark, scratch_path(spark, "store"))
    store.write(rows(spark, ("a", 1), ("b", 2)))
    store.write(store.read().withColumn("v", F.col("v") * 10))
    assert state(store) == [("a", 10), ("b", 20)]

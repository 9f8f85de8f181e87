"""Sources and sinks: tables are written out in the file format and read back."""

from pyspark.sql import functions as F

from checks.registry import R, U, query, r6
from voxelframe import schemas
from voxelframe.functions.hashing import uniform
from voxelframe.functions.scalars import pid_from_dir
from voxelframe.session import scratch_path
from voxelframe.sources import files as SF
from voxelframe.sources.store import VersionedStore


def doubled_labels(t):
    """Every label twice; the later line of an id carries the toxicity label."""
    first = t.labels.select(F.col("doc_id").alias("id"), F.col("quality").alias("cancer"), F.lit(0).alias("turn"))
    second = t.labels.select(F.col("doc_id").alias("id"), F.col("toxic").alias("cancer"), F.lit(1).alias("turn"))
    return first.unionByName(second).orderBy("turn", "id").select("id", "cancer")


def written_csv(t, df, name, **options):
    path = scratch_path(t.spark, name)
    df.write.csv(path, header=True, **options)
    return path


@query("src1_label_csv", "select cast(doc_id as varchar) as pid, toxic as label from labels")
def _(t):
    return SF.read_labels(t.spark, written_csv(t, doubled_labels(t), "labels"))


@query("src2_label_csv_semicolon", "select cast(doc_id as varchar) as pid, toxic as label from labels")
def _(t):
    return SF.read_labels(t.spark, written_csv(t, doubled_labels(t), "labels2", sep=";"), ";")


@query("src3_annotation_csv", "select cast(pid as varchar) as pid, z, y, x, d from f_ann")
def _(t):
    path = written_csv(t, t.f_ann.select(F.col("pid").alias("id"), "x", "y", "z", "d"), "annotations")
    return SF.read_annotations(t.spark, path).drop(SF.LINE)


@query("src4_negative_candidate_csv", "select cast(pid as varchar) as pid, z, y, x, d from f_ann where d=0")
def _(t):
    path = written_csv(t, t.f_ann.select(F.col("pid").alias("id"), "x", "y", "z", "d"), "candidates")
    return SF.read_negative_candidates(t.spark, path).drop(SF.LINE)


PROPS = ["diameter"] + schemas.PROPERTY_COLUMNS[1:]


@query("src5_property_csv", f"""
select cast(pid as varchar) as pid, z, y, x, d, {', '.join(f"1+floor(5*{U(p,'pid','aid')}) as {p}" for p in PROPS[1:])} from f_ann""")
def _(t):
    cols = [F.col("pid").alias("id"), "x", "y", "z", F.col("d").alias("diameter")]
    cols += [(1 + F.floor(5 * uniform(p, "pid", "aid"))).cast("double").alias(p) for p in PROPS[1:]]
    path = written_csv(t, t.f_ann.select(*cols), "properties")
    return SF.read_properties(t.spark, path).select(
        "pid", "z", "y", "x", "d", *[F.col("props")[p].alias(p) for p in PROPS[1:]]
    )


def stored_candidates(t):
    path = scratch_path(t.spark, "store")
    SF.write_results(t.f_cand.select("pid", "cid", "p"), path, buckets=8)
    return path


@query("src6_candidate_store_listing", "select distinct pid, true as in_bucket from f_cand")
def _(t):
    files = SF.candidate_files(t.spark, stored_candidates(t))
    bucket = F.regexp_extract("file", r"/bucket=(\d+)/", 1).cast("int")
    return files.groupBy("pid").agg(F.bool_and(bucket == SF.bucket_of("pid", 8)).alias("in_bucket"))


@query("src7_scan_folder_listing", "select distinct cast(l_suppkey as varchar) as pid from lineitem")
def _(t):
    path = scratch_path(t.spark, "scans")
    slices = t.f_slices.select("pid", "sid", "pos_z")
    slices.repartition("pid").write.partitionBy("pid").parquet(path)
    folders = SF.scan_folders(t.spark, path)
    return folders.select(F.replace(pid_from_dir("folder"), F.lit("pid="), F.lit("")).alias("pid")).filter("pid rlike '^[0-9]+$'")


@query("src8_generated_listing", "select distinct pid, cast(0 as bigint) as n_missing from f_cand")
def _(t):
    missing = SF.generated(t.spark, scratch_path(t.spark, "nothing-here")).agg(F.count("pid").alias("n_missing"))
    done = SF.generated(t.spark, stored_candidates(t))
    return done.withColumn("n_missing", F.lit(missing.first()[0]))


@query("src9_result_sink", """
select c.pid, c.cid, case when a.pid is not null then c.p+1 else c.p end as p from f_cand c left join f_label_a a using (pid)""")
def _(t):
    path = stored_candidates(t)
    redone = t.f_cand.join(t.f_label_a.select("pid"), "pid", "left_semi").select("pid", "cid", (F.col("p") + 1).alias("p"))
    SF.write_results(redone, path, buckets=8)
    return t.spark.read.parquet(path).select("pid", "cid", "p")


@query("src9_versioned_store", """
select c.pid, c.cid, case when b.pid is not null then c.p+2 when a.pid is not null then c.p+1 else c.p end as p
from f_cand c left join f_label_a a using (pid) left join f_label_b b on b.pid=c.pid and b.label=1""")
def _(t):
    """Three writes, each replacing some patients, and a compaction after the second."""
    store = VersionedStore(t.spark, scratch_path(t.spark, "versions"), most=2)
    rows = t.f_cand.select("pid", "cid", "p")
    store.write(rows)
    for labels, add in ((t.f_label_a, 1), (t.f_label_b.filter("label = 1"), 2)):
        store.write(rows.join(labels.select("pid"), "pid", "left_semi").withColumn("p", F.col("p") + add))
    return store.read()


@query("src10_submission_csv", f"select cast(pid as varchar) as id, p as cancer from f_pred where config='c1_spl'")
def _(t):
    path = scratch_path(t.spark, "submission")
    SF.write_submission(t.f_pred.filter("config = 'c1_spl'"), path)
    return t.spark.read.csv(path, header=True, schema=schemas.SUBMISSION_CSV)


@query("src11_submission_scan", f"select cast(pid as varchar) as pid, {R('avg(p)')} as p from f_pred group by pid")
def _(t):
    path = scratch_path(t.spark, "submission")
    means = t.f_pred.groupBy("pid").agg(r6(F.avg("p")).alias("p"))
    SF.write_submission(means, path)
    return SF.read_submission(t.spark, path)


@query("src12_catalog_lookup", """
select distinct n.config, count(p.pid) as n_models from (select distinct config from f_pred union select 'c9_spl') n
left join (select config, min(pid) as pid from f_pred group by config) p using (config) group by n.config""")
def _(t):
    catalog = t.f_pred.groupBy("config").agg(F.min("pid").alias("model"))
    wanted = t.f_pred.select("config").union(t.f_pred.select(F.lit("c9_spl")))
    return SF.lookup_counts(SF.lookup_one(catalog, t.f_pred), wanted)


@query("src13_reader_marks", f"""
select pid, aid, reader, {R('cx')} as cx, {R('cy')} as cy, {R('cz')} as cz, malignancy from f_marks where cx is not null""")
def _(t):
    # four readers per annotation, each with one nodule; nested as the source has it
    flat = F.array_sort(F.collect_list(F.struct("reader", "cx", "cy", "cz", "malignancy")))
    nested = t.f_marks.groupBy("pid", "aid").agg(
        F.transform(
            flat,
            lambda s: F.array(F.struct(
                F.when(s["cx"].isNotNull(), F.array(s["cx"], s["cy"], s["cz"])).alias("centroid_xyz"),
                F.create_map(F.lit("malignancy"), s["malignancy"]).alias("characteristics"),
            )),
        ).alias("readers")
    )
    return SF.explode_reader_marks(nested).select(
        "pid", "aid", "reader", r6("cx").alias("cx"), r6("cy").alias("cy"), r6("cz").alias("cz"),
        F.col("characteristics")["malignancy"].alias("malignancy"),
    )

"""Streaming jobs and the user extension points."""

import numpy as np
from pyspark.sql import functions as F

from checks.candidates import SCORE_SQL, WEIGHTS
from checks.lenses import VOX_SHAPE
from checks.registry import R, U, query, r6
from checks.scalars import LAYOUT
from voxelframe.functions import pooling as P
from voxelframe.functions import scalars as S
from voxelframe.functions import udtf
from voxelframe.operators import ranking as RK
from voxelframe.operators import scoring as SC
from voxelframe.session import scratch_path
from voxelframe.streaming import jobs


@query("str1_incremental_scoring", f"select pid, {R(SCORE_SQL)} as p from f_patch")
def _(t):
    base = scratch_path(t.spark, "stream")
    patches = t.f_patch.select("pid", "v")
    model = SC.LinearSigmoid(WEIGHTS, 0.25)

    def run():
        return jobs.score_new_patients(
            t.spark, f"{base}/in", f"{base}/out", f"{base}/state", model, patches.schema, files_per_batch=2
        )

    patches.filter("pid % 3 < 2").repartition(3).write.mode("append").parquet(f"{base}/in")
    run()
    # the second delivery repeats some patients
    patches.filter("pid % 3 > 0").repartition(2).write.mode("append").parquet(f"{base}/in")
    return run().select("pid", r6("p").alias("p"))


CURVES = """c as (select run, line_no, line, coalesce(max(case when line like 'Chunk%' then cast(split_part(split_part(line,' ',2),'/',1) as bigint) end) over (partition by run order by line_no),-1) as chunk from f_log),
k as (select run, line_no, chunk, case when line like 'Mean train%' then 'train' else 'valid' end as kind, cast(trim(split_part(line,':',2)) as double) as loss from c where line not like 'Chunk%')"""


@query("str2_running_curves", f"""with {CURVES}, b as (select run, kind, min(loss) as best, arg_min(line_no, loss) as best_at from k group by run, kind)
select k.run, k.line_no, k.chunk, k.kind, {R('loss')} as loss, {R('best')} as best, best_at from k join b using (run, kind)""")
def _(t):
    base = scratch_path(t.spark, "logs")
    lines = t.f_log.select(F.concat_ws("\t", "run", "line_no", "line").alias("value"))
    half = F.xxhash64("value") % 2 == 0
    lines.filter(half).write.mode("append").text(f"{base}/in")
    jobs.follow_logs(t.spark, f"{base}/in", f"{base}/table", f"{base}/best", f"{base}/state", 2)
    lines.filter(~half).write.mode("append").text(f"{base}/in")
    curves, best = jobs.follow_logs(t.spark, f"{base}/in", f"{base}/table", f"{base}/best", f"{base}/state", 2)
    return curves.join(best, ["run", "kind"]).select(
        "run", "line_no", "chunk", "kind", r6("loss").alias("loss"), r6("best").alias("best"), "best_at"
    )


@query("udf1_preparation_chain", f"select pid,z,y,x,{R('(least(greatest((hu+1000)/1400e0,0),1)-0.35e0)/0.2e0')} as v from f_vox where hu > -900")
def _(t):
    def body(df):
        return df.filter("hu > -900")

    def normalise(df, mean, std):
        return df.withColumn("v", S.zmuv(S.hu_norm("hu"), F.lit(mean), F.lit(std)))

    return t.f_vox.transform(body).transform(normalise, 0.35, 0.2).select("pid", "z", "y", "x", r6("v").alias("v"))


@query("udf2_ranking_strategy", """
select pid, cid, row_number() over (partition by pid order by features[2]*sqrt(features[3]) desc, cid) as rank from f_feat""")
def _(t):
    def by_size(layout, features):
        return layout.unit(features, "nodule", 1) * F.sqrt(layout.get(features, "size"))

    scored = t.f_feat.withColumn("score", by_size(LAYOUT, "features"))
    return RK.rank_candidates(scored, "score").select("pid", "cid", "rank")


@query("udf3_label_builder", f"select pid, aid, {R('case when d>0 then least(d/30,1) else 0 end')} as y from f_ann")
def _(t):
    def share_of_three_cm(d):
        return F.when(F.col(d) > 0, F.least(F.col(d) / 30, F.lit(1.0))).otherwise(0.0)

    return t.f_ann.select("pid", "aid", r6(share_of_three_cm("d")).alias("y"))


class TwoClass:
    """A model with a two-class head: softmax of mean against spread."""

    def score(self, batch: np.ndarray) -> np.ndarray:
        heads = np.stack([batch.mean(axis=1) * 4, batch.std(axis=1) * 4], axis=1)
        e = np.exp(heads - heads.max(axis=1, keepdims=True))
        return e / e.sum(axis=1, keepdims=True)


@query("udf4_user_scorer", f"""
select pid, {R('1/(1+exp(4*m-4*s))')} as p from (select pid, avg(e) as m, stddev_pop(e) as s from (select pid, cast(unnest(v) as double) as e from f_patch) q group by pid) t""")
def _(t):
    return SC.score_patches(t.f_patch, TwoClass()).select("pid", r6("p").alias("p"))


@query("udf5_pool_choice", f"""
select pid, {R('ln(avg(exp(8*p))+1e-7)/8')} as lme, {R('pow(avg(pow(p,4)),0.25e0)')} as p_norm, {R('max(p)')} as top from f_inst group by pid""")
def _(t):
    pools = {
        "lme": lambda c: P.log_mean_exp(c, 8),
        "p_norm": lambda c: F.pow(F.avg(F.pow(c, F.lit(4))), F.lit(0.25)),
        "top": F.max,
    }
    return t.f_inst.groupBy("pid").agg(*[r6(pool(F.col("p"))).alias(n) for n, pool in pools.items()])


@query("udf6_tile_udtf", f"""
select pid, z, y, x, cast(tz as int) as tz, cast(z-tz*3 as int) as lz from f_vox, (select unnest(range({(VOX_SHAPE[0]-4)//3+1})) as tz) a where z between tz*3 and tz*3+3""")
def _(t):
    udtf.register(t.spark)
    return t.spark.sql(
        "select v.pid, v.z, v.y, v.x, u.tile as tz, u.local as lz from {v} v, lateral tiles_of(v.z, " + f"{VOX_SHAPE[0]}, 4, 3) u", v=t.f_vox
    )

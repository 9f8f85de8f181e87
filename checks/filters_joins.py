"""Filters and joins."""

from pyspark.sql import functions as F

from checks.registry import R, query, r6
from voxelframe.operators import filters as FL
from voxelframe.operators import joins as J

@query("flt1_cutoff_to_sentinel", f"""
select pid, cid, {R('case when p>=0.6 then p end')} as p60, {R('case when p>=0.75 then p end')} as p75,
 coalesce({R('case when p>=0.85 then p end')}, -1) as p85_export from f_cand""")
def _(t):
    return t.f_cand.select(
        "pid", "cid",
        r6(FL.cutoff("p", 0.6)).alias("p60"),
        r6(FL.cutoff("p", 0.75)).alias("p75"),
        F.coalesce(r6(FL.cutoff("p", 0.85)), F.lit(-1.0)).alias("p85_export"),
    )


@query("flt2_hu_threshold_mask", "select pid,z,y,x from f_vox where hu < -350")
def _(t):
    return FL.below(t.f_vox).select("pid", "z", "y", "x")


@query("flt3_apply_mask", f"""
select v.pid,v.z,v.y,v.x,{R('case when m.pid is null then 0 else v.hu end')} as hu from f_vox v
left join (select pid,z,y,x from f_vox where hu < -350) m using (pid,z,y,x)""")
def _(t):
    vox = t.f_vox
    return FL.apply_mask(vox, FL.below(vox), "hu").select("pid", "z", "y", "x", r6("hu").alias("hu"))


@query("flt4_patch_inside", """
select pid, cid, (z>24 and z<60-24) and (y>24 and y<512-24) and (x>24 and x<512-24) as inside from f_cand""")
def _(t):
    return t.f_cand.select("pid", "cid", FL.patch_inside(["z", "y", "x"], (60, 512, 512), 48).alias("inside"))


@query("flt5_require_binary", """
select 'valid' as part, pid, label from f_label_a where label in (0,1)
union all select 'valid', pid, label from f_label_b where label in (0,1)""")
def _(t):
    both = t.f_label_a.unionByName(t.f_label_b)
    return FL.require_binary(both).select(F.lit("valid").alias("part"), "pid", "label")


@query("flt6_grid_compatible", """
select a.pid, max(abs(a.s_xy-b.s_xy)+abs(a.s_xy-b.s_xy)+abs(a.o-b.o)) < 1e-9 as compatible
from (select pid, min(s_xy) as s_xy, min(pos_z) as o from f_slices group by pid) a
join (select pid, max(s_xy) as s_xy, min(pos_z)+(pid%2)*1e-3 as o from f_slices group by pid) b using (pid) group by a.pid""")
def _(t):
    s = t.f_slices.groupBy("pid").agg(
        F.min("s_xy").alias("sa"), F.max("s_xy").alias("sb"), F.min("pos_z").alias("oa")
    )
    mask = s.select("pid", F.col("sb"), (F.col("oa") + (F.col("pid") % 2) * 1e-3).alias("ob"))
    scan = s.select("pid", "sa", "oa")
    return scan.join(mask, "pid").select(
        "pid",
        FL.grid_compatible(
            [F.col("sa"), F.col("sa"), F.col("oa")], [F.col("sb"), F.col("sb"), F.col("ob")]
        ).alias("compatible"),
    )


@query("jn1_keep_patients_with_candidates", """
select pid, label from f_label_a a where exists (select 1 from f_cand c where c.pid=a.pid)""")
def _(t):
    return J.keep_known(t.f_label_a, t.f_cand)


@query("jn2_exclude_done", """
select pid, cid from f_cand c where not exists (select 1 from f_label_a a where a.pid=c.pid)""")
def _(t):
    return J.exclude_done(t.f_cand, t.f_label_a).select("pid", "cid")


@query("jn3_include_list", """
select pid, cid from f_cand c where pid in (select pid from f_label_b)""")
def _(t):
    return J.keep_known(t.f_cand, t.f_label_b).select("pid", "cid")


@query("jn4_attach_label", "select c.pid, cid, label from f_cand c left join f_label_a a using (pid)")
def _(t):
    return J.attach_label(t.f_cand.select("pid", "cid"), t.f_label_a)


@query("jn5_right_wins", """
select coalesce(b.pid,a.pid) as pid, case when b.pid is not null then b.label else a.label end as label
from f_label_a a full join f_label_b b on a.pid=b.pid""")
def _(t):
    return J.right_wins(t.f_label_a, t.f_label_b)


@query("jn6_positive_and_negative", """
select p.pid, coalesce(n_pos,0) as n_pos, coalesce(n_neg,0) as n_neg,
 case when n_pos>0 then 'positive' when n_neg>0 then 'negative' else 'none' end as kind
from (select p_partkey as pid from part union select pid from f_label_a) p
left join (select pid, count(*) filter (d>0) as n_pos, count(*) filter (d=0) as n_neg from f_ann group by pid) a using (pid)""")
def _(t):
    ann = t.f_ann
    patients = t.part.select(F.col("p_partkey").alias("pid")).union(t.f_label_a.select("pid"))
    return J.positives_and_negatives(patients, ann.filter("d > 0"), ann.filter("d = 0"))


def nearest(t):
    return J.match_nearest(t.f_ann.filter("d > 0").select("pid", "aid", "z", "y", "x", "d"), t.f_cand)


NEAREST_SQL = """near as (select pid, aid, cid, dist2 from (
 select a.pid, a.aid, c.cid, (a.z-c.z)*(a.z-c.z)+(a.y-c.y)*(a.y-c.y)+(a.x-c.x)*(a.x-c.x) as dist2, a.d,
  row_number() over (partition by a.pid, a.aid order by (a.z-c.z)*(a.z-c.z)+(a.y-c.y)*(a.y-c.y)+(a.x-c.x)*(a.x-c.x), c.cid) as rn
 from f_ann a join f_cand c using (pid) where a.d>0) t where rn=1 and dist2 <= (d/2)*(d/2))"""


@query("jn7_nearest_blob", f"with {NEAREST_SQL} select pid, aid, cid, {R('dist2')} as dist2 from near")
def _(t):
    return nearest(t).select("pid", "aid", "cid", r6("dist2").alias("dist2"))


@query("jn7_blob_flags", f"""with {NEAREST_SQL}
select c.pid, c.cid, cast(n.cid is not null as int) as flag from f_cand c left join (select distinct pid, cid from near) n on n.pid=c.pid and n.cid=c.cid""")
def _(t):
    return J.flag_claimed(t.f_cand.select("pid", "cid"), nearest(t))


@query("jn8_marks_within_radius", f"""
select a.pid, a.aid, m.aid as mark_aid, m.reader, {R('m.malignancy')} as malignancy from f_ann a join f_marks m on a.pid=m.pid
where a.d>0 and m.cx is not null and (a.z-m.cz)*(a.z-m.cz)+(a.y-m.cy)*(a.y-m.cy)+(a.x-m.cx)*(a.x-m.cx) < 25""")
def _(t):
    marks = t.f_marks.withColumnRenamed("aid", "mark_aid")
    near = J.marks_within(t.f_ann.filter("d > 0").select("pid", "aid", "z", "y", "x"), marks)
    return near.select("pid", "aid", "mark_aid", F.col("reader").cast("int").alias("reader"), r6("malignancy").alias("malignancy"))


@query("jn9_point_in_mask", f"""
select c.pid, c.cid, m.pid is not null as inside from f_pts c
left join (select pid,z,y,x from f_vox where hu < -350) m
on m.pid=c.pid and m.z=cast(floor(c.z) as int) and m.y=cast(floor(c.y) as int) and m.x=cast(floor(c.x) as int)""")
def _(t):
    return J.point_in_mask(t.f_pts, FL.below(t.f_vox)).select("pid", "cid", "inside")


@query("jn10_close_pairs", f"""
select a.pid, a.cid as i, b.cid as j, {R('sqrt((a.z-b.z)*(a.z-b.z)+(a.y-b.y)*(a.y-b.y)+(a.x-b.x)*(a.x-b.x))')} as dist
from f_cand a join f_cand b on a.pid=b.pid and a.cid<b.cid
where (a.z-b.z)*(a.z-b.z)+(a.y-b.y)*(a.y-b.y)+(a.x-b.x)*(a.x-b.x) <= 40*40""")
def _(t):
    return J.close_pairs(t.f_cand, 40.0).select("pid", "i", "j", r6("dist").alias("dist"))


@query("jn10_close_pair_counts", """
select a.pid, count(*) as n_pairs from f_cand a join f_cand b on a.pid=b.pid and a.cid<b.cid
where (a.z-b.z)*(a.z-b.z)+(a.y-b.y)*(a.y-b.y)+(a.x-b.x)*(a.x-b.x) <= 60*60 group by a.pid""")
def _(t):
    return J.close_pair_counts(t.f_cand, 60.0)


@query("jn11_patch_window", """
select c.pid, c.cid, count(*) as n, cast(sum(v.hu) as bigint) as total,
 cast(sum(v.hu*(16*(v.z-c.z+2)+4*(v.y-c.y+2)+(v.x-c.x+2))) as bigint) as moment
from (select pid, cid, cast(round_even(z,0) as int) as z, cast(round_even(y,0) as int) as y, cast(round_even(x,0) as int) as x from f_pts) c
join f_vox v on v.pid=c.pid and v.z>=c.z-2 and v.z<c.z+2 and v.y>=c.y-2 and v.y<c.y+2 and v.x>=c.x-2 and v.x<c.x+2
group by c.pid, c.cid""")
def _(t):
    found = J.patch_voxels(t.f_pts, t.f_vox, 2, value="hu", brick=4)
    at = F.col("pz") * 16 + F.col("py") * 4 + F.col("px")
    return found.groupBy("pid", "cid").agg(
        F.count(F.lit(1)).alias("n"), F.sum("hu").cast("long").alias("total"),
        F.sum(F.col("hu") * at).cast("long").alias("moment"),
    )


SCHEDULE = {0: 0.1, 100: 0.05, 2500: 0.01, 7000: 0.002}


@query("jn12_step_schedule", f"""
with sched as (select * from (values (0,0.1e0),(100,0.05e0),(2500,0.01e0),(7000,0.002e0)) s(start_at, rate))
select event_id, {R('(select arg_max(rate, start_at) from sched where start_at <= event_id)')} as rate from events""")
def _(t):
    return t.events.select("event_id", r6(J.step_value("event_id", SCHEDULE)).alias("rate"))


@query("jn12_asof_lookup", """
select e.run, e.idx, (select max(l.line_no) from f_log l where l.run=e.run and l.line like 'Chunk%' and l.line_no <= e.idx) as chunk
from (select user_id % 5 as run, event_id as idx from events) e""")
def _(t):
    rows = t.events.select((F.col("user_id") % 5).alias("run"), F.col("event_id").alias("idx"))
    steps = t.f_log.filter(F.col("line").startswith("Chunk")).select(
        "run", F.col("line_no").alias("idx"), F.col("line_no").alias("chunk")
    )
    return J.asof_lookup(rows, steps, ["run"], "idx", "chunk", width=1000.0)


@query("jn13_same_keys", f"""
select p.config, p.pid, {R('p.p')} as p, a.label from f_pred p join f_label_a a using (pid)""")
def _(t):
    return J.require_same_keys(t.f_pred, t.f_label_a, per=["config"]).select("config", "pid", r6("p").alias("p"), "label")


@query("jn13_key_difference", """
select count(a.pid) as n_left, count(b.pid) as n_right, count(*) filter (a.pid is not null and b.pid is not null) as n_both,
 count(*) filter (b.pid is null) as n_left_only, count(*) filter (a.pid is null) as n_right_only,
 count(*) filter (b.pid is null or a.pid is null) = 0 as equal from f_label_a a full join f_label_b b on a.pid=b.pid""")
def _(t):
    return J.key_difference(t.f_label_a, t.f_label_b)


@query("jn14_scan_mask_pairing", """
select v.pid, count(*) as n_scan, count(m.z) as n_mask, cast(sum(case when m.z is not null then v.hu end) as bigint) as hu_in_mask
from f_vox v left join (select pid,z,y,x from f_vox where hu < -350) m using (pid,z,y,x) group by v.pid""")
def _(t):
    vox = t.f_vox
    mask = FL.below(vox).select("pid", "z", "y", "x", F.lit(1).alias("m"))
    return vox.join(mask, ["pid", "z", "y", "x"], "left").groupBy("pid").agg(
        F.count(F.lit(1)).alias("n_scan"), F.count("m").alias("n_mask"),
        F.sum(F.when(F.col("m") == 1, F.col("hu"))).cast("long").alias("hu_in_mask"),
    )


@query("jn15_replicas", "select pid, cid, cast(unnest(range(8)) as int) as replica from f_cand")
def _(t):
    return J.replicate(t.f_cand.select("pid", "cid"), 8)

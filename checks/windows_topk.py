"""Windows, rankings and set operations."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from checks.lenses import HEADS
from checks.registry import R, query, r6
from checks.scalars import LAYOUT, slice_geometry
from voxelframe.functions import scalars as S
from voxelframe.operators import aggregates as A
from voxelframe.operators import ranking as RK
from voxelframe.operators import runs as RN
from voxelframe.operators import setops as SO
from voxelframe.operators import slices as SL
from voxelframe.plans import ordered as O


def positioned(t):
    return slice_geometry(t.f_slices).withColumn("position_mm", S.slice_position("orientation", "position"))


ORDERED = """ord as (select pid, sid, instance_number, pos_z*normal_z as position_mm,
 row_number() over (partition by pid order by pos_z*normal_z, sid)-1 as slice_no,
 pos_z*normal_z - lag(pos_z*normal_z) over (partition by pid order by pos_z*normal_z, sid) as gap from f_slices)"""


@query("win1_slice_order", f"with {ORDERED} select pid, sid, cast(slice_no as int) as slice_no from ord")
def _(t):
    return SL.order_slices(positioned(t)).select("pid", "sid", "slice_no")


@query("win2_slice_spacing", f"with {ORDERED} select pid, sid, {R('gap')} as gap from ord")
def _(t):
    return SL.order_slices(positioned(t)).select("pid", "sid", r6("gap").alias("gap"))


UNIFORM = """uni as (select pid, count(*) as n_slices, max(case when slice_no=1 then gap end) as first_gap,
 coalesce(max(gap) - max(case when slice_no=1 then gap end) < 0.01, true) as uniform,
 coalesce(max(gap) - max(case when slice_no=1 then gap end) < 0.01 and min(gap) - max(case when slice_no=1 then gap end) > -0.01, true) as uniform2
 from ord group by pid)"""


@query("win3_uniform_spacing", f"with {ORDERED}, {UNIFORM} select pid, n_slices, {R('first_gap')} as first_gap, uniform, uniform2 from uni")
def _(t):
    o = SL.order_slices(positioned(t))
    two = SL.uniform_spacing(o, two_sided=True).select("pid", F.col("uniform").alias("uniform2"))
    return SL.uniform_spacing(o).join(two, "pid").select(
        "pid", "n_slices", r6("first_gap").alias("first_gap"), "uniform", "uniform2"
    )


@query("win4_multi_series_dedupe", f"""
with {ORDERED}, {UNIFORM},
pick as (select pid, sid, position_mm from (select o.*, count(*) over w as n, row_number() over (w order by instance_number desc, slice_no desc) as r
  from ord o join uni u using (pid) where not u.uniform window w as (partition by o.pid, slice_no//2)) p where n=2 and r=1
 union all select o.pid, o.sid, o.position_mm from ord o join uni u using (pid) where u.uniform),
again as (select pid, sid, position_mm, row_number() over (partition by pid order by position_mm, sid)-1 as slice_no,
 position_mm - lag(position_mm) over (partition by pid order by position_mm, sid) as gap from pick),
verdict as (select pid, max(case when slice_no=1 then gap end) as g, coalesce(max(gap)-max(case when slice_no=1 then gap end) < 0.01, true) as resolved from again group by pid)
select a.pid, a.sid, cast(a.slice_no as int) as slice_no, {R('g')} as spacing_z, resolved from again a join verdict using (pid)""")
def _(t):
    return SL.assemble_scans(positioned(t)).select(
        "pid", "sid", "slice_no", r6("spacing_z").alias("spacing_z"), "resolved"
    )


def mid_pixels(t):
    mid = S.mid_pixel_position("orientation", "position", "pixel_spacing", F.lit(400), F.lit(512))
    return slice_geometry(t.f_slices).withColumn("m", mid).select(
        "pid", "sid", F.col("m")[0].alias("mx"), F.col("m")[1].alias("my"), F.col("m")[2].alias("mz")
    )


LINE = """mid as (select pid, sid, case when normal_z=1 then 256*s_xy-170 else 200*s_xy-170 end as mx,
 case when normal_z=1 then 200*s_xy-160 else 256*s_xy-160 end as my, pos_z as mz from f_slices),
pairs as (select a.pid, a.sid as s1, b.sid as s2, sqrt((a.mx-b.mx)*(a.mx-b.mx)+(a.my-b.my)*(a.my-b.my)+(a.mz-b.mz)*(a.mz-b.mz)) as dist,
 a.mx as px, a.my as py, a.mz as pz, b.mx as qx, b.my as qy, b.mz as qz from mid a join mid b on a.pid=b.pid and a.sid<b.sid),
axis as (select * from (select *, row_number() over (partition by pid order by dist desc, s1, s2) as rn from pairs) p where rn=1),
line as (select m.pid, m.sid, ((qx-px)/dist)*(mx-px)+((qy-py)/dist)*(my-py)+((qz-pz)/dist)*(mz-pz) as line_pos
 from mid m join axis using (pid))"""


@query("win5_principal_line", f"with {LINE} select pid, sid, {R('line_pos')} as line_pos from line")
def _(t):
    return SL.principal_line(mid_pixels(t)).select("pid", "sid", r6("line_pos").alias("line_pos"))


@query("win6_cumulative_sum", f"""
select user_id, event_id, {R('sum(value) over (partition by user_id order by event_id)')} as total from events""")
def _(t):
    e = t.events.select("user_id", "event_id", "value")
    return O.running_sum(e, ["user_id"], ["event_id"], "value", O.value_bucket(F.col("event_id"), 4096), "total").select(
        "user_id", "event_id", r6("total").alias("total")
    )


@query("win7_normalise_to_sum", f"""
select event_id, {R('value/sum(value) over w*2')} as share,
 {R('(value-min(value) over w)/(sum(value) over w - min(value) over w * count(value) over w)')} as shifted
from events window w as (partition by user_id)""")
def _(t):
    e = t.events.select("user_id", "event_id", "value")
    a = A.share_of_total(e, ["user_id"], "value", 2.0)
    b = A.share_of_total(a, ["user_id"], "value", 1.0, True, "shifted")
    return b.select("event_id", r6("share").alias("share"), r6("shifted").alias("shifted"))


@query("win8_forward_fill", """
select run, line_no, max(case when line like 'Chunk%' then cast(split_part(split_part(line,' ',2),'/',1) as bigint) end)
 over (partition by run order by line_no) as chunk from f_log""")
def _(t):
    return RN.with_chunk(t.f_log).select("run", "line_no", "chunk")


@query("win9_boundary_groups", """
select user_id, event_id, cast(sum(changed) over (partition by user_id order by event_id) as bigint) as run_no from (
 select user_id, event_id, case when event_type is distinct from lag(event_type) over (partition by user_id order by event_id) then 1 else 0 end as changed from events) t""")
def _(t):
    e = t.events.select("user_id", "event_id", "event_type")
    return RN.boundary_groups(e, ["user_id"], ["event_id"], "event_type", O.value_bucket(F.col("event_id"), 4096)).select(
        "user_id", "event_id", F.col("run_no").cast("long").alias("run_no")
    )


@query("win10_thickness_check", f"""
with {LINE}, {ORDERED},
lo as (select pid, sid, line_pos - lag(line_pos) over (partition by pid order by line_pos, sid) as g from line),
loc as (select pid, abs(max(case when rn=2 then v end) - max(case when rn=1 then v end)) as by_location from (
  select pid, case when sid % 7=0 then null else pos_z end as v, row_number() over (partition by pid order by pos_z*normal_z, sid) as rn from f_slices) q group by pid)
select o.pid, {R('max(case when slice_no=1 then gap end)')} as by_position, {R('coalesce(max(by_location),0)')} as by_location,
 max(n_gaps) as n_gaps, {R('max(max_gap)')} as max_gap from ord o join loc using (pid)
 join (select pid, count(distinct round(g,6)) as n_gaps, max(g) as max_gap from lo group by pid) l using (pid) group by o.pid""")
def _(t):
    s = positioned(t).withColumn("slice_location", F.when(F.col("sid") % 7 != 0, F.col("pos_z")))
    out = SL.thickness_check(s, SL.principal_line(mid_pixels(t)))
    return out.select(
        "pid", r6("by_position").alias("by_position"), r6("by_location").alias("by_location"),
        "n_gaps", r6("max_gap").alias("max_gap"),
    )


# --- rankings --------------------------------------------------------------------------------


@query("top1_rank_by_score", "select pid, cid, row_number() over (partition by pid order by p desc, cid) as rank from f_cand")
def _(t):
    return RK.rank_candidates(t.f_cand.select("pid", "cid", "p")).select("pid", "cid", "rank")


@query("top2_top_n", """
select pid, cid, cast(rn as int) as rank from (select pid, cid, row_number() over (partition by pid order by p desc, cid) as rn from f_cand) t where rn<=8""")
def _(t):
    return RK.top_n(t.f_cand.select("pid", "cid", "p"), 8).select("pid", "cid", "rank")


@query("top3_top_n_padded", f"""
select s.pid, cast(s.slot as int) as rank, cid, {R('p')} as p from (select p_partkey as pid, unnest(range(1,21)) as slot from part) s
left join (select pid, cid, p, row_number() over (partition by pid order by p desc, cid) as rn from f_cand) c on c.pid=s.pid and c.rn=s.slot""")
def _(t):
    patients = t.part.select(F.col("p_partkey").alias("pid"))
    return RK.top_n_padded(t.f_cand.select("pid", "cid", "p"), patients, 20).select("pid", "rank", "cid", r6("p").alias("p"))


def ranked_by(t, strategy):
    scored = t.f_feat.withColumn("score", strategy(LAYOUT, "features"))
    return RK.rank_candidates(scored, "score").select("pid", "cid", "rank", r6("score").alias("score"))


def ranked_sql(expr):
    return f"""select pid, cid, row_number() over (partition by pid order by s desc, cid) as rank, {R('s')} as score
     from (select pid, cid, {expr} as s from f_feat) t"""


@query("top4_rank_malignancy", ranked_sql("features[5]/5"))
def _(t):
    return ranked_by(t, RK.by_malignancy)


@query("top5_rank_nodule_malignancy", ranked_sql("features[2]*features[5]/5"))
def _(t):
    return ranked_by(t, RK.by_nodule_malignancy)


LO = "(5.3854e0*(pow(features[3]/10,-0.5e0)-1.58113883e0)+(features[7]*(-0.1276e0)+features[8]*0.377e0)+0.7729e0*(features[4]/5))"


@query("top6_rank_clinical_blend", ranked_sql(f"features[2]*(features[5]/5+exp({LO})/(1+exp({LO})))"))
def _(t):
    return ranked_by(t, RK.by_clinical_blend)


@query("top7_rank_nodule", ranked_sql("features[2]"))
def _(t):
    return ranked_by(t, RK.by_nodule)


@query("top8_rank_bounded_malignancy", ranked_sql("features[5]"))
def _(t):
    return ranked_by(t, RK.by_bounded_malignancy)


@query("top9_best_epoch", f"""
select run, {R('min(v)')} as best, arg_min(line_no, v) as best_at from (
 select run, line_no, cast(trim(split_part(line,':',2)) as double) as v from f_log where line like 'Validation%') t group by run""")
def _(t):
    v = RN.parse_losses(t.f_log).filter("kind = 'valid'")
    return RK.best_epoch(v, ["run"], "loss", "line_no").select("run", r6("best").alias("best"), "best_at")


# --- sets ------------------------------------------------------------------------------------


@query("set1_concatenate", "select pid, label from f_label_a union all select pid, label from f_label_b")
def _(t):
    return SO.concatenate(t.f_label_a, t.f_label_b)


@query("set2_difference", "select pid from f_label_a except select pid from f_label_b")
def _(t):
    return SO.difference(t.f_label_a.select("pid"), t.f_label_b.select("pid"), ["pid"])


@query("set3_intersection", """
select (select count(*) from (select pid from f_label_a intersect select pid from f_label_b) i) as n_both,
 (select count(*) from (select pid from f_label_a except select pid from f_label_b) x) = 0 and
 (select count(*) from (select pid from f_label_b except select pid from f_label_a) y) = 0 as equal""")
def _(t):
    return SO.overlap(t.f_label_a, t.f_label_b, "pid")

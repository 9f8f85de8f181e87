"""Projections and scalar functions."""

from pyspark.sql import functions as F

from checks.lenses import HEADS
from checks.registry import R, query, r6
from voxelframe.functions import scalars as S

LAYOUT = S.HeadLayout(HEADS)


@query("prj1_pid_from_dir", """
select page_id, list_extract(string_split(rtrim(url,'/'),'/'),-1) as pid,
 list_extract(string_split(rtrim(url||'/','/'),'/'),-1) as pid_trailing from pages""")
def _(t):
    return t.pages.select(
        "page_id",
        S.pid_from_dir("url").alias("pid"),
        S.pid_from_dir(F.concat("url", F.lit("/"))).alias("pid_trailing"),
    )


@query("prj2_pid_from_file", """
select page_id, replace(replace(list_extract(string_split(url||'.mhd','/'),-1),'.mhd',''),'.pkl','') as pid,
 replace(replace(list_extract(string_split(url||'.pkl','/'),-1),'.html',''),'.pkl','') as pid_pkl from pages""")
def _(t):
    return t.pages.select(
        "page_id",
        S.pid_from_file(F.concat("url", F.lit(".mhd"))).alias("pid"),
        S.pid_from_file(F.concat("url", F.lit(".pkl")), ".html").alias("pid_pkl"),
    )


@query("prj3_slice_id", "select page_id, string_split(url,'.')[1] as sid from pages")
def _(t):
    return t.pages.select("page_id", S.slice_id("url").alias("sid"))


@query("prj4_ct_to_hu", f"select pid,z,y,x,{R('greatest(1.5e0*hu+10, -1000e0)')} as hu_out from f_vox")
def _(t):
    return t.f_vox.select(
        "pid", "z", "y", "x", r6(S.ct_to_hu("hu", F.lit(1.5), F.lit(10.0))).alias("hu_out")
    )


@query("prj5_hu_norm", f"select pid,z,y,x,{R('least(greatest((1.2e0*hu+1000)/1400,0),1)')} as v from f_vox")
def _(t):
    return t.f_vox.select("pid", "z", "y", "x", r6(S.hu_norm(F.col("hu") * 1.2)).alias("v"))


@query("prj6_hu_norm_low_clip", f"select pid,z,y,x,{R('least(greatest((50e0*hu+1000)/1400,0),10)')} as v from f_vox")
def _(t):
    return t.f_vox.select("pid", "z", "y", "x", r6(S.hu_norm_low_clip(F.col("hu") * 50.0)).alias("v"))


@query("prj7_pixel_norm", f"select pid,z,y,x,{R('(least(greatest((1.2e0*hu+1000)/1400,0),1)-0.5)/0.5')} as v from f_vox")
def _(t):
    return t.f_vox.select("pid", "z", "y", "x", r6(S.pixel_norm(F.col("hu") * 1.2)).alias("v"))


@query("prj8_zmuv", f"""
select pid,z,y,x,{R('(hu-(-300.5e0))/404.25e0')} as v,
 {R('case when z=0 then cast(hu as double) else (hu-(-300.5e0))/404.25e0 end')} as v_null from f_vox""")
def _(t):
    std = F.when(F.col("z") != 0, F.lit(404.25))
    return t.f_vox.select(
        "pid", "z", "y", "x",
        r6(S.zmuv("hu", F.lit(-300.5), F.lit(404.25))).alias("v"),
        r6(S.zmuv(F.col("hu").cast("double"), F.lit(-300.5), std)).alias("v_null"),
    )


@query("prj9_world_to_voxel", f"""
select pid, aid, {R('abs(z-100)/2.5e0')} as vz, {R('abs(y-250)/0.7e0')} as vy, {R('abs(x-250)/0.7e0')} as vx from f_ann""")
def _(t):
    axes = {"z": (100.0, 2.5), "y": (250.0, 0.7), "x": (250.0, 0.7)}
    return t.f_ann.select("pid", "aid", *[
        r6(S.world_to_voxel(c, F.lit(o), F.lit(s))).alias("v" + c) for c, (o, s) in axes.items()
    ])


def slice_geometry(slices):
    """Orientation, position and spacing arrays of the slice lens."""
    flat = F.array(*[F.lit(float(v)) for v in (1, 0, 0, 0, 1, 0)])
    flipped = F.array(*[F.lit(float(v)) for v in (0, 1, 0, 1, 0, 0)])
    return (
        slices.withColumn("orientation", F.when(F.col("normal_z") == 1, flat).otherwise(flipped))
        .withColumn("position", F.array(F.lit(-170.0), F.lit(-160.0), F.col("pos_z")))
        .withColumn("pixel_spacing", F.array("s_xy", "s_xy"))
    )


@query("prj10_slice_position", f"select pid, sid, {R('pos_z*normal_z')} as position_mm from f_slices")
def _(t):
    return slice_geometry(t.f_slices).select(
        "pid", "sid", r6(S.slice_position("orientation", "position")).alias("position_mm")
    )


@query("prj11_mid_pixel_position", f"""
select pid, sid, {R('case when normal_z=1 then 256*s_xy-170 else 200*s_xy-170 end')} as mx,
 {R('case when normal_z=1 then 200*s_xy-160 else 256*s_xy-160 end')} as my, {R('pos_z')} as mz from f_slices""")
def _(t):
    mid = S.mid_pixel_position("orientation", "position", "pixel_spacing", F.lit(400), F.lit(512))
    return slice_geometry(t.f_slices).withColumn("m", mid).select(
        "pid", "sid", r6(F.col("m")[0]).alias("mx"), r6(F.col("m")[1]).alias("my"), r6(F.col("m")[2]).alias("mz")
    )


@query("prj12_diameter_to_prob", f"""
select pid, cid, {R('''least(greatest(case when dd<5 then 0.035e0*dd/5 when dd<10 then 0.035+(dd-5)*(0.28e0-0.035)/5
 when dd<20 then 0.28e0+(dd-10)*(0.64e0-0.28)/10 when dd<25 then 0.64e0+(dd-20)*(0.82e0-0.64)/5
 when dd<30 then 0.82e0+(dd-25)*(0.93e0-0.82)/5 else 0.93e0+(dd-30)*(0.97e0-0.93)/10 end,0),1)''')} as prob
from (select pid, cid, d*2-1.5e0 as dd from f_cand) c""")
def _(t):
    return t.f_cand.select("pid", "cid", r6(S.diameter_to_prob(F.col("d") * 2 - 1.5)).alias("prob"))


@query("prj13_digitize", """
select pid, cid, cast(d>=5 as int)+cast(d>=10 as int)+cast(d>=20 as int) as bin from f_cand""")
def _(t):
    return t.f_cand.select("pid", "cid", S.digitize("d", [5, 10, 20]).alias("bin"))


@query("prj14_size_bin", """
select pid, aid, case when d<=0 then 0 when d<10 then 1 when d<20 then 2 when d<30 then 3 else 4 end as bin_last,
 case when d<=0 then 0 when d<10 then 1 when d<20 then 2 when d<30 then 3 else 1 end as bin_first from f_ann""")
def _(t):
    b = [10, 20, 30]
    return t.f_ann.select(
        "pid", "aid", S.size_bin("d", b).alias("bin_last"), S.size_bin("d", b, "first").alias("bin_first")
    )


@query("prj15_logodds_to_p", f"""
select pid, cid, {R('case when lo < -500 then 0 when lo > 500 then 1 else exp(lo)/(1+exp(lo)) end')} as prob
from (select pid, cid, least(greatest(logit*100,-600),600) as lo from f_inst) t""")
def _(t):
    lo = F.least(F.greatest(F.col("logit") * 100, F.lit(-600)), F.lit(600))
    return t.f_inst.select("pid", "cid", r6(S.logodds_to_p(lo)).alias("prob"))


@query("prj16_head_slice", f"""
select pid, cid, {R('features[2]')} as nodule1, {R('features[3]')} as size, {R('features[4]')} as spiculation,
 {R('features[5]')} as malignancy, {R('features[6]+features[7]+features[8]+features[9]+features[10]')} as texture_sum from f_feat""")
def _(t):
    tex = LAYOUT.get("features", "texture")
    return t.f_feat.select(
        "pid", "cid",
        r6(F.element_at(LAYOUT.get("features", "nodule"), 2)).alias("nodule1"),
        *[r6(LAYOUT.get("features", h)).alias(h) for h in ("size", "spiculation", "malignancy")],
        r6(F.aggregate(tex, F.lit(0.0), lambda a, v: a + v)).alias("texture_sum"),
    )


@query("prj17_weighted_sum", f"""
select pid, {R('list_sum(list_transform(range(1,65), lambda i: cast(v[i] as double)*(((i*7) % 11)-5)/10))')} as score from f_patch""")
def _(t):
    weights = [(((i * 7) % 11) - 5) / 10 for i in range(1, 65)]
    return t.f_patch.select("pid", r6(S.weighted_sum("v", weights)).alias("score"))


@query("prj18_scale_patch_loc", f"select pid, cid, {R('z/512')} as z, {R('y/512')} as y, {R('x/512')} as x from f_cand")
def _(t):
    return t.f_cand.select("pid", "cid", *[r6(S.scale_patch_location(c)).alias(c) for c in "zyx"])


@query("prj19_swap_axes", f"""
select pid, i, {R('cast(v[(i%4)*16 + ((i//4)%4)*4 + (i//16) + 1] as double)')} as value
from (select pid, v, unnest(range(64)) as i from f_patch) t""")
def _(t):
    swapped = S.swap_axes("v", (4, 4, 4), 0, 2)
    return t.f_patch.select("pid", F.posexplode(swapped).alias("i", "v")).select(
        "pid", F.col("i").cast("long").alias("i"), r6("v").alias("value")
    )


@query("prj20_experiment_id", """
select event_id, event_type||'-'||strftime(ts,'%Y%m%d-%H%M%S') as expid,
 printf('%02d:%02d:%02d', event_id*13//3600, (event_id*13%3600)//60, event_id*13%60) as elapsed from events""")
def _(t):
    return t.events.select(
        "event_id",
        S.experiment_id("event_type", "ts").alias("expid"),
        S.hms(F.col("event_id") * 13 + F.lit(0.25)).alias("elapsed"),
    )


@query("prj21_eta", f"""
select run, line_no, {R('case when idx+1-3=0 then null else (line_no*1.5e0)*(10000-idx+1)/(idx+1-3) end')} as eta from (
 select run, line_no, cast(split_part(split_part(line,' ',2),'/',1) as double) as idx from f_log where line like 'Chunk%') t""")
def _(t):
    idx = F.regexp_extract("line", r"^Chunk (\d+)/", 1).cast("double")
    return t.f_log.filter(F.col("line").startswith("Chunk")).select(
        "run", "line_no",
        r6(S.eta_seconds(F.col("line_no") * 1.5, idx, F.lit(10000.0), F.lit(3.0))).alias("eta"),
    )


@query("prj22_hu_norm_no_clip", f"select pid,z,y,x,{R('(3e0*hu+1000)/1400')} as v from f_vox")
def _(t):
    return t.f_vox.select("pid", "z", "y", "x", r6(S.hu_norm_no_clip(F.col("hu") * 3.0)).alias("v"))

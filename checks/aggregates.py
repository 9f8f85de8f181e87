"""Aggregations."""

from pyspark.sql import functions as F

from checks.registry import R, U, query, r6
from checks.scalars import LAYOUT
from voxelframe.functions.hashing import uniform
from voxelframe.operators import aggregates as A
from voxelframe.operators import joins as J
from voxelframe.operators import ranking as RK
from voxelframe.plans.ordered import hash_bucket

SPLIT = f"case when {U('split', 'pid')} < 0.7 then 'train' else 'valid' end"


def with_split(df):
    return df.withColumn("split", F.when(uniform("split", "pid") < 0.7, "train").otherwise("valid"))


@query("agg1_patient_lists", """
select pid, (rn-1)//8 as chunk, count(*) as n, min(aid) as first_aid, max(aid) as last_aid,
 cast(sum(((rn-1)%8+1)*(aid%1000)) as bigint) as moment
from (select pid, aid, row_number() over (partition by pid order by aid) as rn from f_ann) t group by 1,2""")
def _(t):
    lists = A.as_lists(
        t.f_ann.select("pid", "aid"), ["pid"], ["aid"], F.col("aid"), F.floor(F.col("aid") / 1e9).cast("long"), chunk=8
    )
    moment = F.aggregate(
        F.transform("items", lambda a, i: (i + 1) * (a % 1000)), F.lit(0).cast("long"), lambda s, v: s + v
    )
    return lists.select(
        "pid", "chunk", F.size("items").cast("long").alias("n"), F.element_at("items", 1).alias("first_aid"),
        F.element_at("items", -1).alias("last_aid"), moment.alias("moment"),
    )


@query("agg2_count_classes", """
select count(*) filter (d>0) as n_pos, count(*) filter (d=0) as n_neg, count(distinct pid) as n_patients from f_ann""")
def _(t):
    return A.count_classes(t.f_ann)


@query("agg3_class_ratio", f"""
select split, count(*) as n, {R('avg(label)')} as ratio from (select {SPLIT} as split, label from f_label_a) t group by split""")
def _(t):
    return A.class_ratio(with_split(t.f_label_a)).select("split", "n", r6("ratio").alias("ratio"))


@query("agg4_spacing_extrema", f"""
select {R('min(s_xy)')} as min_s_xy, {R('max(s_xy)')} as max_s_xy, {R('min(pos_z)')} as min_pos_z, {R('max(pos_z)')} as max_pos_z from f_slices""")
def _(t):
    e = A.extrema(t.f_slices, ["s_xy", "pos_z"])
    return e.select(*[r6(c).alias(c) for c in e.columns])


@query("agg5_frequency", f"select {R('s_xy')} as s_xy, count(*) as n from f_slices group by s_xy")
def _(t):
    return A.frequency(t.f_slices.withColumn("s_xy", r6("s_xy")), ["s_xy"])


@query("agg5_slice_counts", f"""
select min(n) as min_n, max(n) as max_n, {R('avg(n)')} as mean_n from (select pid, count(*) as n from f_slices group by pid) t""")
def _(t):
    per = t.f_slices.groupBy("pid").agg(F.count(F.lit(1)).alias("n"))
    return per.agg(F.min("n").alias("min_n"), F.max("n").alias("max_n"), r6(F.avg("n")).alias("mean_n"))


EXTENT = "select pid, (max(z)+1)*2.5e0+(max(y)+1)*0.7e0+(max(x)+1)*0.7e0+count(*)*1e-3 as extent from f_vox group by pid"


@query("agg6_extent_extremes", f"""
select * from (select 'low' as side, pid, {R('extent')} as extent from ({EXTENT}) a order by extent, pid limit 5) l
union all select * from (select 'high' as side, pid, {R('extent')} as extent from ({EXTENT}) b order by extent desc, pid limit 5) h""")
def _(t):
    size = (
        (F.max("z") + 1) * 2.5 + (F.max("y") + 1) * 0.7 + (F.max("x") + 1) * 0.7 + F.count(F.lit(1)) * 1e-3
    )
    per = t.f_vox.groupBy("pid").agg(r6(size).alias("extent"))
    return RK.extremes(per, "extent", "pid", 5).select("side", "pid", "extent")


@query("agg7_mask_proportion", "select count(*) filter (hu < -350) as n_inside, count(*) filter (hu >= -350) as n_outside from f_vox")
def _(t):
    return A.mask_proportion(t.f_vox, F.col("hu") < -350)


@query("agg8_mean_and_std", f"select {R('avg(hu)')} as mean, {R('stddev_pop(hu)')} as std from f_vox")
def _(t):
    return A.mean_and_std(t.f_vox, "hu").select(r6("mean").alias("mean"), r6("std").alias("std"))


FRACTIONS = "[" + ",".join(repr(v) + "e0" if "e" not in repr(v) else repr(v) for v in
                           [sum([1.0 / 14] * i) for i in range(14)]) + "]"
BORDERS = f"""borders as (select pid, list_append(quantile_cont(cast(hu as double), {FRACTIONS}), 450e0) as b
 from f_vox where hu > -950 and hu < 450 group by pid)"""


@query("agg9_equalisation_borders", f"""
with {BORDERS} select pid, i-1 as i, {R('b[i]')} as border from (select pid, b, unnest(range(1,16)) as i from borders) t""")
def _(t):
    b = A.equalisation_borders(t.f_vox)
    return b.select("pid", F.posexplode("borders").alias("i", "border")).select(
        "pid", F.col("i").cast("long").alias("i"), r6("border").alias("border")
    )


@query("agg10_apply_equalisation", f"""
with {BORDERS}
select v.pid, v.z, v.y, v.x, {R('''coalesce((select max((v.hu-lo)/(hi-lo)*100+(-950+100*(i-1))) from
  (select unnest(range(1,15)) as i, unnest(b.b[1:14]) as lo, unnest(b.b[2:15]) as hi) s where v.hu >= lo and v.hu < hi), v.hu)''')} as v
from f_vox v join borders b using (pid)""")
def _(t):
    vox = t.f_vox
    out = A.apply_equalisation(vox, A.equalisation_borders(vox))
    return out.select("pid", "z", "y", "x", r6("v").alias("v"))


@query("agg11_coordinate_extrema", f"""
select pid, {','.join(f"{R(f'{m}({c}*{s})')} as {m}_{c}" for c, s in (('z','2.5e0'),('y','0.7e0'),('x','0.7e0')) for m in ('min','max'))}
from f_cand group by pid""")
def _(t):
    scaled = t.f_cand.select("pid", (F.col("z") * 2.5).alias("z"), (F.col("y") * 0.7).alias("y"), (F.col("x") * 0.7).alias("x"))
    e = A.extrema(scaled, ["z", "y", "x"], ["pid"])
    return e.select("pid", *[r6(c).alias(c) for c in e.columns if c != "pid"])


@query("agg12_heat_map", f"""
select pid, cast(floor(z*2.5e0/400*48) as int) as hz, cast(floor(y*0.7e0/400*48) as int) as hy, cast(floor(x*0.7e0/400*48) as int) as hx,
 {R('sum(p)/32')} as heat from f_cand group by 1,2,3,4""")
def _(t):
    return A.heat_map(t.f_cand, "p", (2.5, 0.7, 0.7)).withColumn("heat", r6("heat"))


NEAR_MARKS = """near as (select a.pid, a.aid, m.aid as mark_aid, m.reader, m.malignancy, m.spiculation, m.texture
 from f_ann a join f_marks m on a.pid=m.pid
 where a.d>0 and m.cx is not null and (a.z-m.cz)*(a.z-m.cz)+(a.y-m.cy)*(a.y-m.cy)+(a.x-m.cx)*(a.x-m.cx) < 25)"""


def near_marks(t):
    marks = t.f_marks.withColumnRenamed("aid", "mark_aid")
    return J.marks_within(t.f_ann.filter("d > 0").select("pid", "aid", "z", "y", "x", "d"), marks)


@query("agg13_property_summary", f"""
with {NEAR_MARKS} select pid, aid, {R('avg(malignancy)')} as mean, {R('quantile_cont(malignancy,0.5)')} as median,
 {R(f"arg_min(malignancy, {U('pick', 'mark_aid', 'reader')})")} as pick from near group by pid, aid""")
def _(t):
    s = A.property_summary(near_marks(t), ["pid", "aid"], "malignancy", uniform("pick", "mark_aid", "reader"))
    return s.select("pid", "aid", *[r6(c).alias(c) for c in ("mean", "median", "pick")])


@query("agg14_objective_means", f"""
select {R('nodule')} as nodule, {R('size')} as size, {R('malignancy')} as malignancy, {R('nodule+0.5*coalesce(size,0)+2*coalesce(malignancy,0)')} as total from (
 select avg(-ln(greatest(features[2],1e-12))) as nodule, avg(case when features[3]>10 then (features[3]-15)*(features[3]-15) end) as size,
  avg(case when features[3]>20 then (features[5]-2.5)*(features[5]-2.5) end) as malignancy from f_feat) t""")
def _(t):
    size, mal = LAYOUT.get("features", "size"), LAYOUT.get("features", "malignancy")
    losses = t.f_feat.select(
        (-F.log(F.greatest(LAYOUT.unit("features", "nodule", 1), F.lit(1e-12)))).alias("nodule"),
        F.when(size > 10, (size - 15) * (size - 15)).alias("size"),
        F.when(size > 20, (mal - 2.5) * (mal - 2.5)).alias("malignancy"),
    )
    m = A.objective_means(losses, ["nodule", "size", "malignancy"], {"size": 0.5, "malignancy": 2.0})
    return m.select(*[r6(c).alias(c) for c in m.columns])


@query("agg15_masked_objective", f"""
select pid, {R('sum(e*v)/(1e-5+sum(e))')} as objective from (
 select pid, cast(features[3]>20 as int)*1e0 as e, (features[5]-2.5)*(features[5]-2.5) as v from f_feat) t group by pid""")
def _(t):
    size, mal = LAYOUT.get("features", "size"), LAYOUT.get("features", "malignancy")
    return t.f_feat.groupBy("pid").agg(
        r6(A.masked_mean((mal - 2.5) * (mal - 2.5), (size > 20).cast("double"))).alias("objective")
    )


@query("agg16_top_score_report", f"""
select pid, rn as i, {R('p')} as score from (
 select pid, p, cast(row_number() over (partition by pid order by p desc, cid) as int) as rn from f_cand) t where rn <= 10""")
def _(t):
    rep = RK.top_score_report(t.f_cand, 10)
    return rep.select("pid", F.posexplode("scores").alias("i", "s")).select(
        "pid", (F.col("i") + 1).alias("i"), r6("s").alias("score")
    )


@query("agg17_set_fingerprint", f"""
select split, count(*) as n, md5(concat_ws('|', {','.join(f"cast(sum(cast('0x'||substr(md5(cast(pid as varchar)),{1+8*i},8) as bigint)) as varchar)" for i in range(4))})) as fingerprint
from (select {SPLIT} as split, pid from f_label_a) t group by split""")
def _(t):
    return A.set_fingerprint(with_split(t.f_label_a), "pid", ["split"])

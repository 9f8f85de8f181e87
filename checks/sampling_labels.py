"""Sampling, splits, batches and label construction."""

from pyspark.sql import functions as F

from checks.filters_joins import nearest
from checks.registry import R, U, query, r6
from voxelframe.operators import joins as J
from voxelframe.operators import labels as L
from voxelframe.operators import sampling as SM


@query("smp1_stratified_holdout", f"""
select pid, label, case when row_number() over (partition by label order by {U('final','pid')}, pid)
 <= round_even(0.15e0*count(*) over (partition by label),0) then 'test' else 'train' end as split from f_label_a""")
def _(t):
    return SM.stratified_holdout(t.f_label_a, 0.15, "final").select("pid", "label", "split")


@query("smp2_holdout", f"""
select pid, case when row_number() over (order by {U('plain','pid')}, pid) <= floor(0.2e0*count(*) over ()) then 'valid' else 'train' end as split from f_label_b""")
def _(t):
    return SM.holdout(t.f_label_b.select("pid"), 0.2, "plain").select("pid", "split")


@query("smp3_shards", """
select pid, cid, least((row_number() over (order by pid, cid)-1)//((select count(*) from f_cand)//7)+1, 7) as shard from f_cand""")
def _(t):
    return SM.shards(t.f_cand.select("pid", "cid"), 7, ["pid", "cid"])


NEG_RANK = f"""select *, row_number() over (partition by pid order by {U('match','pid','aid')}, aid) as rn from f_ann where d=0"""


@query("smp4_matched_negatives", f"""
select pid, aid, d from f_ann where d>0 union all
select n.pid, n.aid, n.d from ({NEG_RANK}) n join (select pid, count(*) as want from f_ann where d>0 group by pid) w using (pid) where rn <= want""")
def _(t):
    return SM.matched_negatives(t.f_ann.select("pid", "aid", "d"), "match").select("pid", "aid", "d")


@query("smp5_one_annotation", f"select pid, arg_min(aid, {U('one','pid','aid')}) as aid from f_ann group by pid")
def _(t):
    return SM.one_per_group(t.f_ann, "one")


PICKS = """select pid, arg_min(aid, case when d>0 then %s end) as pos, arg_min(aid, case when d=0 then %s end) as neg,
 count(*) filter (d>0) as n from f_ann group by pid"""


@query("smp6_positive_share_batches", f"""
select (rn-1)//32 as batch_id, (rn-1)%32 as slot, pid, case when (rn-1)%32 < 10 then pos else neg end as aid, (rn-1)%32 < 10 as positive
from (select *, row_number() over (order by {U('batch','pid')}, pid) as rn from ({PICKS % (U('batch','pid','aid'), U('batch','pid','aid'))}) a where n>0) t""")
def _(t):
    return SM.positive_share_batches(t.f_ann, 32, 0.3, "batch")


@query("smp7_two_pool_batches", f"""
with per as ({PICKS % (U('pool','pid','aid'), U('pool','pid','aid'))}),
pos as (select (row_number() over (order by {U('pool','pid')}, pid)-1)//24 as batch_id, pid, pos as aid, true as positive from per where n>0),
neg as (select (row_number() over (order by {U('pool','pid')}, pid)-1)//8 as batch_id, pid, neg as aid, false as positive from per where n=0)
select * from pos union all select * from neg where batch_id in (select batch_id from pos)""")
def _(t):
    return SM.two_pool_batches(t.f_ann, 32, 0.75, "pool")


@query("smp8_fixed_ratio_epoch", f"""
with np as (select count(*) as n from f_ann where d>0),
pat as (select pid, n, row_number() over (order by {U('epoch','pid')}, pid) as patient from (select pid, count(*) as n from f_ann where d=0 group by pid) g),
num as (select pid, aid, row_number() over (partition by pid order by {U('epoch','pid','aid')}, aid) as item from f_ann where d=0),
draws as (select draw, cast(floor({U('epoch-patient','draw')}*(select count(*) from pat)) as bigint)+1 as patient, {U('epoch-item','draw')} as v
 from (select unnest(range(cast(floor(n+(1-0.25e0)/0.25e0*n) as bigint)-n)) as draw from np) d)
select pid, aid, cast(null as bigint) as draw, true as positive from f_ann where d>0
union all select p.pid, m.aid, d.draw, false from draws d join pat p using (patient) join num m on m.pid=p.pid and m.item=cast(floor(d.v*p.n) as bigint)+1""")
def _(t):
    return SM.fixed_ratio_epoch(t.f_ann, 0.25, "epoch")


@query("smp9_balanced_stream", f"""
with neg as (select pid, row_number() over (order by {U('coin','pid')}, pid) as turn from f_label_a where label=0),
pos as (select pid, row_number() over (order by {U('coin','pid')}, pid) as p from f_label_a where label=1),
many as (select turn, cast(floor(-ln(1-{U('coin-coin','turn')})/ln(2e0)) as int) as m from neg),
draws as (select turn, unnest(range(1,m+1)) as draw from many)
select turn, cast(0 as bigint) as draw, pid, 0 as label from neg
union all select d.turn, d.draw, pos.pid, 1 from draws d join pos on pos.p=cast(floor({U('coin-draw','turn','draw')}*(select count(*) from pos)) as bigint)+1""")
def _(t):
    return SM.balanced_stream(t.f_label_a, "coin").withColumn("draw", F.col("draw").cast("long"))


@query("smp10_weighted_draw", f"""
select pid, cid, cast(pick as int) as pick from (select *, row_number() over (partition by pid order by -ln(greatest({U('wd','pid','cid')}, 1e-16))/p, cid) as pick
 from (select pid, cid, p, row_number() over (partition by pid order by p desc, cid) as rn from f_cand) t where rn<=16) s where pick<=8""")
def _(t):
    return SM.weighted_draw(t.f_cand.select("pid", "cid", "p"), 8, 16, "p", "wd").select("pid", "cid", "pick")


@query("smp11_label_dependent_pick", f"""
select pid, cid, cast(pick as int) as pick from (select *, row_number() over (partition by pid order by case when label=1 then rn else {U('ld','pid','cid')} end, cid) as pick from (
 select c.pid, c.cid, c.rn, l.label from (select pid, cid, row_number() over (partition by pid order by p desc, cid) as rn from f_cand) c left join f_label_a l using (pid) where rn<=16) t) s where pick<=8""")
def _(t):
    return SM.label_dependent_pick(t.f_cand.select("pid", "cid", "p"), t.f_label_a, 8, 16, "ld").select("pid", "cid", "pick")


@query("smp12_shuffled_top", f"""
select pid, cid, cast(row_number() over (partition by pid order by {U('st','pid','cid')}, cid) as int) as slot from (
 select pid, cid, row_number() over (partition by pid order by p desc, cid) as rn from f_cand) t where rn<=8""")
def _(t):
    return SM.shuffled_top(t.f_cand.select("pid", "cid", "p"), 8, "st").select("pid", "cid", "slot")


@query("smp13_epoch_batches", f"""
select pid, (rn-1)//32 as batch_id, (rn-1)%32 as slot from (select pid, row_number() over (order by {U('ep','pid')}, pid) as rn from f_label_b) t
where (rn-1)//32 < (select count(*) from f_label_b)//32""")
def _(t):
    return SM.epoch_batches(t.f_label_b.select("pid"), 32, "ep", full_only=True).select("pid", "batch_id", "slot")


RANGES = {"translation_z": (-5, 5), "translation_y": (-5, 5), "translation_x": (-3, 3), "rotation_z": (-10, 10), "rotation_x": (0, 180)}


@query("smp14_augmentation", f"""
select pid, cid, {', '.join(f"{R(f'{lo}+{U(f'aug-{k}','pid','cid')}*({hi}-({lo}))')} as {k}" for k, (lo, hi) in RANGES.items())}, cast(0 as double) as rotation_y from f_cand""")
def _(t):
    drawn = t.f_cand.select("pid", "cid", *SM.augmentation(RANGES, "aug", "pid", "cid"))
    return drawn.select("pid", "cid", *[r6(c).alias(c) for c in drawn.columns[2:]])


@query("smp15_k_folds", f"""
select pid, cast((row_number() over (partition by label order by {U('cv','pid')}, pid)-1)%10 as int) as fold from f_label_a""")
def _(t):
    return SM.k_folds(t.f_label_a, 10, "cv").select("pid", "fold")


@query("smp16_random_centre", f"""
select pid, cast(2+floor({U('rc-z','pid')}*(nz-4)) as int) as cz, cast(2+floor({U('rc-y','pid')}*(ny-4)) as int) as cy, cast(1+floor({U('rc-x','pid')}*(nx-2)) as int) as cx
from (select pid, max(z)+1 as nz, max(y)+1 as ny, max(x)+1 as nx from f_vox group by pid) t""")
def _(t):
    shapes = t.f_vox.groupBy("pid").agg(*[(F.max(c) + 1).alias("n" + c) for c in "zyx"])
    return shapes.select("pid", *SM.random_centre([F.col("nz"), F.col("ny"), F.col("nx")], (4, 4, 3), "rc", "pid"))


# --- labels ----------------------------------------------------------------------------------

PROB = """least(greatest(case when d<5 then 0.035e0*d/5 when d<10 then 0.035+(d-5)*(0.28e0-0.035)/5
 when d<20 then 0.28e0+(d-10)*(0.64e0-0.28)/10 when d<25 then 0.64e0+(d-20)*(0.82e0-0.64)/5
 when d<30 then 0.82e0+(d-25)*(0.93e0-0.82)/5 else 0.93e0+(d-30)*(0.97e0-0.93)/10 end,0),1)"""


@query("lbl1_nodule_label", "select pid, aid, cast(d>0 as int) as y from f_ann")
def _(t):
    return t.f_ann.select("pid", "aid", L.nodule_label().alias("y"))


@query("lbl2_soft_malignancy", f"select pid, aid, {R(f'case when d>0 then {PROB} else 0 end')} as y from f_ann")
def _(t):
    return t.f_ann.select("pid", "aid", r6(L.soft_malignancy()).alias("y"))


@query("lbl3_size_label", f"select pid, aid, {R('case when d>0 then d else 0 end')} as y from f_ann")
def _(t):
    return t.f_ann.select("pid", "aid", r6(L.size_label()).alias("y"))


@query("lbl4_size_bin_label", """
select pid, aid, case when d<=0 then 0 when d<6 then 1 when d<12 then 2 when d<24 then 3 else 4 end as y from f_ann""")
def _(t):
    return t.f_ann.select("pid", "aid", L.size_bin_label([6, 12, 24]).alias("y"))


OBJECTIVES = ["nodule", "size", "malignancy", "spiculation", "texture"]


@query("lbl5_property_targets", f"""
with m as (select a.pid, a.aid, avg(malignancy) as mal, quantile_cont(spiculation,0.5) as spi, avg(texture) as tex from f_ann a join f_marks m on a.pid=m.pid
 where a.d>0.01 and m.cx is not null and (a.z-m.cz)*(a.z-m.cz)+(a.y-m.cy)*(a.y-m.cy)+(a.x-m.cx)*(a.x-m.cx) < 25 group by a.pid, a.aid)
select a.pid, a.aid, cast(d>0.01 as int)*1e0 as t_nodule, case when d>0.01 then cast(d>=8 as int)+cast(d>=16 as int)+cast(d>=24 as int) else 0 end*1e0 as t_size,
 {R('coalesce((mal-1)/4,0)')} as t_malignancy, coalesce(cast(spi>=2 as int)+cast(spi>=3.5 as int),0)*1e0 as t_spiculation, {R('coalesce(tex-1,0)')} as t_texture,
 1e0 as e_nodule, cast(d>0.01 as int)*1e0 as e_size, cast(mal is not null as int)*1e0 as e_malignancy, cast(spi is not null as int)*1e0 as e_spiculation,
 cast(tex is not null as int)*1e0 as e_texture from f_ann a left join m using (pid, aid)""")
def _(t):
    out = L.property_targets(
        t.f_ann, t.f_marks.drop("aid"), OBJECTIVES, {"size": [8, 16, 24], "spiculation": [2, 3.5]},
        {"malignancy": "bounded_continuous", "texture": "continuous"},
    )
    return out.select(
        "pid", "aid",
        *[r6(F.col("target")[i]).alias(f"t_{o}") for i, o in enumerate(OBJECTIVES)],
        *[F.col("enabled")[i].alias(f"e_{o}") for i, o in enumerate(OBJECTIVES)],
    )


@query("lbl6_property_vector", f"""
select pid, aid, reader, {R('case when d=0 then 0 else malignancy/5 end')} as v1, {R('case when d=0 then 0 else texture/5 end')} as v2,
 {R('case when d=0 then 0 else malignancy+10*spiculation+100*texture end')} as v_all
from (select m.*, case when (m.aid+reader)%3=0 then 0 else 1 end as d from f_marks m) t""")
def _(t):
    names = ["malignancy", "spiculation", "texture"]
    props = F.create_map(*[x for n in names for x in (F.lit(n), F.col(n))])
    d = F.when((F.col("aid") + F.col("reader")) % 3 == 0, 0.0).otherwise(1.0)
    some = L.property_vector(props, ["malignancy", "texture"], names, d)
    full = L.property_vector(props, [], names, d)
    return t.f_marks.select(
        "pid", "aid", F.col("reader").cast("int").alias("reader"), r6(some[0]).alias("v1"), r6(some[1]).alias("v2"),
        r6(full[0] + 10 * full[1] + 100 * full[2]).alias("v_all"),
    )


@query("lbl7_patient_label_batches", f"""
select p.pid, label, (row_number() over (order by {U('lb','p.pid')}, p.pid)-1)//16 as batch_id from (select p_partkey as pid from part) p left join f_label_a using (pid)""")
def _(t):
    patients = t.part.select(F.col("p_partkey").alias("pid"))
    return J.attach_label(SM.epoch_batches(patients, 16, "lb"), t.f_label_a).select("pid", "label", "batch_id")

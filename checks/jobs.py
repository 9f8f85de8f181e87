"""Row sets the models are fed from: compositions of the operators."""

from pyspark.sql import functions as F

from checks.candidates import WEIGHTS, merge_step, walk
from checks.registry import R, U, query, r6
from checks.sampling_labels import PICKS
from checks.scalars import LAYOUT
from checks.stencils import DOG_S, DOG_STEPS, peaks_sql, pruned_sql, weights_sql
from checks.volumes import AUG, SHAPES, SPACING8, piece_sums, trilinear_sql
from checks.windows_topk import ORDERED, UNIFORM, positioned
from voxelframe.operators import filters as FL
from voxelframe.operators import labels as L
from voxelframe.operators import volume as V
from voxelframe.operators import scoring as SC
from voxelframe.plans import jobs as JB
from voxelframe.plans import stages as ST


@query("job_segmentation_patches", f"""
with one as (select pid, arg_min(aid, {U('seg','pid','aid')}) as aid from f_ann where d>0 group by pid),
b as (select *, (row_number() over (order by {U('seg','pid')}, pid)-1)//16 as batch_id from one)
select b.pid, b.aid, batch_id, {R('a.d')} as d from b join f_ann a using (pid, aid)""")
def _(t):
    return JB.segmentation_patches(t.f_ann, 16, "seg").select("pid", "aid", "batch_id", r6("d").alias("d"))


@query("job_candidate_batches", f"""
select b.batch_id, b.slot, b.pid, b.aid, {R('case when a.d>0 then a.d else 0 end')} as y from (
 select (rn-1)//32 as batch_id, (rn-1)%32 as slot, pid, case when (rn-1)%32 < 16 then pos else neg end as aid
 from (select *, row_number() over (order by {U('cb','pid')}, pid) as rn from ({PICKS % (U('cb','pid','aid'), U('cb','pid','aid'))}) p where n>0) t) b join f_ann a using (pid, aid)""")
def _(t):
    rows = JB.candidate_batches(t.f_ann, 32, 0.5, "cb", L.size_label())
    return rows.select("batch_id", "slot", "pid", "aid", r6("y").alias("y"))


@query("job_candidate_validation", f"""
select pid, aid, 1 as y from f_ann where d>0 union all
select n.pid, n.aid, 0 from (select *, row_number() over (partition by pid order by {U('cv2','pid','aid')}, aid) as rn from f_ann where d=0) n
join (select pid, count(*) as want from f_ann where d>0 group by pid) w using (pid) where rn <= want""")
def _(t):
    return JB.candidate_validation(t.f_ann, "cv2").select("pid", "aid", "y")


@query("job_property_batches", f"""
with per as ({PICKS % (U('pb','pid','aid'), U('pb','pid','aid'))}),
rows_ as (select (row_number() over (order by {U('pb','pid')}, pid)-1)//24 as batch_id, pid, pos as aid from per where n>0),
neg as (select (row_number() over (order by {U('pb','pid')}, pid)-1)//8 as batch_id, pid, neg as aid from per where n=0),
chosen as (select * from rows_ union all select * from neg where batch_id in (select batch_id from rows_)),
m as (select a.pid, a.aid, avg(malignancy) as mal from f_ann a join f_marks m on a.pid=m.pid where a.d>0.01 and m.cx is not null
 and (a.z-m.cz)*(a.z-m.cz)+(a.y-m.cy)*(a.y-m.cy)+(a.x-m.cx)*(a.x-m.cx) < 25 group by a.pid, a.aid)
select c.batch_id, c.pid, c.aid, case when a.d>0.01 then 1e0 else 0e0 end as nodule, {R('coalesce((mal-1)/4,0)')} as malignancy, case when mal is null then 0e0 else 1e0 end as enabled
from chosen c join f_ann a using (pid, aid) left join m using (pid, aid)""")
def _(t):
    rows = JB.property_batches(
        t.f_ann, t.f_marks.drop("aid"), 32, 0.75, "pb", ["nodule", "malignancy"], {}, {"malignancy": "bounded_continuous"}
    )
    return rows.select(
        "batch_id", "pid", "aid", F.col("target")[0].alias("nodule"), r6(F.col("target")[1]).alias("malignancy"), F.col("enabled")[1].alias("enabled")
    )


@query("job_property_epoch", f"""
with pat as (select pid, n, row_number() over (order by {U('pe','pid')}, pid) as patient from (select pid, count(*) as n from f_ann where d=0 group by pid) g),
num as (select pid, aid, row_number() over (partition by pid order by {U('pe','pid','aid')}, aid) as item from f_ann where d=0),
draws as (select draw, cast(floor({U('pe-patient','draw')}*(select count(*) from pat)) as bigint)+1 as patient, {U('pe-item','draw')} as v
 from (select unnest(range(cast(floor(n+(1-0.25e0)/0.25e0*n) as bigint)-n)) as draw from (select count(*) as n from f_ann where d>0) c) d),
epoch as (select pid, aid, cast(-1 as bigint) as draw, true as positive from f_ann where d>0
 union all select p.pid, m.aid, d.draw, false from draws d join pat p using (patient) join num m on m.pid=p.pid and m.item=cast(floor(d.v*p.n) as bigint)+1)
select pid, aid, draw, positive, (row_number() over (order by {U('pe-order','pid','aid','draw')}, pid, aid, draw)-1)//32 as batch_id from epoch""")
def _(t):
    return JB.property_epoch(t.f_ann, 0.25, 32, "pe").select("pid", "aid", "draw", "positive", "batch_id")


@query("job_scans", f"""
with {ORDERED}, {UNIFORM},
pick as (select pid, sid, position_mm from (select o.*, count(*) over w as n, row_number() over (w order by instance_number desc, slice_no desc) as r
  from ord o join uni u using (pid) where not u.uniform window w as (partition by o.pid, slice_no//2)) p where n=2 and r=1
 union all select o.pid, o.sid, o.position_mm from ord o join uni u using (pid) where u.uniform),
again as (select pid, sid, row_number() over (partition by pid order by position_mm, sid)-1 as z from pick),
pix as (select l_suppkey as pid, cast(l_quantity as bigint)*2+cast(case when l_linestatus='O' then 1 else 0 end as bigint) as sid,
 cast(round(l_discount*100) as int) as y, cast(round(l_tax*100) as int) as x, cast(sum(l_partkey) % 1401 as int)-1000 as hu from lineitem group by 1,2,3,4)
select p.pid, cast(z as int) as z, y, x, hu from pix p join again using (pid, sid) where p.pid not in (select pid from f_label_a)""")
def _(t):
    sid = F.col("l_quantity").cast("long") * 2 + F.when(F.col("l_linestatus") == "O", 1).otherwise(0)
    pixels = t.lineitem.groupBy(
        F.col("l_suppkey").alias("pid"), sid.alias("sid"), F.round(F.col("l_discount") * 100).cast("int").alias("y"),
        F.round(F.col("l_tax") * 100).cast("int").alias("x"),
    ).agg((F.sum("l_partkey") % 1401 - 1000).cast("int").alias("hu"))
    return JB.scans(positioned(t), pixels, done=t.f_label_a)


@query("job_spacing_extrema", f"""
with {ORDERED}, {UNIFORM},
pick as (select pid, sid, position_mm from (select o.*, count(*) over w as n, row_number() over (w order by instance_number desc, slice_no desc) as r
  from ord o join uni u using (pid) where not u.uniform window w as (partition by o.pid, slice_no//2)) p where n=2 and r=1
 union all select o.pid, o.sid, o.position_mm from ord o join uni u using (pid) where u.uniform),
again as (select pid, sid, position_mm - lag(position_mm) over (partition by pid order by position_mm, sid) as gap, row_number() over (partition by pid order by position_mm, sid) as rn from pick),
per as (select pid, max(gap) filter (rn=2) as sz from again group by pid)
select {R('min(sz)')} as min_sz, {R('max(sz)')} as max_sz, {R('min(0.5+(pid%5)*0.1)')} as min_sy, {R('max(0.5+(pid%5)*0.1)')} as max_sy from per""")
def _(t):
    e = JB.spacing_extrema(positioned(t))
    return e.select(*[r6(c).alias(c) for c in e.columns])


@query("job_patient_slots", f"""
select s.pid, cast(s.slot as int) as rank, case when p>=0.9 then cid end as cid, {R('case when p>=0.9 then z/512 end')} as loc_z, label from (
 select pid, unnest(range(1,9)) as slot from (select distinct pid from f_cand where pid in (select p_partkey from part)) q) s
left join (select pid, cid, p, z, row_number() over (partition by pid order by p desc, cid) as rn from f_cand) c on c.pid=s.pid and c.rn=s.slot left join f_label_a l on l.pid=s.pid""")
def _(t):
    patients = t.part.select(F.col("p_partkey").alias("pid"))
    slots = JB.patient_slots(t.f_cand.select("pid", "cid", "z", "y", "x", "p"), patients, t.f_label_a, 8, "ps", threshold=0.9)
    return slots.select("pid", "rank", "cid", r6("loc_z").alias("loc_z"), "label")


@query("job_random_negative_slots", f"""
select pid, cid, cast(pick as int) as pick from (select *, row_number() over (partition by pid order by case when label=1 then rn else {U('rn','pid','cid')} end, cid) as pick from (
 select c.pid, c.cid, c.rn, l.label from (select pid, cid, row_number() over (partition by pid order by p desc, cid) as rn from f_cand) c left join f_label_b l using (pid) where rn<=16) t) s where pick<=8""")
def _(t):
    return JB.random_negative_slots(t.f_cand.select("pid", "cid", "p"), t.f_label_b, 8, 16, "rn").select("pid", "cid", "pick")


@query("job_balanced_slots", f"""
with known as (select * from f_label_a where pid in (select pid from f_cand)),
neg as (select pid, row_number() over (order by {U('bs','pid')}, pid) as turn from known where label=0),
pos as (select pid, row_number() over (order by {U('bs','pid')}, pid) as p from known where label=1),
draws as (select turn, unnest(range(1,m+1)) as draw from (select turn, cast(floor(-ln(1-{U('bs-coin','turn')})/ln(2e0)) as int) as m from neg) q),
stream as (select turn, cast(0 as int) as draw, pid, 0 as label from neg
 union all select d.turn, cast(d.draw as int), pos.pid, 1 from draws d join pos on pos.p=cast(floor({U('bs-draw','turn','draw')}*(select count(*) from pos)) as bigint)+1)
select s.*, c.cid, cast(rn as int) as rank from stream s join (select pid, cid, row_number() over (partition by pid order by p desc, cid) as rn from f_cand) c on c.pid=s.pid and rn<=4""")
def _(t):
    return JB.balanced_slots(t.f_cand.select("pid", "cid", "p"), t.f_label_a, 4, "bs").select("turn", "draw", "pid", "label", "cid", "rank")


@query("job_heat_maps", f"""
select h.*, label from (select pid, cast(floor(z*2.5e0/400*48) as int) as hz, cast(floor(y*0.7e0/400*48) as int) as hy, cast(floor(x*0.7e0/400*48) as int) as hx,
 {R('sum(features[5])/32')} as heat from f_feat group by 1,2,3,4) h left join f_label_a using (pid)""")
def _(t):
    return JB.heat_maps(t.f_feat, t.f_label_a, LAYOUT, (2.5, 0.7, 0.7)).withColumn("heat", r6("heat"))


@query("job_replica_draws", f"""
select pid, cid, cast(replica as int) as replica, {', '.join(f"{R(f'{lo}+{U(f'rep-{k}','pid','cid','replica')}*({hi}-({lo}))')} as {k}" for k, (lo, hi) in AUG.items())}
from (select *, unnest(range(2)) as replica from f_pts) t""")
def _(t):
    rows = JB.replica_patches(t.f_pts.select("pid", "cid"), 2, AUG, "rep")
    return rows.select("pid", "cid", "replica", *[r6(k).alias(k) for k in AUG])


GRID4 = "(select unnest(range(4)) as pz) gz, (select unnest(range(4)) as py) gy, (select unnest(range(4)) as px) gx"


# per patch: single values at the centre lie on a lattice with exact halves of the sixth decimal
@query("job_validation_patches", f"""
with {SHAPES}, targets as (select p.pid, p.cid as aid, cast(pz as int) as pz, cast(py as int) as py, cast(px as int) as px, nz, ny, nx,
 {', '.join(f"p{c}*(6.1e0/4)/{s}e0+p.{c}-3.05e0/{s} as s{c}" for c, s in zip('zyx', SPACING8))} from f_pts p join shapes on shapes.pid=p.pid, {GRID4})
select pid, aid, count(*) as n, {R('avg(least(greatest((v+1000)/1400,0),1))')} as mean, {R('sum((pz*16+py*4+px)*least(greatest((v+1000)/1400,0),1))/64')} as moment from ({trilinear_sql('targets', ('aid','pz','py','px'), rounded=False)}) r group by pid, aid""")
def _(t):
    pts = t.f_pts.withColumnRenamed("cid", "aid")
    rows = JB.centres(pts.select("pid", "aid"), pts)
    vox = t.f_vox
    out = JB.patch_pieces(rows, vox, V.volume_shapes(vox), SPACING8, (4, 4, 4), (6.1, 6.1, 6.1))
    return piece_sums(out, "v", "aid").select("pid", "aid", "n", r6("mean").alias("mean"), r6("moment").alias("moment"))


@query("job_masked_scan", f"""
with {SHAPES}, targets as (select pid, cast(z as int) as z, cast(y as int) as y, cast(x as int) as x, nz, ny, nx, z*(12/6e0)/1.5e0+nz/2e0-6/1.5e0 as sz, y*(12/6e0)/1.1e0+ny/2e0-6/1.1e0 as sy,
 x*(12/6e0)/1.2e0+nx/2e0-6/1.2e0 as sx from shapes, (select unnest(range(6)) as z) gz, (select unnest(range(6)) as y) gy, (select unnest(range(6)) as x) gx),
m as (select pid,z,y,x,1e0 as one from f_vox where hu < -350)
select a.pid, a.z, a.y, a.x, a.v as hu, b.v > 0 as inside from ({trilinear_sql('targets', 'zyx')}) a join ({trilinear_sql('targets', 'zyx', 'one', 'm')}) b using (pid, z, y, x)""")
def _(t):
    vox = t.f_vox
    out = JB.masked_scan(vox, FL.below(vox), V.volume_shapes(vox), SPACING8, (6, 6, 6), (12.0, 12.0, 12.0))
    return out.select("pid", "z", "y", "x", r6("hu").alias("hu"), "inside")


# a quarter of the patients is still to do; two replicas, moved by half a voxel
STAGE_T = f"""{SHAPES}, drawn as (select pid, cid, replica, {', '.join(f"{c}+({U(f'stage-{c}','pid','cid','replica')}*2-1)*0.5e0 as {c}" for c in 'zyx')}
 from (select *, unnest(range(2)) as replica from f_pts where pid % 4 = 0) t),
targets as (select p.pid, cid, replica, pz, py, px, nz, ny, nx, {', '.join(f"p{c}*(6.1e0/4)/{s}e0+p.{c}-3.05e0/{s} as s{c}" for c, s in zip('zyx', SPACING8))} from drawn p join shapes using (pid), {GRID4}),
vals as ({trilinear_sql('targets', ('cid','replica','pz','py','px'), rounded=False)}),
one as (select pid, cid, replica, 1/(1+exp(-(sum(least(greatest((v+1000)/1400,0),1)*(((pz*16+py*4+px+1)*7) % 11-5)/10e0)+0.25))) as p from vals group by pid, cid, replica),
means as (select pid, cid, avg(p) as p, count(*) as n_replicas from one group by pid, cid),
scored as (select f.pid, f.cid, f.z, f.y, f.x, f.d, m.p, m.n_replicas from f_pts f join means m on m.pid=f.pid and m.cid=f.cid)"""


@query("stage_scores", f"""with recursive {STAGE_T}, {walk('cid', merge_step(2.0), 'scored').removeprefix('with recursive ').replace('select pid, unnest', ', kept_ as (select pid, unnest', 1)})
select s.pid, s.cid, {R('s.p')} as p, s.n_replicas, row_number() over (partition by s.pid order by s.p desc, s.cid) as rank from scored s join kept_ using (pid, cid)""")
def _(t):
    vox = t.f_vox
    done = t.f_pts.filter("pid % 4 <> 0").select("pid")
    out = ST.stage_scores(
        t.f_pts, vox, V.volume_shapes(vox), SPACING8, (4, 4, 4), (6.1, 6.1, 6.1), SC.LinearSigmoid(WEIGHTS, 0.25), done, 2, 0.5, "stage", distance=2.0
    )
    return out.select("pid", "cid", r6("p").alias("p"), "n_replicas", "rank")


G9 = "(select unnest(range(9)) as z) gz, (select unnest(range(9)) as y) gy, (select unnest(range(9)) as x) gx"
STITCHED = """select pid, z+1 as z, y+1 as y, x+1 as x, v from squared where z<6 and y<6 and x<6"""
MASKED = f"""select s.* from ({STITCHED}) s join inside using (pid, z, y, x)"""
STAGE_C = f"""{SHAPES}, targets as (select pid, cast(z as int) as z, cast(y as int) as y, cast(x as int) as x, nz, ny, nx,
 {', '.join(f"{c}*(12/9e0)/{s}e0+n{c}/2e0-6/{s}e0 as s{c}" for c, s in zip('zyx', SPACING8))} from shapes, {G9} where pid % 2 = 0),
low as (select pid,z,y,x,1e0 as one from f_vox where hu < -350),
inside as (select pid, z, y, x from ({trilinear_sql('targets', 'zyx', 'one', 'low', rounded=False)}) q where v > 0),
squared as (select pid, z, y, x, pow(least(greatest((v+1000)/1400,0),1), 2) as v from ({trilinear_sql('targets', 'zyx', rounded=False)}) q),
{weights_sql(DOG_S, (9, 9, 9), MASKED)}, {DOG_STEPS}, {peaks_sql('0.05')}"""


# every second patient is still to do; the model squares its input
@query("stage_candidates", f"""with {STAGE_C}, {pruned_sql(0.5).replace('select pid, z*1e0', ', found as (select pid, z*1e0', 1)})
select pid, {', '.join(f"{R(f'{c}*(12/9e0)/{s}e0+n{c}/2e0-6/{s}e0')} as {c}" for c, s in zip('zyx', SPACING8))}, sigma from found join shapes using (pid)""")
def _(t):
    vox = t.f_vox
    sizes = V.volume_shapes(vox)
    out = ST.stage_candidates(
        vox, FL.below(vox), sizes, SPACING8, (9, 9, 9), (12.0, 12.0, 12.0), lambda tiles: tiles.withColumn("v", F.col("v") * F.col("v")),
        4, 3, sizes.filter("pid % 2 <> 0"), 1, 4, 0.05,
    )
    return out.select("pid", *[r6(c).alias(c) for c in "zyx"], r6("sigma").alias("sigma"))

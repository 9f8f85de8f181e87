"""Morphology, components, hulls, lung masks, scale spaces and blob detection."""

from pyspark.sql import functions as F

from checks.candidates import overlap_sql
from checks.lenses import BIG_SHAPE, VOX_SHAPE
from checks.registry import R, query, r6
from voxelframe.functions import scalars as S
from voxelframe.operators import components as C
from voxelframe.operators import filters as FL
from voxelframe.operators import morphology as M
from voxelframe.operators import scalespace as SS
from voxelframe.operators import spectrum as SP
from voxelframe.operators import volume as V
from voxelframe.plans import detection as D

NZ, NY, NX = VOX_SHAPE
KEYS = ["pid", "z", "y", "x"]


def shapes(t):
    return t.f_vox.select("pid").distinct().select(
        "pid", F.lit(NZ).alias("nz"), F.lit(NY).alias("ny"), F.lit(NX).alias("nx")
    )


def dense(t):
    """Every grid position with its HU, 0 where no voxel is present."""
    return V.densify(t.f_vox, shapes(t), "hu")


DENSE = f"""dense as (select g.pid, g.z, g.y, g.x, coalesce(v.hu,0) as hu from (select pid, cast(z as int) as z, cast(y as int) as y, cast(x as int) as x from (select distinct pid from f_vox) p,
 (select unnest(range({NZ})) as z) a, (select unnest(range({NY})) as y) b, (select unnest(range({NX})) as x) c) g left join f_vox v using (pid,z,y,x))"""


def disk(src, val, r, agg):
    return f"""select p.pid,p.z,p.y,p.x,{agg}(q.{val}) as {val} from {src} p join {src} q on q.pid=p.pid and q.z=p.z
     and (q.y-p.y)*(q.y-p.y)+(q.x-p.x)*(q.x-p.x)<={r * r} group by p.pid,p.z,p.y,p.x"""


def mask_of(df, condition):
    return df.withColumn("m", F.when(condition, 1).otherwise(0)).select(*KEYS, "m")


AIR = f"{DENSE}, m0 as (select pid,z,y,x,case when hu < -350 then 1 else 0 end as m from dense)"
BODY = f"{DENSE}, m0 as (select pid,z,y,x,case when hu > -350 then 1 else 0 end as m from dense)"


@query("vol15_binary_dilation", f"with {AIR}, d as ({disk('m0', 'm', 2, 'max')}) select pid,z,y,x from d where m=1")
def _(t):
    return M.dilate_disk(mask_of(dense(t), F.col("hu") < -350), "m", 2, placed=True).filter("m = 1").drop("m")


@query("vol15_binary_erosion", f"with {BODY}, d as ({disk('m0', 'm', 1, 'min')}) select pid,z,y,x from d where m=1")
def _(t):
    return M.erode_disk(mask_of(dense(t), F.col("hu") > -350), "m", 1, placed=True).filter("m = 1").drop("m")


@query("vol15_binary_opening", f"with {BODY}, e as ({disk('m0', 'm', 1, 'min')}), d as ({disk('e', 'm', 1, 'max')}) select pid,z,y,x from d where m=1")
def _(t):
    return M.open_disk(mask_of(dense(t), F.col("hu") > -350), "m", 1, placed=True).filter("m = 1").drop("m")


@query("vol15_binary_closing", f"with {AIR}, e as ({disk('m0', 'm', 1, 'max')}), d as ({disk('e', 'm', 1, 'min')}) select pid,z,y,x from d where m=1")
def _(t):
    return M.close_disk(mask_of(dense(t), F.col("hu") < -350), "m", 1, placed=True).filter("m = 1").drop("m")


CUBE = f"""{BODY}, e as (select p.pid,p.z,p.y,p.x from m0 p join m0 q on q.pid=p.pid and q.z between p.z-1 and p.z and q.y between p.y-1 and p.y and q.x between p.x-1 and p.x
 group by p.pid,p.z,p.y,p.x having min(q.m)=1),
o as (select distinct e.pid, cast(e.z-dz as int) as z, cast(e.y-dy as int) as y, cast(e.x-dx as int) as x from e, (select unnest([0,1]) as dz) a, (select unnest([0,1]) as dy) b, (select unnest([0,1]) as dx) c)"""


@query("vol15_cube_opening", f"with {CUBE} select * from o where z>=0 and y>=0 and x>=0")
def _(t):
    return M.opening(dense(t).filter("hu > -350").select(*KEYS), M.cube_offsets(2), VOX_SHAPE)


@query("vol15_dilation_3d", f"""
select distinct v.pid, cast(v.z+dz as int) as z, cast(v.y+dy as int) as y, cast(v.x+dx as int) as x from f_vox v, (select unnest([-1,0,1]) as dz) a, (select unnest([-1,0,1]) as dy) b, (select unnest([-1,0,1]) as dx) c
where v.hu < -800 and abs(dz)+abs(dy)+abs(dx)<=2 and v.z+dz between 0 and {NZ-1} and v.y+dy between 0 and {NY-1} and v.x+dx between 0 and {NX-1}""")
def _(t):
    return M.dilate(FL.below(t.f_vox, threshold=-800), M.neighbour_offsets(2), VOX_SHAPE)


@query("vol16_grey_closing_erosion", f"with {DENSE}, a as ({disk('dense', 'hu', 1, 'max')}), b as ({disk('a', 'hu', 1, 'min')}), c as ({disk('b', 'hu', 2, 'min')}) select pid,z,y,x,{R('hu')} as hu from c")
def _(t):
    chain = M.disk_chain(dense(t).select(*KEYS, "hu"), "hu", [(1, True), (1, False), (2, False)], placed=True)
    return chain.select(*KEYS, r6("hu").alias("hu"))


EDGE = f"(y=0 or x=0 or y={NY-1} or x={NX-1})"


def reach(name, src, diagonal):
    near = "abs(n.y-r.y)<=1 and abs(n.x-r.x)<=1" if diagonal else "abs(n.y-r.y)+abs(n.x-r.x)=1"
    return f"""{name}(pid,z,y,x) as (select pid,z,y,x from {src} where {EDGE} union
     select n.pid,n.z,n.y,n.x from {name} r join {src} n on n.pid=r.pid and n.z=r.z and {near})"""


@query("vol17_clear_border", f"""with recursive air as (select pid,z,y,x from f_vox where hu < -350), {reach('gone', 'air', True)}
select * from air except select * from gone""")
def _(t):
    return C.clear_border(FL.below(t.f_vox).select(*KEYS), NY, NX)


FILLED = f"""{DENSE}, back as (select pid,z,y,x from dense where not hu > -350), {reach('outside', 'back', False)},
filled as (select pid,z,y,x from dense except select * from outside)"""


@query("vol18_fill_holes", f"with recursive {FILLED} select * from filled")
def _(t):
    return C.fill_holes(dense(t), F.col("hu") > -350, NY, NX, placed=True)


def hull_sql(src, axis, keys="pid"):
    """Hull of each slice of src from all pairs of rim points of its row extents."""
    row, col = [c for c in "zyx" if c != axis]
    return f"""ext as (select {keys}, {axis} as s, {row} as r, min({col})*1e0 as lo, max({col})*1e0 as hi from {src} group by {keys}, {axis}, {row}),
 low as (select {keys}, s, r-0.5e0 as r, lo as c from ext union all select {keys}, s, r+0.5e0, lo from ext union all select {keys}, s, r, lo-0.5 from ext),
 top as (select {keys}, s, r-0.5e0 as r, hi as c from ext union all select {keys}, s, r+0.5e0, hi from ext union all select {keys}, s, r, hi+0.5 from ext),
 rows_ as (select {keys}, s, unnest(range(min(r), max(r)+1)) as r from ext group by {keys}, s),
 lows as (select q.pid, q.s, q.r, min(case when a.r=b.r then least(a.c,b.c) else a.c+(b.c-a.c)*(q.r-a.r)/(b.r-a.r) end) as c from rows_ q join low a on a.pid=q.pid and a.s=q.s and a.r<=q.r join low b on b.pid=q.pid and b.s=q.s and b.r>=q.r group by 1,2,3),
 tops as (select q.pid, q.s, q.r, max(case when a.r=b.r then greatest(a.c,b.c) else a.c+(b.c-a.c)*(q.r-a.r)/(b.r-a.r) end) as c from rows_ q join top a on a.pid=q.pid and a.s=q.s and a.r<=q.r join top b on b.pid=q.pid and b.s=q.s and b.r>=q.r group by 1,2,3),
 hull as (select pid, cast(s as int) as {axis}, cast(r as int) as {row}, cast(unnest(range(cast(ceil(l.c-1e-9) as int), cast(floor(h.c+1e-9) as int)+1)) as int) as {col} from lows l join tops h using (pid, s, r))"""


@query("vol19_convex_hull", f"with low8 as (select pid,z,y,x from f_vox where hu < -800), {hull_sql('low8', 'z')} select pid,z,y,x from hull")
def _(t):
    return C.convex_hull(FL.below(t.f_vox, threshold=-800).select(*KEYS))


@query("vol19_convex_hull_x", f"with low8 as (select pid,z,y,x from f_vox where hu < -800), {hull_sql('low8', 'x')} select pid,z,y,x from hull")
def _(t):
    return C.convex_hull(FL.below(t.f_vox, threshold=-800).select(*KEYS), "x")


CODE = "cast(z as bigint)*1099511627776+cast(y as bigint)*1048576+cast(x as bigint)"


def labels_sql(name, src, three_d):
    near = "abs(n.z-r.z)<=1 and" if three_d else "n.z=r.z and"
    return f"""walk_{name}(pid,z,y,x,code) as (select pid,z,y,x,{CODE} from {src} union select n.pid,n.z,n.y,n.x,r.code from walk_{name} r join {src} n
      on n.pid=r.pid and {near} abs(n.y-r.y)<=1 and abs(n.x-r.x)<=1),
     {name} as (select pid,z,y,x,min(code) as label from walk_{name} group by pid,z,y,x)"""


AIR_SET = "air as (select pid,z,y,x from f_vox where hu < -350), deep as (select pid,z,y,x from f_vox where hu < -700)"


@query("vol20_label_slices", f"with recursive {AIR_SET}, {labels_sql('lab', 'air', False)} select * from lab")
def _(t):
    return C.label_slices(FL.below(t.f_vox))


@query("vol20_label_volume", f"with recursive {AIR_SET}, {labels_sql('lab', 'deep', True)} select * from lab")
def _(t):
    return C.label_volume(FL.below(t.f_vox, threshold=-700), brick=4)


@query("vol21_region_properties", f"""with recursive {AIR_SET}, {labels_sql('lab', 'deep', True)}
select pid, label, count(*) as area, {R('avg(z)')} as cz, {R('avg(y)')} as cy, {R('avg(x)')} as cx, min(z) as min_z, max(z) as max_z from lab group by pid, label""")
def _(t):
    p = C.region_properties(C.label_volume(FL.below(t.f_vox, threshold=-700), brick=4))
    return p.select("pid", "label", "area", *[r6(f"c{c}").alias(f"c{c}") for c in "zyx"], "min_z", "max_z")


@query("vol22_keep_largest", f"""with recursive {AIR_SET}, {labels_sql('lab', 'deep', True)},
best as (select pid, label, row_number() over (partition by pid order by count(*) desc, label) as rn from lab group by pid, label)
select l.pid, z, y, x, l.label from lab l join best b on b.pid=l.pid and b.label=l.label and rn=1""")
def _(t):
    return C.keep_largest(C.label_volume(FL.below(t.f_vox, threshold=-700), brick=4))


def linked_sql(src, min_pixels, min_share):
    """Regions of src kept by the walk from the middle slice outward."""
    mid = NZ // 2
    return f"""{labels_sql('lab', src, False)},
 reg as (select pid, label, max(z) as z, count(*) as area from lab group by pid, label),
 ov as (select a.pid, a.z, a.label, b.label as parent, count(*) as n from lab a join lab b on b.pid=a.pid and b.y=a.y and b.x=a.x and b.z=a.z-sign(a.z-{mid}) where a.z<>{mid} group by 1,2,3,4),
 alive(step, pid, label) as (select 0, pid, label from reg where z={mid} union all
  select a.step+1, o.pid, o.label from alive a join ov o on o.pid=a.pid and o.parent=a.label join reg r on r.pid=o.pid and r.label=o.label
  where abs(o.z-{mid})=a.step+1 group by a.step+1, o.pid, o.label having sum(n)>={min_pixels} and sum(n)/max(r.area)>={min_share}),
 linked as (select lab.pid, lab.z, lab.y, lab.x from lab join alive using (pid, label))"""


@query("vol23_prune_by_overlap", f"with recursive {AIR_SET}, {linked_sql('air', 1, 0.3)} select * from linked")
def _(t):
    return C.prune_by_overlap(FL.below(t.f_vox).select(*KEYS), NZ // 2, 1, 0.3)


@query("vol24_lung_mask_hull", f"""with recursive air as (select pid,z,y,x from f_vox where hu < -200), {reach('gone', 'air', True)},
cleared as (select * from air except select * from gone), {DENSE}, m0 as (select d.pid,d.z,d.y,d.x,case when c.pid is null then 0 else 1 end as m from dense d left join cleared c using (pid,z,y,x)),
e as ({disk('m0', 'm', 1, 'min')}), o as ({disk('e', 'm', 1, 'max')}), om as (select pid,z,y,x from o where m=1), {hull_sql('om', 'z')} select pid,z,y,x from hull""")
def _(t):
    return D.lung_mask_hull(t.f_vox, shapes(t), threshold=-200, radius=1)


BODY_VALUES = f"""{FILLED}, f0 as (select d.pid,d.z,d.y,d.x,d.hu,case when f.pid is null then 0 else 1 end as m from dense d left join filled f using (pid,z,y,x)),
core as ({disk('f0', 'm', 1, 'min')}), inn as (select f.pid,f.z,f.y,f.x,f.hu*c.m as hu from f0 f join core c using (pid,z,y,x)),
c1 as ({disk('inn', 'hu', 1, 'max')}), closed as ({disk('c1', 'hu', 1, 'min')})"""


@query("vol25_lung_mask_body", f"with recursive {BODY_VALUES}, w as ({disk('closed', 'hu', 2, 'min')}) select pid,z,y,x from w where hu < -350")
def _(t):
    return D.lung_mask_body(dense(t), body=1, close=1, wall=2, placed=True)


@query("vol26_lung_mask_linked", f"""with recursive {BODY_VALUES}, lung as (select pid,z,y,x from closed where hu < -350), {linked_sql('lung', 1, 0.015)},
m1 as (select d.pid,d.z,d.y,d.x,case when l.pid is null then 0 else 1 end as m from dense d left join linked l using (pid,z,y,x)), g as ({disk('m1', 'm', 2, 'max')}) select pid,z,y,x from g where m=1""")
def _(t):
    return D.lung_mask_linked(dense(t), body=1, close=1, grow=2, min_pixels=1, placed=True, shapes=shapes(t))


@query("vol27_lung_mask_region")
def _(t):
    # raw values are noise; smoothed ones have regions large enough to survive the opening
    smooth = SS.scale_space(t.f_vox, shapes(t), [1.0], "gauss", "hu").drop("level")
    return D.lung_mask_region(smooth, shapes(t), threshold=-180, min_area=8, value="v", brick=8)


# --- scale spaces ----------------------------------------------------------------------------


def norm_vox(t):
    return t.f_vox.select(*KEYS, S.hu_norm("hu").alias("v"))


NORM_VOX = "select pid,z,y,x,least(greatest((hu+1000)/1400e0,0),1) as v from f_vox"


def weights_sql(sigmas, shape=VOX_SHAPE, vox=NORM_VOX):
    """Smoothing weights per axis, scale and derivative order, ends mirrored."""
    rows = ",".join(f"({i},{s!r}e0)" for i, s in enumerate(sigmas))
    axes = " union all ".join(f"select '{c}' as axis, {n} as n" for c, n in zip("zyx", shape))
    return f"""sig(s, sigma) as (select * from (values {rows}) v),
 ker0 as (select s, sigma, k, exp(-0.5*(k/sigma)*(k/sigma)) as w from (select s, sigma, unnest(range(-cast(floor(4*sigma+0.5) as int), cast(floor(4*sigma+0.5) as int)+1)) as k from sig) q),
 ker1 as (select s, sigma, k, w/sum(w) over (partition by s) as w from ker0),
 ker as (select s, 0 as d, k, w from ker1 union all select s, 2, k, w*(k*k/pow(sigma,4)-1/pow(sigma,2)) from ker1),
 wts as (select axis, s, d, o, case when m<n then m else 2*n-1-m end as i, sum(w) as w from (select axis, n, s, d, o, (((o+k)%(2*n))+2*n)%(2*n) as m, w from (select axis, n, unnest(range(n)) as o from ({axes}) a) b, ker) c group by 1,2,3,4,5),
 vox as ({vox})"""


def axis_pass(src, axis, d, out):
    others = ", ".join(f"a.{c}" for c in "zyx" if c != axis)
    on_s = "and w.s=a.s" if src != "vox" else ""
    return f"""{out} as (select a.pid, w.s, {others}, w.o as {axis}, sum(w.w*a.v) as v from {src} a join wts w on w.axis='{axis}' and w.d={d} and w.i=a.{axis} {on_s} group by a.pid, w.s, {others}, w.o)"""


GAUSS = f"{axis_pass('vox', 'x', 0, 'gx')}, {axis_pass('gx', 'y', 0, 'gxy')}, {axis_pass('gxy', 'z', 0, 'g')}"
DOG_S = SS.dog_sigmas(1, 4)
LOG_S = SS.log_sigmas(1, 3, 3)
DOG_STEPS = f"""{GAUSS}, space as (select pid, z, y, x, q.s as level, (v-next_v)*sigma as v
 from (select *, lead(v) over (partition by pid, z, y, x order by s) as next_v from g) q join sig on sig.s=q.s where next_v is not null)"""
DOG = f"{weights_sql(DOG_S)}, {DOG_STEPS}"
LOG = f"""{weights_sql(LOG_S)}, {GAUSS}, {axis_pass('vox', 'x', 2, 'hx')}, {axis_pass('hx', 'y', 0, 'hxy')}, {axis_pass('hxy', 'z', 0, 'lx')},
 {axis_pass('gx', 'y', 2, 'hy')}, {axis_pass('hy', 'z', 0, 'ly')}, {axis_pass('gxy', 'z', 2, 'lz')},
 space as (select pid, z, y, x, u.s as level, -sum(v)*max(sigma)*max(sigma) as v from (select * from lx union all by name select * from ly union all by name select * from lz) u join sig on sig.s=u.s group by pid, z, y, x, u.s)"""
OUT = f"select pid, cast(z as int) as z, cast(y as int) as y, cast(x as int) as x, cast(level as int) as level, {R('v')} as v"


def space_out(df):
    return df.select(*KEYS, "level", r6("v").alias("v"))


@query("vol28_gaussian", f"with {weights_sql(DOG_S)}, {GAUSS}, space as (select *, s as level from g) {OUT} from space")
def _(t):
    return space_out(SS.scale_space(norm_vox(t), shapes(t), DOG_S, "gauss"))


@query("vol29_difference_of_gaussians", f"with {DOG} {OUT} from space")
def _(t):
    return space_out(SS.scale_space(norm_vox(t), shapes(t), DOG_S, "dog"))


@query("vol30_laplacian_of_gaussian", f"with {LOG} {OUT} from space")
def _(t):
    return space_out(SS.scale_space(norm_vox(t), shapes(t), LOG_S, "log"))


def peaks_sql(threshold):
    return f"""peaks as (select a.pid, a.z, a.y, a.x, a.level, max(a.v) as v from space a join space b on b.pid=a.pid and abs(b.z-a.z)<=1 and abs(b.y-a.y)<=1 and abs(b.x-a.x)<=1 and abs(b.level-a.level)<=1
 where a.v > {threshold} group by 1,2,3,4,5 having max(b.v)=max(a.v))"""


@query("vol31_local_maxima", f"with {DOG}, {peaks_sql('0.1')} {OUT} from peaks")
def _(t):
    return space_out(SS.local_maxima(norm_vox(t), shapes(t), DOG_S, "dog", 0.1))


def pruned_sql(limit):
    return f"""blob as (select p.*, p.s as sigma, ((z*1099511627776+y*1048576+x)*64+level) as cid from (select peaks.*, sig.sigma as s from peaks join sig on sig.s=peaks.level) p),
 dead as (select a.pid, a.cid from blob a join blob b on b.pid=a.pid and (b.sigma>a.sigma or (b.sigma=a.sigma and b.cid>a.cid)), lateral (select sqrt((a.z-b.z)*(a.z-b.z)+(a.y-b.y)*(a.y-b.y)+(a.x-b.x)*(a.x-b.x)) as dd) l
  where {overlap_sql('dd', 'a.sigma', 'b.sigma')} > {limit})
select pid, z*1e0 as z, y*1e0 as y, x*1e0 as x, {R('sigma')} as sigma from blob where not exists (select 1 from dead where dead.pid=blob.pid and dead.cid=blob.cid)"""


@query("can6_blob_detection_dog", f"with {DOG}, {peaks_sql('0.1')}, {pruned_sql(0.5)}")
def _(t):
    b = D.detect_blobs_dog(norm_vox(t), shapes(t), 1, 4, threshold=0.1)
    return b.select(*KEYS, r6("sigma").alias("sigma"))


@query("can7_blob_detection_log", f"with {LOG}, {peaks_sql('0.2')}, {pruned_sql(0.5)}")
def _(t):
    b = D.detect_blobs_log(norm_vox(t), shapes(t), 1, 3, 3, 0.2)
    return b.select(*KEYS, r6("sigma").alias("sigma"))


# --- scans of 64 voxels per axis, scales from 1 to beyond 15 ------------------------------------

WIDE_S = SS.dog_sigmas(1, 15)
WIDE = f"{weights_sql(WIDE_S, BIG_SHAPE, 'select pid,z,y,x,v from f_big')}, {DOG_STEPS}"
WIDE_LEAST = 0.15
NEAR = ", ".join(f"(select unnest([-1,0,1]) as d{c}) n{c}" for c in "zyxl")
WIDE_PEAKS = f"""high as (select * from space where v > {WIDE_LEAST}),
 around as (select a.*, a.z+dz as bz, a.y+dy as b_y, a.x+dx as bx, a.level+dl as bl from high a, {NEAR}),
 peaks as (select a.pid, a.z, a.y, a.x, a.level, max(a.v) as v from around a join space b on b.pid=a.pid and b.z=a.bz and b.y=a.b_y and b.x=a.bx and b.level=a.bl group by 1,2,3,4,5 having max(b.v)=max(a.v))"""


def big_shapes(t):
    return t.f_big.select("pid").distinct().select("pid", *[F.lit(n).alias(f"n{c}") for c, n in zip("zyx", BIG_SHAPE)])


@query("vol31_wide_maxima", f"with {WIDE}, {WIDE_PEAKS} {OUT} from peaks")
def _(t):
    return space_out(SS.local_maxima(t.f_big, big_shapes(t), WIDE_S, "dog", WIDE_LEAST, slab=24))


@query("can6_blob_detection_wide", f"with {WIDE}, {WIDE_PEAKS}, {pruned_sql(0.5)}")
def _(t):
    b = D.detect_blobs_dog(t.f_big, big_shapes(t), 1, 15, threshold=WIDE_LEAST, slab=24)
    return b.select(*[F.col(c).cast("double").alias(c) if c != "pid" else F.col(c) for c in KEYS], r6("sigma").alias("sigma"))


BIG_DENSE = """big as (select g.pid, g.z, g.y, g.x, coalesce(v.v,0)*10+(g.z*31+g.y*17+g.x*23) % 97 as hu from (select pid, cast(z as int) as z, cast(y as int) as y, cast(x as int) as x from (select distinct pid from f_big) p,
 (select unnest(range(64)) as z) a, (select unnest(range(64)) as y) b, (select unnest(range(64)) as x) c) g left join f_big v using (pid,z,y,x))"""


def big_dense(t):
    full = V.densify(t.f_big, big_shapes(t), "v")
    return full.select(*KEYS, (F.col("v") * 10 + (F.col("z") * 31 + F.col("y") * 17 + F.col("x") * 23) % 97).alias("hu"))


def wide_disk(src, val, r, agg):
    """A disk of any radius as windows: runs along x, then the rows of the disk."""
    widths = M.run_widths(r)
    runs = ", ".join(f"{agg}({val}) over (partition by pid,z,y order by x range between {w} preceding and {w} following) as r{w}" for w in sorted(set(widths.values())))
    side = [f"{abs(d)} {'preceding' if d < 0 else 'following'}" for d in widths]
    rows = ", ".join(f"{agg}(r{w}) over (partition by pid,z,x order by y range between {e} and {e})" for (d, w), e in zip(widths.items(), side))
    return f"select pid,z,y,x,{'greatest' if agg == 'max' else 'least'}({rows}) as {val} from (select pid,z,y,x,{runs} from {src}) q"


ROUND = "hu > 90 or (y-32)*(y-32)+(x-32)*(x-32) < (18+z % 9)*(18+z % 9)"


@query("vol15_wide_opening", f"""with {BIG_DENSE}, m0 as (select pid,z,y,x,case when {ROUND} then 1 else 0 end as m from big), a as ({wide_disk('m0', 'm', 5, 'min')}),
b as ({wide_disk('a', 'm', 5, 'max')}), c as ({wide_disk('b', 'm', 8, 'min')}), d as ({wide_disk('c', 'm', 13, 'max')}) select pid,z,y,x from d where m=1""")
def _(t):
    """Disks of 5, 8 and 13 in one chain."""
    chain = M.disk_chain(mask_of(big_dense(t), F.expr(ROUND)), "m", [(5, False), (5, True), (8, False), (13, True)], placed=True)
    return chain.filter("m = 1").drop("m")


@query("vol16_wide_grey", f"""with {BIG_DENSE}, a as ({wide_disk('big', 'hu', 2, 'max')}), b as ({wide_disk('a', 'hu', 2, 'min')}), c as ({wide_disk('b', 'hu', 13, 'min')}) select pid,z,y,x,{R('hu')} as hu from c""")
def _(t):
    chain = M.disk_chain(big_dense(t), "hu", [(2, True), (2, False), (13, False)], placed=True)
    return chain.select(*KEYS, r6("hu").alias("hu"))


N_SPEC = 64


@query("vol32_power_spectrum_1d", f"""
with w as (select i, 0.54-0.46*cos(2*pi()*i/62) as h from (select unnest(range(63)) as i) q),
vals as (select pid, i, cast(v[i+1] as double)*h as a from f_patch, w)
select pid, k, {R('sqrt(pow(sum(a*cos(2*pi()*k*i/63)),2)+pow(sum(a*sin(2*pi()*k*i/63)),2))')} as magnitude from vals, (select unnest(range(32)) as k) f group by pid, k""")
def _(t):
    out = SP.power_spectrum(t.f_patch, (64,), "v")
    return out.select("pid", F.posexplode("spectrum").alias("k", "m")).select("pid", F.col("k").cast("long").alias("k"), r6("m").alias("magnitude"))


@query("vol32_power_spectrum_3d", f"""
with w as (select i, pow(0.54-0.46*cos(2*pi()*i/2),1e0/3) as h from (select unnest(range(3)) as i) q),
vals as (select pid, a.i as z, b.i as y, c.i as x, cast(v[a.i*16+b.i*4+c.i+1] as double)*a.h*b.h*c.h as v from f_patch, w a, w b, w c)
select pid, kz*4+ky*2+kx as k, {R('sqrt(pow(sum(v*cos(2*pi()*(kz*z+ky*y+kx*x)/3)),2)+pow(sum(v*sin(2*pi()*(kz*z+ky*y+kx*x)/3)),2))')} as magnitude
from vals, (select unnest(range(2)) as kz) fz, (select unnest(range(2)) as ky) fy, (select unnest(range(2)) as kx) fx group by pid, kz, ky, kx""")
def _(t):
    out = SP.power_spectrum(t.f_patch, (4, 4, 4), "v")
    return out.select("pid", F.posexplode("spectrum").alias("k", "m")).select("pid", F.col("k").cast("long").alias("k"), r6("m").alias("magnitude"))

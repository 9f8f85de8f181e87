"""Affine maps, resampling, patches, shapes and tiles."""

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from checks.lenses import VOX_SHAPE
from checks.registry import R, T6, U, query, r6, tied6
from voxelframe.functions import affine as A
from voxelframe.operators import filters as FL
from voxelframe.operators import sampling as SM
from voxelframe.operators import volume as V
from voxelframe.plans import bricks as BR

NZ, NY, NX = VOX_SHAPE
AUG = {"translation_z": (-5, 5), "translation_y": (-5, 5), "translation_x": (-5, 5),
       "rotation_z": (-10, 10), "rotation_y": (-10, 10), "rotation_x": (-10, 10)}
DRAWS = ", ".join(f"{lo}+{U(f'aff-{k}','pid','cid')}*({hi}-({lo})) as {k}" for k, (lo, hi) in AUG.items())
# rotation about z, y, x as one matrix, then scale and translation
ROT = f"""draws as (select pid, cid, z, y, x, d, {DRAWS} from f_cand),
trig as (select *, cos(radians(rotation_z)) as c0, sin(radians(rotation_z)) as s0, cos(radians(rotation_y)) as c1, sin(radians(rotation_y)) as s1,
 cos(radians(rotation_x)) as c2, sin(radians(rotation_x)) as s2 from draws),
rot as (select *, c2*c1 as r00, -c2*s1*s0+s2*c0 as r01, -c2*s1*c0-s2*s0 as r02, -s2*c1 as r10, s2*s1*s0+c2*c0 as r11, s2*s1*c0-c2*s0 as r12,
 s1 as r20, c1*s0 as r21, c1*c0 as r22 from trig),
aff as (select *, -(r00*translation_z+r01*translation_y+r02*translation_x) as g0, -(r10*translation_z+r11*translation_y+r12*translation_x) as g1,
 -(r20*translation_z+r21*translation_y+r22*translation_x) as g2 from rot)"""


def drawn(t):
    return t.f_cand.select("pid", "cid", "z", "y", "x", "d", *SM.augmentation(AUG, "aff", "pid", "cid"))


def rotation():
    return [F.col(f"rotation_{a}") for a in "zyx"]


def translation():
    return [F.col(f"translation_{a}") for a in "zyx"]


def entries(m, names="m"):
    return [r6(c).alias(f"{names}{i}{j}") for (i, j), c in zip([(i, j) for i in range(3) for j in range(4)], A.to_columns(m))]


@query("vol1_build_affine", f"""with {ROT} select pid, cid, {', '.join(R(f'r{i}{j}/{s}') + f' as m{i}{j}' for i in range(3) for j, s in enumerate(('2e0','0.5e0','1.25e0')))},
 {', '.join(R(f'g{i}') + f' as m{i}3' for i in range(3))} from aff""")
def _(t):
    return drawn(t).select("pid", "cid", *entries(A.affine([2.0, 0.5, 1.25], rotation(), translation())))


# patch of 48 voxels over 60 mm around the candidate, spacing 2.5 x 0.7 x 0.7
SP = ("2.5e0", "0.7e0", "0.7e0")
TOTAL = f"""tot as (select *, {', '.join(f'r{i}{j}*60/48/{SP[i]} as a{i}{j}' for i in range(3) for j in range(3))},
 {', '.join(f'({c}*{SP[i]} + g{i} - 30*(r{i}0+r{i}1+r{i}2))/{SP[i]} as o{i}' for i, c in enumerate('zyx'))} from aff)"""


def total_map():
    return A.patch_map(
        [F.col(c) for c in "zyx"], [2.5, 0.7, 0.7], (48, 48, 48), (60.0, 60.0, 60.0), rotation=rotation(), translation=translation()
    )


@query("vol2_compose_affine", f"""with {ROT}, {TOTAL} select pid, cid, {', '.join(R(f'a{i}{j}') + f' as m{i}{j}' for i in range(3) for j in range(3))},
 {', '.join(R(f'o{i}') + f' as m{i}3' for i in range(3))} from tot""")
def _(t):
    return drawn(t).select("pid", "cid", *entries(total_map()))


def cof(i, j):
    r, c = [k for k in range(3) if k != i], [k for k in range(3) if k != j]
    sign = "" if (i + j) % 2 == 0 else "-1*"
    return f"{sign}(a{r[0]}{c[0]}*a{r[1]}{c[1]}-a{r[0]}{c[1]}*a{r[1]}{c[0]})"


DET = "(" + "+".join(f"a0{j}*({cof(0, j)})" for j in range(3)) + ")"
DELTA = ["(z+3-o0)", "(y-2-o1)", "(x+1.5e0-o2)"]


@query("vol3_transform_points", f"""with {ROT}, {TOTAL} select pid, cid,
 {', '.join(R(f'a{i}0*10+a{i}1*20+a{i}2*30+o{i}') + f' as f{c}' for i, c in enumerate('zyx'))},
 {', '.join(f"round_even(({'+'.join(f'({cof(k, i)})*{DELTA[k]}' for k in range(3))})/{DET},0)+0e0 as o{c}" for i, c in enumerate('zyx'))},
 round_even(d*48/60,0)+0e0 as od from tot""")
def _(t):
    m = total_map()
    forward = A.apply(m, [10.0, 20.0, 30.0])
    points = drawn(t).select(
        "pid", "cid", *A.to_columns(m), *[f.alias(f"f{c}") for f, c in zip(forward, "zyx")],
        (F.col("z") + 3).alias("z"), (F.col("y") - 2).alias("y"), (F.col("x") + 1.5).alias("x"), "d",
    )
    moved = V.transform_points(points, A.from_columns(), (48, 48, 48), (60.0, 60.0, 60.0))
    return moved.select("pid", "cid", *[r6(f"f{c}").alias(f"f{c}") for c in "zyx"], "oz", "oy", "ox", "od")


SHAPES = "shapes as (select pid, max(z)+1 as nz, max(y)+1 as ny, max(x)+1 as nx from f_vox group by pid)"


def trilinear_sql(targets, keys, value="hu", table="f_vox", rounded=True):
    """Interpolated value of targets(pid, keys, sz, sy, sx, nz, ny, nx)."""
    k = ", ".join(f"t.{c}" for c in keys)
    w = "*".join(f"(1-abs(v.{c}-t.s{c}))" for c in "zyx")
    near = " and ".join(f"v.{c} between cast(floor(t.s{c}) as int) and cast(floor(t.s{c}) as int)+1 and abs(v.{c}-t.s{c})<1 and t.s{c}>=0 and t.s{c}<=t.n{c}-1" for c in "zyx")
    total = f"coalesce(sum({w}*v.{value}),0)"
    return f"""select t.pid, {k}, {R(total) if rounded else total} as v from {targets} t left join {table} v on v.pid=t.pid and {near} group by t.pid, {k}"""


GRID8 = "(select unnest(range(8)) as z) gz, (select unnest(range(8)) as y) gy, (select unnest(range(8)) as x) gx"
# 8 voxels over 12 mm around the middle of the scan, spacing 1.5 x 1.1 x 1.2
SCAN_T = f"""targets as (select pid, cast(z as int) as z, cast(y as int) as y, cast(x as int) as x, nz, ny, nx, z*(12/8e0)/1.5e0+nz/2e0-6/1.5e0 as sz, y*(12/8e0)/1.1e0+ny/2e0-6/1.1e0 as sy,
 x*(12/8e0)/1.2e0+nx/2e0-6/1.2e0 as sx from shapes, {GRID8})"""
SPACING8, P8, MM8 = [1.5, 1.1, 1.2], (8, 8, 8), (12.0, 12.0, 12.0)


@query("vol4_resample_trilinear", f"with {SHAPES}, {SCAN_T} {trilinear_sql('targets', 'zyx')}")
def _(t):
    vox = t.f_vox
    out = V.transform_scan(vox, V.volume_shapes(vox), SPACING8, P8, MM8, value="hu")
    return out.select("pid", "z", "y", "x", r6("hu").alias("v"))


TURN = [10.0, 20.0, -5.0]
TURNED = A.scan_map([0.0] * 3, SPACING8, P8, MM8, rotation=TURN)
TURNED_T = f"""targets as (select pid, cast(z as int) as z, cast(y as int) as y, cast(x as int) as x, nz, ny, nx,
 {', '.join(f"{'+'.join(f'({TURNED[i][j]!r})*{a}' for j, a in enumerate('zyx'))}+({TURNED[i][3]!r})+n{c}/2e0 as s{c}" for i, c in enumerate('zyx'))} from shapes, {GRID8})"""


@query("vol4_resample_brick_table", f"with {SHAPES}, {TURNED_T} {trilinear_sql('targets', 'zyx')}")
def _(t):
    """A turned scan out of bricks of four voxels, blocks of three."""
    vox = t.f_vox
    shapes = V.volume_shapes(vox)
    m = A.scan_map([F.col(f"n{c}") for c in "zyx"], SPACING8, P8, MM8, rotation=TURN)
    maps = shapes.select("pid", "nz", "ny", "nx", *A.to_columns(m))
    out = BR.resample_affine(BR.brick_table(vox, "hu", edge=4), maps, [], P8, value="hu", edge=4, block=3)
    return out.select("pid", "z", "y", "x", r6("hu").alias("v"))


# the 12 mm grid puts sources exactly half way between voxels, where rounding noise decides; 11.9 does not
NEAREST_T = SCAN_T.replace("12/8e0", "11.9e0/8").replace("6/1.5e0", "5.95e0/1.5").replace("6/1.1e0", "5.95e0/1.1").replace("6/1.2e0", "5.95e0/1.2")


@query("vol4_resample_nearest", f"""with {SHAPES}, {NEAREST_T} select t.pid, t.z, t.y, t.x, {R('coalesce(v.hu,0)')} as v from targets t left join f_vox v
 on v.pid=t.pid and v.z=cast(floor(sz+0.5) as int) and v.y=cast(floor(sy+0.5) as int) and v.x=cast(floor(sx+0.5) as int)
 and sz between 0 and nz-1 and sy between 0 and ny-1 and sx between 0 and nx-1""")
def _(t):
    vox = t.f_vox
    out = V.transform_scan(vox, V.volume_shapes(vox), SPACING8, P8, (11.9, 11.9, 11.9), value="hu", order=0)
    return out.select("pid", "z", "y", "x", r6("hu").alias("v"))


@query("vol5_transform_mask", f"""with {SHAPES}, {SCAN_T}, m as (select pid,z,y,x,1e0 as one from f_vox where hu < -350)
select pid, z, y, x from ({trilinear_sql('targets', 'zyx', 'one', 'm')}) r where v > 0""")
def _(t):
    vox = t.f_vox
    return V.transform_mask(FL.below(vox), V.volume_shapes(vox), SPACING8, P8, MM8)


@query("vol5_transform_annotations", f"""with {SHAPES} select p.pid, p.cid,
 {', '.join(f"round_even((p.{c}-(n{c}/2e0-6/{s}e0))/((12/8e0)/{s}e0),0)+0e0 as o{c}" for c, s in zip('zyx', SPACING8))}, round_even(d*8/12,0)+0e0 as od from f_pts p join shapes using (pid)""")
def _(t):
    pts = t.f_pts.join(V.volume_shapes(t.f_vox), "pid")
    m = A.scan_map([F.col(f"n{c}") for c in "zyx"], SPACING8, P8, MM8)
    out = V.transform_points(pts, m, P8, MM8)
    return out.select("pid", "cid", "oz", "oy", "ox", "od")


GRID4 = "(select unnest(range(4)) as pz) gz, (select unnest(range(4)) as py) gy, (select unnest(range(4)) as px) gx"
MOMENT = "pz*16+py*4+px"


def patch_t(where="true"):
    """Sample positions of the 4 x 4 x 4 patches of 6.1 mm around all points."""
    return f"""targets as (select p.pid, cid, cast(pz as int) as pz, cast(py as int) as py, cast(px as int) as px, nz, ny, nx,
 {', '.join(f"p{c}*(6.1e0/4)/{s}e0+p.{c}-3.05e0/{s} as s{c}" for c, s in zip('zyx', SPACING8))} from f_pts p join shapes using (pid), {GRID4} where {where})"""


def per_patch(rows):
    return f"select pid, cid, count(*) as n, {T6('avg(v)')} as mean, {T6(f'sum(({MOMENT})*v)/64')} as moment from ({rows}) r group by pid, cid"


def piece_sums(pieces, value="hu", cid="cid"):
    """Size, mean and moment of each patch from its pieces; the raster place of a voxel is MOMENT."""
    def run(batches):
        for b in batches:
            sums = np.zeros((2, b.num_rows))
            (of, at), (first, v) = ((np.asarray(c.offsets), c.values.to_numpy(zero_copy_only=False)) for c in b.columns[2:])
            n = np.diff(first)
            for size in np.unique(n[n > 0]):
                rows = np.flatnonzero(n == size)
                i = np.arange(size)
                x = v[first[rows, None] + i]
                place = np.broadcast_to(i, x.shape).copy()
                part = np.flatnonzero(np.diff(of)[rows])
                place[part] = at[of[rows[part], None] + i]
                # down the columns values are added one after the other
                sums[:, rows] = np.ascontiguousarray(x.T).sum(axis=0), np.ascontiguousarray((place * x).T).sum(axis=0)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(n), *map(pa.array, sums)], ["pid", cid, "n", "s", "m"])

    rows = pieces.select("pid", cid, "places", value)
    kinds = [rows.schema[c].dataType.simpleString() for c in ("pid", cid)]
    sums = rows.mapInArrow(run, f"pid {kinds[0]}, `{cid}` {kinds[1]}, n int, s double, m double")
    return sums.groupBy("pid", cid).agg(F.sum("n").alias("n"), (F.sum("s") / F.sum("n")).alias("mean"), (F.sum("m") / 64).alias("moment"))


def patch_sums(pieces):
    return piece_sums(pieces).select("pid", "cid", "n", tied6(F.col("mean")).alias("mean"), tied6(F.col("moment")).alias("moment"))


@query("vol6_patch_transform", f"with {SHAPES}, {patch_t()} {per_patch(trilinear_sql('targets', ('cid','pz','py','px'), rounded=False))}")
def _(t):
    vox = t.f_vox
    out = V.patch_pieces(t.f_pts, vox, V.volume_shapes(vox), SPACING8, (4, 4, 4), (6.1, 6.1, 6.1), value="hu")
    return patch_sums(out)


CUTOFF = 0.75


def cut_slots(t):
    """All points; those under the cutoff are empty slots."""
    slots = t.f_pts
    for c in "zyx":
        slots = slots.withColumn(c, FL.cutoff("p", CUTOFF, F.col(c)))
    return slots


CROP = f"""with slots as (select pid, cid, {', '.join(f"case when p>={CUTOFF} then round_even({c},0) end as {c}" for c in 'zyx')} from f_pts),
cells as (select s.pid, s.cid, pz, py, px, coalesce(hu,0)*1e0 as v from slots s cross join {GRID4}
 left join f_vox v on v.pid=s.pid and v.z=s.z-2+pz and v.y=s.y-2+py and v.x=s.x-2+px) {per_patch('select * from cells')}"""


@query("vol7_candidate_crop", CROP)
def _(t):
    vox = t.f_vox
    return patch_sums(V.crop_pieces(cut_slots(t), vox, V.volume_shapes(vox), 2, value="hu"))


@query("vol7_candidate_affine", f"""with {SHAPES}, {patch_t(f'p.p>={CUTOFF}')} {per_patch(trilinear_sql('targets', ('cid','pz','py','px'), rounded=False))}
union all select pid, cid, 64, 0e0, 0e0 from f_pts where p<{CUTOFF}""")
def _(t):
    vox = t.f_vox
    out = V.patch_pieces(cut_slots(t), vox, V.volume_shapes(vox), SPACING8, (4, 4, 4), (6.1, 6.1, 6.1), value="hu")
    return patch_sums(out)


# --- shapes ----------------------------------------------------------------------------------

CLIP = f"z between 0 and {NZ-1} and y between 0 and {NY-1} and x between 0 and {NX-1}"
RASTER = f"""ball as (select pid, cid, round_even(z,0) as cz, round_even(y,0) as cy, round_even(x,0) as cx, round_even(d/2,0) as r from f_pts),
cells as (select b.pid, b.cid, cz+oz as z, cy+oy as y, cx+ox as x, oz*oz+oy*oy+ox*ox as d2, r, greatest(abs(oz),abs(oy),abs(ox)) as far from ball b,
 (select unnest(range(-4,5)) as oz) a, (select unnest(range(-4,5)) as oy) c, (select unnest(range(-4,5)) as ox) e)"""


@query("vol8_rasterise_sphere", f"with {RASTER} select pid, cid, count(*) as n, cast(sum(z*100+y*10+x) as bigint) as moment from cells where d2<=r*r and {CLIP} group by pid, cid")
def _(t):
    s = V.rasterise(t.f_pts, VOX_SHAPE, "sphere", keep=["cid"])
    return s.groupBy("pid", "cid").agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.col("z") * 100 + F.col("y") * 10 + F.col("x")).cast("long").alias("moment")
    )


@query("vol8_rasterise_cube_gauss", f"""with {RASTER} select pid, cid, count(*) filter (far<=r) as n_cube, {R("sum(case when d2<=3*r*r then case when r>0 then exp(-d2/(2*r*r)) else 1 end end)")} as gauss
 from cells where {CLIP} and (far<=r or d2<=3*r*r) group by pid, cid""")
def _(t):
    cube = V.rasterise(t.f_pts, VOX_SHAPE, "cube", keep=["cid"]).groupBy("pid", "cid").agg(F.count(F.lit(1)).alias("n_cube"))
    gauss = V.rasterise(t.f_pts, VOX_SHAPE, "gauss", keep=["cid"]).groupBy("pid", "cid").agg(r6(F.sum("v")).alias("gauss"))
    return cube.join(gauss, ["pid", "cid"], "full_outer").select("pid", "cid", F.coalesce("n_cube", F.lit(0)).cast("long").alias("n_cube"), "gauss")


@query("vol9_union_masks", f"with {RASTER} select pid, cast(z as int) as z, cast(y as int) as y, cast(x as int) as x, least(count(*),1)*1e0 as v from cells where d2<=r*r and {CLIP} group by 1,2,3,4")
def _(t):
    return V.rasterise_union(t.f_pts, VOX_SHAPE, "sphere")


@query("vol10_gaussian_axes", f"""
select pid, aid, {', '.join(f"{R(f'sum((i+1)*exp(-({c}/32-i)*({c}/32-i)/(2*pow(dd/2,2))))')} as label_{c}" for c in 'zyx')}
from (select *, (d+1)/4 as dd, unnest(range(16)) as i from f_ann) t group by pid, aid""")
def _(t):
    vectors = V.gaussian_axes([F.col(c) / 32 for c in "zyx"], (F.col("d") + 1) / 4, 16)
    out = t.f_ann.select("pid", "aid", *vectors)

    def moment(c):
        return F.aggregate(F.transform(c, lambda v, i: v * (i + 1)), F.lit(0.0), lambda s, v: s + v)

    return out.select("pid", "aid", *[r6(moment(F.col(f"label_{c}"))).alias(f"label_{c}") for c in "zyx"])


# --- tiles -----------------------------------------------------------------------------------

TILES = f"""tiles as (select v.*, cast(tz as int) as tz, cast(ty as int) as ty, cast(tx as int) as tx, cast(z-tz*3 as int) as lz, cast(y-ty*3 as int) as ly, cast(x-tx*3 as int) as lx from f_vox v,
 (select unnest(range({(NZ-4)//3+1})) as tz) a, (select unnest(range({(NY-4)//3+1})) as ty) b, (select unnest(range({(NX-4)//3+1})) as tx) c
 where z between tz*3 and tz*3+3 and y between ty*3 and ty*3+3 and x between tx*3 and tx*3+3)"""


@query("vol11_tile", f"with {TILES} select pid, tz, ty, tx, lz, ly, lx, hu from tiles")
def _(t):
    return V.tile(t.f_vox, VOX_SHAPE, 4, 3).select("pid", "tz", "ty", "tx", "lz", "ly", "lx", "hu")


PADS = [(n - ((n - 4) // 3 + 1) * 3) // 2 for n in VOX_SHAPE]


@query("vol12_stitch", f"""with {TILES} select pid, {', '.join(f'cast(t{c}*3+l{c}+{p} as int) as {c}' for c, p in zip('zyx', PADS))}, hu*2e0 as v from tiles where lz<3 and ly<3 and lx<3""")
def _(t):
    tiles = V.tile(t.f_vox, VOX_SHAPE, 4, 3).withColumn("v", F.col("hu") * 2.0)
    return V.stitch(tiles, VOX_SHAPE, 4, 3)


@query("vol13_sliding_features", f"""
select pid, cast(tz as int) as tz, cast(ty as int) as ty, cast(tx as int) as tx, count(*) as n, {R('avg(hu)')} as mean, max(hu) as top from f_vox v,
 (select unnest(range({-(-(NZ-4)//2)})) as tz) a, (select unnest(range({-(-(NY-4)//2)})) as ty) b, (select unnest(range({-(-(NX-4)//2)})) as tx) c
 where z between tz*2 and tz*2+3 and y between ty*2 and ty*2+3 and x between tx*2 and tx*2+3 group by 1,2,3,4""")
def _(t):
    return V.sliding_features(
        t.f_vox, VOX_SHAPE, 4, 2, [F.count(F.lit(1)).alias("n"), r6(F.avg("hu")).alias("mean"), F.max("hu").alias("top")]
    )


@query("vol14_zoom", f"""with {SHAPES}, m as (select *, cast(round_even(nz*(2.5e0/3.7e0),0) as int) as mz, cast(round_even(ny*(0.7e0/1e0),0) as int) as my, cast(round_even(nx*(0.7e0/1e0),0) as int) as mx from shapes),
targets as (select pid, cast(z as int) as z, cast(y as int) as y, cast(x as int) as x, nz, ny, nx, least(z*((nz-1e0)/(mz-1e0)),nz-1e0) as sz, least(y*((ny-1e0)/(my-1e0)),ny-1e0) as sy, least(x*((nx-1e0)/(mx-1e0)),nx-1e0) as sx
 from m, (select unnest(range(16)) as z) a, (select unnest(range(16)) as y) b, (select unnest(range(16)) as x) c where z<mz and y<my and x<mx)
select r.*, {R('2.5e0*nz/mz')} as sz, {R('0.7e0*ny/my')} as sy, {R('0.7e0*nx/mx')} as sx from ({trilinear_sql('targets','zyx')}) r join m using (pid)""")
def _(t):
    vox = t.f_vox
    out = V.zoom(vox, V.volume_shapes(vox), (2.5, 0.7, 0.7), (3.7, 1.0, 1.0), "hu")
    return out.select("pid", "z", "y", "x", r6("hu").alias("v"), *[r6(f"s{c}").alias(f"s{c}") for c in "zyx"])

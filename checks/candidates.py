"""Blob and candidate operators, and the user extension points."""

import math

from pyspark.sql import functions as F

from checks.registry import R, U, query, r6
from checks.scalars import LAYOUT
from voxelframe.functions import affine as A
from voxelframe.functions.hashing import uniform
from voxelframe.operators import aggregates as AG
from voxelframe.operators import blobs as B
from voxelframe.operators import joins as J
from voxelframe.operators import ranking as RK
from voxelframe.operators import scoring as SC

PAIRS = """pairs as (select a.pid, a.cid as i, b.cid as j, a.sig as s1, b.sig as s2, sqrt((a.z-b.z)*(a.z-b.z)+(a.y-b.y)*(a.y-b.y)+(a.x-b.x)*(a.x-b.x)) as dd
 from (select *, d/2 as sig from f_cand) a join (select *, d/2 as sig from f_cand) b on a.pid=b.pid and a.cid<b.cid
 where (a.z-b.z)*(a.z-b.z)+(a.y-b.y)*(a.y-b.y)+(a.x-b.x)*(a.x-b.x) <= 40*40)"""


def disk(d, r1, r2):
    def ac(a, b):
        return f"acos(least(greatest(({d}*{d}+{a}*{a}-{b}*{b})/(2*{d}*{a}),-1e0),1e0))"
    lens = f"({r1}*{r1}*{ac(r1, r2)}+{r2}*{r2}*{ac(r2, r1)}-0.5*sqrt(abs(({r1}+{r2}-{d})*({d}-{r2}+{r1})*({d}+{r2}-{r1})*({d}+{r2}+{r1}))))"
    return f"{lens}/(pi()*pow(least({r1},{r2}),2))"


def sphere(d, r1, r2):
    # two caps, cut by the plane of the common circle
    plane = f"(({d}*{d}+{r1}*{r1}-{r2}*{r2})/(2*{d}))"
    caps = "+".join(f"pi()*pow({h},2)*({r}-{h}/3)" for r, h in ((r1, f"({r1}-{plane})"), (r2, f"({r2}-{d}+{plane})")))
    return f"({caps})/(4e0/3*pi()*pow(least({r1},{r2}),3))"


def overlap_sql(d, s1, s2, n=3):
    r1, r2 = f"({s1}*sqrt({n}e0))", f"({s2}*sqrt({n}e0))"
    f = disk(d, r1, r2) if n == 2 else sphere(d, r1, r2)
    return f"case when {d}>{r1}+{r2} then 0 when {d}<=abs({r1}-{r2}) then 1 else {f} end"


def pairs(t):
    c = t.f_cand.select("pid", "cid", "z", "y", "x", (F.col("d") / 2).alias("sigma"))
    close = J.close_pairs(c, 40.0, keep=["sigma"])
    return close.withColumnsRenamed({"i_sigma": "s1", "j_sigma": "s2"})


@query("can1_disk_overlap", f"with {PAIRS} select pid, i, j, {R(disk('dd','(10*s1)','(10*s2)'))} as v from pairs where dd>0")
def _(t):
    return pairs(t).filter("dist > 0").select(
        "pid", "i", "j", r6(B.disk_overlap(F.col("dist"), F.col("s1") * 10, F.col("s2") * 10)).alias("v")
    )


@query("can2_sphere_overlap", f"with {PAIRS} select pid, i, j, {R(sphere('dd','s1','s2'))} as v from pairs where dd>0 and dd<s1+s2")
def _(t):
    return pairs(t).filter("dist > 0 and dist < s1 + s2").select(
        "pid", "i", "j", r6(B.sphere_overlap(F.col("dist"), F.col("s1"), F.col("s2"))).alias("v")
    )


@query("can3_blob_overlap", f"""with {PAIRS} select pid, i, j, {R(overlap_sql('dd','s1','s2'))} as v3, {R(overlap_sql('dd','s1','s2',2))} as v2 from pairs""")
def _(t):
    d, s1, s2 = F.col("dist"), F.col("s1"), F.col("s2")
    return pairs(t).select(
        "pid", "i", "j", r6(B.blob_overlap(d, s1, s2)).alias("v3"), r6(B.blob_overlap(d, s1, s2, 2)).alias("v2")
    )


DEAD = f"""dead as (select p.pid, case when s1>s2 then j else i end as cid from (select a.pid, a.cid as i, b.cid as j, a.d/2 as s1, b.d/2 as s2,
 sqrt((a.z-b.z)*(a.z-b.z)+(a.y-b.y)*(a.y-b.y)+(a.x-b.x)*(a.x-b.x)) as dd from f_cand a join f_cand b on a.pid=b.pid and a.cid<b.cid) p
 where {overlap_sql('dd','s1','s2')} > 0.2)"""


@query("can4_prune_overlap", f"with {DEAD} select pid, cid from f_cand c where not exists (select 1 from dead x where x.pid=c.pid and x.cid=c.cid)")
def _(t):
    c = t.f_cand.select("pid", "cid", "z", "y", "x", (F.col("d") / 2).alias("sigma"))
    return B.prune(c, 0.2, width=64.0).select("pid", "cid")


def greedy_input(t):
    return t.f_cand.select("pid", "cid", "z", "y", "x", (F.col("d") / 2).alias("sigma"))


def walk(order, step, table="f_cand", out="cid"):
    """SQL twin of a loop over each patient's candidates in an order, with a list of those kept so far."""
    item = "struct_pack(cid := o.cid, z := o.z, y := o.y, x := o.x, s := o.d/2e0, p := o.p)"
    return f"""with recursive o as (select *, row_number() over (partition by pid order by {order}) as rn from {table}),
walked as (select o.pid, 1::bigint as rn, [{item}] as kept from o where rn=1
 union all select w.pid, w.rn+1, {step.replace('ITEM', item)} from walked w join o on o.pid=w.pid and o.rn=w.rn+1)
select pid, unnest(kept).{out} as {out} from walked w where rn=(select count(*) from {table} c where c.pid=w.pid)"""


def apart(a, b, z="1e0"):
    return f"sqrt(({a}.z-{b}.z)*({a}.z-{b}.z)*{z}*{z}+({a}.y-{b}.y)*({a}.y-{b}.y)+({a}.x-{b}.x)*({a}.x-{b}.x))"


GREEDY = f"case when len(list_filter(w.kept, lambda q: {overlap_sql(apart('o', 'q'), 'q.s', '(o.d/2e0)')} > 0.2))=0 then list_append(w.kept, ITEM) else w.kept end"
def merge_step(distance=B.MERGE_DISTANCE):
    near = f"list_position(list_transform(w.kept, lambda q: {apart('o', 'q', str(B.MERGE_Z_SCALE))} < {distance}), true)"
    return f"""case when coalesce({near},0)=0 then list_append(w.kept, ITEM)
 when o.p > w.kept[{near}].p then list_append(list_concat(w.kept[1:{near}-1], w.kept[{near}+1:]), ITEM) else w.kept end"""


@query("can4_prune_greedy", walk("d desc, z, y, x, cid", GREEDY))
def _(t):
    return B.prune_greedy(greedy_input(t), 0.2, width=64.0).select("pid", "cid")


@query("can5_merge_close", walk("cid", merge_step()))
def _(t):
    return B.merge_close(t.f_cand.select("pid", "cid", "z", "y", "x", "p")).select("pid", "cid")


SPACING, PATCH, PATCH_MM = [2.5, 0.7, 0.7], (48, 48, 48), (60.0, 60.0, 60.0)
LIN = ["(1/2.5e0)*60/48", "(1/0.7e0)*60/48", "(1/0.7e0)*60/48"]


@query("can8_map_to_source", f"""
select pid, cid, {', '.join(f"{R(f'({l})*{c}+({n}/2e0-30/{s}e0)')} as {c}" for c, l, n, s in zip('zyx', LIN, (60, 512, 512), (2.5, 0.7, 0.7)))},
 1 as flag from f_cand""")
def _(t):
    m = A.scan_map([60.0, 512.0, 512.0], SPACING, PATCH, PATCH_MM)
    moved = A.apply(m, [F.col(c) for c in "zyx"])
    return t.f_cand.select("pid", "cid", *[r6(p).alias(c) for p, c in zip(moved, "zyx")], F.lit(1).alias("flag"))


WEIGHTS = [(((i * 7) % 11) - 5) / 10 for i in range(1, 65)]
SCORE_SQL = "1/(1+exp(-(list_sum(list_transform(range(1,65), lambda i: cast(v[i] as double)*(((i*7) % 11)-5)/10))+0.25)))"


@query("can9_score_patches", f"select pid, {R(SCORE_SQL)} as p, {R(SCORE_SQL)} as p_expr from f_patch")
def _(t):
    model = SC.LinearSigmoid(WEIGHTS, 0.25)
    scored = SC.score_patches(t.f_patch.withColumn("p_expr", model.column("v")), model, keep=("pid", "p_expr"))
    return scored.select("pid", r6("p").alias("p"), r6("p_expr").alias("p_expr"))


@query("can10_tta_average", f"""
select pid, cid, {R('avg(p+0.1*('+U('tta','k','replica')+'-0.5))')} as p, count(*) as n_replicas from (
 select *, unnest(range(8)) as replica from f_cand) t group by pid, cid""")
def _(t):
    replicas = J.replicate(t.f_cand.select("pid", "cid", "p", "k"), 8)
    scored = replicas.withColumn("p", F.col("p") + 0.1 * (uniform("tta", "k", "replica") - 0.5))
    return SC.average_replicas(scored, ["pid", "cid"]).withColumn("p", r6("p"))


@query("can11_candidate_heat_map", f"""
select pid, cast(floor(z*2.5e0/400*48) as int) as hz, cast(floor(y*0.7e0/400*48) as int) as hy, cast(floor(x*0.7e0/400*48) as int) as hx,
 {R('sum(features[5])/32')} as heat from f_feat group by 1,2,3,4""")
def _(t):
    ranked = t.f_feat.withColumn("score", RK.by_bounded_malignancy(LAYOUT, "features"))
    return AG.heat_map(ranked, "score", (2.5, 0.7, 0.7)).withColumn("heat", r6("heat"))

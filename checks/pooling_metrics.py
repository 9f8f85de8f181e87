"""Multiple-instance pooling, losses, metrics, ensembles, run curves and the flagship query."""

from pyspark.sql import functions as F

from checks.filters_joins import NEAREST_SQL, nearest
from checks.lenses import HEADS
from checks.registry import R, U, query, r6
from checks.scalars import LAYOUT
from voxelframe.functions import pooling as P
from voxelframe.functions import scalars as S
from voxelframe.operators import ensemble as E
from voxelframe.operators import filters as FL
from voxelframe.operators import joins as J
from voxelframe.operators import metrics as M
from voxelframe.operators import runs as RN
from voxelframe.plans import patient as PT


@query("flagship_patient_log_loss", f"""
with r as (select pid, cid, p, row_number() over (partition by pid order by p desc, cid) rn from f_cand),
slots as (select pid, unnest(range(1, 9)) as rn from f_label_a),
s as (select slots.pid, case when p >= 0.75 then p else 0 end x from slots left join r on r.pid = slots.pid and r.rn = slots.rn),
m as (select pid, ln(avg(exp(16*x)) + 1e-7)/16 pm from s group by pid)
select count(*) n, {R('-avg(l.label*ln(least(greatest(pm,1e-15),1-1e-15)) + (1-l.label)*ln(1-least(greatest(pm,1e-15),1-1e-15)))')} as log_loss
from m join f_label_a l using (pid)""")
def _(t):
    preds = PT.patient_predictions(t.f_cand, t.f_label_a)
    out = PT.patient_log_loss(preds, t.f_label_a)
    return out.select("n", r6("log_loss").alias("log_loss"))


SIG = "(1/(1+exp(-logit)))"
SOFT = "(greatest(logit,0)+ln(1+exp(-abs(logit))))"


@query("mil1_log_mean_exp", f"""
select pid, {R('ln(avg(exp(p))+1e-7)')} as r1, {R('ln(avg(exp(8*p))+1e-7)/8')} as r8, {R('ln(avg(exp(16*p))+1e-7)/16')} as r16 from f_inst group by pid""")
def _(t):
    return t.f_inst.groupBy("pid").agg(*[r6(P.log_mean_exp(F.col("p"), r)).alias(f"r{r}") for r in (1, 8, 16)])


@query("mil2_noisy_or", f"select pid, {R(f'1-exp(-sum({SOFT}/10))')} as v from (select pid, logit*1e0 as logit from f_inst) t group by pid")
def _(t):
    return t.f_inst.groupBy("pid").agg(r6(1 - F.exp(-F.sum(P.softplus(F.col("logit")) / 10))).alias("v"))


@query("mil2_noisy_or_full", f"select pid, {R(f'1-exp(-sum({SOFT}))')} as v from (select pid, logit-6 as logit from f_inst) t group by pid")
def _(t):
    return t.f_inst.groupBy("pid").agg(r6(P.noisy_or(F.col("logit") - 6)).alias("v"))


@query("mil3_one_minus_product", f"select pid, {R(f'1-exp(sum(ln({SIG})))')} as v from (select pid, logit+4 as logit from f_inst) t group by pid")
def _(t):
    return t.f_inst.groupBy("pid").agg(r6(P.one_minus_product(F.col("logit") + 4)).alias("v"))


@query("mil4_mean_power", f"select pid, {R(f'avg(pow({SIG},2))')} as v from f_inst group by pid")
def _(t):
    return t.f_inst.groupBy("pid").agg(r6(P.mean_power(F.col("logit"))).alias("v"))


@query("mil5_mil_loss", f"""
select i.pid, {R(f'sum(ln(1-{SIG}+1e-12))')} as benign, {R(f'sum({SIG})')} as malignant,
 {R(f'case when max(label)=1 then sum({SIG}) else sum(ln(1-{SIG}+1e-12)) end')} as loss from f_inst i join f_label_a using (pid) group by i.pid""")
def _(t):
    pooled = t.f_inst.groupBy("pid").agg(
        P.log_benign(F.col("logit")).alias("benign"), P.sum_malignant(F.col("logit")).alias("malignant")
    ).join(t.f_label_a, "pid")
    loss = P.mil_loss(F.col("label"), F.col("benign"), F.col("malignant"))
    return pooled.select("pid", r6("benign").alias("benign"), r6("malignant").alias("malignant"), r6(loss).alias("loss"))


ATT = [((i * 5) % 9 - 4) / 4 for i in range(64)]


@query("mil6_attention_pool", f"""
with s as (select label, v, list_sum(list_transform(range(64), lambda i: cast(v[i+1] as double)*((i*5)%9-4)/4)) as s from f_patch),
w as (select s.label, v, exp(s.s-m.m) as w from s join (select label, max(s) as m from s group by label) m using (label))
select label, i, {R('sum(w*cast(v[i+1] as double))/sum(w)')} as v from w, (select unnest(range(64)) as i) d group by label, i""")
def _(t):
    pooled = P.attention_pool(t.f_patch, ["label"], "v", ATT)
    return pooled.select("label", F.posexplode("pooled").alias("i", "v")).select("label", F.col("i").cast("long").alias("i"), r6("v").alias("v"))


@query("mil7_masked_mean", f"select pid, {R('sum(case when p>0.5 then logit else 0 end)/nullif(sum(case when p>0.5 then 1 else 0 end),0)')} as v from f_inst group by pid")
def _(t):
    m = (F.col("p") > 0.5).cast("double")
    return t.f_inst.groupBy("pid").agg(r6(P.masked_mean(F.col("logit"), m)).alias("v"))


@query("mil8_masked_std", f"""
select pid, {R('sqrt(greatest(sum(m*logit*logit)/nullif(sum(m),0)-pow(sum(m*logit)/nullif(sum(m),0),2),0))')} as v from (
 select pid, logit, case when cid % 3 < 2 then 1e0 else 0e0 end as m from f_inst) t group by pid having sum(m) > 1""")
def _(t):
    m = (F.col("cid") % 3 < 2).cast("double")
    return t.f_inst.groupBy("pid").agg(r6(P.masked_std(F.col("logit"), m)).alias("v"), F.sum(m).alias("n")).filter("n > 1").drop("n")


ERF = """(sign({x})*(1-((((1.061405429e0*{t}-1.453152027e0)*{t}+1.421413741e0)*{t}-0.284496736e0)*{t}+0.254829592e0)*{t}*exp(-{x}*{x})))"""
CDF_X = "((k-mu)/(sigma*sqrt(2e0)+1e-16))"
CDF = "(" + ERF.format(x=CDF_X, t=f"(1/(1+0.3275911e0*abs({CDF_X})))") + "+1)/2"


@query("mil9_normal_cdf", f"""
select pid, cid, k, {R(CDF)} as v from (select pid, cid, z/8 as mu, d/4 as sigma, unnest(range(8)) as k from f_cand) t""")
def _(t):
    cdf = P.normal_cdf(F.col("z") / 8, F.col("d") / 4, 8)
    return t.f_cand.select("pid", "cid", F.posexplode(cdf).alias("k", "v")).select(
        "pid", "cid", F.col("k").cast("long").alias("k"), r6("v").alias("v")
    )


@query("mil10_heaviside", f"select pid, cid, k, case when k - z/8 >= 0 then 1e0 else 0e0 end as v from (select pid, cid, z, unnest(range(8)) as k from f_cand) t")
def _(t):
    return t.f_cand.select("pid", "cid", F.posexplode(P.heaviside(F.col("z") / 8, 8)).alias("k", "v")).select(
        "pid", "cid", F.col("k").cast("long").alias("k"), "v"
    )


@query("mil11_softplus_lower_bound", f"select pid, cid, {R(f'{SOFT}+1')} as v from f_inst")
def _(t):
    return t.f_inst.select("pid", "cid", r6(P.softplus(F.col("logit"), 1)).alias("v"))


# --- metrics ---------------------------------------------------------------------------------


def ll(p, y, eps):
    q = f"least(greatest({p},{eps}),1-{eps})"
    return f"({y}*ln({q})+(1-{y})*ln(1-{q}))"


def scored(t):
    return J.require_same_keys(t.f_pred, t.f_label_a, per=["config"])


@query("met1_log_loss", f"select config, {R('-avg('+ll('p','label','1e-15')+')')} as loss from f_pred join f_label_a using (pid) group by config")
def _(t):
    return scored(t).groupBy("config").agg(r6(M.log_loss("p", "label")).alias("loss"))


@query("met2_cross_entropy", f"select config, {R('avg('+ll('p','label','1e-12')+')')} as ce, {R('-avg('+ll('p','label','1e-12')+')')} as signed_ce from f_pred join f_label_a using (pid) group by config")
def _(t):
    return scored(t).groupBy("config").agg(
        r6(M.cross_entropy("p", "label")).alias("ce"), r6(M.cross_entropy("p", "label", signed=True)).alias("signed_ce")
    )


VOXEL_PRED = "select pid, least(greatest((hu+1000)/1400e0,0),1) as p, case when hu < -350 then 1e0 else 0e0 end as t from f_vox"


def voxel_predictions(t):
    vox = t.f_vox
    mask = FL.below(vox).select("pid", "z", "y", "x", F.lit(1.0).alias("t"))
    return vox.join(mask, ["pid", "z", "y", "x"], "left").select(
        "pid", S.hu_norm("hu").alias("p"), F.coalesce("t", F.lit(0.0)).alias("t")
    )


@query("met3_dice", f"select pid, {R('(2*sum(p*t)+1e-12)/(sum(p)+sum(t)+1e-12)')} as dice from ({VOXEL_PRED}) v group by rollup(pid)")
def _(t):
    return voxel_predictions(t).rollup("pid").agg(r6(M.dice(F.col("p"), F.col("t"))).alias("dice"))


@query("met4_coverage", f"select pid, sum(p*t)/sum(t) > 0.24 as hit from ({VOXEL_PRED}) v group by pid")
def _(t):
    return voxel_predictions(t).groupBy("pid").agg(M.covered(F.col("p"), F.col("t"), 0.24).alias("hit"))


@query("met5_confusion", """
select config, count(*) filter (label=1 and p>=0.2) as tp, count(*) filter (label=0 and p<0.2) as tn, count(*) filter (label=0 and p>=0.2) as fp,
 count(*) filter (label=1 and p<0.2) as fn, count(*) filter (label=1) as n_pos, count(*) filter (label<>1) as n_neg from f_pred join f_label_a using (pid) group by config""")
def _(t):
    return M.confusion(scored(t), "p", "label", 0.2, ["config"])


FLAGGED = f"""{NEAREST_SQL}, flagged as (select c.pid, c.cid, c.p, cast(n.cid is not null as int) as flag from f_cand c
 left join (select distinct pid, cid from near) n on n.pid=c.pid and n.cid=c.cid),
per as (select w.pid, coalesce(n_blobs,0) as n_blobs, coalesce(tp,0) as tp, coalesce(n_pos,0) as n_pos
 from (select p_partkey as pid from part) w
 left join (select pid, count(*) as n_blobs, sum(flag) as tp from flagged group by pid) b on b.pid = w.pid
 left join (select pid, count(*) as n_pos from f_ann where d>0 group by pid) a on a.pid = w.pid)"""


def flagged(t):
    return J.flag_claimed(t.f_cand.select("pid", "cid", "p"), nearest(t))


def all_patients(t):
    return t.part.select(F.col("p_partkey").alias("pid"))


@query("met6_detection_totals", f"""with {FLAGGED}
select count(*) as n_patients, cast(sum(tp) as bigint) as tp, cast(sum(n_blobs) as bigint) as n_blobs, cast(sum(n_pos) as bigint) as n_pos, count(*) filter (tp<n_pos) as n_missed from per""")
def _(t):
    return M.detection_totals(M.detection_per_patient(flagged(t), t.f_ann.filter("d > 0"), patients=all_patients(t)))


@query("met7_detection_in_top", f"""with {FLAGGED},
top as (select pid, sum(flag) as tp_top from (select *, row_number() over (partition by pid order by p desc, cid) as rn from flagged) t where rn<=5 group by pid)
select cast(sum(tp) as bigint) as tp, cast(sum(n_pos) as bigint) as n_pos, cast(sum(tp_top) as bigint) as tp_top, cast(sum(5-coalesce(tp_top,0)) as bigint) as fp_top from per left join top using (pid)""")
def _(t):
    return M.detection_in_top(flagged(t), t.f_ann.filter("d > 0"), 5, patients=all_patients(t))


@query("met8_mask_recall", """
select c.pid, count(*) as n, count(m.pid) as n_inside, count(m.pid) < count(*) as missed from f_pts c left join (select pid,z,y,x from f_vox where hu < -350) m
on m.pid=c.pid and m.z=cast(floor(c.z) as int) and m.y=cast(floor(c.y) as int) and m.x=cast(floor(c.x) as int) group by c.pid""")
def _(t):
    return M.mask_recall(J.point_in_mask(t.f_pts, FL.below(t.f_vox)))


@query("met9_categorical_cross_entropy", f"""
select pid, {R('avg(-ln(least(greatest(features[1+y],1e-12),1-1e-12)))')} as loss from (select pid, features, cast(cid % 2 as int) as y from f_feat) t group by pid""")
def _(t):
    loss = M.categorical_cross_entropy(LAYOUT.get("features", "nodule"), F.col("cid") % 2)
    return t.f_feat.groupBy("pid").agg(r6(F.avg(loss)).alias("loss"))


@query("met10_squared_error", f"select pid, {R('avg((features[3]-10)*(features[3]-10))')} as loss from f_feat group by pid")
def _(t):
    return t.f_feat.groupBy("pid").agg(r6(F.avg(M.squared_error(LAYOUT.get("features", "size"), F.lit(10.0)))).alias("loss"))


@query("met11_bounded_cross_entropy", f"""
select pid, {R('avg('+ll('features[5]/5','t','1e-12')+'-(t*ln(t)+(1-t)*ln(1-t)))')} as loss from (
 select pid, features, least(greatest(features[4]/5,1e-12),1-1e-12) as t from f_feat) f group by pid""")
def _(t):
    loss = M.bounded_cross_entropy(LAYOUT.get("features", "malignancy") / 5, LAYOUT.get("features", "spiculation") / 5)
    return t.f_feat.groupBy("pid").agg(r6(F.avg(loss)).alias("loss"))


@query("met12_binary_cross_entropy", f"""
select config, {R('-avg('+ll('p','least(greatest(label,0),1)','1e-12')+')')} as bce, {R('-avg('+ll('(1-(1-p))','least(greatest(label*3,0),1)','1e-12')+')')} as from_multiclass
from f_pred join f_label_a using (pid) group by config""")
def _(t):
    s = scored(t)
    class0 = 1 - F.col("p")
    return s.groupBy("config").agg(
        r6(F.avg(M.binary_cross_entropy(F.col("p"), F.col("label")))).alias("bce"),
        r6(F.avg(M.binary_cross_entropy(1 - class0, F.col("label") * 3))).alias("from_multiclass"),
    )


def crps_axis(mu, at):
    x = "((k-" + mu + ")/(sigma*sqrt(2e0)+1e-16))"
    cdf = "(" + ERF.format(x=x, t="(1/(1+0.3275911e0*abs(" + x + ")))") + "+1)/2"
    return f"avg(pow({cdf}-(case when k-{at}>=0 then 1 else 0 end),2))"


@query("met13_crps", f"""
select pid, cid, {R(crps_axis('mz','tz')+'+'+crps_axis('my','ty')+'+'+crps_axis('mx','tx'))} as crps from (
 select pid, cid, d/4 as sigma, z/4 as mz, (z+(cid%3))/4 as tz, y/32 as my, (y+1)/32 as ty, x/32 as mx, (x-4)/32 as tx, unnest(range(16)) as k from f_cand) t group by pid, cid""")
def _(t):
    sigma = F.col("d") / 4
    total = (
        M.crps(F.col("z") / 4, sigma, (F.col("z") + F.col("cid") % 3) / 4, 16)
        + M.crps(F.col("y") / 32, sigma, (F.col("y") + 1) / 32, 16)
        + M.crps(F.col("x") / 32, sigma, (F.col("x") - 4) / 32, 16)
    )
    return t.f_cand.select("pid", "cid", r6(total).alias("crps"))


@query("met14_prior_log_odds", f"select {R('ln((count(*)-sum(label))/(count(*)+1))')} as b0, {R('ln(sum(label)/count(*))')} as b1 from f_label_a")
def _(t):
    return M.prior_log_odds(t.f_label_a).select(r6("b0").alias("b0"), r6("b1").alias("b1"))


# --- ensembles and runs ----------------------------------------------------------------------

LOSSES = f"select config, -avg({ll('p','label','1e-15')}) as loss from f_pred join f_label_a using (pid) group by config"


@query("ens1_average", f"select pid, {R('avg(p)')} as p, count(*) as n_configs from f_pred where config in ('c1_spl','c3_spl','c5_spl') group by pid")
def _(t):
    return E.average(t.f_pred, ["c1_spl", "c3_spl", "c5_spl"]).select("pid", r6("p").alias("p"), "n_configs")


@query("ens2_best_config", f"select arg_min(config, loss) as config, {R('min(loss)')} as loss from ({LOSSES}) t")
def _(t):
    return E.best_config(t.f_pred, t.f_label_a).select("config", r6("loss").alias("loss"))


FOLDS = f"""folds as (select pid, label, (row_number() over (partition by label order by {U('cv','pid')}, pid)-1)%10 as fold from f_label_a),
perfold as (select o.left_out, config, -avg({ll('p','label','1e-15')}) as loss from f_pred join folds using (pid) join (select unnest(range(10)) as left_out) o on o.left_out<>fold group by 1,2),
winners as (select left_out, arg_min(config, loss) as config, min(loss) as loss from perfold group by left_out)"""


@query("ens3_best_per_fold", f"with {FOLDS} select cast(left_out as int) as left_out, config, {R('loss')} as loss from winners")
def _(t):
    return E.best_per_fold(t.f_pred, t.f_label_a, 10, "cv").select("left_out", "config", r6("loss").alias("loss"))


@query("ens4_map_winners_to_all", f"with {FOLDS} select pid, {R('avg(p)')} as p, count(*) as n_configs from f_pred where config in (select config from winners) group by pid")
def _(t):
    winners = E.rename_models(E.best_per_fold(t.f_pred, t.f_label_a, 10, "cv").select("config").distinct())
    full = E.rename_models(t.f_pred)
    return E.average(full, winners).select("pid", r6("p").alias("p"), "n_configs")


@query("ens5_learning_curves", f"""
with c as (select run, line_no, line, coalesce(max(case when line like 'Chunk%' then cast(split_part(split_part(line,' ',2),'/',1) as bigint) end) over (partition by run order by line_no),-1) as chunk from f_log),
k as (select run, line_no, chunk, case when line like 'Mean train%' then 'train' else 'valid' end as kind, cast(trim(split_part(line,':',2)) as double) as loss from c where line not like 'Chunk%')
select run, kind, {R('min(loss)')} as best, arg_min(line_no, loss) as best_at, arg_min(chunk, loss) as best_chunk from k group by run, kind""")
def _(t):
    best = RN.best_of_curves(RN.learning_curves(t.f_log))
    return best.select("run", "kind", r6("best").alias("best"), "best_at", "best_chunk")

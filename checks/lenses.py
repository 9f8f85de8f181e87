"""Domain views of the test tables, one text for both engines."""

from __future__ import annotations

import re

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def duck_uniform(seed: str, *keys: str) -> str:
    text = ",".join([f"'{seed}'", *keys])
    return f"(cast(('0x'||substr(md5(concat_ws('|',{text})),1,13)) as bigint)/4503599627370496e0)"


def spark_uniform(seed: str, *keys: str) -> str:
    text = ",".join([f"'{seed}'", *keys])
    return f"(cast(conv(substr(md5(concat_ws('|',{text})),1,13),16,10) as double)/4503599627370496D)"


class Duck:
    u = staticmethod(duck_uniform)

    @staticmethod
    def arr(*items: str) -> str:
        return "list_value(" + ",".join(items) + ")"

    @staticmethod
    def explode(items: str) -> str:
        return f"unnest({items})"

    @staticmethod
    def cfg_u() -> str:
        return "(cast(('0x'||substr(md5(concat_ws('|',config,pid)),1,13)) as bigint)/4503599627370496e0)"


class Spark:
    u = staticmethod(spark_uniform)

    @staticmethod
    def arr(*items: str) -> str:
        return "array(" + ",".join(items) + ")"

    @staticmethod
    def explode(items: str) -> str:
        return f"explode({items})"

    @staticmethod
    def cfg_u() -> str:
        return "(cast(conv(substr(md5(concat_ws('|',config,pid)),1,13),16,10) as double)/4503599627370496D)"


def _vox(q):
    # one 10 x 11 x 9 volume per supplier; the number of volumes grows with the tables
    return """select l_suppkey as pid, cast(floor((l_quantity-1)/5) as int) as z,
      cast(round(l_discount*100) as int) as y, cast(round(l_tax*100) as int) as x,
      cast(sum(l_partkey*31+l_orderkey*17+l_linenumber) % 1401 as int)-1000 as hu
      from lineitem group by 1,2,3,4"""


VOX_SHAPE = (10, 11, 9)


def _big(q):
    # scans of 64 x 64 x 64 voxels with scattered and clustered points, one per 64 suppliers
    return """select cast(floor((l_suppkey-1)/64) as bigint) as pid, cast(l_orderkey*7+l_linenumber*11 as bigint) % 64 as z,
      cast(l_partkey*5+l_linenumber as bigint) % 64 as y, cast(l_orderkey % 29+l_partkey % 36 as bigint) as x,
      cast(1+sum(l_partkey+l_orderkey) % 8 as double) as v from lineitem group by 1,2,3,4"""


BIG_SHAPE = (64, 64, 64)


def _cand(q):
    # cid follows (orderkey, linenumber, suppkey) and is unique in a patient, so no window is needed
    return f"""select pid, cid, z, y, x, d, {q.u('p', 'k')} as p, k from (
      select l_partkey as pid, (l_orderkey*8+l_linenumber)*10000000+l_suppkey as cid,
       concat_ws('-',l_partkey,l_orderkey,l_suppkey,l_linenumber) as k,
       max(l_quantity) as z, cast(floor(max(l_extendedprice)) % 512 as double) as y,
       cast(l_orderkey % 512 as double) as x, cast(1+l_suppkey % 30 as double) as d
      from lineitem group by l_partkey,l_orderkey,l_suppkey,l_linenumber) t"""


def _pts(q):
    # candidates inside the volumes of the voxel lens
    return f"""select pid, cid, z, y, x, d, {q.u('p', 'k')} as p, k from (
      select l_suppkey as pid, (l_orderkey*8+l_linenumber)*10000000+l_partkey as cid,
       concat_ws('-',l_partkey,l_orderkey,l_suppkey,l_linenumber) as k,
       max(l_quantity)/5e0 as z, (floor(max(l_extendedprice)) % 1100)/1e2 as y,
       cast(l_orderkey % 900 as double)/1e2 as x, cast(1+l_partkey % 5 as double) as d
      from lineitem group by l_partkey,l_orderkey,l_suppkey,l_linenumber) t"""


def _ann(q):
    return f"""select pid, cid as aid, z+(cid % 3) as z, y+1 as y, x-(cid % 5)*2 as x,
      cast(case when {q.u('ann', 'k')}<0.05 then d+5 else 0 end as double) as d, k from f_cand"""


def _slices(q):
    # at most 100 slices per patient: one per (quantity, line status)
    return f"""select pid, sid, instance_number, pos_z, cast(case when pid % 2=0 then 1 else -1 end as double) as normal_z,
      cast(0.5+(pid % 5)*0.1 as double) as s_xy from (
       select pid, sid, n as instance_number, cast(case when pid % 3=0 then 2.5*sid
        when pid % 3=1 then 2.5*floor(sid/2) else floor(1000*{q.u('pos', 'pid', 'sid')})/10 end as double) as pos_z
       from (select l_suppkey as pid, cast(l_quantity as bigint)*2+cast(case when l_linestatus='O' then 1 else 0 end as bigint) as sid,
        count(*) as n from lineitem group by 1,2) g) s"""


def _label_a(q):
    return "select doc_id as pid, quality as label from labels"


def _label_b(q):
    return "select vec_id as pid, cast(case when label>=5 then 1 else 0 end as int) as label from embeddings"


def _pred(q):
    cfg = q.explode(q.arr("'c1_spl'", "'c2_spl'", "'c3_spl'", "'c4_spl'", "'c5_spl'"))
    return f"""select config, pid, 0.75e0*{q.cfg_u()}+0.25e0*quality as p from (
      select doc_id as pid, quality, {cfg} as config from labels) t"""


def _patch(q):
    return "select vec_id as pid, embedding as v, label from embeddings"


def _inst(q):
    return "select pid, cid, ln(p/(1-p)) as logit, p from f_cand where p>0 and p<1"


def _log(q):
    return """select user_id % 5 as run, event_id as line_no, case event_id % 3 when 0 then concat('Chunk ',event_id,'/10000')
      when 1 then concat('Mean train loss: 0.',lpad(cast(event_id*7919 % 1000000 as varchar(20)),6,'0'))
      else concat('Validation loss:  0.',lpad(cast(event_id*104729 % 1000000 as varchar(20)),6,'0')) end as line from events"""


def _marks(q):
    reader = q.explode(q.arr("0", "1", "2", "3"))
    return f"""select pid, aid, reader, case when (aid+reader) % 11=0 then null else x+(reader-1)*1.5e0 end as cx,
      y+2*reader as cy, z-1 as cz, cast(1+(aid*7+reader) % 5 as double) as malignancy,
      cast(1+(aid*3+reader) % 5 as double) as spiculation, cast(1+(aid+reader*2) % 5 as double) as texture
      from (select pid, aid, z, y, x, {reader} as reader from f_ann where d>0) a"""


def _feat(q):
    tex = [q.u(f"t{i}", "k") for i in range(1, 6)]
    heads = q.arr("1-p", "p", "d", f"5*{q.u('sp', 'k')}", f"5*{q.u('ma', 'k')}", *tex)
    return f"select pid, cid, z, y, x, {heads} as features from f_cand"


LENSES = {
    "f_vox": _vox,
    "f_big": _big,
    "f_cand": _cand,
    "f_pts": _pts,
    "f_ann": _ann,
    "f_slices": _slices,
    "f_label_a": _label_a,
    "f_label_b": _label_b,
    "f_pred": _pred,
    "f_patch": _patch,
    "f_inst": _inst,
    "f_log": _log,
    "f_marks": _marks,
    "f_feat": _feat,
}
DEPENDS = {"f_ann": ["f_cand"], "f_inst": ["f_cand"], "f_feat": ["f_cand"], "f_marks": ["f_ann"]}

# heads of the feature lens in order, with their widths
HEADS = [
    ("nodule", "classification", 2),
    ("size", "continuous", 1),
    ("spiculation", "continuous", 1),
    ("malignancy", "continuous", 1),
    ("texture", "classification", 5),
]


def with_lenses(sql: str) -> str:
    """Prefix the lens definitions a query needs."""
    needed: list[str] = []

    def visit(name: str) -> None:
        for d in DEPENDS.get(name, []):
            visit(d)
        if name not in needed:
            needed.append(name)

    for name in re.findall(r"\bf_\w+\b", sql):
        if name in LENSES:
            visit(name)
    if not needed:
        return sql
    ctes = ",\n".join(f"{n} as materialized ({LENSES[n](Duck)})" for n in needed)
    body = sql.strip()
    if body.lower().startswith("with recursive"):
        return f"with recursive {ctes},\n{body[len('with recursive'):]}"
    if body.lower().startswith("with "):
        return f"with {ctes},\n{body[len('with '):]}"
    return f"with {ctes}\n{body}"


def spark_lens(data, name: str):
    """The lens as a DataFrame; table names are bound to DataFrames, no view is left behind."""
    text = LENSES[name](Spark)
    inputs = {}
    for t in set(re.findall(r"\bfrom (\w+)", text)):
        if t in LENSES:
            inputs[t] = spark_lens(data, t)
        elif t in TABLES:
            inputs[t] = data.table(t)
    for t in inputs:
        text = re.sub(rf"\bfrom {t}\b", "from {" + t + "}", text)
    return data.spark.sql(text, **inputs)

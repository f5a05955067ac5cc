"""Queries of operators that the other modules leave out."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import camera as K
from ..functions import geometry as G
from ..functions import hashing as H
from ..functions import text as X
from ..operators import selection as S
from ..streaming import machines
from . import views as V
from .registry import ORACLES, QUERIES, query
from .sequences import EP

_T = V.table


@query("""select l_orderkey, count(*) as n_points, count(p_partkey) as n_known, string_agg(coalesce(p_size, -1)::varchar, ',' order by l_linenumber, l_partkey, l_suppkey) as path
from lineitem left join part on l_partkey = p_partkey group by l_orderkey""")
def raw_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of a path looked up and put in order."""
    li = _T(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    p = _T(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), "p_size", F.lit(1).alias("known"))
    g = li.join(p, "l_partkey", "left").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_suppkey", F.coalesce("p_size", F.lit(-1)).alias("size")))).alias("s"), F.count("known").alias("n_known"))
    return g.select("l_orderkey", F.size("s").cast("long").alias("n_points"), "n_known", V.text(F.col("s.size")).alias("path"))


_RARE = ("opposite_initial_turn", "vague_stop_there", "repeated_walk_forward")


@query(f"""with audit as ({ORACLES['instruction_audit']}), f as (select doc_id, unnest(list_filter(string_split(flags, ','), lambda x: x in {_RARE})) as flag from audit),
turn as (select doc_id, flag, row_number() over (partition by flag order by md5(doc_id::varchar), doc_id) as r from f),
one as (select doc_id, r, flag from turn qualify row_number() over (partition by doc_id order by r, flag) = 1), first as (select doc_id, 0 as p, r from one order by r, flag, doc_id limit 300),
cuts as (select quantile_cont(n_chars, [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9]) as q from documents),
rest as (select doc_id, len(list_filter(q, lambda x: n_chars > x)) as d, row_number() over (partition by len(list_filter(q, lambda x: n_chars > x)) order by md5(doc_id::varchar), doc_id) as r from documents, cuts where doc_id not in (select doc_id from first)),
filled as (select doc_id, 1 as p, r from rest order by r, d, doc_id limit 300)
select doc_id from (select * from first union all select * from filled) order by p, r, doc_id limit 300""")
def review_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows in turn by rare flags of the audit, filled up evenly over length deciles."""
    rare = F.filter(F.split("flags", ","), lambda x: x.isin(*_RARE))
    d = QUERIES["instruction_audit"](spark, sf_dir).select("doc_id", rare.alias("flags")).join(_T(spark, sf_dir, "documents").select("doc_id", "n_chars"), "doc_id")
    return S.balanced_review(d, "doc_id", "flags", "n_chars", 300)


@query("""with c as (select source, count(*) as c from documents group by source), m as (select source, sum(c) over (order by source) - c / 2.0 as mid, sum(c) over () as n from c)
select doc_id, least(floor(mid * 3 / n), 2)::int as part from documents join m using (source)""")
def scene_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T10."""
    return S.split_by_scene(_T(spark, sf_dir, "documents").select("doc_id", "source"), "source", 3).select("doc_id", "part")


@query(f"""{EP}, two as (select user_id, max(actions) filter (where k = 0) as p, max(actions) filter (where k = 1) as o from episodes group by user_id),
c as (select user_id, p, o, o[1] = 0 or len(o) <> len(p) or {H.sql_number("'mixture'", "user_id::varchar")}::double / 18446744073709551616.0 < 0.3 as oracle from two where p is not null and o is not null)
select user_id, case when oracle then 'oracle' else 'policy' end as actor, array_to_string(case when oracle then o else p end, ',') as queue from c""")
def actor_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A user's second episode as the oracle's, the first as the policy's queue."""
    two = V.episodes(spark, sf_dir).where("k < 2").groupBy("user_id").agg(F.max(F.when(F.col("k") == 0, F.col("actions"))).alias("p"), F.max(F.when(F.col("k") == 1, F.col("actions"))).alias("o"))
    m = S.mixture(F.col("o"), F.col("p"), 0.3, F.col("user_id"))
    return two.where("p is not null and o is not null").select("user_id", m.alias("m")).select("user_id", "m.actor", V.text(F.col("m.queue")).alias("queue"))


@query("""with c as (select doc_id, text, regexp_extract(text, '^[^.]*\\.\\s+([^.]+)', 1) as clause from documents)
select doc_id, case when trim(clause) <> '' and (length(lower(text)) - length(replace(lower(text), lower(trim(clause)), ''))) = length(trim(clause)) then instr(lower(text), lower(trim(clause))) - 1 end::int as place
from c where not regexp_matches(clause, '\\s\\s|[\\n\\t]')""")
def clause_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F8: the second sentence of each text, where its white space is single blanks."""
    c = _T(spark, sf_dir, "documents").select("doc_id", "text", F.regexp_extract("text", r"^[^.]*\.\s+([^.]+)", 1).alias("clause")).where(~F.rlike("clause", F.lit(r"\s\s|[\n\t]")))
    return c.select("doc_id", X.clause_place(F.col("text"), F.col("clause"))["s"].cast("int").alias("place"))


@query("""select conv_id, turn, case when role = 'assistant' then '' else '- ' || role || ': ' || length(text)::varchar end as feedback, case role when 'system' then 0 when 'user' then 1 else 2 end as action from conversations""")
def feedback_and_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F14, F16."""
    check = F.array(F.struct(F.col("role").alias("kind"), (F.col("role") == "assistant").alias("passed"), F.length("text").cast("string").alias("reason")))
    name = F.when(F.col("role") == "system", "stop").when(F.col("role") == "user", " Forward").otherwise("2")
    return _T(spark, sf_dir, "conversations").select("conv_id", "turn", X.repair_feedback(check).alias("feedback"), X.action_id(name).alias("action"))


@query("""select doc_id, 'You are a robot that follows an instruction. You see ' || case when doc_id % 2 = 0 then 'a panorama of all directions' else 'the view to the front' end || '. Answer with the next 18 actions out of forward, left, right and stop.' as system,
repeat('<image>', (doc_id % 4)::int) || chr(10) || 'Instruction (' || len(regexp_extract_all(lower(text), '[a-z]+(?:''[a-z]+)?'))::varchar || ' words): ' || text as prompt from documents""")
def prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F12."""
    view = F.when(F.col("doc_id") % 2 == 0, "panorama").otherwise("front")
    return _T(spark, sf_dir, "documents").select("doc_id", X.system_prompt(view, 18).alias("system"), X.user_prompt(F.col("text"), F.col("doc_id") % 4).alias("prompt"))


@query(f"""with {V.POSES_SQL} select vec_id, case when z < 0 then round(320 + 500 * x / -z, 4) end as u, case when z < 0 then round(240 - 500 * y / -z, 4) end as v, round((x * 100 - 5) * 2.0 / 500, 9) as bx,
 floor((90 - (x * 30 + 40)) / 180 * 512)::int as first_row, (ceil((90 - (x * 30 - 40)) / 180 * 512) - floor((90 - (x * 30 + 40)) / 180 * 512))::int as n_rows, round(case when qw < 0 then -qx else qx end, 6) as back_x, round(abs(qw), 6) as back_w from poses""")
def camera_math(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Projection, crop rows, and quaternion to matrix and back."""
    x, y, z = F.col("x"), F.col("y"), F.col("z")
    p = K.project(x, y, z, 500.0, 320.0, 240.0)
    b = K.unproject(x * 100, y, F.lit(2.0), 500.0, 5.0, 0.0)
    first, n = K.latitude_rows(512, x * 30 - 40, x * 30 + 40)
    q = K.quaternion_of_matrix(G.rotation_matrix(*map(F.col, ("qx", "qy", "qz", "qw"))))
    return V.poses(spark, sf_dir).select("vec_id", F.round(p[0], 4).alias("u"), F.round(p[1], 4).alias("v"), F.round(b[0], 9).alias("bx"), first.alias("first_row"), n.alias("n_rows"), F.round(q[0], 6).alias("back_x"), F.round(q[3], 6).alias("back_w"))


@query("""with i as (select vec_id, list_transform(embedding, lambda v: (abs(v) * 400)::int) as px from embeddings)
select vec_id, round(len(list_filter(px, lambda v: v < 16)) / 64.0, 9) as dark, round(len(list_filter(px[1:8], lambda v: v < 16)) / 8.0, 9) as top, round(len(list_filter(px[57:64], lambda v: v < 16)) / 8.0, 9) as bottom,
 round(coalesce(len(list_filter(list_filter(embedding, lambda d: d > 0), lambda d: d >= 0.05::float))::double / nullif(len(list_filter(embedding, lambda d: d > 0)), 0), 0), 9) as visible from i join embeddings using (vec_id)""")
def image_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embeddings as images of 8 by 8; pixels arrive as arrays, as no decoder is installed."""
    px = F.transform("embedding", K.level)
    s = K.dark_shares(F.col("px"), 8, 8, 16)
    seen = K.visible_share(F.transform("embedding", lambda v: v.cast("double")), F.lit(0.05).cast("float").cast("double"), 0.0)
    return _T(spark, sf_dir, "embeddings").withColumn("px", px).select("vec_id", *(F.round(c, 9).alias(k) for k, c in s.items()), F.round(seen, 9).alias("visible"))


@query(f"""with {V.POSES_SQL}, pairs as (select p.vec_id, t.vec_id as triangle, p.x - t.x as u, p.y - t.y as h, p.z - t.z as v from poses p join poses t on p.label >= 5 and t.label < 5),
b as (select *, greatest(0, least(1, ((u - 0.1) * -0.1 + v * 0.1) / 0.02)) as t from pairs),
d as (select vec_id, triangle, sqrt(h * h + case when u >= 0 and v >= 0 and u + v <= 0.1 then 0 else least(power(u - greatest(0, least(0.1, u)), 2) + v * v, u * u + power(v - greatest(0, least(0.1, v)), 2), power(u - 0.1 + 0.1 * t, 2) + power(v - 0.1 * t, 2)) end) as distance from b)
select vec_id, arg_min(triangle, (distance, triangle)) as triangle, round(min(distance), 9) as distance from d where distance <= 0.2 group by vec_id""")
def located_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nearest triangle of each pose; triangles lie flat at poses of other labels."""
    p = V.poses(spark, sf_dir)
    t = p.where("label < 5").select(F.col("vec_id").alias("triangle"), *(F.col(k).alias(f"a{k}") for k in "xyz"), *((F.col(k) + F.lit(0.1 if k == "x" else 0.0)).alias(f"b{k}") for k in "xyz"), *((F.col(k) + F.lit(0.1 if k == "z" else 0.0)).alias(f"c{k}") for k in "xyz"))
    return S.locate(p.where("label >= 5"), t, "vec_id", "triangle", 0.2, 0.25).withColumn("distance", F.round("distance", 9))


@query(f"""with recursive {V.POSES_SQL}, nodes as (select k as node, 0.15 * (k % 4 - 1.5) as nx, 0.15 * (k // 4 - 1.0) as nz from (select unnest(generate_series(0, 11)) as k)),
near as (select a.node as at, b.node, b.nx, b.nz from nodes a join nodes b on abs(a.nx - b.nx) + abs(a.nz - b.nz) < 0.16), p as (select label, vec_id, x, z, row_number() over (partition by label order by vec_id) as i from poses),
walk(label, vec_id, i, node) as (select label, vec_id, i, (select arg_min(node, (power(nx - x, 2) + power(nz - z, 2), node)) from nodes) from p where i = 1
 union all select p.label, p.vec_id, p.i, (select arg_min(n.node, (power(nx - p.x, 2) + power(nz - p.z, 2), n.node)) from near n where n.at = w.node) from walk w join p on p.label = w.label and p.i = w.i + 1) select label, vec_id, node from walk""")
def tracked_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The node of a small grid that each label's walker is at."""
    nodes = {k: (0.15 * (k % 4 - 1.5), 0.15 * (k // 4 - 1.0)) for k in range(12)}
    near = {k: [j for j in nodes if j != k and abs(nodes[j][0] - nodes[k][0]) + abs(nodes[j][1] - nodes[k][1]) < 0.16] for k in nodes}
    return machines.batch(V.poses(spark, sf_dir), "label", ["vec_id"], ["x", "z"], lambda: machines.NodeTracker(nodes, near), "node long")


@query("""with g as (select vec_id, generate_series(0, 63) as i, embedding from embeddings), f as (select vec_id, unnest(i) as i, embedding from g) select vec_id, count(*) as n_pixels, count(*) filter (where embedding[i + 1] > 0) as n_true, least(count(*) filter (where embedding[i + 1] > 0), 10) as n_left from f group by vec_id""")
def capped_masks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """G12."""
    mask = F.transform("embedding", lambda v: v > 0)
    yes = lambda m: F.size(F.filter(m, lambda x: x)).cast("long")
    return _T(spark, sf_dir, "embeddings").select("vec_id", F.size(K.pixel_grid(8, 8)).cast("long").alias("n_pixels"), yes(mask).alias("n_true"), yes(K.cap_true(mask, 10, F.col("vec_id"))).alias("n_left"))

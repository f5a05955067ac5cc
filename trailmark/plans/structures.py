"""Queries of contracts (P), graphs (G), sources and sinks (S, K), streams (R) and job operators (X)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import actions as A
from ..functions import registry as M
from ..operators import contracts as C
from ..operators import graph as G
from ..operators import segments as SEG
from ..sources import jsonl, sinks
from ..streaming import machines, windows
from . import views as V
from .registry import query
from .sequences import EP, RUNS_SQL

_T = V.table


# -- contracts -----------------------------------------------------------------------------------------------------------


@query(f"""{EP} select episode_id, concat_ws(',', case when k > n then 'more_decisions_than_actions' end, case when k % 5 = 0 then 'no_regions' end) as flags from episodes""")
def trajectory_contract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P2."""
    zero = F.array(F.lit(0.0), F.lit(1.0), F.lit(2.0))
    f = C.trajectory_flags(F.col("actions"), F.col("k") % 5, F.col("k"), F.col("n").cast("double"), zero, zero)
    return V.episodes(spark, sf_dir).select("episode_id", F.array_join(f, ",").alias("flags"))


@query(f"""with {V.STEPS_SQL}, c as (select user_id, row_number() over (partition by user_id order by ts, event_id) - 1 as i, (event_id % 3) + 1 as n from steps),
d as (select user_id, i * 2 as step, n, lag(i * 2 + n) over (partition by user_id order by i) as prev from c)
select user_id, concat_ws(',', case when bool_or(not n between 1 and 2) then 'count_out_of_range' end, case when bool_or(step > coalesce(prev, 0)) then 'gap' end, case when bool_or(step < coalesce(prev, 0)) then 'overlap' end) as flags, count(*) as n_chunks from d group by user_id""")
def chunk_contract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P3."""
    i = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")) - 1
    c = _T(spark, sf_dir, "events").select("user_id", (i * 2).alias("step"), (F.col("event_id") % 3 + 1).alias("n"))
    return C.chunk_flags(c, "user_id", "step", "n", 2).select("user_id", F.array_join("flags", ",").alias("flags"), "n_chunks")


@query(f"with {V.POSES_SQL} select vec_id, case when abs(sqrt(power(qx * s, 2) + power(qy * s, 2) + power(qz * s, 2) + power(qw * s, 2)) - 1) > 1e-3 then 'quaternion_invalid' else '' end as flags from (select *, case when vec_id % 7 = 0 then 1.01 else 1.0 end as s from poses)")
def pose_contract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P4, P5."""
    s = F.when(F.col("vec_id") % 7 == 0, 1.01).otherwise(1.0)
    f = C.pose_flags(F.array("x", "y", "z"), F.array(*(F.col(c) * s for c in ("qx", "qy", "qz", "qw"))))
    return V.poses(spark, sf_dir).select("vec_id", F.array_join(f, ",").alias("flags"))


@query("""with g as (select l_orderkey, l_returnflag, count(*) as n, bool_and(l_linestatus = 'O') as ok from lineitem group by 1, 2)
select l_orderkey, count(*) filter (where l_returnflag in ('N') and n = 1 and ok) = 1 and count(*) filter (where n > 1 or not ok) = 0 as accepted from g group by l_orderkey""")
def acceptance_contract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P6."""
    li = _T(spark, sf_dir, "lineitem").select("l_orderkey", "l_returnflag", (F.col("l_linestatus") == "O").alias("ok"))
    return C.acceptance(li, "l_orderkey", "l_returnflag", "ok", ("N",))


@query(f"""{EP}, t as (select episode_id, actions, n, 2 as step, actions[1:2] as history, list_concat(actions[3:6], list_transform(generate_series(1, 4 - len(actions[3:6])), lambda x: 0)) as target from episodes where n > 2)
select episode_id, concat_ws(',', case when n % 3 <> 0 and n <> 3 then 'images' end, case when list_contains(history, 0) then 'stop_in_history' end) as flags from (select * from t)""")
def training_row_contract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P8; images are made wrong for episodes of a length that three does not divide."""
    e = V.episodes(spark, sf_dir).where("n > 2")
    target = A.padded_target(F.col("actions"), F.lit(2), 4)
    at = F.array_position(target, F.lit(0))
    real = F.when(at > 0, at).otherwise(F.size(target))
    images = F.when(F.col("n") % 3 == 0, 3).otherwise(4)
    f = C.training_row_flags(images, F.slice("actions", F.lit(1), F.lit(2)), F.lit(2), target, real)
    return e.select("episode_id", F.array_join(f, ",").alias("flags"))


@query("""select conv_id, count(*) filter (where instr(text, 'a') > 0) as placeholders, count(*) as images, count(*) filter (where instr(text, 'a') > 0) = count(*) as agrees from conversations group by conv_id""")
def placeholder_contract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P9."""
    g = _T(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.count_if(F.instr("text", "a") > 0).alias("placeholders"), F.count(F.lit(1)).alias("images"))
    return g.withColumn("agrees", F.col("placeholders") == F.col("images"))


@query("select event_id, json_extract_string(props, '$.page') as page, props is not null and json_valid(props) as valid from events")
def json_contract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fields of JSON text under a declared schema."""
    e = _T(spark, sf_dir, "events")
    parsed = F.from_json("props", "map<string,string>", {"mode": "PERMISSIVE"})
    return e.select("event_id", parsed["page"].alias("page"), (F.col("props").isNotNull() & parsed.isNotNull()).alias("valid"))


@query("""with s as (select doc_id, string_split(text, '.') as parts, text from documents)
select doc_id, len(parts) as n_spans, '' as flags from s""")
def span_contract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sentences assembled with their places, which the contract then checks against the text."""
    parts = F.split("text", "\\.", -1)
    d = _T(spark, sf_dir, "documents").select("doc_id", "text", parts.alias("parts"))
    before = F.transform("parts", lambda _, i: F.when(i == 0, 0).otherwise(F.length(F.array_join(F.slice("parts", F.lit(1), i), ".")) + 1))
    spans = F.zip_with("parts", before, lambda p, s: F.struct(s.alias("s"), (s + F.length(p)).alias("e"), p.alias("t")))
    return d.withColumn("spans", spans).select("doc_id", F.size("parts").cast("long").alias("n_spans"), F.array_join(C.span_flags(F.col("text"), F.col("spans")), ",").alias("flags"))


@query("""with f as (select l_orderkey, l_linenumber - 1 as frame from lineitem) select l_orderkey, count(*) as n_frames, min(frame) = 0 and count(distinct frame) = count(*) and max(frame) + 1 = count(*) as contiguous from f group by l_orderkey""")
def frame_catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S9, P13, A29."""
    f = _T(spark, sf_dir, "lineitem").select("l_orderkey", (F.col("l_linenumber") - 1).alias("frame"))
    return C.missing_frames(f, "l_orderkey", "frame")


@query("""select doc_id, source, lang, n_chars from documents where doc_id in (3, 5, 8, 13, 21, 34, 55, 89) order by doc_id limit 5""")
def id_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A list of ids, all of which must exist; fixed fields first; the first five."""
    from ..operators.joins import require_all

    d = _T(spark, sf_dir, "documents")
    wanted = require_all(spark.createDataFrame([(i,) for i in (3, 5, 8, 13, 21, 34, 55, 89)], "doc_id long"), d, ["doc_id"], "ids")
    return d.join(F.broadcast(wanted), "doc_id").select("doc_id", "source", "lang", "n_chars").orderBy("doc_id").limit(5)


@query(f"""with {V.POSES_SQL} select label, count(*) as n, round(avg(case when isfinite(v) then v else 0 end), 9) as mean from (select label, case when vec_id % 10 = 0 then 'nan'::double when vec_id % 11 = 0 then 'infinity'::double else x end as v from poses) group by label""")
def finite_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P20, P16."""
    from ..functions.geometry import zero_unless_finite

    v = F.when(F.col("vec_id") % 10 == 0, float("nan")).when(F.col("vec_id") % 11 == 0, float("inf")).otherwise(F.col("x"))
    return V.poses(spark, sf_dir).groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(zero_unless_finite(v)), 9).alias("mean"))


# -- segments and paths --------------------------------------------------------------------------------------------------


def _walks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user's steps as one walk: its actions with a last stop and its states, 0.25 m a move and 15 degrees a turn."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    s = V.steps(spark, sf_dir).select("user_id", "ts", "event_id", F.greatest("action", F.lit(1)).alias("action"))
    s = s.withColumn("yaw", F.sum(F.when(F.col("action") == 2, 15.0).when(F.col("action") == 3, -15.0).otherwise(0.0)).over(w))
    move = F.when(F.col("action") == 1, 0.25).otherwise(0.0)
    s = s.withColumn("x", F.sum(move * F.sin(F.radians("yaw"))).over(w)).withColumn("z", -F.sum(move * F.cos(F.radians("yaw"))).over(w))
    g = s.groupBy(F.col("user_id").cast("string").alias("episode_id")).agg(F.array_sort(F.collect_list(F.struct("ts", "event_id", "action", "yaw", "x", "z"))).alias("s"))
    states = lambda c: F.concat(F.array(F.lit(0.0)), F.col(f"s.{c}"), F.slice(f"s.{c}", F.lit(-1), F.lit(1)))
    # Decisions at some turns; an anchor stands a little beside the next state.
    at = F.filter(F.sequence(F.lit(0), F.size("s") - 1), lambda i: (F.get("s", i)["action"] != 1) & (F.get("s", i)["event_id"] % 5 == 0))
    g = g.select("episode_id", F.concat(F.col("s.action"), F.array(F.lit(0))).alias("actions"), states("x").alias("xs"), states("z").alias("zs"), states("yaw").alias("yaws"), at.alias("decided_at"))
    return g.withColumn("ys", F.transform("xs", lambda _: F.lit(0.0))).withColumn("anchors", F.transform("decided_at", lambda i: F.array(F.get("xs", i + 1) + 0.1, F.lit(0.0), F.get("zs", i + 1))))


@query(None)
def segmentation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Segments of each walk; tests hold the kernel against worked examples and a slower twin."""
    return SEG.segments(_walks(spark, sf_dir))


@query("select distinct user_id::varchar as episode_id, '' as flags from events")
def segment_contract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P12 over W19: what segmentation gives has no flag."""
    walks = _walks(spark, sf_dir)
    f = C.segment_flags(segmentation(spark, sf_dir), "episode_id", "seg_start", "seg_end", "terminal", walks.select("episode_id", F.size("actions").alias("n")), "n")
    return f.select("episode_id", F.array_join("flags", ",").alias("flags"))


@query(None)
def warped_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact DTW of neighbouring labels' paths; tests hold it against a brute-force table."""
    p = V.poses(spark, sf_dir).groupBy("label").agg(F.transform(F.array_sort(F.collect_list(F.struct("vec_id", "x", "y", "z"))), lambda s: F.array(s["x"], s["y"], s["z"])).alias("path"))
    r = p.select((F.col("label") + 1).alias("label"), F.col("path").alias("reference"))
    return SEG.warped_similarity(p.join(r, "label").select(F.col("label").alias("id"), "path", "reference", (F.col("label") % 2).alias("success")), 0.5)


@query(f"""with recursive {V.POSES_SQL}, p as (select label, vec_id, x, z, degrees(atan2(2 * (qw * qy + qx * qz), 1 - 2 * (qy * qy + qz * qz))) as yaw, row_number() over (partition by label order by vec_id) as i from poses),
walk(label, i, vec_id, kx, kz, kyaw, keep) as (select label, i, vec_id, x, z, yaw, true from p where i = 1
 union all select p.label, p.i, p.vec_id, case when far then p.x else kx end, case when far then p.z else kz end, case when far then p.yaw else kyaw end, far
 from walk w join p on p.label = w.label and p.i = w.i + 1, lateral (select sqrt(power(p.x - kx, 2) + power(p.z - kz, 2)) >= 0.2 or least(abs(p.yaw - kyaw), 360 - abs(p.yaw - kyaw)) >= 60.0 as far))
select label, vec_id from walk where keep""")
def greedy_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frames kept by movement or turn since the last kept one."""
    from ..functions.geometry import yaw_degrees

    p = V.poses(spark, sf_dir).withColumn("yaw", yaw_degrees(*map(F.col, ("qx", "qy", "qz", "qw"))))
    return SEG.greedy_motion(p, "label", "vec_id", 0.2, 60.0)


# -- graphs --------------------------------------------------------------------------------------------------------------


@query(f"with {V.GRAPH_SQL} select s, count(distinct p) as degree, count(distinct p) >= 3 as junction from edges group by s")
def node_degrees(spark: SparkSession, sf_dir: str) -> DataFrame:
    """G4."""
    return G.degrees(V.graph(spark, sf_dir), "s", "p")


_ROUNDS = 8
_SPREAD = ", ".join(f"l{k} as (select node, min(root) as root from (select node, root from l{k - 1} union all select b.v, l.root from l{k - 1} l join both_ways b on l.node = b.u) group by node)" for k in range(1, _ROUNDS + 1))


@query(f"""with {V.GRAPH_SQL}, sparse as (select s, p + 1000000 as p from edges), both_ways as (select s as u, p as v from sparse union all select p, s from sparse),
l0 as (select distinct u as node, u as root from both_ways), {_SPREAD} select node, root from l{_ROUNDS}""")
def graph_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """G2, J14.  The SQL spreads least nodes over eight edges, more than this dense graph is wide; tests hold long paths against a plain union-find."""
    e = V.graph(spark, sf_dir)
    return G.connected_components(e.select(F.col("s").alias("u"), (F.col("p") + 1000000).alias("v")))


@query(f"with {V.GRAPH_SQL} select s, p, (dense_rank() over (partition by s order by p) - 1)::int as dense from edges")
def dense_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """G9."""
    return G.dense_labels(V.graph(spark, sf_dir), "s", "p").select("s", "p", "dense")


@query("""with owners as (select l_partkey, l_suppkey, count(distinct l_orderkey) as n, min(l_orderkey) as a, max(l_orderkey) as b from lineitem group by 1, 2) select a, b, count(*) as shared from owners where n = 2 group by a, b""")
def shared_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """G1: pairs of faces (orders) that own an edge (a part of a supplier) together; only edges with exactly two owners count."""
    o = _T(spark, sf_dir, "lineitem").groupBy("l_partkey", "l_suppkey").agg(F.countDistinct("l_orderkey").alias("n"), F.min("l_orderkey").alias("a"), F.max("l_orderkey").alias("b"))
    return o.where("n = 2").groupBy("a", "b").agg(F.count(F.lit(1)).alias("shared"))


@query(f"""with {V.GRAPH_SQL}, e as (select s as u, p + 1000000 as v from edges union select p + 1000000, s from edges), h0 as (select 1 as node), h1 as (select distinct v as node from e join h0 on u = node), h2 as (select distinct v as node from e join h1 on u = node),
h3 as (select distinct v as node from e join h2 on u = node) select node, min(hops)::int as hops from (select node, 0 as hops from h0 union all select node, 1 from h1 union all select node, 2 from h2 union all select node, 3 from h3) group by node""")
def hop_distances(spark: SparkSession, sf_dir: str) -> DataFrame:
    """G3."""
    g = V.graph(spark, sf_dir)
    one = g.select(F.col("s").alias("u"), (F.col("p") + 1000000).alias("v"))
    return G.hop_distances(one.union(one.select("v", "u")), spark.range(1, 2).withColumnRenamed("id", "node"), 3).select("node", "hops")


@query(None)
def coverage_seeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Farthest-point seeds in each scene's graph."""
    return G.coverage_seeds(_scene_graph(spark, sf_dir), "scene", 8, 25.0)


@query(None)
def rejoin_distances(spark: SparkSession, sf_dir: str) -> DataFrame:
    """G5."""
    return G.rejoin_distances(_scene_graph(spark, sf_dir), "scene")


@query(None)
def watershed_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Basins of each scene's nodes by their greatest quantity; tests hold the kernel against all paths of small graphs."""
    nodes = _T(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("scene"), F.col("l_partkey").alias("node")).agg(F.max("l_quantity").alias("height"), F.count(F.lit(1)).cast("double").alias("area"))
    return G.watershed(_scene_graph(spark, sf_dir), nodes, "scene", 60.0, 0.9, 3.0)


def _scene_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A scene for each supplier: its parts are the nodes, parts that it sold one after the other have an edge."""
    w = Window.partitionBy("l_suppkey").orderBy("l_orderkey", "l_linenumber", "l_partkey")
    li = _T(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("scene"), F.col("l_partkey").alias("a"), F.lead("l_partkey").over(w).alias("b"), F.col("l_quantity").cast("double").alias("w"))
    return li.where("a <> b").groupBy("scene", F.least("a", "b").alias("u"), F.greatest("a", "b").alias("v")).agg(F.min("w").alias("w"))


@query(f"""with {V.GRAPH_SQL}, d as (select s, count(*) as n from edges group by s), c as (select a.s, count(*) as close from edges a join edges b on a.s = b.s and a.p <> b.p and abs(a.p - b.p) < 20 group by a.s)
select s as region, (n * (n - 1) * (n - 2))::bigint as triples, (coalesce(close, 0) * (n - 2))::bigint as rejected_close from d left join c using (s) where n > 2""")
def decision_triples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ordered (in, selected, alternative) connections of a region and how many a gate rejects, the selected and the alternative being close.

    Triples are not built: a rejected pair takes part in as many as the region has other connections; pairs come from a grid join.
    """
    from ..operators.joins import near_pairs

    e = V.graph(spark, sf_dir)
    n = e.groupBy("s").agg(F.count(F.lit(1)).alias("n"))
    close = near_pairs(e.withColumn("x", F.col("p").cast("double")), "p", ["x"], 19.5, ["s"]).groupBy("s").agg((F.count(F.lit(1)) * 2).alias("close"))
    k = F.col("n")
    return n.where("n > 2").join(close, "s", "left").select(F.col("s").alias("region"), (k * (k - 1) * (k - 2)).alias("triples"), (F.coalesce("close", F.lit(0)) * (k - 2)).alias("rejected_close"))


# -- sources and sinks ---------------------------------------------------------------------------------------------------


@query(f"{EP} select episode_id, n from episodes")
def jsonl_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Episodes written as JSON lines and read back strictly."""
    e = V.episodes(spark, sf_dir).select("episode_id", F.lit("go").alias("instruction"), "actions", F.lit(None).cast("string").alias("trajectory_id"))
    path = G.shared_folder(spark, "episodes")
    sinks.json_lines(e, path, gzip=True)
    return jsonl.strict(spark, path).select("episode_id", F.size("actions").cast("long").alias("n"))


@query("select source, count(*) as n_keys from documents group by source")
def keyed_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K5: one keyed JSON document a source, parsed again."""
    d = _T(spark, sf_dir, "documents").select("doc_id", "source", "lang")
    k = sinks.keyed_document(d, "doc_id", "source")
    return k.select("source", F.size(F.map_keys(F.from_json("document", "map<string,string>"))).cast("long").alias("n_keys"))


@query(f"{EP}, l(length) as (values (2), (4), (8)) select length, count(*) as n_rows, count(*) filter (where n >= length) as complete from episodes cross join l group by length")
def horizon_fan_out(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K7: several horizons from one pass over the rows."""
    e = V.episodes(spark, sf_dir).select("n", F.explode(F.array(F.lit(2), F.lit(4), F.lit(8))).alias("length"))
    return e.groupBy("length").agg(F.count(F.lit(1)).alias("n_rows"), F.count_if(F.col("n") >= F.col("length")).alias("complete"))


# -- streams and jobs ----------------------------------------------------------------------------------------------------


@query(None)
def collision_recovery(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The machine folded over each user's steps, with a new plan every seventh; tests hold it against a plain twin and the stream form."""
    e, v = F.col("event_id"), F.col("value")
    plan = F.when(e % 7 == 0, F.array(((e % 3) + 1).cast("int"), F.lit(1), F.when(e % 4 == 0, 0).otherwise(2)))
    s = V.steps(spark, sf_dir).select(
        "user_id", "ts", "event_id", F.when(v > 20, 1).otherwise(F.col("action")).alias("action"), (v > 30).alias("collided"), (e % 3 * 0.2).cast("double").alias("change"), plan.alias("plan"),
        F.when(e % 2 == 0, F.slice(plan, F.lit(1), F.lit(1))).otherwise(plan).alias("default"), F.when(e % 5 == 0, F.array(F.lit(1), F.lit(3))).alias("pending"), (e % 11 * 0.1).cast("double").alias("left"), F.lit(0.5).alias("right"),
    )
    return machines.batch(s, "user_id", ["ts", "event_id"], ["action", "collided", "change", "plan", "default", "pending", "left", "right"], machines.Unstick, "said string, queue string").select("user_id", "event_id", "said", "queue")


@query(f"""with {V.STEPS_SQL}, r as (select user_id, action, value, (row_number() over (partition by user_id order by ts, event_id) - 1) // 4 as atom from steps)
select user_id, atom::bigint as atom, count(*) as n, round(sum(value), 6) as total from r group by user_id, atom""")
def count_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows of four steps."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    r = V.steps(spark, sf_dir).withColumn("atom", F.floor((F.row_number().over(w) - 1) / 4))
    return r.groupBy("user_id", "atom").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 6).alias("total"))


@query("""with p as (select user_id, event_id, ts, max(case when event_type = 'purchase' then ts end) over (partition by user_id order by ts, event_id rows between unbounded preceding and 1 preceding) as seen from events)
select event_id, seen is not null and ts - seen <= interval 1 day as fresh from p""")
def latest_value(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether the last purchase before an event is fresh enough."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, -1)
    seen = F.max(F.when(F.col("event_type") == "purchase", F.col("ts"))).over(w)
    e = _T(spark, sf_dir, "events").select("event_id", "ts", seen.alias("seen"))
    return e.select("event_id", (F.col("seen").isNotNull() & (F.col("ts") - F.col("seen") <= F.expr("interval '1' day"))).alias("fresh"))


@query("""with log as (select doc_id % 300 as k, doc_id as seq, doc_id % 7 as mark, case when n_chars % 3 = 0 then 'error' else 'accepted' end as status from documents),
l as (select k, max_by(mark, seq) as mark, max_by(status, seq) as status from log group by k)
select d.k, d.mark from (select distinct doc_id as k, doc_id % 7 as mark from documents) d left join l using (k) where not (l.k is not null and l.mark = d.mark and l.status = 'accepted')""")
def resumable(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is still to do by the last log entry of each key."""
    d = _T(spark, sf_dir, "documents")
    log = d.select((F.col("doc_id") % 300).alias("k"), F.col("doc_id").alias("at"), (F.col("doc_id") % 7).alias("mark"), F.when(F.col("n_chars") % 3 == 0, "error").otherwise("accepted").alias("status"))
    todo = d.select(F.col("doc_id").alias("k"), (F.col("doc_id") % 7).alias("mark")).distinct()
    return windows.resume(todo, log, "k", "mark", "at")


@query("select count(*) as n from (select distinct sha256(text) as digest from documents) where digest not in (select sha256(text) from documents where doc_id % 2 = 0)")
def uncached_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every second document has an answer in the cache."""
    d = _T(spark, sf_dir, "documents")
    cache = d.where("doc_id % 2 = 0").select(F.sha2(F.col("text").cast("binary"), 256).alias("digest")).distinct()
    return windows.uncached(d.select("text"), cache, "text").agg(F.count(F.lit(1)).alias("n"))


@query("""with g as (select lang, max(n_chars) as most from documents group by lang) select doc_id, (most - n_chars)::bigint as padding from documents join g using (lang)""")
def padded_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Padding of each row to the longest of its batch; the maximum is joined, not windowed, so a hot batch is split."""
    d = _T(spark, sf_dir, "documents").select("doc_id", "lang", "n_chars")
    return d.join(d.groupBy("lang").agg(F.max("n_chars").alias("most")), "lang").select("doc_id", (F.col("most") - F.col("n_chars")).alias("padding"))


@query("select time_bucket(interval 1 day, ts)::timestamp as window_start, event_type, count(*) as n from events group by 1, 2")
def event_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tumbling event-time windows, as on the stream."""
    e = _T(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return windows.tumbling(e, "ts", "1 day", ["event_type"]).withColumn("window_start", F.col("window_start").cast("timestamp_ntz"))


@query("""with d as (select l_orderkey, l_linenumber as step, l_quantity / 10 as distance from lineitem) select l_orderkey, count(*) as steps_taken, max_by(distance, step) as final_distance, min(distance) as oracle_distance, (max_by(distance, step) <= 3)::int as success, (min(distance) <= 3)::int as oracle_success
from (select l_orderkey, step, max(distance) as distance from d group by 1, 2) group by l_orderkey""")
def registered_measures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """2.12: measures by name, planned as one aggregate."""
    d = _T(spark, sf_dir, "lineitem").groupBy("l_orderkey", F.col("l_linenumber").alias("step")).agg(F.max(F.col("l_quantity") / 10).alias("distance"))
    return M.measure(d, ["l_orderkey"], ["steps_taken", "final_distance", "oracle_distance", "success", "oracle_success"])

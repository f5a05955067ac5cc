"""Queries of the window and sequence operators (W) and the action contract."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import actions as A
from ..functions import hashing as H
from . import views as V
from .registry import query

HORIZON = 4
EP = f"with {V.STEPS_SQL}"
#: SQL of runs until the first stop, from ``episodes``.
RUNS_SQL = """flat as (select episode_id, unnest(actions) as a, generate_subscripts(actions, 1) - 1 as i from episodes),
cutoff as (select episode_id, coalesce(list_position(actions, 0), len(actions) + 1) - 1 as upto from episodes),
body as (select episode_id, a, i, case when a is distinct from lag(a) over (partition by episode_id order by i) then 1 else 0 end as new from flat join cutoff using (episode_id) where i < upto),
runs0 as (select episode_id, a, i, sum(new) over (partition by episode_id order by i) as r from body),
runs as (select episode_id, r, min(a) as action, min(i) as s, max(i) as e from runs0 group by episode_id, r)"""


@query(f"{EP} select user_id, episode_id, n, {V.joined('actions')} as actions from episodes")
def episodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.episodes(spark, sf_dir).select("user_id", "episode_id", "n", V.text("actions").alias("actions"))


@query(f"""{EP}, flags as (select episode_id, case when n < 3 then 'too_short' end as f1, case when list_position(actions, 0) is distinct from n::int then 'stop_not_unique_terminal' end as f2 from episodes)
select episode_id, concat_ws(',', f1, f2) as flags from flags""")
def action_contract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.episodes(spark, sf_dir).select("episode_id", F.array_join(A.contract_flags(F.col("actions"), 3), ",").alias("flags"))


@query(f"{EP}, {RUNS_SQL} select episode_id, action, s::int as run_start, e::int as run_end from runs")
def action_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = V.episodes(spark, sf_dir).select("episode_id", F.inline(A.runs_before_stop(F.col("actions"))))
    return r.select("episode_id", "action", F.col("start").alias("run_start"), F.col("end").alias("run_end"))


@query(f"""{EP}, flat as (select episode_id, unnest(actions) as a, generate_subscripts(actions, 1) - 1 as i, n from episodes),
body as (select episode_id, a in (2, 3) as ok, i, case when (a in (2, 3)) is distinct from lag(a in (2, 3)) over (partition by episode_id order by i) then 1 else 0 end as new from flat where i < n - 1),
r0 as (select *, sum(new) over (partition by episode_id order by i) as r from body)
select episode_id, min(i)::int as block_start, (max(i) + 1)::int as block_end from r0 where ok group by episode_id, r""")
def turn_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = V.episodes(spark, sf_dir).select("episode_id", F.inline(A.blocks(F.col("actions"), (2, 3))))
    return b.select("episode_id", F.col("start").alias("block_start"), F.col("end").alias("block_end"))


LABELS = "labels0 as (select user_id, case when event_type = 'error' then -1 else (event_id % 3)::int end as label, row_number() over (partition by user_id order by ts, event_id) as i from events)"


def _labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("event_type") == "error", -1).otherwise((F.col("event_id") % 3).cast("int"))
    return V.table(spark, sf_dir, "events").select("user_id", "ts", "event_id", label.alias("label"))


def region_runs_of(labelled: DataFrame, key: str, order: list[str], label: str) -> DataFrame:
    """Runs of labels; negative ones split runs and are dropped.  Rows (key, label, run_length)."""
    w = Window.partitionBy(key).orderBy(*order)
    new = (~F.col(label).eqNullSafe(F.lag(label).over(w))).cast("int")
    r = labelled.withColumn("_new", new).withColumn("_run", F.sum("_new").over(w))
    return r.where(F.col(label) >= 0).groupBy(key, "_run").agg(F.min(label).alias(label), F.count(F.lit(1)).alias("run_length")).drop("_run")


@query(f"""with {LABELS}, r0 as (select *, case when label is distinct from lag(label) over (partition by user_id order by i) then 1 else 0 end as new from labels0),
r1 as (select *, sum(new) over (partition by user_id order by i) as r from r0)
select user_id, min(label) as label, count(*) as run_length from r1 where label >= 0 group by user_id, r""")
def region_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return region_runs_of(_labels(spark, sf_dir), "user_id", ["ts", "event_id"], "label")


@query(f"""with {LABELS}, kept as (select * from labels0 where label >= 0), r0 as (select *, label is distinct from lag(label) over (partition by user_id order by i) as new from kept)
select user_id, count(*) as n_labels, string_agg(label::varchar, ',' order by i) as labels from r0 where new group by user_id""")
def compressed_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    kept = _labels(spark, sf_dir).where("label >= 0")
    first = kept.withColumn("new", ~F.col("label").eqNullSafe(F.lag("label").over(w))).where("new")
    g = first.groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct("ts", "event_id", "label"))).alias("s"))
    return g.select("user_id", F.size("s").cast("long").alias("n_labels"), V.text(F.col("s.label")).alias("labels"))


@query(f"""{EP}, capped as (select episode_id, actions[1:8] as actions from episodes), {RUNS_SQL.replace('from episodes', 'from capped')}
select episode_id, string_agg(concat(action, 'x', e - s + 1), ' ' order by s) as plan from runs group by episode_id""")
def merged_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = A.runs_before_stop(F.slice("actions", F.lit(1), F.lit(8)))
    said = F.transform(r, lambda x: F.concat(x["action"].cast("string"), F.lit("x"), (x["end"] - x["start"] + 1).cast("string")))
    return V.episodes(spark, sf_dir).select("episode_id", F.array_join(said, " ").alias("plan")).where("plan <> ''")


@query(f"""{EP}, starts as (select episode_id, actions, n, unnest(generate_series(0, n - 1)) as s from episodes)
select episode_id, s::int as start, array_to_string(list_concat(actions[s + 1 : s + {HORIZON}], list_transform(generate_series(1, {HORIZON} - least({HORIZON}, n - s)), lambda x: 0)), ',') as target,
  array_to_string(actions[1:s], ',') as history from starts""")
def targets_and_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = V.episodes(spark, sf_dir).select("episode_id", "actions", F.explode(F.sequence(F.lit(0), F.size("actions") - 1)).alias("start"))
    return e.select("episode_id", "start", V.text(A.padded_target(F.col("actions"), F.col("start"), HORIZON)).alias("target"), V.text(F.slice("actions", F.lit(1), F.col("start"))).alias("history"))


_SEED = "'7', 'r2r', episode_id".split(", ")


@query(f"""{EP}, complete as (select *, ({H.sql_number(*_SEED, "'stride_offset'")} % 3)::bigint as off from episodes where list_position(actions, 0) = n and n >= 5),
strides as (select episode_id, unnest(generate_series(off, n - {HORIZON} - 1, 3)) as s, 'stride3' as reason from complete where off < n - {HORIZON}),
firsts as (select episode_id, 0 as s, 'episode_start' from complete),
flat as (select episode_id, unnest(actions) as a, generate_subscripts(actions, 1) - 1 as i, n from complete),
body as (select *, a in (2, 3) as ok, case when (a in (2, 3)) is distinct from lag(a in (2, 3)) over (partition by episode_id order by i) then 1 else 0 end as new from flat where i < n - 1),
r0 as (select *, sum(new) over (partition by episode_id order by i) as r from body),
turns as (select episode_id, min(i) as s, 'multi_turn_onset' from r0 where ok group by episode_id, r, n having count(*) >= 2 and min(i) < n - {HORIZON}),
stops as (select episode_id, n - p as s, 'terminal_stop' from complete, (values (1), (2), (3)) v(p) where {H.sql_number(*_SEED, "'stop_keep'", "p::varchar")}::double / 18446744073709551616.0 < 0.5)
select episode_id, s::int as start, string_agg(distinct reason, ',' order by reason) as reasons from (select * from strides union all select * from firsts union all select * from turns union all select * from stops) group by episode_id, s""")
def start_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Strided starts from a hashed offset, turn onsets and hashed stop windows; reasons of one start are merged."""
    n = F.col("n")
    seed = ("7", "r2r", F.col("episode_id"))
    e = V.episodes(spark, sf_dir).where((F.array_position("actions", F.lit(0)) == n) & (n >= 5)).withColumn("off", H.stable_index(3, *seed, "stride_offset"))
    pair = lambda s, why: F.struct(s.cast("int").alias("start"), F.lit(why).alias("reason"))
    last = (n - HORIZON).cast("int")
    strides = F.when(F.col("off") < last, F.transform(F.sequence(F.col("off"), last - 1, F.lit(3)), lambda s: pair(s, "stride3"))).otherwise(F.array().cast("array<struct<start:int,reason:string>>"))
    turns = F.transform(F.filter(A.blocks(F.col("actions"), (2, 3)), lambda b: (b["end"] - b["start"] >= 2) & (b["start"] < last)), lambda b: pair(b["start"], "multi_turn_onset"))
    stops = F.array_compact(F.array(*(F.when(H.stable_keep(0.5, *seed, "stop_keep", p), pair(n - p, "terminal_stop")) for p in (1, 2, 3))))
    picked = e.select("episode_id", F.inline(F.concat(strides, F.array(pair(F.lit(0), "episode_start")), turns, stops)))
    return picked.groupBy("episode_id", "start").agg(F.array_join(F.array_sort(F.collect_set("reason")), ",").alias("reasons"))


@query(f"""{EP}, w as (select episode_id, n, greatest(n - 100, 0) as lo, n - 1 as hi from episodes)
select episode_id, array_to_string(list_sort(list_distinct(list_transform(generate_series(0, 10), lambda s: lo + (s * (hi - lo)) // 10))), ',') as slots from w""")
def image_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    lo, hi = F.greatest(F.col("n") - 100, F.lit(0)), F.col("n") - 1
    return V.episodes(spark, sf_dir).select("episode_id", V.text(A.evenly(lo, hi, 10)).alias("slots"))


@query(f"""{EP}, flat as (select episode_id, unnest(vals[1:6]) as v, generate_subscripts(vals[1:6], 1) as i from episodes),
acc as (select episode_id, i, sum(v) over (partition by episode_id order by i) as total from flat)
select episode_id, least(greatest(count(*) filter (where total <= 100.0 + 1e-12), 2), 6)::int as horizon from acc group by episode_id""")
def uncertainty_horizon(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.episodes(spark, sf_dir).select("episode_id", A.uncertainty_horizon(F.col("vals"), 100.0, 2, 6).alias("horizon"))


@query(f"""{EP} select episode_id, list_position(actions[1:4], 0)::bigint as commit_at, array_to_string(actions[1:least(5, coalesce(list_position(actions, 0), n))], ',') as replan from episodes""")
def stop_and_replan(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = F.col("actions")
    return V.episodes(spark, sf_dir).select("episode_id", A.stop_commit(a, 4).cast("long").alias("commit_at"), V.text(A.replan_prefix(a, 5)).alias("replan"))


@query(f"""with {V.POSES_SQL}, d as (select label, vec_id, x, y, z, sqrt(power(x - lag(x) over w, 2) + power(y - lag(y) over w, 2) + power(z - lag(z) over w, 2)) as step from poses window w as (partition by label order by vec_id))
select label, vec_id, round(coalesce(sum(step) over (partition by label order by vec_id), 0), 6) as arc from d""")
def arc_length(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_arc(V.poses(spark, sf_dir)).select("label", "vec_id", F.round("arc", 6).alias("arc"))


def with_arc(p: DataFrame, key: str = "label", order: str = "vec_id") -> DataFrame:
    """``arc``, the length of the path up to each pose."""
    w = Window.partitionBy(key).orderBy(order)
    step = F.sqrt(sum(((F.col(c) - F.lag(c).over(w)) ** 2 for c in "yz"), (F.col("x") - F.lag("x").over(w)) ** 2))
    return p.withColumn("_step", step).withColumn("arc", F.coalesce(F.sum("_step").over(w), F.lit(0.0))).drop("_step")


@query(f"""with {V.POSES_SQL}, h as (select label, vec_id, x, z, y, degrees(atan2(2 * (qw * qy + qx * qz), 1 - 2 * (qy * qy + qz * qz))) as yaw from poses),
d as (select *, yaw - lag(yaw) over w as turn0, sqrt(power(x - lag(x) over w, 2) + power(z - lag(z) over w, 2)) as travel, y - lag(y) over w as rise from h window w as (partition by label order by vec_id))
select label, vec_id, round(coalesce(turn0 - 360 * floor((turn0 + 180) / 360), 0), 6) as turn, round(coalesce(travel, 0), 6) as travel, round(coalesce(rise, 0), 6) as rise,
  round(sum(coalesce(turn0 - 360 * floor((turn0 + 180) / 360), 0)) over (partition by label order by vec_id), 5) as heading from d""")
def camera_motion(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..functions.geometry import wrap_degrees, yaw_degrees

    w = Window.partitionBy("label").orderBy("vec_id")
    p = V.poses(spark, sf_dir).withColumn("yaw", yaw_degrees(*map(F.col, ("qx", "qy", "qz", "qw"))))
    d = p.withColumn("turn", F.coalesce(wrap_degrees(F.col("yaw") - F.lag("yaw").over(w)), F.lit(0.0)))
    d = d.withColumn("travel", F.coalesce(F.sqrt((F.col("x") - F.lag("x").over(w)) ** 2 + (F.col("z") - F.lag("z").over(w)) ** 2), F.lit(0.0)))
    d = d.withColumn("rise", F.coalesce(F.col("y") - F.lag("y").over(w), F.lit(0.0))).withColumn("heading", F.sum("turn").over(w))
    return d.select("label", "vec_id", F.round("turn", 6).alias("turn"), F.round("travel", 6).alias("travel"), F.round("rise", 6).alias("rise"), F.round("heading", 5).alias("heading"))


@query("""with o as (select user_id, ts, event_id, epoch(ts) - epoch(lag(ts) over (partition by user_id order by ts, event_id)) as gap from events),
c as (select user_id, ts, sum(case when gap > 86400 then 1 else 0 end) over (partition by user_id order by ts, event_id) as cluster from o)
select user_id, cluster::bigint as cluster, count(*) as n from c group by user_id, cluster""")
def gap_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    micros = F.unix_micros(F.col("ts").cast("timestamp"))
    gap = micros - F.lag(micros).over(w)
    e = V.table(spark, sf_dir, "events").withColumn("gap", gap)
    return e.withColumn("cluster", F.sum(F.when(F.col("gap") > 86_400_000_000, 1).otherwise(0)).over(w).cast("long")).groupBy("user_id", "cluster").agg(F.count(F.lit(1)).alias("n"))


@query(f"""{EP}, {RUNS_SQL}, iv as (select episode_id, s, e + 1 as e1, action from runs where action in (2, 3)),
m as (select *, max(e1) over (partition by episode_id order by s, e1 rows between unbounded preceding and 1 preceding) as reach from iv),
g as (select *, sum(case when reach is null or s - reach > 2 then 1 else 0 end) over (partition by episode_id order by s, e1) as grp from m)
select episode_id, min(s)::int as span_start, max(e1)::int as span_end, string_agg(action::varchar, '' order by s) as turns from g group by episode_id, grp""")
def merged_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans that lie at most two apart become one; what they carry is joined in order."""
    turns = V.episodes(spark, sf_dir).select("episode_id", F.inline(A.runs_before_stop(F.col("actions")))).where("action in (2, 3)").withColumn("e1", F.col("end") + 1)
    w = Window.partitionBy("episode_id").orderBy("start", "e1")
    reach = F.max("e1").over(w.rowsBetween(Window.unboundedPreceding, -1))
    g = turns.withColumn("new", (reach.isNull() | (F.col("start") - reach > 2)).cast("int")).withColumn("grp", F.sum("new").over(w))
    s = g.groupBy("episode_id", "grp").agg(F.min("start").alias("span_start"), F.max("e1").alias("span_end"), F.array_sort(F.collect_list(F.struct("start", "action"))).alias("l"))
    return s.select("episode_id", "span_start", "span_end", V.text(F.col("l.action"), "").alias("turns"))


@query(f"""{EP}, {RUNS_SQL} select e.episode_id, coalesce(bool_or(r.action in (2, 3) and (r.e + 1) >= 0.55 * e.n and (r.e - r.s + 1) * 15 >= 45), false) as late_turn
from episodes e left join runs r using (episode_id) group by e.episode_id""")
def late_turn(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = A.runs_before_stop(F.col("actions"))
    return V.episodes(spark, sf_dir).select(
        "episode_id", F.exists(r, lambda x: x["action"].isin(2, 3) & (x["end"] + 1 >= 0.55 * F.col("n")) & ((x["end"] - x["start"] + 1) * 15 >= 45)).alias("late_turn")
    )


@query(f"""{EP}, two as (select user_id, max(actions) filter (where k = 0) as a, max(actions) filter (where k = 1) as b from episodes group by user_id),
flat as (select user_id, unnest(generate_series(1, least(len(a), len(b)))) as i, a, b from two where a is not null and b is not null)
select user_id, min(i - 1) filter (where a[i] <> b[i]) as first_mismatch from flat group by user_id""")
def first_mismatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = V.episodes(spark, sf_dir).where("k < 2")
    two = e.groupBy("user_id").agg(F.max(F.when(F.col("k") == 0, F.col("actions"))).alias("a"), F.max(F.when(F.col("k") == 1, F.col("actions"))).alias("b")).where("a is not null and b is not null")
    n = F.least(F.size("a"), F.size("b"))
    differ = F.filter(F.sequence(F.lit(0), n - 1), lambda i: F.get("a", i) != F.get("b", i))
    return two.select("user_id", F.get(differ, F.lit(0)).cast("long").alias("first_mismatch"))


@query(f"""{EP} select episode_id, round(1 - power(0.9, k / 5.0), 9) as p from episodes""")
def oracle_probability(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.episodes(spark, sf_dir).select("episode_id", F.round(1 - F.pow(F.lit(0.9), F.col("k") / 5.0), 9).alias("p"))


@query(f"""with {V.POSES_SQL}, o as (select label, y, case when y - lag(y) over (partition by label order by y) > 0.05 then 1 else 0 end as new from poses),
g as (select label, y, sum(new) over (partition by label order by y rows between unbounded preceding and current row) as level from o)
select label, level::bigint as level, count(*) as n, round(min(y), 6) as low, round(max(y), 6) as high from g group by label, level""")
def height_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("label").orderBy("y").rowsBetween(Window.unboundedPreceding, 0)
    o = V.poses(spark, sf_dir).withColumn("new", F.when(F.col("y") - F.lag("y").over(Window.partitionBy("label").orderBy("y")) > 0.05, 1).otherwise(0))
    g = o.withColumn("level", F.sum("new").over(w).cast("long"))
    return g.groupBy("label", "level").agg(F.count(F.lit(1)).alias("n"), F.round(F.min("y"), 6).alias("low"), F.round(F.max("y"), 6).alias("high"))


@query(f"""{EP}, recursive_seed as (select episode_id, vals, 1 as i, [vals[1]] as kept from episodes) select episode_id, len(list_reduce(list_prepend([vals[1]], list_transform(vals[2:], lambda v: [v])), lambda acc, x: case when abs(acc[-1] - x[1]) > 40.0 then list_concat(acc, x) else acc end)) as n_kept from episodes""")
def sparse_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values kept when they differ by more than 40 from the last one kept."""
    return V.episodes(spark, sf_dir).select("episode_id", F.size(A.keep_if_far(F.col("vals"), 40.0)).cast("long").alias("n_kept"))


@query(f"""with {V.POSES_SQL}, nxt as (select label, vec_id, x, y, z, lead(x) over w as x1, lead(y) over w as y1, lead(z) over w as z1 from poses window w as (partition by label order by vec_id)),
seg as (select *, greatest(1, ceil(sqrt(power(x1-x,2)+power(y1-y,2)+power(z1-z,2)) / 0.1))::bigint as parts from nxt where x1 is not null),
pts as (select label, vec_id, parts, unnest(generate_series(0, parts - 1)) as j, x, y, z, x1, y1, z1 from seg)
select label, vec_id, j, round(x + (x1 - x) * j / parts, 6) as px, round(y + (y1 - y) * j / parts, 6) as py, round(z + (z1 - z) * j / parts, 6) as pz from pts""")
def dense_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each leg of a path cut into equal parts of at most 0.1."""
    w = Window.partitionBy("label").orderBy("vec_id")
    s = V.poses(spark, sf_dir).select("label", "vec_id", "x", "y", "z", *(F.lead(c).over(w).alias(f"{c}1") for c in "xyz")).where("x1 is not null")
    length = F.sqrt((F.col("x1") - F.col("x")) ** 2 + (F.col("y1") - F.col("y")) ** 2 + (F.col("z1") - F.col("z")) ** 2)
    s = s.withColumn("parts", F.greatest(F.lit(1), F.ceil(length / 0.1)).cast("long"))
    p = s.withColumn("j", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)))
    return p.select("label", "vec_id", "j", *(F.round(F.col(c) + (F.col(f"{c}1") - F.col(c)) * F.col("j") / F.col("parts"), 6).alias(f"p{c}") for c in "xyz"))

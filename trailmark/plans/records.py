"""Queries of sources, sinks, records, parameters and the machines that no other query runs."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import camera as K
from ..functions import geometry as GEO
from ..functions import text as X
from ..functions import validate
from ..functions.statistics import ordered_means
from ..operators import graph as G
from ..operators import joins as J
from ..operators import records as REC
from ..sources import images, jsonl, sinks
from ..streaming import machines
from . import views as V
from .registry import query
from .sequences import EP

_T = V.table


# -- sources -------------------------------------------------------------------------------------------------------------


@query("select doc_id, lang from documents where doc_id % 10 <> 3 and doc_id % 10 <> 7 and lang is not null")
def lenient_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of which some are cut short and some have no key; those are left out."""
    d = _T(spark, sf_dir, "documents")
    line = F.to_json(F.struct(F.when(F.col("doc_id") % 10 != 7, F.col("doc_id")).alias("doc_id"), "lang"))
    path = G.shared_folder(spark, "lenient")
    d.select(F.when(F.col("doc_id") % 10 == 3, F.substring(line, 1, 9)).otherwise(line).alias("value")).write.text(path)
    return jsonl.lenient(spark, path, "doc_id long, lang string", ["doc_id", "lang"])


@query("select doc_id, n_chars from documents where doc_id < (select max(doc_id) from documents)")
def torn_journal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S3, K3, K4: a journal that was appended to in two runs; the last line of its last file was torn off and is left out."""
    d = _T(spark, sf_dir, "documents").select("doc_id", "n_chars")
    last = d.agg(F.max("doc_id")).first()[0]
    path = G.shared_folder(spark, "journal")
    sinks.append(d.where(F.col("doc_id") % 2 == 0).where(F.col("doc_id") < last), path)
    sinks.append(d.where(F.col("doc_id") % 2 == 1).where(F.col("doc_id") < last), path)
    torn = spark.range(1).select(F.lit('{"doc_id": 1, "n_ch').alias("value"))
    torn.coalesce(1).write.mode("append").text(path)
    return jsonl.journal(spark, path, "doc_id long, n_chars long")


@query("select s_suppkey as id, s_name as name from supplier")
def document_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One gzip document whose array field holds the rows."""
    s = _T(spark, sf_dir, "supplier").select(F.struct(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name")).alias("e"))
    path = G.shared_folder(spark, "document")
    s.agg(F.collect_list("e").alias("episodes")).withColumn("version", F.lit(1)).coalesce(1).write.option("compression", "gzip").json(path)
    return jsonl.document_array(spark, path, "episodes", "id long, name string")


@query("select 'scene-' || s_nationkey::varchar as scene from supplier group by s_nationkey having min(s_suppkey) % 3 <> 0")
def scene_folders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files found by a listing that reads none of them; a scene has exactly one mesh and one navigation mesh (every third folder lacks one)."""
    n = _T(spark, sf_dir, "supplier").groupBy(F.col("s_nationkey").alias("n")).agg(F.min("s_suppkey").alias("k"))
    both = F.when(F.col("k") % 3 == 0, F.array(F.lit("x.basis.glb"))).otherwise(F.array(F.lit("x.basis.glb"), F.lit("x.basis.navmesh")))
    path = G.shared_folder(spark, "scenes")
    files = n.select(F.explode(both).alias("file"), F.concat(F.lit("scene-"), F.col("n").cast("string")).alias("folder"))
    for suffix in ("glb", "navmesh"):
        some = files.where(F.endswith("file", F.lit(suffix))).select("folder", F.lit("mesh").alias("value"))
        some.repartition("folder").write.partitionBy("folder").mode("append").option("compression", "none").text(f"{path}/{suffix}")
    # Spark names files itself; the listing sees them as folder/part.suffix.
    seen = jsonl.listing(spark, path, "*.txt").select(F.concat(F.regexp_extract("path", "folder=([^/]+)", 1), F.lit("/x.basis."), F.regexp_extract("path", "/(glb|navmesh)/folder", 1)).alias("path"))
    return jsonl.scenes(seen.select(F.concat(F.lit("/data/"), "path").alias("path")).distinct()).select("scene")


@query("select conv_id, turn, role, case role when 'user' then 'a' else 'b' end as source from conversations where role in ('user', 'assistant')")
def rows_by_role(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files of two roles, read with their role; keys that the first source lacks come from the second."""
    c = _T(spark, sf_dir, "conversations").select("conv_id", "turn", F.col("role").alias("language"))
    path = G.shared_folder(spark, "roles")
    for role in ("user", "assistant"):
        sinks.json_lines(c.where(F.col("language") == role), f"{path}/{role}")
    read = lambda *roles: jsonl.by_role(spark, {k: f"{path}/{k}" for k in ("user", "assistant")}, "conv_id long, turn long, language string", list(roles), ["*"])
    key = F.concat_ws(":", "conv_id", "turn").alias("key")
    first, second = (read(r).select(key, "conv_id", "turn", "role", F.lit(s).alias("source")) for r, s in (("user", "a"), ("*", "b")))
    return jsonl.with_fallback(first, second, "key").select("conv_id", "turn", "role", "source")


@query("""with i as (select vec_id, list_transform(embedding, lambda v: (abs(v) * 400)::int) as px from embeddings)
select vec_id, len(px) as n_pixels, list_sum(px)::bigint as total, round(len(list_filter(px, lambda v: v < 16)) / 64.0, 9)::double as dark from i""")
def picture_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embeddings written as small PNG files, read back as files and decoded to statistics."""
    @F.pandas_udf("binary")
    def drawn(ids: pd.Series, px: pd.Series) -> pd.Series:
        return pd.Series([images.encode(np.asarray(p, np.uint8).reshape(8, 8), int(i) % 3) for i, p in zip(ids, px, strict=True)])

    px = F.transform("embedding", K.level)
    shown = _T(spark, sf_dir, "embeddings").select("vec_id", drawn("vec_id", px).alias("content"))
    seen = shown.select("vec_id", images.gray_pixels(F.col("content")).alias("px"))
    return seen.select(
        "vec_id", F.size("px").cast("long").alias("n_pixels"), F.aggregate("px", F.lit(0).cast("long"), lambda s, v: s + v).alias("total"), F.round(F.size(F.filter("px", lambda v: v < 16)) / 64.0, 9).alias("dark")
    )


@query("select doc_id, row_number() over (order by doc_id) - 1 as line, (sum(n_chars + 1) over (order by doc_id) - n_chars - 1)::bigint as at from documents")
def row_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Number and offset of each row in order of id; running sums are made by ranges of ids, of which few totals are put in order."""
    d = _T(spark, sf_dir, "documents").select("doc_id", F.col("n_chars").cast("long").alias("size"), F.floor(F.col("doc_id") / 256).alias("part"))
    before = lambda c, w: F.coalesce(F.sum(c).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    wide = F.floor(F.col("part") / 256).alias("wide")  # ranges of ranges, so that no window holds more than 256 * 256 rows of a table of 10^10
    parts = d.groupBy("part").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("size") + 1).alias("s")).select("*", wide)
    tops = parts.groupBy("wide").agg(F.sum("n").alias("tn"), F.sum("s").alias("ts"))
    top = Window.orderBy("wide")
    tops = tops.select("wide", before("tn", top).alias("un"), before("ts", top).alias("us"))
    inner = Window.partitionBy("wide").orderBy("part")
    shift = parts.select("part", "wide", before("n", inner).alias("pn"), before("s", inner).alias("ps")).join(tops, "wide")
    own = Window.partitionBy("part").orderBy("doc_id")
    return d.select("doc_id", "part", before(F.lit(1), own).alias("i"), before(F.col("size") + 1, own).alias("o")).join(shift, "part").select("doc_id", (F.col("i") + F.col("pn") + F.col("un")).alias("line"), (F.col("o") + F.col("ps") + F.col("us")).alias("at"))


# -- sinks ---------------------------------------------------------------------------------------------------------------


@query("select 'first' as step, 'true' as said union all select 'again', 'false' union all select 'changed', 'refused' union all select 'equal in any order', 'true'")
def guarded_write(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table is written once; the same rows in another order are taken as done, other rows are refused."""
    o = _T(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice")
    path = G.shared_folder(spark, "once")
    said = [("first", str(sinks.write_once(o, path)).lower()), ("again", str(sinks.write_once(o.orderBy(F.desc("o_orderkey")), path)).lower())]
    try:
        said.append(("changed", str(sinks.write_once(o.withColumn("o_totalprice", F.col("o_totalprice") + 1), path)).lower()))
    except ValueError:
        said.append(("changed", "refused"))
    said.append(("equal in any order", str(sinks.fingerprint(o) == sinks.fingerprint(o.repartition(7))).lower()))
    return spark.createDataFrame(said, "step string, said string")


@query("""select line from (select 0 as k, '# Orders by status' as line union all select 1, '' union all select 2, '| o_orderstatus | n |' union all select 3, '|---|---|'
union all select 3 + row_number() over (order by o_orderstatus), '| ' || o_orderstatus || ' | ' || n::varchar || ' |' from (select o_orderstatus, count(*) as n from orders group by o_orderstatus))""")
def markdown_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K8: a report of a few aggregated rows, line by line."""
    n = _T(spark, sf_dir, "orders").groupBy("o_orderstatus").agg(F.count(F.lit(1)).alias("n")).orderBy("o_orderstatus")
    return spark.createDataFrame([(line,) for line in sinks.markdown("Orders by status", n).splitlines()], "line string")


@query(f"{EP}, l(length) as (values (2), (4), (8)) select length, count(*) as n_rows, sum(least(n, length))::bigint as n_actions from episodes cross join l group by length")
def horizon_folders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K7: one folder for each horizon, written in one pass and read back."""
    path = G.shared_folder(spark, "horizons")
    sinks.by_length(V.episodes(spark, sf_dir).select("episode_id", "n"), (2, 4, 8), path)
    back = spark.read.parquet(path)
    return back.groupBy("length").agg(F.count(F.lit(1)).alias("n_rows"), F.sum(F.least("n", "length")).alias("n_actions"))


@query(f"{EP} select episode_id, n, true as same from episodes")
def published_pair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K6: the same rows published plain and compressed; readers of either see all rows or none, as each write is committed as a whole."""
    e, path = V.episodes(spark, sf_dir).select("episode_id", "n"), G.shared_folder(spark, "pair")
    for gzip in (False, True):
        sinks.json_lines(e, f"{path}/{'gz' if gzip else 'plain'}", gzip)
    read = lambda kind: spark.read.schema("episode_id string, n long").json(f"{path}/{kind}")
    both = read("plain").join(read("gz").withColumnRenamed("n", "m"), "episode_id", "full_outer")
    return both.select("episode_id", "n", F.col("n").eqNullSafe(F.col("m")).alias("same"))


@query("""with f as (select l_orderkey, avg(l_discount) as dark from lineitem group by l_orderkey) select l_orderkey, case when dark > 0.07 then 'remove' else 'keep' end as verdict from f""")
def keep_and_remove(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What would be deleted is written as a table beside what is kept; nothing is deleted."""
    f = V.placed(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(ordered_means(F.col("at"), dark=F.col("l_discount"))["dark"].alias("dark"))
    path = G.shared_folder(spark, "verdicts")
    f.select("l_orderkey", F.when(F.col("dark") > 0.07, "remove").otherwise("keep").alias("verdict")).write.partitionBy("verdict").parquet(path)
    return spark.read.parquet(path).select("l_orderkey", "verdict")


@query("select l_returnflag as part, count(distinct l_orderkey) as episodes, count(*) as frames, round(count(*)::double / count(distinct l_orderkey), 9) as frames_an_episode from lineitem group by l_returnflag")
def scan_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The counts of a scan; seconds are the job's own metrics and not rows."""
    c = _T(spark, sf_dir, "lineitem").groupBy(F.col("l_returnflag").alias("part")).agg(F.countDistinct("l_orderkey").alias("episodes"), F.count(F.lit(1)).alias("frames"))
    return c.withColumn("frames_an_episode", F.round(F.col("frames") / F.col("episodes"), 9))


@query("select o_custkey, count(*) as n, row_number() over (order by count(*) desc, o_custkey) - 1 as batch from orders group by o_custkey qualify row_number() over (order by count(*) desc, o_custkey) <= 100")
def largest_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The hundred largest groups, largest first."""
    g = _T(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "o_custkey").limit(100)
    return g.withColumn("batch", (F.row_number().over(Window.orderBy(F.desc("n"), "o_custkey")) - 1).cast("long"))


@query("""with c as (select n_nationkey as k, n_regionkey as gamma, length(n_name) as horizon from nation), s as (select n_nationkey as k, n_regionkey as gamma, case when n_nationkey % 4 = 0 then 0 else length(n_name) end as horizon from nation)
select c.k, concat_ws(',', case when c.gamma <> s.gamma then 'gamma' end, case when c.horizon <> s.horizon then 'horizon' end) as differs from c join s using (k)""")
def reusable_outputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored settings against those of the run, field by field; an output is used again where none differs."""
    n = _T(spark, sf_dir, "nation")
    k, gamma, horizon = F.col("n_nationkey").alias("k"), F.col("n_regionkey"), F.length("n_name")
    now = n.select(k, F.to_json(F.struct(gamma.alias("gamma"), horizon.alias("horizon"))).alias("now"))
    old = n.select(k, F.to_json(F.struct(F.when(F.col("n_nationkey") % 4 == 0, 0).otherwise(horizon).alias("horizon"), gamma.alias("gamma"))).alias("old"))
    read = lambda c: F.from_json(c, "map<string,string>")
    both = now.join(old, "k").select("k", read("now").alias("a"), read("old").alias("b"))
    names = F.array_sort(F.array_union(F.map_keys("a"), F.map_keys("b")))
    return both.select("k", F.array_join(F.filter(names, lambda x: ~F.col("a")[x].eqNullSafe(F.col("b")[x])), ",").alias("differs"))


@query("select c_nationkey as scene, count(*) as n, (row_number() over (order by c_nationkey) - 1) % 4 as worker from customer group by c_nationkey")
def worker_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scenes in turn to four workers; only scenes are put in order."""
    s = _T(spark, sf_dir, "customer").groupBy(F.col("c_nationkey").alias("scene")).agg(F.count(F.lit(1)).alias("n"))
    return s.withColumn("worker", F.pmod(F.row_number().over(Window.orderBy("scene")) - 1, F.lit(4)).cast("long"))


@query("""with g as (select user_id, ts, coalesce(ts - lag(ts) over (partition by user_id order by ts) >= interval 6 hour, true)::int as new from events),
s as (select user_id, ts, sum(new) over (partition by user_id order by ts rows unbounded preceding) as k from g) select user_id, min(ts)::timestamp as session_start, count(*) as n from s group by user_id, k""")
def event_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions of event time, as on the stream: a new one begins after six hours without an event."""
    from ..streaming import windows

    e = _T(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return windows.sessions(e, "ts", "6 hours", "user_id").withColumn("session_start", F.col("session_start").cast("timestamp_ntz"))


@query(f"""{EP}, flat as (select episode_id, unnest(actions) as a, generate_subscripts(actions, 1) as i from episodes), g as (select *, i - row_number() over (partition by episode_id, a order by i) as g from flat),
r as (select episode_id, count(*) as n from g group by episode_id, a, g) select episode_id, count(*) as runs, max(n) as longest, round(((len(episode_id) * 77.5) - 0) - 360 * floor((len(episode_id) * 77.5 + 180) / 360), 6)::double as wrapped from r group by episode_id""")
def sql_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """2.12: scalar and table functions of the engine in a SQL text."""
    from ..functions import registry as functions

    functions.install(spark)
    V.episodes(spark, sf_dir).createOrReplaceTempView("trailmark_episodes")
    runs = "select episode_id, count(*) as runs, max(r.n) as longest from trailmark_episodes, lateral action_runs(actions) r group by episode_id"
    return spark.sql(f"select episode_id, runs, longest, wrap_degrees(length(episode_id) * 77.5D) as wrapped from ({runs})")


# -- records, routes, texts, math ------------------------------------------------------------------------------------------


@query(f"""with {V.POSES_SQL}, p as (select label, vec_id, floor(x / 0.2) * 0.2 as x, floor(z / 0.2) * 0.2 as z, row_number() over (partition by label order by vec_id) as i from poses),
m as (select *, i = 1 or x is distinct from lag(x) over w or z is distinct from lag(z) over w as kept from p window w as (partition by label order by vec_id))
select label::int as episode_id, 'walk ' || label as trajectory_id, 'scans/' || label || '.glb' as scene_id, count(*) filter (where kept) as n_places, round(min_by(x, i), 6) as start_x, round(max_by(x, i), 6) as goal_x, 0.25::double as radius, 'Go to ' || label as text, round(sum(abs(x)), 6) as geodesic from m group by label""")
def route_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each label's poses, on a coarse grid, as one record of a route benchmark, as JSON and back."""
    grid = lambda c: F.floor(F.col(c) / 0.2) * 0.2
    g = V.poses(spark, sf_dir).select("label", "vec_id", grid("x").alias("x"), grid("z").alias("z")).groupBy("label").agg(F.array_sort(F.collect_list(F.struct("vec_id", "x", "z"))).alias("s"), F.sum(F.abs("x")).alias("length"))
    at = F.transform("s", lambda p: F.array(p["x"], F.lit(0.0), p["z"]))
    name = F.col("label").cast("string")
    r = REC.route_record(F.col("label"), F.concat(F.lit("walk "), name), F.concat(F.lit("/data/scans/"), name, F.lit(".glb")), "/data", at, GEO.heading_quaternion(F.lit(0.0)), F.concat(F.lit("Go to "), name), F.col("length"))
    kept = g.select(r.alias("r"))
    back = kept.select(F.from_json(F.to_json("r"), kept.schema["r"].dataType).alias("r"))
    return back.select(
        "r.episode_id", "r.trajectory_id", "r.scene_id", F.size("r.reference_path").cast("long").alias("n_places"), F.round(F.get("r.start_position", F.lit(0)), 6).alias("start_x"),
        F.round(F.col("r.goals")[0]["position"][0], 6).alias("goal_x"), F.col("r.goals")[0]["radius"].alias("radius"), F.col("r.instruction.instruction_text").alias("text"), F.round("r.info.geodesic_distance", 6).alias("geodesic"),
    )


@query(f"""{EP}, l as (select episode_id, actions, list_transform(actions, lambda a, i: case when i % 4 = 0 then -1 else a end) as seen from episodes),
c as (select episode_id, actions, list_filter(seen, lambda x: x >= 0) as s from l),
r as (select episode_id, list_filter(list_transform(actions, lambda x, i: case when i = 1 or actions[i - 1] <> x then x end), lambda x: x is not null) as expected,
  list_filter(list_transform(s, lambda x, i: case when i = 1 or s[i - 1] <> x then x end), lambda x: x is not null) as short from c)
select episode_id, short = expected or short = list_filter(expected, lambda x, i: i = 1 or i = len(expected) or list_contains(short, x)) as same from r""")
def same_routes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The runs of an episode's actions against those seen when every fourth action is not."""
    e = V.episodes(spark, sf_dir)
    runs = F.filter(F.transform("actions", lambda x, i: F.when((i == 0) | (F.get("actions", i - 1) != x), x)), lambda x: x.isNotNull())
    seen = F.transform("actions", lambda a, i: F.when((i + 1) % 4 == 0, -1).otherwise(a))
    return e.select("episode_id", REC.same_route(runs, seen).alias("same"))


_CONNECTIONS = ((0, 1, 10, -0.1, 0.0), (0, 1, 11, -0.1, 0.3), (1, 2, 12, 0.1, 0.0), (1, 2, 13, 0.1, -0.3), (0, 2, 14, 0.0, 0.0))


@query(f"""with {V.POSES_SQL}, p as (select label * 100 + vec_id // 50 as path, vec_id, x, z, case when abs(z) > 0.2 then -1 when x < -0.1 then 0 when x < 0.1 then 1 else 2 end as region from poses),
n as (select *, case when region is distinct from lag(region) over (partition by path order by vec_id) then 1 else 0 end as new from p), r as (select *, sum(new) over (partition by path order by vec_id) as run from n),
runs as (select path, run, min(region) as region, min_by(x, vec_id) as fx, min_by(z, vec_id) as fz, max_by(x, vec_id) as lx, max_by(z, vec_id) as lz from r where region >= 0 group by path, run),
s as (select *, lead(region) over w as nxt, (lx + lead(fx) over w) / 2 as mx, (lz + lead(fz) over w) / 2 as mz from runs window w as (partition by path order by run)),
c(lo, hi, connection, cx, cz) as (values {', '.join(map(str, _CONNECTIONS))}),
t as (select s.*, (select arg_min(connection, (sqrt(power(cx - mx, 2) + power(cz - mz, 2)), connection)) from c where lo = least(region, nxt) and hi = greatest(region, nxt)) as taken from s),
w as (select path, count(nxt) > 0 and count(nxt) = count(taken) as ok, string_agg(region::varchar, ',' order by run) as regions, string_agg(taken::varchar, ',' order by run) as taken from t group by path)
select path, case when ok then regions end as regions, case when ok then taken end as taken from (select distinct path from p) left join w using (path)""")
def path_structures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Short paths through three regions, with two connections for most pairs."""
    x, z = F.col("x"), F.col("z")
    region = F.when(F.abs(z) > 0.2, -1).when(x < -0.1, 0).when(x < 0.1, 1).otherwise(2)
    p = V.poses(spark, sf_dir).select((F.col("label") * 100 + F.floor(F.col("vec_id") / 50)).alias("path"), "vec_id", "x", "z", region.alias("label"))
    c = spark.createDataFrame(list(_CONNECTIONS), "lo int, hi int, connection int, cx double, cz double")
    text = lambda k: F.array_join(F.transform(k, lambda v: v.cast("string")), ",").alias(k)
    return J.path_structure(p, c, "path", "vec_id").select("path", text("regions"), text("taken"))


_TAILS = ("", " follow the red arrow", " go along the Yellow Line", " at label Q", " in frame 12", " marked S3 then", " to the kitchen")


@query(f"""with t as (select doc_id, text || ([{', '.join(f"'{x}'" for x in _TAILS)}])[doc_id % 7 + 1] as text from documents) select doc_id, regexp_matches(text, '{X.MARKER}') as marked from t""")
def marker_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """texts that speak of arrows, frames or lines; most documents have such words put behind them."""
    tail = F.get(F.array(*map(F.lit, _TAILS)), (F.col("doc_id") % 7).cast("int"))
    return _T(spark, sf_dir, "documents").select("doc_id", X.speaks_of_markers(F.concat("text", tail)).alias("marked"))


@query("""select vec_id, round(embedding[4]::double, 9) as x, round(embedding[12]::double, 9) as y, round(-embedding[8]::double, 9) as z, round(sin(embedding[1]::double / 2), 9) as qy, round(cos(embedding[1]::double / 2), 9) as qw from embeddings""")
def pose_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M4: embeddings as camera matrices and headings."""
    p = F.transform("embedding", lambda v: v.cast("double"))
    at, q = REC.position_of_pose(p), GEO.heading_quaternion(F.get(p, F.lit(0)))
    return _T(spark, sf_dir, "embeddings").select("vec_id", *(F.round(at[i], 9).alias(k) for i, k in enumerate("xyz")), F.round(q[1], 9).alias("qy"), F.round(q[3], 9).alias("qw"))


@query("""with pairs as (select a.s_nationkey as island, a.s_suppkey as a, b.s_suppkey as b, abs(a.s_acctbal - b.s_acctbal) as d, floor(a.s_acctbal / 2000) as from_, floor(b.s_acctbal / 2000) as to_ from supplier a join supplier b on a.s_nationkey = b.s_nationkey and a.s_suppkey <> b.s_suppkey),
ends as (select l_suppkey, l_partkey, row_number() over (partition by l_suppkey order by l_partkey) - 1 as i from (select distinct l_suppkey, l_partkey from lineitem) qualify i < 2),
cand as (select p.*, e.l_partkey as e, f.l_partkey as f, row_number() over (partition by a, b order by e.i + f.i, e.i) as k from pairs p join ends e on e.l_suppkey = a join ends f on f.l_suppkey = b),
gated as (select *, (e + f) % 4 as events, (e * 7 + f) % 100 as offset_, (e + 3 * f) % 50 as clearance from cand where k <= 2 and d between 100 and 2000),
best as (select *, row_number() over (partition by island, from_, to_, events order by events desc, offset_, clearance desc, a, b, e, f) as nth from gated where events > 0),
family as (select *, row_number() over (partition by island, from_ order by clearance desc, offset_, to_, events, a, b) as r, count(*) over (partition by island, from_) as structures from best where nth = 1)
select island, from_::bigint as start_step, a, b, e, f, events::bigint as events, structures from family where r = 1""")
def route_families(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Routes between suppliers of a nation, two endpoint pairs each, gated by distance; the best of each structure, then of each family."""
    s = _T(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("k"), F.col("s_nationkey").alias("island"), F.col("s_acctbal").alias("x"), F.floor(F.col("s_acctbal") / 2000).alias("step"))
    a = s.select("island", F.col("k").alias("a"), F.col("x").alias("xa"), F.col("step").alias("start_step"), F.explode(F.array(F.col("step") - 1, "step", F.col("step") + 1)).alias("to_step"))
    b = s.select("island", F.col("k").alias("b"), F.col("x").alias("xb"), F.col("step").alias("to_step"))
    gate = F.abs(F.col("xa") - F.col("xb")).between(100, 2000) & (F.col("a") != F.col("b"))
    pairs = a.join(b, ["island", "to_step"]).where(gate).select("island", "a", "b", "start_step", "to_step")
    rank = F.row_number().over(Window.partitionBy("l_suppkey").orderBy("l_partkey")) - 1
    ends = _T(spark, sf_dir, "lineitem").select("l_suppkey", "l_partkey").distinct().withColumn("i", rank).where("i < 2")
    first, last = ends.toDF("a", "e", "i"), ends.toDF("b", "f", "j")
    # Of the four endpoint pairs the two of least sum of places, the first start first: (0, 0) and (0, 1); (1, 0) where there is no second end.
    w = Window.partitionBy("a", "b").orderBy(F.col("i") + F.col("j"), "i")
    c = pairs.join(first, "a").join(last, "b").withColumn("n", F.row_number().over(w)).where("n <= 2")
    c = c.withColumn("events", (F.col("e") + F.col("f")) % 4).withColumn("off", (F.col("e") * 7 + F.col("f")) % 100).withColumn("clearance", (F.col("e") + F.col("f") * 3) % 50).where("events > 0")
    best = c.groupBy("island", "start_step", "to_step", "events").agg(F.min(F.struct("off", (-F.col("clearance")).alias("less"), "a", "b", "e", "f")).alias("r")).select("*", "r.*").drop("r")
    family = best.groupBy("island", "start_step").agg(F.min(F.struct("less", "off", "to_step", "events", "a", "b", "e", "f")).alias("r"), F.count(F.lit(1)).alias("structures"))
    return family.select("island", "start_step", "r.a", "r.b", "r.e", "r.f", "r.events", "structures")


# -- parameters and machines -----------------------------------------------------------------------------------------------


@query("""select c as given, lower(trim(c)) in ('1', 'true', 'yes', 'on', 'y', 't') as truth from (values ('1'), ('true'), (' YES'), ('off'), ('n'), ('0')) v(c)""")
def parsed_parameters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parameters are read on the driver; bad ones are errors before anything runs."""
    validate.ordered("horizon", validate.whole("least", 1), 8)
    validate.positive("radius", 0.25)
    for bad in (lambda: validate.positive("x", float("nan")), lambda: validate.whole("x", True), lambda: validate.names(["a", "A "], ("a", "b")), lambda: validate.truth("maybe")):
        try:
            bad()
        except ValueError:
            continue
        raise AssertionError("a bad parameter was taken")
    assert validate.names([" B", "a"], ("a", "b")) == ["a", "b"] and validate.id_list("3, 5 8") == [3, 5, 8]
    return spark.createDataFrame([(c, validate.truth(c)) for c in ("1", "true", " YES", "off", "n", "0")], "given string, truth boolean")


@query(f"""with {V.POSES_SQL}, d as (select label, vec_id, coalesce(sqrt(power(x - lag(x) over w, 2) + power(y - lag(y) over w, 2) + power(z - lag(z) over w, 2)), 0) as step, sqrt(x*x + y*y + z*z) as goal from poses window w as (partition by label order by vec_id))
select label, vec_id, row_number() over w as steps, round(sum(step) over w, 5) as length, round(min(goal) over w, 6) as closest from d window w as (partition by label order by vec_id)""")
def running_measures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Measures after each step."""
    p = V.poses(spark, sf_dir).withColumn("goal", F.sqrt(F.col("x") ** 2 + F.col("y") ** 2 + F.col("z") ** 2))
    out = machines.batch(p, "label", ["vec_id"], ["x", "y", "z", "goal"], machines.RunningMeasures, "steps long, length double, closest double")
    return out.select("label", "vec_id", "steps", F.round("length", 5).alias("length"), F.round("closest", 6).alias("closest"))


@query(f"""with {V.STEPS_SQL} select user_id, event_id, greatest(0, row_number() over (partition by user_id order by ts, event_id) - 8) as dropped from steps""")
def dropped_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A queue of eight that nothing is taken from: what has been dropped after each item."""
    return machines.batch(V.steps(spark, sf_dir).select("user_id", "ts", "event_id", "action"), "user_id", ["ts", "event_id"], ["action"], _Filled, "dropped long").select("user_id", "event_id", "dropped")


class _Filled(machines.Queue):
    def feed(self, action: int) -> int:
        return self.put(int(action))


@query(f"""with {V.STEPS_SQL}, r as (select *, row_number() over (partition by user_id order by ts, event_id) - 1 as i from steps)
select a.user_id, a.event_id, b.action::bigint as acted from r a join r b on a.user_id = b.user_id and b.i = a.i - a.i % 3""")
def planned_actions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """R2: a plan of three equal actions is made when the queue is empty and run before the next one."""
    return machines.batch(V.steps(spark, sf_dir).select("user_id", "ts", "event_id", "action"), "user_id", ["ts", "event_id"], ["action"], _Planned, "acted long").select("user_id", "event_id", "acted")


class _Planned(machines.Queue):
    def feed(self, action: int) -> int:
        return self.act([int(action)] * 3)


@query(f"""with recursive {V.POSES_SQL}, p as (select label, vec_id, x, z, row_number() over (partition by label order by vec_id) as i from poses), w(k, wx, wz, r) as (values (0, 0.0, 0.0, 0.2), (1, 0.1, 0.0, 0.2), (2, 0.1, 0.1, 0.1)),
go(label, vec_id, i, k, part) as (select label, vec_id, i, 0, 0 from p where i = 1
 union all select g.label, case when near then g.vec_id else n.vec_id end, case when near then g.i else n.i end, case when near then g.k + 1 else g.k end, case when near then 0 else 0 end
 from go g join p c on c.label = g.label and c.i = g.i left join w on w.k = g.k, lateral (select coalesce(power(w.wx - c.x, 2) + power(w.wz - c.z, 2) <= w.r * w.r, false) as near) left join p n on n.label = g.label and n.i = g.i + 1 where near or n.i is not null)
select label, vec_id, max(k)::bigint as reached from go group by label, vec_id""")
def waypoint_progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Waypoints reached so far; several can be reached at one place."""
    return machines.batch(V.poses(spark, sf_dir), "label", ["vec_id"], ["x", "z"], lambda: machines.Waypoints([(0.0, 0.0), (0.1, 0.0), (0.1, 0.1)], 0.2, 0.1), "reached long")

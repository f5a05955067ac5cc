"""Queries of the join operators (J) and set operations (U)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import actions as A
from ..operators import joins as J
from . import views as V
from .registry import query
from .sequences import EP, RUNS_SQL, with_arc

R = f"with {V.RESULTS_SQL}"


@query(f"{R} select scene_id, id, a.success as base_success, b.success as new_success, round(b.spl - a.spl, 9) as spl_gain from latest a join latest b using (scene_id, id) where a.side = 'F' and b.side = 'O'")
def paired_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J1."""
    r = V.latest(spark, sf_dir)
    a = r.where("side = 'F'").select("scene_id", "id", F.col("success").alias("base_success"), F.col("spl").alias("a_spl"))
    b = r.where("side = 'O'").select("scene_id", "id", F.col("success").alias("new_success"), F.col("spl").alias("b_spl"))
    return a.join(b, ["scene_id", "id"]).select("scene_id", "id", "base_success", "new_success", F.round(F.col("b_spl") - F.col("a_spl"), 9).alias("spl_gain"))


@query("""select c.doc_id as episode_id, coalesce(s.text, '') = '' as no_source, c.text = coalesce(s.text, '') as identical from (select * from documents where source <> 'src0') c
left join (select doc_id + 1 as doc_id, text from documents where source = 'src0') s using (doc_id)""")
def source_instruction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Left join with an empty default."""
    d = V.table(spark, sf_dir, "documents")
    s = d.where("source = 'src0'").select((F.col("doc_id") + 1).alias("doc_id"), F.col("text").alias("old"))
    old = F.coalesce("old", F.lit(""))
    return d.where("source <> 'src0'").join(s, "doc_id", "left").select(F.col("doc_id").alias("episode_id"), (old == "").alias("no_source"), (F.col("text") == old).alias("identical"))


@query(f"""{EP}, keyed as (select user_id, k, episode_id, lag(k) over (partition by user_id order by k) as prev from episodes),
o as (select user_id, o_custkey, row_number() over (partition by o_custkey order by o_orderkey) - 1 as pos, o_orderkey from orders join (select distinct user_id from episodes) u on o_custkey = user_id)
select episode_id, o_orderkey, coalesce(prev < k, true) as increasing from keyed join o on keyed.user_id = o.o_custkey and keyed.k = o.pos""")
def ordinal_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The k-th episode of a user with the k-th order, checking that k increases."""
    w = Window.partitionBy("user_id").orderBy("k")
    e = V.episodes(spark, sf_dir).select("user_id", "k", "episode_id", F.coalesce(F.lag("k").over(w) < F.col("k"), F.lit(True)).alias("increasing"))
    o = V.table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("user_id"), "o_orderkey")
    o = o.withColumn("k", (F.row_number().over(Window.partitionBy("user_id").orderBy("o_orderkey")) - 1).cast("long"))
    return e.join(o, ["user_id", "k"]).select("episode_id", "o_orderkey", "increasing")


@query("""select d.doc_id, l.quality, b.item_id from documents d join labels l using (doc_id) left join benchmark b on b.item_id = d.doc_id % 50""")
def three_way(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Manifest, catalog and annotations; a label without a document fails the job."""
    d, lab = V.table(spark, sf_dir, "documents"), V.table(spark, sf_dir, "labels")
    lab = J.require_all(lab, d, ["doc_id"], "documents")
    b = V.table(spark, sf_dir, "benchmark").select("item_id", F.col("item_id").alias("part"))
    return d.join(lab, "doc_id").withColumn("part", F.col("doc_id") % 50).join(b, "part", "left").select("doc_id", "quality", "item_id")


@query(f"{R} select distinct scene_id, id from latest where side = 'O' and not exists (select 1 from latest f where f.side = 'F' and f.scene_id = latest.scene_id and f.id = latest.id)")
def pending_episodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J5."""
    r = V.latest(spark, sf_dir)
    return J.pending(r.where("side = 'O'").select("scene_id", "id").distinct(), r.where("side = 'F'"), ["scene_id", "id"])


@query(f"""{R} select status, count(*) as n from (select case when b.id is null then 'missing' when a.id is null then 'extra' when a.success is not distinct from b.success then 'same' else 'changed' end as status
from (select * from latest where side = 'F') a full outer join (select * from latest where side = 'O') b on a.scene_id = b.scene_id and a.id = b.id) group by status""")
def integrity_compare(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J6."""
    r = V.latest(spark, sf_dir)
    return J.compare_keyed(r.where("side = 'F'"), r.where("side = 'O'"), ["scene_id", "id"], "success").groupBy("status").agg(F.count(F.lit(1)).alias("n"))


@query("select doc_id from labels where doc_id not in (select doc_id from documents where text is not null)")
def coverage_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Required ids that are not available; should be empty."""
    return J.pending(V.table(spark, sf_dir, "labels").select("doc_id"), V.table(spark, sf_dir, "documents").where("text is not null"), ["doc_id"])


@query("select lang, count(*) filter (where rejected) as removed, count(*) filter (where not rejected) as kept from (select lang, doc_id in (select doc_id from labels where quality = 0) as rejected from documents) group by lang")
def rejected_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Semi and anti join by one set of ids, in one join."""
    d = V.table(spark, sf_dir, "documents").select("doc_id", "lang")
    bad = V.table(spark, sf_dir, "labels").where("quality = 0").select("doc_id").distinct().withColumn("bad", F.lit(True))
    return d.join(bad, "doc_id", "left").groupBy("lang").agg(F.count_if(F.col("bad").isNotNull()).alias("removed"), F.count_if(F.col("bad").isNull()).alias("kept"))


@query("select a.s_suppkey as a, b.s_suppkey as b, a.s_nationkey as island from supplier a join supplier b on a.s_nationkey = b.s_nationkey and a.s_suppkey <> b.s_suppkey where abs(a.s_acctbal - b.s_acctbal) <= 2000")
def region_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ordered pairs of one island within a gate; joined on steps of the gate's width, so far pairs are not made."""
    s = V.table(spark, sf_dir, "supplier")
    step = F.floor(F.col("s_acctbal") / 2000)
    a = s.select(F.col("s_suppkey").alias("a"), F.col("s_nationkey").alias("island"), F.col("s_acctbal").alias("x"), step.alias("step"))
    b = s.select(F.col("s_suppkey").alias("b"), F.col("s_nationkey").alias("island"), F.col("s_acctbal").alias("y"), F.explode(F.array(step - 1, step, step + 1)).alias("step"))
    return a.join(b, ["island", "step"]).where((F.col("a") != F.col("b")) & (F.abs(F.col("x") - F.col("y")) <= 2000)).select("a", "b", "island")


@query("""with r as (select s_nationkey as g, s_suppkey, row_number() over (partition by s_nationkey order by s_suppkey) - 1 as i from supplier),
c as (select c_nationkey as g, c_custkey, row_number() over (partition by c_nationkey order by c_custkey) - 1 as j from customer)
select g as n, s_suppkey, c_custkey from (select *, row_number() over (partition by g order by i + j, i) as k from r join c using (g)) where k <= 5""")
def endpoint_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J10."""
    at = lambda t, g, key, i: V.table(spark, sf_dir, t).select(F.col(g).alias("n"), key, (F.row_number().over(Window.partitionBy(g).orderBy(key)) - 1).alias(i))
    return J.cartesian_heads(at("supplier", "s_nationkey", "s_suppkey", "i"), at("customer", "c_nationkey", "c_custkey", "j"), "n", "i", "j", 5).select("n", "s_suppkey", "c_custkey")


@query(f"""with {V.STEPS_SQL}, t as (select user_id, lag(action) over w as came, action as via, lead(action) over w as goes from steps window w as (partition by user_id order by ts, event_id)),
rel(came, via, goes, relation) as (values (1, 2, 1, 'bend_left'), (1, 3, 1, 'bend_right'), (2, 1, 3, 'zig'), (3, 1, 2, 'zag'))
select relation, count(*) as n, count(distinct user_id) as users from t join rel using (came, via, goes) group by relation""")
def transition_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three consecutive actions looked up in a table of relations."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    t = V.steps(spark, sf_dir).select("user_id", F.lag("action").over(w).alias("came"), F.col("action").alias("via"), F.lead("action").over(w).alias("goes"))
    rel = spark.createDataFrame([(1, 2, 1, "bend_left"), (1, 3, 1, "bend_right"), (2, 1, 3, "zig"), (3, 1, 2, "zag")], "came int, via int, goes int, relation string")
    return t.join(F.broadcast(rel), ["came", "via", "goes"]).groupBy("relation").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("user_id").alias("users"))


@query("""select lo, hi, l_orderkey, price from (select least(l_suppkey, l_partkey) as lo, greatest(l_suppkey, l_partkey) as hi, l_orderkey, l_extendedprice as price,
row_number() over (partition by least(l_suppkey, l_partkey), greatest(l_suppkey, l_partkey) order by l_extendedprice, l_orderkey) as k from lineitem) where k = 1""")
def nearest_connection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J12."""
    li = V.table(spark, sf_dir, "lineitem").select("l_suppkey", "l_partkey", F.col("l_extendedprice").alias("price"), "l_orderkey")
    return J.nearest_of_pair(li, li, "l_suppkey", "l_partkey", "price", "l_orderkey").select("lo", "hi", "l_orderkey", "price")


@query(f"""with {V.POSES_SQL} select a.label, count(*) as pairs, round(min(d), 6) as nearest from (select a.label, sqrt(power(a.x-b.x,2)+power(a.y-b.y,2)+power(a.z-b.z,2)) as d
from poses a join poses b on a.label = b.label and a.vec_id < b.vec_id) a where d <= 0.15 group by a.label""")
def near_poses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J14."""
    p = J.near_pairs(V.poses(spark, sf_dir), "vec_id", ["x", "y", "z"], 0.15, ["label"])
    return p.groupBy("label").agg(F.count(F.lit(1)).alias("pairs"), F.round(F.min("distance"), 6).alias("nearest"))


@query(f"""{EP}, b as (select *, coalesce(sum(n) over (partition by 1 order by blk, episode_id rows between unbounded preceding and 1 preceding), 0) as lo from (select episode_id, n, 0 as blk from episodes))
select count(*) as draws, count(distinct ordinal) as distinct_draws from (select unnest(generate_series(0, (select sum(n)::bigint from episodes) - 1, 7)) as ordinal) d join b on ordinal >= lo and ordinal < lo + n""")
def ordinal_draws(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every seventh of all (episode, start) ordinals, each found in exactly one episode."""
    e = V.episodes(spark, sf_dir).select("episode_id", "n")
    total = e.agg(F.sum("n")).first()[0] or 0
    d = spark.range(0, total, 7).withColumnRenamed("id", "ordinal")
    return J.locate_in_prefix_sums(e, d, "episode_id", "n", "ordinal", 64).agg(F.count(F.lit(1)).alias("draws"), F.countDistinct("ordinal").alias("distinct_draws"))


@query(f"""with {V.POSES_SQL}, d as (select label, vec_id, sqrt(power(x - lag(x) over w, 2) + power(y - lag(y) over w, 2) + power(z - lag(z) over w, 2)) as step from poses window w as (partition by label order by vec_id)),
arcs as (select label, vec_id, coalesce(sum(step) over (partition by label order by vec_id), 0) as arc from d)
select a.label, a.vec_id, (select b.vec_id from arcs b where b.label = a.label and b.arc <= a.arc - 1.5 order by b.arc desc, b.vec_id limit 1) as before from arcs a""")
def asof_before(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J16."""
    p = with_arc(V.poses(spark, sf_dir)).select("label", "vec_id", "arc")
    return J.last_within(p, "label", "arc", 1.5, "vec_id").select("label", "vec_id", "before")


@query(f"""with {V.POSES_SQL}, d as (select label, vec_id, sqrt(power(x - lag(x) over w, 2) + power(y - lag(y) over w, 2) + power(z - lag(z) over w, 2)) as step from poses window w as (partition by label order by vec_id)),
arcs as (select label, vec_id, coalesce(sum(step) over (partition by label order by vec_id), 0) as arc from d)
select a.label, a.vec_id, coalesce((select min(b.vec_id) from arcs b where b.label = a.label and b.arc > a.arc + 1.5), (select max(b.vec_id) from arcs b where b.label = a.label)) as after from arcs a""")
def asof_after(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first state more than a distance ahead, the last one where the path ends before."""
    p = with_arc(V.poses(spark, sf_dir)).select("label", "vec_id", "arc")
    return J.first_beyond(p, "label", "arc", 1.5, "vec_id").select("label", "vec_id", "after")


@query(f"""{EP}, {RUNS_SQL}, pts as (select episode_id, unnest(generate_series(0, n - 1, 3)) as at from episodes)
select p.episode_id, p.at::int as at, r.action from pts p join runs r on p.episode_id = r.episode_id and p.at >= r.s and p.at <= r.e""")
def interval_owner(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J18."""
    e = V.episodes(spark, sf_dir)
    pts = e.select("episode_id", F.explode(F.sequence(F.lit(0), F.size("actions") - 1, F.lit(3))).alias("at"))
    spans = e.select("episode_id", F.inline(A.runs_before_stop(F.col("actions")))).select("episode_id", "action", F.col("start").alias("s"), (F.col("end") + 1).alias("e"))
    return J.owners(pts, spans, "episode_id", "at", "s", "e").select("episode_id", "at", "action")


@query(f"""{EP}, flat as (select episode_id, unnest(vals) as v from episodes) select episode_id, true as found, round(min(abs(v - 50.0)), 9) as gap from flat group by episode_id""")
def nearest_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Least distance of a row's states to a point, with its place."""
    gaps = F.transform("vals", lambda v, i: F.struct(F.abs(v - 50.0).alias("d"), i.alias("i")))
    best = F.array_min(gaps)
    return V.episodes(spark, sf_dir).select("episode_id", best["i"].isNotNull().alias("found"), F.round(best["d"], 9).alias("gap"))


@query("select count(*) filter (where f = 'jpg') as jpg, count(*) filter (where f = 'png') as png, count(*) filter (where f is null) as none from (select case when p1.page_id is not null then 'jpg' when p2.page_id is not null then 'png' end as f from documents d left join pages p1 on p1.page_id = d.doc_id * 2 left join pages p2 on p2.page_id = d.doc_id)")
def fallback_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First path, else the second."""
    d, p = V.table(spark, sf_dir, "documents").select("doc_id"), V.table(spark, sf_dir, "pages").select("page_id")
    first, second = p.select((F.col("page_id") / 2).alias("k1"), F.lit("jpg").alias("f1")), p.select(F.col("page_id").alias("k2"), F.lit("png").alias("f2"))
    j = d.join(first, d.doc_id.cast("double") == first.k1, "left").join(second, d.doc_id == second.k2, "left").select(F.coalesce("f1", "f2").alias("f"))
    return j.agg(F.count_if(F.col("f") == "jpg").alias("jpg"), F.count_if(F.col("f") == "png").alias("png"), F.count_if(F.col("f").isNull()).alias("none"))


_INPUTS = "select l_returnflag as input, l_orderkey as scene, l_linestatus as mode, l_linenumber as sensor from lineitem"


@query(f"""with i as ({_INPUTS}), meta as (select input, list_sort(list(distinct mode)) as modes, list_sort(list(distinct sensor)) as sensors from i group by input), per as (select scene, count(distinct input) as n from i group by scene)
select (select count(distinct (modes, sensors)) from meta) = 1 as same_parameters, max(n) = 1 as disjoint, count(*) filter (where n > 1) as shared_scenes, (select count(*) from meta) as inputs from per""")
def merge_preconditions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Before collections are merged their parameters must be equal as JSON and no scene may be in two of them; inputs are the rows of a return flag."""
    i = V.table(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("input"), F.col("l_orderkey").alias("scene"), F.col("l_linestatus").alias("mode"), F.col("l_linenumber").alias("sensor"))
    meta = i.groupBy("input").agg(F.to_json(F.struct(F.array_sort(F.collect_set("mode")).alias("modes"), F.array_sort(F.collect_set("sensor")).alias("sensors"))).alias("meta"))
    same = meta.agg((F.countDistinct("meta") == 1).alias("same_parameters"), F.count(F.lit(1)).alias("inputs"))
    per = i.groupBy("scene").agg(F.countDistinct("input").alias("n")).agg((F.max("n") == 1).alias("disjoint"), F.count_if(F.col("n") > 1).alias("shared_scenes"))
    return same.join(per, F.lit(True)).select("same_parameters", "disjoint", "shared_scenes", "inputs")


# -- set operations ------------------------------------------------------------------------------------------------------


@query(f"{R} select side, scene_id, id, success, distance, path_length, spl from latest")
def last_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keyed upsert; the last row in order wins."""
    return V.latest(spark, sf_dir).select("side", "scene_id", "id", "success", "distance", "path_length", "spl")


@query("""with u as (select doc_id, text from documents union all select doc_id, text from documents where doc_id % 3 = 0), g as (select doc_id, count(*) as copies, count(distinct text) as versions from u group by doc_id)
select copies, versions, count(*) as n from g group by copies, versions""")
def conflict_checked_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Identical repeats are ignored, a different repeat fails the job."""
    from ..operators.sets import union_without_conflicts

    d = V.table(spark, sf_dir, "documents").select("doc_id", "text")
    merged = union_without_conflicts(d, d.where("doc_id % 3 = 0"), "doc_id", ["text"])
    return merged.select(F.col("copies"), F.lit(1).cast("long").alias("versions")).groupBy("copies", "versions").agg(F.count(F.lit(1)).alias("n"))


@query("""select source, a.n + coalesce(b.n, 0) as n, coalesce(b.n, 0) = c.n as reconciled from (select source, count(*) as n from documents where lang = 'en' group by source) a
left join (select source, count(*) as n from documents where lang <> 'en' group by source) b using (source) join (select source, count(*) filter (where lang <> 'en') as n from documents group by source) c using (source)""")
def reconciled_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Disjoint parts united, counts by scene compared with the whole."""
    d = V.table(spark, sf_dir, "documents").select("doc_id", "source", "lang")
    parts = d.where("lang = 'en'").withColumn("part", F.lit(1)).unionByName(d.where("lang <> 'en'").withColumn("part", F.lit(2)))
    counted = parts.groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("part") == 2).alias("second"), F.count_if(F.col("part") == 1).alias("first"))
    whole = d.groupBy("source").agg(F.count_if(F.col("lang") != "en").alias("w"))
    return counted.where("first > 0").join(whole, "source").select("source", "n", (F.col("second") == F.col("w")).alias("reconciled"))


@query("""select 'both' as part, count(*) as n from (select doc_id from documents intersect select doc_id from labels) union all select 'documents', count(*) from (select doc_id from documents except select doc_id from labels)
union all select 'labels', count(*) from (select doc_id from labels except select doc_id from documents)""")
def key_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """U4: intersection and both differences in one pass over the keys."""
    d, lab = V.table(spark, sf_dir, "documents").select("doc_id").distinct(), V.table(spark, sf_dir, "labels").select("doc_id").distinct()
    both = d.withColumn("a", F.lit(1)).join(lab.withColumn("b", F.lit(1)), "doc_id", "full_outer")
    c = both.agg(F.count_if(F.col("a").isNotNull() & F.col("b").isNotNull()).alias("both"), F.count_if(F.col("b").isNull()).alias("documents"), F.count_if(F.col("a").isNull()).alias("labels"))
    return c.select(F.inline(F.array(*(F.struct(F.lit(k).alias("part"), F.col(k).alias("n")) for k in ("both", "documents", "labels")))))


@query("""select name, coalesce(b.n, a.n) as n from (select source as name, count(*) as n from documents where lang = 'en' group by source) a full outer join (select source as name, count(*) as n from documents where lang = 'de' group by source) b using (name)""")
def merged_summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries of the newer summary win."""
    d = V.table(spark, sf_dir, "documents")
    old, new = (d.where(F.col("lang") == k).groupBy(F.col("source").alias("name")).agg(F.count(F.lit(1)).alias(c)) for k, c in (("en", "o"), ("de", "w")))
    return old.join(new, "name", "full_outer").select("name", F.coalesce("w", "o").alias("n"))

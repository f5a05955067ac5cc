"""Queries of aggregates (A), sorting and sampling (T), text (F) and math (M) operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import actions as A
from ..functions import geometry as G
from ..functions import hashing as H
from ..functions import statistics as S
from ..functions import text as X
from ..operators import reports as R_
from . import views as V
from .registry import query
from .sequences import EP, RUNS_SQL

R = f"with {V.RESULTS_SQL}"
_T = V.table


# -- aggregates ----------------------------------------------------------------------------------------------------------


@query(f"{R} select side, round(coalesce(avg(success), 0), 9) as success, round(coalesce(avg(spl), 0), 9) as spl, round(coalesce(avg(distance), 0), 4) as distance, sum(success)::bigint as successes from latest group by side")
def result_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A1, A2."""
    r = V.latest(spark, sf_dir).groupBy("side")
    return r.agg(*(F.round(S.safe_mean(F.col(c)), d).alias(c) for c, d in (("success", 9), ("spl", 9), ("distance", 4))), F.sum("success").alias("successes"))


@query(f"{EP} select n::varchar as key, count(*) as n_episodes from episodes group by n")
def length_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A3."""
    return V.episodes(spark, sf_dir).groupBy("n").agg(F.count(F.lit(1)).alias("n_episodes")).select(F.col("n").cast("string").alias("key"), "n_episodes")


@query("""with l as (select lang, n_chars, row_number() over (partition by lang order by n_chars) - 1 as i, count(*) over (partition by lang) as n from documents)
select lang, max(case when i = round_even((n - 1) * 0.5, 0) then n_chars end) as p50, max(case when i = round_even((n - 1) * 0.9, 0) then n_chars end) as p90,
  max(case when i = floor((n - 1) * 0.95) then n_chars end) as p95_floor from l group by lang""")
def ranked_quantiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A4, A5."""
    d = _T(spark, sf_dir, "documents")
    a = S.ranked_quantiles(d, "n_chars", {"p50": 0.5, "p90": 0.9}, "nearest", ["lang"])
    return a.join(S.ranked_quantiles(d, "n_chars", {"p95_floor": 0.95}, "floor", ["lang"]), "lang")


@query("select source, round(quantile_cont(n_chars, 0.5), 6) as p50, round(quantile_cont(n_chars, 0.95), 6) as p95, min(n_chars) as low, round(avg(n_chars), 6) as mean, max(n_chars) as high from documents group by source")
def linear_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A6."""
    return _T(spark, sf_dir, "documents").groupBy("source").agg(
        F.round(F.percentile("n_chars", F.lit(0.5)), 6).alias("p50"), F.round(F.percentile("n_chars", F.lit(0.95)), 6).alias("p95"),
        F.min("n_chars").alias("low"), F.round(F.avg("n_chars"), 6).alias("mean"), F.max("n_chars").alias("high"),
    )


@query("select l_returnflag as flag, round(coalesce(corr(l_quantity, l_extendedprice), 0), 9) as r, 0.0::double as r_constant from lineitem group by l_returnflag")
def correlation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A7."""
    li = _T(spark, sf_dir, "lineitem").withColumn("one", F.lit(1.0)).groupBy(F.col("l_returnflag").alias("flag"))
    return li.agg(F.round(S.pearson(F.col("l_quantity"), F.col("l_extendedprice")), 9).alias("r"), S.pearson(F.col("one"), F.col("l_quantity")).alias("r_constant"))


TOKENS_SQL = "toks as (select doc_id, lang, unnest(regexp_extract_all(lower(text), '[a-z]+(?:''[a-z]+)?')) as token from documents)"


def _tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _T(spark, sf_dir, "documents").select("doc_id", "lang", F.explode(X.tokens(F.col("text"))).alias("token"))


@query(f"""with {TOKENS_SQL}, c as (select lang, token, count(*)::double as c from toks group by lang, token)
select lang, round(log2(sum(c)) - sum(c * log2(c)) / sum(c), 6) as entropy, count(*) as vocabulary, count(*) filter (where c = 1) as hapax from c group by lang""")
def token_entropy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A8."""
    c = _tokens(spark, sf_dir).groupBy("lang", "token").agg(F.count(F.lit(1)).alias("c"))
    return S.entropy(c, "c", ["lang"]).withColumn("entropy", F.round("entropy", 6))


@query(f"""with o as (select doc_id, regexp_extract_all(lower(text), '[a-z]+(?:''[a-z]+)?') as w, {H.sql_number("'5'", "doc_id::varchar")} as h from documents),
o2 as (select *, coalesce(sum(len(w)) over (order by h, doc_id rows between unbounded preceding and 1 preceding), 0) as off from o),
f as (select off + generate_subscripts(w, 1) as pos, unnest(w) as token from o2), b as (select * from f where pos <= 20000),
g as (select token, lead(token) over (order by pos) as nxt, lead(token, 2) over (order by pos) as nxt2 from b)
select round(count(distinct (token, nxt)) filter (where nxt is not null)::double / count(*) filter (where nxt is not null), 9) as distinct_2, round(count(distinct (token, nxt, nxt2)) filter (where nxt2 is not null)::double / count(*) filter (where nxt2 is not null), 9) as distinct_3 from g""")
def distinct_ngrams(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct 2- and 3-grams in the first 20,000 tokens of the texts in hash order; n-grams cross text borders.

    Offsets come from token counts only; texts beyond the budget are left before their tokens are looked at, so the last
    window is over a number of rows that the budget bounds.
    """
    budget = 20_000
    d = _T(spark, sf_dir, "documents").select("doc_id", X.tokens(F.col("text")).alias("w"))
    s = d.select("doc_id", F.size("w").alias("size"), H.stable_number("5", F.col("doc_id")).alias("h"))
    # Texts before the budget is used up: hashes are cut into 256 ranges, whose totals are few rows.
    part = s.withColumn("b", F.floor(F.col("h").cast("double") / 2.0**56).cast("int"))
    before = part.groupBy("b").agg(F.sum("size").alias("t")).withColumn("shift", F.coalesce(F.sum("t").over(Window.orderBy("b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    w = Window.partitionBy("b").orderBy("h", "doc_id").rowsBetween(Window.unboundedPreceding, -1)
    off = part.withColumn("inner", F.coalesce(F.sum("size").over(w), F.lit(0))).join(F.broadcast(before.select("b", "shift")), "b").withColumn("off", F.col("inner") + F.col("shift"))
    used = d.join(off.where(F.col("off") < budget).select("doc_id", "off"), "doc_id")
    flat = used.select("off", F.posexplode("w").alias("i", "token")).withColumn("pos", F.col("off") + F.col("i")).where(F.col("pos") < budget)
    o = Window.orderBy("pos")  # at most ``budget`` rows
    g = flat.select("token", F.lead("token").over(o).alias("n1"), F.lead("token", 2).over(o).alias("n2"))
    two, three = F.when(F.col("n1").isNotNull(), F.struct("token", "n1")), F.when(F.col("n2").isNotNull(), F.struct("token", "n1", "n2"))
    return g.agg(F.round(F.countDistinct(two) / F.count("n1"), 9).alias("distinct_2"), F.round(F.countDistinct(three) / F.count("n2"), 9).alias("distinct_3"))


@query("""with n as (select source, array_to_string(regexp_extract_all(lower(text), '[a-z]+(?:''[a-z]+)?'), ' ') as t from documents)
select source, count(distinct t) as distinct_texts, round(count(distinct t)::double / count(*), 9) as rate from n group by source""")
def unique_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A10."""
    n = _T(spark, sf_dir, "documents").select("source", F.sha2(X.normalize(F.col("text")).cast("binary"), 256).alias("t"), F.lit(1).alias("one"))
    return n.groupBy("source").agg(F.countDistinct("t").alias("distinct_texts"), F.round(F.countDistinct("t") / F.count("one"), 9).alias("rate"))


@query("""with n as (select array_to_string(regexp_extract_all(lower(text), '[a-z]+(?:''[a-z]+)?')[1:3], ' ') as prefix from documents) select prefix, count(*) as n from n group by prefix order by n desc, prefix limit 12""")
def top_prefixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A11."""
    p = _T(spark, sf_dir, "documents").select(F.array_join(F.slice(X.tokens(F.col("text")), F.lit(1), F.lit(3)), " ").alias("prefix"))
    return p.groupBy("prefix").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "prefix").limit(12)


_PHRASE_SQL = " union all ".join(f"select '{k}' as phrase, round(100 * avg(regexp_matches(lower(text), '{v}')::int), 6) as pct from documents" for k, v in {**X.PHRASES, "landmark": X.LANDMARK, "room": X.ROOM, "stop": X.STOP}.items())


@query(_PHRASE_SQL)
def phrase_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One pass, then unpivoted.  A pattern is only tried on texts that hold the letters it needs."""
    low = F.lower("text")
    every = {**X.PHRASES, "landmark": X.LANDMARK, "room": X.ROOM, "stop": X.STOP}
    needs = {"starts_turn_left_or_right": "turn", "turn_left_and_walk": "turn", "turn_right_and_walk": "turn", "walk_forward": "walk", "continue_straight": "continue", "proceed_forward": "proceed", "pass_or_past": "pas", "stop_near_the": "near the", "turn_around": "turn", "numeric_degrees": "degree"}
    found = lambda v: F.rlike("low", F.lit(X.plain(v)))
    hit = lambda k, v: found(v) if k not in needs else F.contains("low", F.lit(needs[k])) & found(v)
    d = _T(spark, sf_dir, "documents").select(low.alias("low"))
    r = d.agg(*(F.round(F.avg(hit(k, v).cast("int")) * 100, 6).alias(k) for k, v in every.items()))
    return r.select(F.inline(F.array(*(F.struct(F.lit(k).alias("phrase"), F.col(k).alias("pct")) for k in every))))


@query(f"{EP} select user_id, round(sum(n)::double / greatest(1, sum(len(list_filter(actions, lambda a: a = 1)))), 9) as ratio from episodes group by user_id")
def ratio_of_sums(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A13."""
    forward = F.sum(F.size(F.filter("actions", lambda a: a == 1)))
    return V.episodes(spark, sf_dir).groupBy("user_id").agg(F.round(F.sum("n") / F.greatest(F.lit(1), forward), 9).alias("ratio"))


@query(f"""{EP} select episode_id, coalesce(list_max(list_filter(vals, lambda v: v > 150)), '-infinity'::double) as high, coalesce(list_min(list_filter(vals, lambda v: v > 150)), 'infinity'::double) as low from episodes""")
def event_extremes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Extremes of a row's events; infinite where there are none."""
    v = F.filter("vals", lambda x: x > 150)
    return V.episodes(spark, sf_dir).select("episode_id", F.coalesce(F.array_max(v), F.lit(float("-inf"))).alias("high"), F.coalesce(F.array_min(v), F.lit(float("inf"))).alias("low"))


@query("select o_custkey, o_orderkey, o_totalprice from (select *, row_number() over (partition by o_custkey order by o_orderpriority, o_totalprice desc, o_orderkey) as k from orders) where k = 1")
def representatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lexicographic best of each family, by a map-side minimum."""
    best = F.min_by(F.struct("o_orderkey", "o_totalprice"), F.struct("o_orderpriority", -F.col("o_totalprice"), "o_orderkey")).alias("b")
    return _T(spark, sf_dir, "orders").groupBy("o_custkey").agg(best).select("o_custkey", "b.o_orderkey", "b.o_totalprice")


@query("""with f as (select l_orderkey, l_discount * 4 as dark, l_tax * 8 as top, l_quantity / 50.0 as border from lineitem),
a as (select l_orderkey, avg(dark) as ad, max(dark) as md, avg(top) as av, max(top) as mt, max(border) as mb, avg((dark >= 0.2 or top >= 0.45 or border >= 0.8)::int) as dirty, avg((dark >= 0.3 or top >= 0.7 or border >= 0.9)::int) as severe from f group by l_orderkey)
select l_orderkey, round(dirty, 6) as dirty, round(severe, 6) as severe, (dirty >= 0.3 and (ad >= 0.12 or av >= 0.25 or mb >= 0.8)) or severe >= 0.2 as remove,
 concat_ws(',', case when dirty >= 0.3 then 'dirty' end, case when severe >= 0.2 then 'severe' end, case when md >= 0.3 then 'max_dark' end, case when mt >= 0.7 then 'max_top' end, case when mb >= 0.8 then 'max_border' end) as reasons from a""")
def frame_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Episode scores from frame statistics, with the reasons and the verdict."""
    f = V.placed(spark, sf_dir, "lineitem").select("at", "l_orderkey", (F.col("l_discount") * 4).alias("dark"), (F.col("l_tax") * 8).alias("top"), (F.col("l_quantity") / 50.0).alias("border"))
    bad = lambda d, t, b: F.avg(((F.col("dark") >= d) | (F.col("top") >= t) | (F.col("border") >= b)).cast("int"))
    a = f.groupBy("l_orderkey").agg(
        S.ordered_means(F.col("at"), ad=F.col("dark"), at=F.col("top")).alias("m"), F.max("dark").alias("md"), F.max("top").alias("mt"), F.max("border").alias("mb"), bad(0.2, 0.45, 0.8).alias("dirty"), bad(0.3, 0.7, 0.9).alias("severe")
    ).select("*", "m.*")
    remove = ((F.col("dirty") >= 0.3) & ((F.col("ad") >= 0.12) | (F.col("at") >= 0.25) | (F.col("mb") >= 0.8))) | (F.col("severe") >= 0.2)
    why = (("dirty", 0.3, "dirty"), ("severe", 0.2, "severe"), ("md", 0.3, "max_dark"), ("mt", 0.7, "max_top"), ("mb", 0.8, "max_border"))
    return a.select("l_orderkey", F.round("dirty", 6).alias("dirty"), F.round("severe", 6).alias("severe"), remove.alias("remove"), F.concat_ws(",", *(F.when(F.col(c) >= v, n) for c, v, n in why)).alias("reasons"))


# Scenes of a collection: a supplier's lines of one number.  Regions are parts, connections orders, junctions parts sold twice; five lines that were not returned are a trajectory.
_LINES_SQL = "lines as (select l_suppkey * 10 + l_linenumber as scene, * from lineitem)"
_SCENES_SQL = f"""{_LINES_SQL}, counts as (select scene, l_partkey, count(*) as k from lines group by 1, 2),
parts as (select scene, count(*) as regions, count(*) filter (where k >= 2) as junctions from counts group by scene),
scenes as (select scene, any_value(regions) as regions, count(distinct l_orderkey) as connections, any_value(junctions) as junctions, count(*) filter (where l_quantity > 48) as relations,
  count(distinct case when l_quantity > 40 and l_tax < 0.02 then l_partkey end) as route_groups, count(*) filter (where l_quantity > 30 and l_tax < 0.01) as verified, count(*) filter (where l_quantity > 25 and l_discount < 0.01) as eligible,
  count(*) filter (where l_returnflag <> 'R') // 5 as trajectories from lines join parts using (scene) group by scene)"""
_LADDER = (("junctions = 0", "no_region_graph_junction"), ("relations = 0", "junctions_fail_decision_geometry_or_visibility"), ("route_groups = 0", "valid_relations_not_used_by_natural_shortest_paths"), ("verified = 0", "natural_routes_fail_primitive_replay_verification"), ("eligible = 0", "replayed_routes_fail_quality_gates"), ("trajectories < 10", "valid_but_structurally_sparse"))


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _T(spark, sf_dir, "lineitem").withColumn("scene", F.col("l_suppkey") * 10 + F.col("l_linenumber"))


def _scenes(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = _lines(spark, sf_dir)
    parts = li.groupBy("scene", "l_partkey").agg(F.count(F.lit(1)).alias("k")).groupBy("scene").agg(F.count(F.lit(1)).alias("regions"), F.count_if(F.col("k") >= 2).alias("junctions"))
    q, t = F.col("l_quantity"), F.col("l_tax")
    rows = li.groupBy("scene").agg(
        F.countDistinct("l_orderkey").alias("connections"), F.count_if(q > 48).alias("relations"), F.countDistinct(F.when((q > 40) & (t < 0.02), F.col("l_partkey"))).alias("route_groups"),
        F.count_if((q > 30) & (t < 0.01)).alias("verified"), F.count_if((q > 25) & (F.col("l_discount") < 0.01)).alias("eligible"), F.floor(F.count_if(F.col("l_returnflag") != "R") / 5).alias("trajectories"),
    )
    return parts.join(rows, "scene")


@query(f"with {_SCENES_SQL} select scene, case {' '.join(f'when {c} then {chr(39)}{n}{chr(39)}' for c, n in _LADDER)} else 'healthy' end as outcome, round(trajectories / greatest(1, route_groups)::double, 9) as retention from scenes")
def diagnosis(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first rung of the ladder that a scene's counters do not pass; A17: the share of its route groups that are kept."""
    s = _scenes(spark, sf_dir)
    return s.select("scene", R_.outcome().alias("outcome"), F.round(R_.retention("trajectories", "route_groups"), 9).alias("retention"))


@query(f"""with {_SCENES_SQL}, judged as (select *, case {' '.join(f'when {c} then {chr(39)}{n}{chr(39)}' for c, n in _LADDER)} else 'healthy' end as outcome from scenes),
eps as (select scene, l_linenumber as decisions, l_extendedprice as length from lines where l_returnflag <> 'R'),
ranked as (select trajectories, row_number() over (order by trajectories) - 1 as i, count(*) over () as n from scenes)
select 'total' as part, unnest(['scenes', 'regions', 'connections', 'route_groups', 'episodes']) as key, unnest([count(*), sum(regions), sum(connections), sum(route_groups), (select count(*) from eps)])::double as value from scenes
union all select 'decisions', decisions::varchar, count(*) from eps group by decisions union all select 'outcome', outcome, count(*) from judged group by outcome
union all select 'length', unnest(['minimum', 'median', 'p90', 'maximum', 'mean']), round(unnest([min(length), quantile_cont(length, 0.5), quantile_cont(length, 0.9), max(length), avg(length)]), 6) from eps
union all select 'per_scene', unnest(['minimum', 'maximum', 'mean']), round(unnest([min(trajectories), max(trajectories), (select count(*) from eps) / greatest(1, count(*))]), 6) from scenes
union all select 'per_scene', k, max(trajectories) filter (where i = floor((n - 1) * f)) from ranked, (values ('p10', 0.1), ('p25', 0.25), ('median', 0.5), ('p75', 0.75), ('p90', 0.9)) v(k, f) group by k
union all select 'unreconciled', 'scenes', (select count(*) from (select scene, count(*) as n from eps group by scene) e full join scenes s using (scene) where coalesce(e.n, 0) // 5 <> coalesce(s.trajectories, 0))""")
def shard_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One report (part, key, value) of all scenes: totals, histograms, outcomes, lengths, trajectories by scene, and scenes whose counts disagree."""
    e = _lines(spark, sf_dir).where("l_returnflag <> 'R'").select("scene", F.col("l_linenumber").alias("decisions"), F.col("l_extendedprice").alias("length"))
    return R_.collection_report(_scenes(spark, sf_dir), e, 5)


@query(f"""{EP}, two as (select user_id, max(actions) filter (where k = 0) as p, max(actions) filter (where k = 1) as t from episodes group by user_id),
f as (select p[i] as p, t[i] as t from (select unnest(generate_series(1, least(len(p), len(t)))) as i, p, t from two where p is not null and t is not null)),
c as (select a.a, count(*) filter (where p = a and t = a) as tp, count(*) filter (where p = a and t <> a) as fp, count(*) filter (where p <> a and t = a) as fn from f cross join (values (0), (1), (2), (3)) a(a) group by a.a)
select a as action, tp, fp, fn, round(case when tp + fp > 0 then tp::double / (tp + fp) else 0 end, 9) as precision, round(case when tp + fn > 0 then tp::double / (tp + fn) else 0 end, 9) as recall,
  round(case when 2 * tp + fp + fn > 0 then 2.0 * tp / (2 * tp + fp + fn) else 0 end, 9) as f1 from c""")
def action_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predicted and true actions of a user's first two episodes, place by place; counts by action in one pass."""
    two = V.episodes(spark, sf_dir).where("k < 2").groupBy("user_id").agg(F.max(F.when(F.col("k") == 0, F.col("actions"))).alias("p"), F.max(F.when(F.col("k") == 1, F.col("actions"))).alias("t")).where("p is not null and t is not null")
    n = F.least(F.size("p"), F.size("t"))
    f = two.select(F.inline(F.arrays_zip(F.slice("p", F.lit(1), n), F.slice("t", F.lit(1), n)))).toDF("p", "t")
    pairs = f.groupBy("p", "t").agg(F.count(F.lit(1)).alias("n"))
    both = pairs.select(F.explode(F.array_distinct(F.array("p", "t"))).alias("action"), "p", "t", "n")
    known = spark.range(4).select(F.col("id").cast("int").alias("action"))
    hit, wrong, lost = (F.coalesce(F.sum(F.when(c, F.col("n"))), F.lit(0)) for c in ((F.col("p") == F.col("t")), (F.col("p") == F.col("action")) & (F.col("t") != F.col("action")), (F.col("t") == F.col("action")) & (F.col("p") != F.col("action"))))
    c = known.join(both, "action", "left").groupBy("action").agg(hit.alias("tp"), wrong.alias("fp"), lost.alias("fn"))
    share = lambda a, b: F.round(F.when(b > 0, a / b).otherwise(0.0), 9)
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return c.select("action", "tp", "fp", "fn", share(tp, tp + fp).alias("precision"), share(tp, tp + fn).alias("recall"), share(2 * tp, 2 * tp + fp + fn).alias("f1"))


@query(None)
def paired_bootstrap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hashed Poisson bootstrap; the draws have no SQL twin, tests hold the interval against theory."""
    r = V.latest(spark, sf_dir)
    a = r.where("side = 'F'").select("scene_id", "id", F.col("spl").alias("a"))
    b = r.where("side = 'O'").select("scene_id", "id", F.col("spl").alias("b"))
    p = a.join(b, ["scene_id", "id"]).withColumn("difference", F.col("b") - F.col("a"))
    return S.paired_bootstrap(p, ["scene_id", "id"], "difference", 100)


@query(f"""with {V.POSES_SQL}, d as (select label, vec_id, sqrt(power(x - lag(x) over w, 2) + power(y - lag(y) over w, 2) + power(z - lag(z) over w, 2)) as step, sqrt(x*x + y*y + z*z) as goal from poses window w as (partition by label order by vec_id))
select label, round(sum(step), 5) as path_length, round(min(goal), 6) as closest, bool_or(goal <= 0.1) as oracle_success, count(*) as steps, round(max_by(goal, vec_id), 6) as final_distance,
  round(max_by(goal, vec_id) / greatest(sum(step), max_by(goal, vec_id)), 6) as spl_like from d group by label""")
def path_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Measures of a path against the origin as its goal."""
    w = Window.partitionBy("label").orderBy("vec_id")
    step = F.sqrt(sum(((F.col(c) - F.lag(c).over(w)) ** 2 for c in "yz"), (F.col("x") - F.lag("x").over(w)) ** 2))
    d = V.poses(spark, sf_dir).select("label", "vec_id", step.alias("step"), F.sqrt(F.col("x") ** 2 + F.col("y") ** 2 + F.col("z") ** 2).alias("goal"))
    last = F.max_by("goal", "vec_id")
    return d.groupBy("label").agg(
        F.round(F.sum("step"), 5).alias("path_length"), F.round(F.min("goal"), 6).alias("closest"), F.bool_or(F.col("goal") <= 0.1).alias("oracle_success"), F.count(F.lit(1)).alias("steps"),
        F.round(last, 6).alias("final_distance"), F.round(last / F.greatest(F.sum("step"), last), 6).alias("spl_like"),
    )


@query("select l_suppkey, round(sum(l_quantity * l_extendedprice) / sum(l_quantity), 4) as centroid, sum(l_quantity) as area, max(l_discount) as clearance from lineitem group by l_suppkey")
def weighted_centroid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A23."""
    return _T(spark, sf_dir, "lineitem").groupBy("l_suppkey").agg(
        F.round(F.sum(F.col("l_quantity") * F.col("l_extendedprice")) / F.sum("l_quantity"), 4).alias("centroid"), F.sum("l_quantity").alias("area"), F.max("l_discount").alias("clearance")
    )


@query("select least(l_suppkey, l_partkey) as lo, greatest(l_suppkey, l_partkey) as hi, max(least(l_quantity, l_linenumber * 10.0)) as saddle from lineitem group by 1, 2")
def bottleneck(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Greatest over a pair's links of the lesser end."""
    return _T(spark, sf_dir, "lineitem").groupBy(F.least("l_suppkey", "l_partkey").alias("lo"), F.greatest("l_suppkey", "l_partkey").alias("hi")).agg(
        F.max(F.least(F.col("l_quantity"), F.col("l_linenumber") * 10.0)).alias("saddle")
    )


@query("""with r as (select l_suppkey, l_quantity as x, l_extendedprice / l_quantity as r from lineitem where l_quantity > 0), t as (select *, sum(x) over (partition by l_suppkey order by r, x) as run, sum(x) over (partition by l_suppkey) as total from r)
select l_suppkey, round(min(r) filter (where run >= total / 2), 6) as ratio from t group by l_suppkey""")
def weighted_median(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A27."""
    return S.weighted_median_ratio(_T(spark, sf_dir, "lineitem"), "l_quantity", "l_extendedprice", ["l_suppkey"]).select("l_suppkey", F.round("ratio", 6).alias("ratio"))


@query(f"{EP} select episode_id, greatest(1, n - (actions[n] = 0)::int)::bigint as reference_length from episodes")
def reference_length(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A28."""
    return V.episodes(spark, sf_dir).select("episode_id", F.greatest(F.lit(1), F.col("n") - (F.element_at("actions", -1) == 0).cast("int")).cast("long").alias("reference_length"))


# -- sorting and sampling ------------------------------------------------------------------------------------------------


@query("select doc_id, source, n_chars from documents order by source desc, n_chars desc, doc_id limit 30")
def worst_examples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Top 30 by several keys; a bounded report."""
    return _T(spark, sf_dir, "documents").select("doc_id", "source", "n_chars").orderBy(F.desc("source"), F.desc("n_chars"), "doc_id").limit(30)


@query("select distinct key, try_cast(key as bigint) is null as is_text, try_cast(key as bigint) as number from (select case when doc_id % 4 = 0 then source else doc_id::varchar end as key from documents)")
def id_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers first, by value, then other ids as text; the keys of the order are returned with the rows."""
    k = F.when(F.col("doc_id") % 4 == 0, F.col("source")).otherwise(F.col("doc_id").cast("string"))
    n = F.expr("try_cast(key as bigint)")
    d = _T(spark, sf_dir, "documents").select(k.alias("key")).distinct().select("key", n.isNull().alias("is_text"), n.alias("number"))
    return d.orderBy("is_text", "number", "key")


@query(f"""select doc_id, ({H.sql_number("'42'", "source", "doc_id::varchar")} % 13)::int as choice, {H.sql_number("'42'", "'keep'", "doc_id::varchar")}::double / 18446744073709551616.0 < 0.25 as keep, sha1(concat_ws(chr(31), source, doc_id::varchar)) as content_id from documents""")
def stable_choices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T4, T5."""
    i = F.col("doc_id")
    return _T(spark, sf_dir, "documents").select("doc_id", H.stable_index(13, "42", F.col("source"), i).alias("choice"), H.stable_keep(0.25, "42", "keep", i).alias("keep"), F.sha1(F.concat_ws("\x1f", "source", i.cast("string")).cast("binary")).alias("content_id"))


@query("select doc_id, source, n_chars from (select *, row_number() over (partition by source order by n_chars desc, doc_id) as rn from documents) order by rn, source limit 64")
def diverse_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Round robin over scenes, the richest first; a limit-pushed rank keeps only a few rows of a scene."""
    w = Window.partitionBy("source").orderBy(F.desc("n_chars"), "doc_id")
    d = _T(spark, sf_dir, "documents").select("doc_id", "source", "n_chars", F.row_number().over(w).alias("rn")).where("rn <= 64")
    return d.orderBy("rn", "source").limit(64).select("doc_id", "source", "n_chars")


def _md5_mod(text: str, n: int) -> str:
    """SQL: the MD5 of a text, as a number, modulo n, from its four 32-bit parts."""
    out = "0"
    for k in range(4):
        out = f"((({out})::bigint * 4294967296 + ('0x' || substr(md5({text}), {8 * k + 1}, 8))::bigint) % {n})"
    return out


@query(f"""with recursive r as (select doc_id, source, row_number() over (order by doc_id) as i, row_number() over (partition by source order by doc_id) - 1 as seen, {_md5_mod('source', 7)} as off from documents),
picks(i, doc_id, subset, counts) as (select 0, null::bigint, null::bigint, [0, 0, 0, 0, 0, 0, 0]
 union all select r.i, r.doc_id, s, list_transform(counts, lambda c, k: c + (k - 1 = s)::int) from picks p join r on r.i = p.i + 1, lateral (select list_filter(list_transform(generate_series(0, 6), lambda t: (off + seen + t) % 7), lambda k: counts[k + 1] < 15)[1] as s) where r.i <= 105)
select doc_id, subset::int as subset from picks where doc_id is not null""")
def subset_assignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Seven subsets of fifteen rows, filled in order; a row goes to the first subset with room from its scene's hashed offset on."""
    from ..operators.selection import fill_subsets

    return fill_subsets(_T(spark, sf_dir, "documents"), "doc_id", "source", 7, 15)


@query(f"""with s as (select source, {_md5_mod('source', 10)} as off from (select distinct source from documents)),
r as (select doc_id, source, row_number() over (partition by source order by doc_id) - 1 as seen from documents) select doc_id, ((off + seen) % 10)::int as subset from r join s using (source)""")
def subset_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T8 without a capacity, over all rows: the hashed offset of the scene plus the number of its rows before, modulo N."""
    from ..operators.selection import scene_offset

    w = Window.partitionBy("source").orderBy("doc_id")
    d = _T(spark, sf_dir, "documents").select("doc_id", "source", (F.row_number().over(w) - 1).alias("seen"))
    return d.select("doc_id", F.pmod(scene_offset(F.col("source"), 10) + F.col("seen"), F.lit(10)).cast("int").alias("subset"))


@query("select doc_id, ((row_number() over (order by doc_id) - 1 - 100) % 4)::int as shard from documents qualify row_number() over (order by doc_id) between 101 and 500")
def slice_and_shard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """[100:][:400][rank::4] of the rows in order of id.  The head is cut first, so the numbering sees 500 rows only."""
    head = _T(spark, sf_dir, "documents").select("doc_id").orderBy("doc_id").limit(500)
    n = head.withColumn("n", F.row_number().over(Window.orderBy("doc_id"))).where("n > 100")
    return n.select("doc_id", F.pmod(F.col("n") - 101, F.lit(4)).cast("int").alias("shard"))


@query("select doc_id from (select doc_id, sha256(doc_id::varchar) as h from documents order by h, doc_id limit 50)")
def shuffled_head(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T13."""
    return _T(spark, sf_dir, "documents").select("doc_id", F.sha2(F.col("doc_id").cast("string"), 256).alias("h")).orderBy("h", "doc_id").limit(50).select("doc_id")


@query(f"""with {V.POSES_SQL}, q as (select label, vec_id, sqrt(x*x+y*y+z*z) as d, row_number() over (partition by label, floor(x / 0.1), floor(y / 0.1), floor(z / 0.1) order by vec_id) as nth from poses)
select label, vec_id from (select *, row_number() over (partition by label order by abs(d - 0.2), vec_id) as rn from q where nth = 1 and d between 0.05 and 0.5) where rn <= 14""")
def shortlist(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One candidate a cell, within a distance gate, the fourteen nearest to the wanted distance."""
    d = F.sqrt(F.col("x") ** 2 + F.col("y") ** 2 + F.col("z") ** 2)
    one = V.poses(spark, sf_dir).groupBy("label", *(F.floor(F.col(c) / 0.1) for c in "xyz")).agg(F.min_by(F.struct("vec_id", d.alias("d")), "vec_id").alias("p")).select("label", "p.*")
    w = Window.partitionBy("label").orderBy(F.abs(F.col("d") - 0.2), "vec_id")
    return one.where("d between 0.05 and 0.5").withColumn("rn", F.row_number().over(w)).where("rn <= 14").select("label", "vec_id")


# -- text ----------------------------------------------------------------------------------------------------------------


# A text's source is the text of the document before it where the number can be divided by 50, and its first run of actions follows from the number; most texts
# have words put before them, so that each flag has rows with and without it.
_LEADS = ("", "Turn around. ", "Please turn right now. ", "Walk forward. Walk forward. Walk forward. ", "Go 90 degrees to. ", "Turn left as the image shows. ")
_AUDIT_SQL = f"""s as (select doc_id, ([{', '.join(f"'{x}'" for x in _LEADS)}])[doc_id % 6 + 1] || case when doc_id % 7 = 0 then '' when doc_id % 7 = 1 then 'Stop there.' else text end as text, doc_id % 3 + 1 as action, doc_id % 11 + 1 as size, doc_id % 4 = 0 as no_run,
  case when doc_id % 50 = 0 then null else '-' end as old from documents),
t as (select *, regexp_extract_all(lower(text), '[a-z]+(?:''[a-z]+)?') as w, array_to_string(regexp_extract_all(lower(text), '[a-z]+(?:''[a-z]+)?'), ' ') as low, split_part(regexp_replace(lower(text), '[.!?]+', chr(1), 'g'), chr(1), 1) as first from s)"""


@query(f"""with {_AUDIT_SQL} select doc_id, concat_ws(',', case when regexp_matches(text, '{X.DANGLING}') then 'dangling_connector' end,
  case when regexp_matches(text, '{X.ARTIFACT}') then 'data_artifact' end, case when old is null or low = '' then 'identical_to_source' end, case when not regexp_matches(text, '{X.STOP}') then 'missing_explicit_stop' end,
  case when regexp_matches(text, '(?i){X.PHRASES["numeric_degrees"]}') then 'numeric_turn_angle' end,
  case when not no_run and size * 15 >= 30 and (action = 2 and regexp_matches(first, '\\bturn\\s+right\\b') or action = 3 and regexp_matches(first, '\\bturn\\s+left\\b')) then 'opposite_initial_turn' end,
  case when len(regexp_extract_all(low, '\\bwalk forward\\b')) >= 3 then 'repeated_walk_forward' end, case when len(w) > 120 then 'too_long' end, case when len(w) < 12 then 'too_short' end,
  case when not no_run and regexp_matches(first, '^(?:please\\s+)?(?:turn around|turn back|make a u-turn)\\b') and (action = 1 or size * 15 < 120) then 'unsupported_initial_turn_around' end,
  case when regexp_matches(low, '\\bstop there$') then 'vague_stop_there' end) as flags, len(w) as words, len(list_filter(regexp_split_to_array(text, '[.!?]+'), lambda x: trim(x) <> '')) as sentences from t""")
def instruction_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All flags of each text."""
    i, t = F.col("doc_id"), F.col("text")
    lead = F.get(F.array(*map(F.lit, _LEADS)), (i % 6).cast("int"))
    said = F.concat(lead, F.when(i % 7 == 0, "").when(i % 7 == 1, "Stop there.").otherwise(t))
    run = F.array(F.struct((i % 3 + 1).cast("int").alias("action"), F.lit(0).alias("start"), (i % 11).cast("int").alias("end")))
    d = _T(spark, sf_dir, "documents").select("doc_id", said.alias("text"), F.when(i % 4 != 0, run).alias("runs"))
    old = F.when(i % 50 == 0, t).otherwise("-")
    w = d.withColumn("w", X.tokens(t))
    return w.select("doc_id", F.array_join(X.instruction_flags(t, old, F.col("runs"), words=F.col("w")), ",").alias("flags"), F.size("w").cast("long").alias("words"), F.size(X.sentences(t)).cast("long").alias("sentences"))


@query("""select conv_id, array_to_string(list_transform(regexp_extract_all(lower(said), '\\b(?:forward|left|right|stop)\\b')[1:18], lambda x: case x when 'forward' then '1' when 'left' then '2' when 'right' then '3' else '0' end), ',') as actions
from (select conv_id, string_agg('turn left then forward </think> ' || case when turn % 2 = 0 then 'right' else 'stop' end, ' ' order by turn) as s, regexp_replace(string_agg('turn left then forward </think> ' || case when turn % 2 = 0 then 'right' else 'stop' end, ' ' order by turn), '^.*</think>', '', 's') as said from conversations group by conv_id)""")
def parsed_actions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F4, F5, F6."""
    said = F.concat(F.lit("turn left then forward </think> "), F.when(F.col("turn") % 2 == 0, "right").otherwise("stop"))
    g = _T(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", said.alias("s")))).alias("l"))
    return g.select("conv_id", V.text(X.parse_actions(F.array_join(F.col("l.s"), " "), 18)).alias("actions"))


@query("""select conv_id, count(*) as n_turns, max_by(role, turn) = 'assistant' as ends_well, string_agg('<|' || role || '|>' || chr(10) || text || chr(10), '' order by turn) as prompt from conversations group by conv_id""")
def chat_prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messages in order as one text, and whether the last one is the assistant's."""
    g = _T(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("m"))
    said = F.transform("m", lambda x: F.concat(F.lit("<|"), x["role"], F.lit("|>\n"), x["text"], F.lit("\n")))
    return g.select("conv_id", F.size("m").cast("long").alias("n_turns"), (F.element_at("m", -1)["role"] == "assistant").alias("ends_well"), F.array_join(said, "").alias("prompt"))


@query("""select page_id, regexp_extract(url, '([^/]+)/[^/]+$', 1) as parent, not regexp_matches(url, '^/|(?:^|/)\\.\\.(?:/|$)') as portable, case when regexp_matches(page_id || '.jpg', '^\\d+\\.(?:jpg|jpeg|png)$') then page_id end as frame from pages""")
def path_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F10, F11, P5, P23."""
    u = F.col("url")
    return _T(spark, sf_dir, "pages").select("page_id", X.parent_name(u).alias("parent"), X.portable(u).alias("portable"), X.frame_number(F.concat(F.col("page_id").cast("string"), F.lit(".jpg"))).alias("frame"))


# -- math ----------------------------------------------------------------------------------------------------------------


@query(f"""with {V.POSES_SQL}, p as (select vec_id, x, z, qx, qy, qz, qw, degrees(atan2(2 * (qw * qy + qx * qz), 1 - 2 * (qy * qy + qz * qz))) as yaw, degrees(atan2(-x, -z)) as dir from poses)
select vec_id, round(yaw, 6) as yaw, round(1 - 2 * (qy * qy + qz * qz), 9) as m00, round(2 * (qx * qz + qy * qw), 9) as m02, round((dir - yaw) - 360 * floor((dir - yaw + 180) / 360), 6) as bearing,
 round(degrees(2 * acos(least(abs(qw), 1.0))), 5) as turn_from_identity, ((x >= -0.2)::int + (x >= 0)::int + (x >= 0.2)::int) as bucket, trunc((x + 1) / 0.25)::int as cell, round(least(greatest(z, -0.1), 0.1), 9) as clamped from p""")
def pose_math(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M1, M2, M3, M5, M7, M8, M13."""
    q = [F.col(c) for c in ("qx", "qy", "qz", "qw")]
    yaw, m = G.yaw_degrees(*q), G.rotation_matrix(*q)
    identity = [F.lit(0.0), F.lit(0.0), F.lit(0.0), F.lit(1.0)]
    return V.poses(spark, sf_dir).select(
        "vec_id", F.round(yaw, 6).alias("yaw"), F.round(m[0], 9).alias("m00"), F.round(m[2], 9).alias("m02"), F.round(G.bearing_degrees(F.col("x"), F.col("z"), yaw), 6).alias("bearing"),
        F.round(G.rotation_error_degrees(q, identity), 5).alias("turn_from_identity"), G.bucket(F.col("x"), (-0.2, 0.0, 0.2)).alias("bucket"), G.to_grid(F.col("x"), -1.0, 0.25).alias("cell"), F.round(G.clamp(F.col("z"), -0.1, 0.1), 9).alias("clamped"),
    )


@query(f"""with {V.POSES_SQL} select vec_id, round(ln(exp(x - g) + exp(y - g) + exp(z - g) + exp(qx - g)) + g - x, 9) as nll, round(cos(y) * sin(x), 9) as vx, round(cos(y) * cos(x), 9) as vz, round(case when label % 2 = 0 then sqrt(x*x+y*y+z*z) else abs(x) end, 9) as robust from (select *, greatest(x, y, z, qx) as g from poses)""")
def logit_math(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M10, M12, M15."""
    x = [F.col(c) for c in ("x", "y", "z", "qx")]
    v = G.lonlat_to_xyz(x[0], x[1])
    geodesic = F.when(F.col("label") % 2 == 0, F.lit(float("nan"))).otherwise(F.abs(x[0]))
    straight = F.sqrt(x[0] ** 2 + x[1] ** 2 + x[2] ** 2)
    return V.poses(spark, sf_dir).select(
        "vec_id", F.round(G.neg_log_softmax(F.array(*x), F.lit(0)), 9).alias("nll"), F.round(v[0], 9).alias("vx"), F.round(v[2], 9).alias("vz"), F.round(F.when(G.finite(geodesic), geodesic).otherwise(straight), 9).alias("robust")
    )

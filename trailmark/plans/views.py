"""The derived views that queries run on, each as a DataFrame and as the SQL common table expressions that mean the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

STOP, FORWARD, LEFT, RIGHT = 0, 1, 2, 3


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def placed(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table with the place ``at`` of each row: its file and its number there."""
    return table(spark, sf_dir, name).select("*", F.struct("_metadata.file_path", "_metadata.row_index").alias("at"))


# -- V1, V2: events as action sequences ----------------------------------------------------------------------------------

STEPS_SQL = """steps0 as (select user_id, event_id, ts, value, case event_type when 'error' then 0 when 'click' then 2 when 'purchase' then 3 else 1 end as action from events),
steps as (select *, coalesce(sum(case when action = 0 then 1 else 0 end) over (partition by user_id order by ts, event_id rows between unbounded preceding and 1 preceding), 0)::bigint as k from steps0),
episodes as (select user_id, k, concat(user_id, ':', k) as episode_id, list(action order by ts, event_id) as actions, list(value order by ts, event_id) as vals, count(*) as n from steps group by user_id, k)"""


def steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events with their action and the number of the user's episode: a new one begins after each stop."""
    action = F.when(F.col("event_type") == "error", STOP).when(F.col("event_type") == "click", LEFT).when(F.col("event_type") == "purchase", RIGHT).otherwise(FORWARD)
    before = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, -1)
    e = table(spark, sf_dir, "events").select("user_id", "event_id", "ts", "value", action.alias("action"))
    return e.withColumn("k", F.coalesce(F.sum((F.col("action") == STOP).cast("long")).over(before), F.lit(0).cast("long")))


def episodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows (user_id, k, episode_id, actions array<int>, vals array<double>, n long), in order of time within an episode."""
    s = F.array_sort(F.collect_list(F.struct("ts", "event_id", "action", "value")))
    g = steps(spark, sf_dir).groupBy("user_id", "k").agg(s.alias("s"))
    return g.select(
        "user_id", "k", F.concat_ws(":", "user_id", "k").alias("episode_id"), F.col("s.action").alias("actions"), F.col("s.value").alias("vals"), F.size("s").cast("long").alias("n")
    )


# -- V3: documents as instructions ---------------------------------------------------------------------------------------

INSTRUCTIONS_SQL = """instructions as (select d.doc_id as episode_id, d.text as instruction, d.source as corpus, d.lang from documents d)"""


def instructions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("episode_id"), F.col("text").alias("instruction"), F.col("source").alias("corpus"), "lang")


# -- V4: line items as result rows of two runs ---------------------------------------------------------------------------

RESULTS_SQL = """results as (select l_orderkey as scene_id, l_linenumber as id, l_linestatus as side, (l_returnflag = 'R')::int as success, l_extendedprice as distance, l_quantity as path_length, l_discount as spl,
  row_number() over (partition by l_linestatus, l_orderkey, l_linenumber order by l_shipdate desc, l_extendedprice desc, l_partkey desc, l_suppkey desc) as nth from lineitem),
latest as (select * exclude (nth) from results where nth = 1)"""


def results(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = table(spark, sf_dir, "lineitem")
    return r.select(
        F.col("l_orderkey").alias("scene_id"), F.col("l_linenumber").alias("id"), F.col("l_linestatus").alias("side"), (F.col("l_returnflag") == "R").cast("int").alias("success"),
        F.col("l_extendedprice").alias("distance"), F.col("l_quantity").alias("path_length"), F.col("l_discount").alias("spl"), "l_shipdate", "l_partkey", "l_suppkey",
    )


def latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Last-wins result of each (side, scene, id)."""
    key = ["side", "scene_id", "id"]
    order = F.struct("l_shipdate", "distance", "l_partkey", "l_suppkey")
    best = results(spark, sf_dir).groupBy(*key).agg(F.max_by(F.struct("success", "distance", "path_length", "spl"), order).alias("r"))
    return best.select("scene_id", "id", "side", "r.success", "r.distance", "r.path_length", "r.spl")


# -- V5: embeddings as poses ---------------------------------------------------------------------------------------------

POSES_SQL = """poses0 as (select vec_id, label, embedding[1]::double as x, embedding[2]::double as y, embedding[3]::double as z, embedding[4]::double as a, embedding[5]::double as b, embedding[6]::double as c, embedding[7]::double as d from embeddings),
poses as (select vec_id, label, x, y, z, a / sqrt(a*a+b*b+c*c+d*d) as qx, b / sqrt(a*a+b*b+c*c+d*d) as qy, c / sqrt(a*a+b*b+c*c+d*d) as qz, d / sqrt(a*a+b*b+c*c+d*d) as qw from poses0)"""


def poses(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = lambda i: F.get("embedding", F.lit(i)).cast("double")
    norm = F.sqrt(sum((e(i) * e(i) for i in range(4, 7)), e(3) * e(3)))
    return table(spark, sf_dir, "embeddings").select(
        "vec_id", "label", e(0).alias("x"), e(1).alias("y"), e(2).alias("z"), *((e(3 + i) / norm).alias(n) for i, n in enumerate(("qx", "qy", "qz", "qw")))
    )


# -- V6: conversations; V7: graph ----------------------------------------------------------------------------------------

GRAPH_SQL = """edges as (select distinct l_suppkey as s, l_partkey as p from lineitem)"""


def graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("s"), F.col("l_partkey").alias("p")).distinct()


def joined(c: str, sep: str = ",") -> str:
    """SQL: a list as text."""
    return f"coalesce(array_to_string({c}, '{sep}'), '')"


def text(c, sep: str = ","):
    """An array as text."""
    return F.array_join(F.transform(c, lambda x: x.cast("string")), sep)

"""URL filtering against allow and block rules.

Each URL is expanded into (host suffix, path prefix) expressions, of the suffix and prefix lengths that rules have; an
equi-join on a short prefix of the expressions' digests finds candidate rules, the full digest confirms them and the
longest rule decides (at equal length block before allow, then the rule that comes last in order).  DataFrame functions only.

Defined results: a null url or one without ``://`` has an empty host and path and gets the default verdict; each row is
judged by itself, so repeated rows give repeated results; extra columns of any name are ignored; an empty rule table
gives the default verdict everywhere.  Rules with a null or empty host never fit.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, ascii_lower

#: Hexadecimal digits of a digest that the join goes by.
SHORT_DIGITS = 8
#: The rules of the registered query.  Fixed values.
RULES = (("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block"))


def host_and_path(url: Column) -> tuple[Column, Column]:
    """The host (A-Z lower-cased) after the first ``://`` and the path after it; both empty without ``://``."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    host = F.regexp_extract(rest, "^[^/?#]*", 0)
    path = F.regexp_extract(F.substring(rest, F.length(host) + 1, F.length(rest)), "^[^?#]*", 0)
    return F.coalesce(ascii_lower(host), F.lit("")), F.coalesce(path, F.lit(""))


def rule_table(spark: SparkSession, rules=RULES) -> DataFrame:
    return spark.createDataFrame(list(rules), "host string, path string, verdict string")


def _digest(host: Column, path: Column) -> Column:
    return F.sha2(F.concat(host, F.lit("\n"), path), 256)


def url_filter(pages: DataFrame, rules: DataFrame, id_col: str = "page_id", url_col: str = "url", default: str = "allow") -> DataFrame:
    """Rows (id, host, path, rule, verdict) for every row of ``pages``."""
    host, path = host_and_path(F.col(url_col))
    urls = pages.select(F.col(id_col), host.alias("host"), path.alias("path"))

    ready = rules.select(ascii_lower(F.col("host")).alias("r_host"), F.coalesce(F.col("path"), F.lit("")).alias("r_path"), F.col("verdict").alias("r_verdict")).where("r_host <> '' and r_verdict is not null")
    ready = ready.withColumn("r_digest", _digest(F.col("r_host"), F.col("r_path"))).withColumn("r_short", F.substring("r_digest", 1, SHORT_DIGITS))
    # A few numbers about the rules: how many labels a host and characters a path of a rule can have.
    shape = ready.agg(
        F.collect_set(F.size(F.split("r_host", "\\."))).alias("labels"), F.collect_set(F.length("r_path")).alias("lengths"), F.count(F.lit(1)).alias("n")
    ).first()
    labels, lengths = sorted(shape["labels"]), sorted(shape["lengths"])
    if shape["n"] <= BROADCAST_ROWS:
        ready = F.broadcast(ready)

    hosts = F.array_compact(F.array(*(F.when(F.size("parts") >= k, F.substring_index("host", ".", -k)) for k in labels))) if labels else F.array().cast("array<string>")
    paths = F.array_compact(F.array(*(F.when(F.length("path") >= n, F.substring("path", 1, n)) for n in lengths))) if lengths else F.array().cast("array<string>")
    # Equal URLs are judged once; what is judged is dealt by URL, so a host with a third of the rows is no hot key.
    distinct = urls.select("host", "path").where("host <> ''").distinct()
    expressions = (
        distinct.withColumn("parts", F.split("host", "\\."))
        .select("host", "path", F.explode(hosts).alias("e_host"), paths.alias("paths"))
        .select("host", "path", "e_host", F.explode("paths").alias("e_path"))
        .withColumn("digest", _digest(F.col("e_host"), F.col("e_path")))
        .withColumn("short", F.substring("digest", 1, SHORT_DIGITS))
    )
    # The join's only key is the short digest; whole digests, all of one length, are compared afterwards (an equality
    # would be made a key of the join as well).
    hits = expressions.join(ready, F.col("short") == F.col("r_short")).where(F.startswith("digest", "r_digest"))
    rank = F.struct((F.length("r_host") + F.length("r_path")).alias("size"), (F.col("r_verdict") == "block").cast("int").alias("block"), F.concat("r_host", "r_path").alias("rule"), F.col("r_verdict").alias("verdict"))
    judged = hits.groupBy("host", "path").agg(F.max(rank).alias("best"))
    return urls.join(judged, ["host", "path"], "left").select(id_col, "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.verdict", F.lit(default)).alias("verdict"))


def oracle_sql(rules=RULES, default: str = "allow") -> str:
    """DuckDB SQL for :func:`url_filter` over ``pages``."""
    values = ", ".join(f"('{h}', '{p}', '{v}')" for h, p, v in rules)
    return f"""
with rules(r_host, r_path, r_verdict) as (values {values}),
cut as (select page_id, case when instr(url, '://') > 0 then substr(url, instr(url, '://') + 3) else '' end as rest from pages),
hosts as (select page_id, rest, regexp_extract(rest, '^[^/?#]*') as raw from cut),
urls as (select row_number() over () as u, page_id,
    translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
    regexp_extract(substr(rest, length(raw) + 1), '^[^?#]*') as path from hosts),
fits as (select u, r_host || r_path as rule, r_verdict,
    row_number() over (partition by u order by length(r_host) + length(r_path) desc, r_verdict desc, r_host || r_path desc) as k
  from urls join rules on (host = r_host or ends_with(host, '.' || r_host)) and starts_with(path, r_path))
select page_id, host, path, rule, coalesce(r_verdict, '{default}') as verdict
from urls left join (select * from fits where k = 1) f using (u)"""

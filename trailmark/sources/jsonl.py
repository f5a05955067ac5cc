"""JSON sources with a declared schema; none is inferred."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ANNOTATION = "episode_id string, instruction string, actions array<int>, trajectory_id string"


def strict(spark: SparkSession, path: str, schema: str = ANNOTATION, key: str = "episode_id") -> DataFrame:
    """Malformed lines, missing ids and repeated ids fail the job; blank lines are skipped."""
    rows = spark.read.schema(schema).option("mode", "FAILFAST").json(path)
    known = rows.where(F.when(F.col(key).isNull(), F.raise_error(F.lit(f"row without {key}")).cast("boolean")).otherwise(True))
    repeated = known.groupBy(key).count().where("count > 1").select(key, F.lit(True).alias("_again"))
    return known.join(repeated, key, "left").where(F.when(F.col("_again"), F.raise_error(F.concat(F.lit(f"repeated {key} "), F.col(key))).cast("boolean")).otherwise(True)).drop("_again")


def lenient(spark: SparkSession, path: str, schema: str, keys: list[str]) -> DataFrame:
    """Malformed lines and rows without a key are left out."""
    rows = spark.read.schema(f"{schema}, _corrupt string").option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt").json(path)
    return rows.where(F.col("_corrupt").isNull()).dropna(subset=keys).drop("_corrupt")


def journal(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """S3: a file written by appending, whose last line may be torn; any other malformed line fails the job.

    The place of a line is its file and offset order, as monotonically increasing ids of one file are.
    """
    lines = spark.read.text(path).where(F.trim("value") != "").select("value", F.monotonically_increasing_id().alias("_at"), F.input_file_name().alias("_file"))
    parsed = lines.select("_at", "_file", F.from_json("value", f"struct<{_fields(schema)}, _corrupt:string>", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"}).alias("r"))
    last = lines.groupBy("_file").agg(F.max("_at").alias("_last"))
    torn = F.col("r._corrupt").isNotNull()
    ok = parsed.join(last, "_file").where(F.when(torn & (F.col("_at") < F.col("_last")), F.raise_error(F.concat(F.lit("malformed line in "), F.col("_file"))).cast("boolean")).otherwise(~torn))
    return ok.select("r.*").drop("_corrupt")


def _fields(schema: str) -> str:
    from pyspark.sql.types import StructType

    return ", ".join(f"{f.name}:{f.dataType.simpleString()}" for f in StructType.fromDDL(schema).fields)


def document_array(spark: SparkSession, path: str, field: str, element: str) -> DataFrame:
    """Rows of the array ``field`` of one JSON document (plain or gzip).

    A document is read by one task; jobs that go over it more than once should write the result as Parquet first.
    """
    doc = spark.read.schema(f"{field} array<struct<{_fields(element)}>>").option("multiLine", True).json(path)
    return doc.select(F.inline(field))


def by_role(spark: SparkSession, paths: dict[str, str], schema: str, roles: list[str], languages: list[str]) -> DataFrame:
    """The files of the wanted roles ("*": all) with a column ``role``, rows of the wanted languages ("*": all)."""
    parts = [spark.read.schema(schema).json(p).withColumn("role", F.lit(k)) for k, p in sorted(paths.items()) if "*" in roles or k in roles]
    if not parts:
        raise ValueError(f"no file has a role of {roles}")
    rows = parts[0]
    for p in parts[1:]:
        rows = rows.unionByName(p)
    return rows if "*" in languages else rows.where(F.col("language").isin(languages))


def with_fallback(first: DataFrame, second: DataFrame, key: str) -> DataFrame:
    """All rows of ``first`` and those of ``second`` whose key it lacks."""
    return first.unionByName(second.join(first.select(key).distinct(), key, "left_anti"))


def listing(spark: SparkSession, path: str, pattern: str) -> DataFrame:
    """Paths and sizes of files without reading them."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(path).select("path", "length", "modificationTime")


def scenes(files: DataFrame) -> DataFrame:
    """Folders with exactly one mesh and one navigation mesh; rows (folder, scene)."""
    folder = F.regexp_extract("path", r"^(.*)/[^/]+$", 1)
    g = files.groupBy(folder.alias("folder")).agg(F.count_if(F.endswith("path", F.lit(".basis.glb"))).alias("m"), F.count_if(F.endswith("path", F.lit(".basis.navmesh"))).alias("n"))
    return g.where("m = 1 and n = 1").select("folder", F.regexp_extract("folder", r"([^/]+)$", 1).alias("scene"))

"""What the operators of this subpackage share: shared folders, table reading, joins on hot keys and Arrow batching."""

from __future__ import annotations

import contextlib
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

#: Text that one Python step works on at once, in characters; larger Arrow batches are cut up.
BLOCK_CHARS = 1_500_000

#: A table is broadcast only if it was counted and has at most so many rows of bounded width.
BROADCAST_ROWS = 100_000

#: A key with more rows than HOT_ROWS may be hot; the bound grows with the table so that at most HOT_KEYS keys are.
HOT_ROWS, HOT_KEYS = 256, 2_000

#: For tables of whole texts: rows read at once, bytes of a file's column read at once, and bytes of a row group and of a page that are
#: written.  A reader holds no more than a row group at once, whatever its own settings are.
BATCH_ROWS, READ_BYTES, GROUP_BYTES, PAGE_BYTES = 256, 1 << 18, 1 << 21, 1 << 18

#: Shared folders made so far, for :func:`scratch`.
_MADE: list[str] = []


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new path in the folder that driver and executors share (``spark.checkpoint.dir``).

    Where the session names none and runs in one process (tests), a temporary folder is set as the session's; a cluster
    without one is an error, as executors would write to disks of their own.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = "file://" + tempfile.mkdtemp(prefix="trailmark-")
        spark.conf.set("spark.checkpoint.dir", base)
    _MADE.append(f"{base.rstrip('/')}/trailmark-{name}-{uuid.uuid4().hex}")
    return _MADE[-1]


def deleted(spark: SparkSession, path: str) -> None:
    """Removes a folder that was written."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


@contextlib.contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Shared folders that are made inside are deleted at the end; only for work whose result is written elsewhere."""
    at = len(_MADE)
    try:
        yield
    finally:
        for path in _MADE[at:]:
            deleted(spark, path)
        del _MADE[at:]


@contextlib.contextmanager
def settings(spark: SparkSession, values: dict[str, str]) -> Iterator[None]:
    """Session settings for what runs inside."""
    before = {k: spark.conf.get(k, None) for k in values}
    try:
        for k, v in values.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def small_pieces(spark: SparkSession) -> contextlib.AbstractContextManager[None]:
    """Whole texts are read from files, and handed to Python, a few at a time by what runs inside."""
    return settings(
        spark,
        {"spark.sql.parquet.columnarReaderBatchSize": str(BATCH_ROWS), "parquet.read.allocation.size": str(READ_BYTES), "parquet.hadoop.vectored.io.enabled": "false", "spark.sql.execution.arrow.maxRecordsPerBatch": str(BATCH_ROWS)},
    )


def cleaning(spark: SparkSession) -> contextlib.AbstractContextManager[None]:
    """Shuffle files of what is written inside go as soon as it is written."""
    return settings(spark, {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true"})


def written(df: DataFrame, name: str, codec: str = "zstd", path: str | None = None, texts: bool = False) -> DataFrame:
    """Writes ``df`` as Parquet to the shared folder and reads it back: lineage ends here and survives lost executors.

    ``texts``: rows hold whole texts; they are read and written in small pieces.  Arrays of many MB, which batches of 4,096 texts
    need, find no place between others in an executor's heap, so that it grows to its limit.
    """
    path = path or shared_folder(df.sparkSession, name)
    small = {"spark.sql.parquet.columnarReaderBatchSize": str(BATCH_ROWS), "parquet.read.allocation.size": str(READ_BYTES), "parquet.hadoop.vectored.io.enabled": "false"} if texts else {}
    pages = {"parquet.block.size": str(GROUP_BYTES), "parquet.page.size": str(PAGE_BYTES)} if texts else {}
    with cleaning(df.sparkSession), settings(df.sparkSession, small):
        df.write.options(compression=codec, **pages).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def packed(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """Rows (row: all other columns of ``docs`` as one struct, text): no column of the caller can clash with one of an operator."""
    rest = [F.col(f"`{c}`") for c in docs.columns if c != text_col] or [F.lit(None).cast("string").alias("none")]
    return docs.select(F.struct(*rest).alias("row"), F.col(text_col).alias("text"))


def unpacked(rows: DataFrame, columns: list[str], text_col: str = "text", **made: Column) -> DataFrame:
    """The columns that were packed, in their order; those in ``made`` with the values given there."""
    value = lambda c: made[c] if c in made else F.col("text") if c == text_col else F.col("row")[c]
    return rows.select(*(value(c).alias(c) for c in columns))


def text_key(text: Column) -> Column:
    """The digest that stands for a text; null counts as empty."""
    return F.md5(F.coalesce(text, F.lit("")).cast("binary"))


def hot_join(rows: DataFrame, values: DataFrame, key: str, n: str, how: str = "left") -> DataFrame:
    """``rows`` joined with ``values`` (unique ``key``, bounded width; ``n``: how many of ``rows`` have it) where single keys may hold any share of the rows.

    Keys with more rows than a bound are joined by broadcast, so their rows stay where they are; the bound is such that
    there cannot be more than HOT_KEYS of them.  All other keys meet in a shuffle, at most so many rows to a key; the plan is the same at
    every size but the smallest.  Both tables are read more than once and should be written ones.  ``how`` is left or inner.
    """
    known = values.agg(F.count(F.lit(1)).alias("keys"), F.sum(n).alias("rows")).first()
    if known["keys"] <= HOT_KEYS:
        return rows.join(F.broadcast(values), key, how)
    bound = max(HOT_ROWS, -(-int(known["rows"]) // HOT_KEYS))
    hot = values.where(F.col(n) > bound)
    if hot.isEmpty():
        return rows.join(values.hint("merge"), key, how)
    hot = F.broadcast(hot)
    rest = rows.join(hot.select(key), key, "left_anti").join(values.where(F.col(n) <= bound).hint("merge"), key, how)
    return rows.join(hot, key).unionByName(rest)


def salted_join(rows: DataFrame, values: DataFrame, key: str, n: str) -> DataFrame:
    """Inner join of ``rows`` with ``values`` whose rows may be wide or several to a key (``n``: how many of ``rows`` have the key).

    The rows of a hot key are dealt over as many parts as they fill, and its values are repeated for each part: no more than
    one copy to HOT_ROWS rows.  Both tables are read more than once and should be written ones.
    """
    share = lambda c: F.ceil(c / HOT_ROWS).cast("int")
    hot = written(values.where(F.col(n) > HOT_ROWS).select(key, n).distinct(), "hot-keys")
    if hot.isEmpty():
        return rows.join(values.drop(n), key)
    salt = F.pmod(F.xxhash64(*rows.columns), share(F.coalesce(n, F.lit(1))))
    dealt = hot_join(rows, hot, key, n).withColumn("salt", salt.cast("int")).drop(n)
    repeated = values.withColumn("salt", F.explode(F.sequence(F.lit(0), share(F.col(n)) - 1))).drop(n)
    return dealt.join(repeated, [key, "salt"]).drop("salt")


def blocks(batches: Iterator[pa.RecordBatch], text: str) -> Iterator[pa.RecordBatch]:
    """The rows of ``batches`` in slices of about BLOCK_CHARS bytes of column ``text`` (one row at least)."""
    import pyarrow.compute as pc

    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        sizes = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False)
        at = size = 0
        for i in range(n):
            size += int(sizes[i])
            if size >= BLOCK_CHARS:
                yield batch.slice(at, i + 1 - at)
                at, size = i + 1, 0
        if at < n:
            yield batch.slice(at)


def give_back() -> None:
    """Hands memory that is free but kept back to the system: a Python worker is used again by tasks of other stages."""
    import ctypes
    import gc

    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def map_text(df: DataFrame, make: Callable[[], Callable[[list], list]], out: StructType, arrow: pa.Schema, text: str = "text", keep_text: bool = False) -> DataFrame:
    """Arrow-batched map: ``make()`` is called once a task and gives a function from a list of texts (never null) to columns.

    ``out`` and ``arrow`` name the added columns; the columns of ``df`` (but ``text``, unless it is kept) pass through in front of them.  If what
    ``make`` gives has a method ``end``, it is called when the task ends.
    """
    keep = [f for f in df.schema.fields if keep_text or f.name != text]
    names = [f.name for f in keep]

    def run(batches):
        f = make()
        try:
            for block in blocks(batches, text):
                cols = f([x or "" for x in block.column(text).to_pylist()])
                yield pa.RecordBatch.from_arrays(
                    [block.column(c) for c in names] + [x if isinstance(x, pa.Array) else pa.array(x, t) for x, t in zip(cols, arrow.types, strict=True)],
                    names=[*names, *arrow.names],
                )
        finally:
            getattr(f, "end", lambda: None)()
            del f
            give_back()

    return df.mapInArrow(run, StructType([*(StructField(f.name, f.dataType) for f in keep), *out.fields]))


def held_out(doc_id: Column) -> Column:
    """crc32 of the id as text leaves 2 when divided by 4."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2


def ascii_lower(x: Column) -> Column:
    return F.translate(x, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")

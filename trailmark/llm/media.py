"""Media columns stored as content-defined chunks.

Write: a payload is cut where a rolling gear hash has its high bits zero, so equal passages give equal chunks wherever
they stand.  A chunk's name is its SHA-256; the store keeps each chunk once (zstandard-compressed with a dictionary that is drawn
from a bounded sample of texts by their hash and belongs to the store; bucketed by digest),
and a recipe holds a payload's manifest: digest and 32-bit little-endian length of each chunk, in order.  Read: the manifests'
entries join the store on the digest, chunks are laid in order, each is checked against its digest and length and the payload
against its own digest.

A payload is the UTF-8 text plus zero bytes up to a positive multiple of 64.  Its stored form ("media") is what is kept of it:
the manifest as the recipe has it, followed by the stored (compressed) chunks in order; its size and digest are taken from
the bytes read back.

A chunk that very many payloads hold is a hot key of the join: it is repeated for every so many of them (``HOT_ROWS``), and a
payload that very many rows have is described once and handed to the rows by :func:`hot_join`.

Defined results: a null or empty text has 0 bytes and a payload of 64 zeros; equal texts share one recipe; repeated rows
give repeated rows; extra columns are ignored; an empty table gives an empty table; a payload that does not come back as
it was written fails the job.
"""

from __future__ import annotations

import hashlib
import struct
import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, HOT_ROWS, blocks, cleaning, give_back, hot_join, shared_folder, written

#: Bytes of the shortest and longest chunk, and high bits of the hash that are zero at a cut (8 KiB on average).
LEAST, MOST, BITS = 2048, 65536, 13
UNIT = 64
#: Level of the stored chunks, which are moved twice and kept: small ones are worth the time.
LEVEL = 9
#: Bytes of the raw-content dictionary that chunks are compressed with, and the texts (and bytes of each) that it is drawn from.
DICTIONARY_BYTES, DICTIONARY_TEXTS, DICTIONARY_PART = 1024 * 1024, 600, 2048
#: Bytes of a payload's digest that recipes go by; the whole digest is checked on reading.
KEY = 16
#: Bytes of a manifest's entry: a digest and a length.
ENTRY = 36

GEAR = np.array([int.from_bytes(hashlib.sha256(bytes([b])).digest()[:4], "little") for b in range(256)], np.uint32)


def payload_of(raw: bytes) -> bytes:
    """``raw`` padded with zeros to a positive multiple of UNIT bytes."""
    return raw + bytes(max(UNIT, -(-len(raw) // UNIT) * UNIT) - len(raw))


def gear(data: np.ndarray) -> np.ndarray:
    """At each byte the gear hash of the last 32: the sum of GEAR[byte] << age, built by doubling the window."""
    h = GEAR[data]
    for w in (1, 2, 4, 8, 16):
        if len(h) > w:
            g = h.copy()
            g[w:] += h[:-w] << np.uint32(w)
            h = g
    return h


def chunk_ends(payloads: list[bytes]) -> list[list[int]]:
    """The ends of the chunks of each payload.  LEAST exceeds the window, so neighbours in the block do not matter."""
    hit = np.flatnonzero(gear(np.frombuffer(b"".join(payloads), np.uint8)) >> np.uint32(32 - BITS) == 0) + 1
    out, base = [], 0
    for p in payloads:
        n, at, ends = len(p), 0, []
        while at < n:
            end = min(at + MOST, n)
            if at + LEAST < end:
                k = int(np.searchsorted(hit, base + at + LEAST))
                if k < len(hit) and hit[k] - base < end:
                    end = int(hit[k]) - base
            ends.append(end)
            at = end
        out.append(ends)
        base += n
    return out


def _cut(block: pa.RecordBatch, text_col: str):
    """(raw length, payload, its chunks) of each row."""
    raws = [(x or "").encode("utf-8", "surrogatepass") for x in block.column(text_col).to_pylist()]
    payloads = [payload_of(r) for r in raws]
    for raw, p, ends in zip(raws, payloads, chunk_ends(payloads), strict=True):
        yield len(raw), p, [p[a:b] for a, b in zip([0, *ends], ends, strict=False)]


def dictionary_of(docs: DataFrame, text_col: str = "text") -> bytes:
    """The beginnings of about DICTIONARY_TEXTS texts, those of least hash; empty for a table without texts."""
    texts = docs.select(F.encode(F.col(text_col), "utf-8").alias("t")).where("length(t) > 0")
    n = docs.count()
    share = -(-(1 << 30) * DICTIONARY_TEXTS // max(n, DICTIONARY_TEXTS))
    hashed = F.pmod(F.xxhash64("t"), F.lit(1 << 30))
    drawn = texts.where(hashed < share).groupBy(hashed.alias("h")).agg(F.min(F.substring("t", 1, DICTIONARY_PART)).alias("t")).collect()
    return b"".join(bytes(r["t"]) for r in sorted(drawn, key=lambda r: r["h"])[: 4 * DICTIONARY_TEXTS])[-DICTIONARY_BYTES:]


def _zstd(dictionary: bytes):
    """(compress, decompress) with a raw-content dictionary; without one if it is too short to serve."""
    import zstandard

    if len(dictionary) < 8:
        return zstandard.ZstdCompressor(level=LEVEL).compress, zstandard.ZstdDecompressor().decompress
    d = zstandard.ZstdCompressionDict(dictionary, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    d.precompute_compress(level=LEVEL)
    return zstandard.ZstdCompressor(level=LEVEL, dict_data=d, write_dict_id=False).compress, zstandard.ZstdDecompressor(dict_data=d).decompress


def manifest_of(digests: list[bytes], sizes: list[int]) -> bytes:
    return b"".join(d + struct.pack("<I", n) for d, n in zip(digests, sizes, strict=True))


def recipes_of(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (id, n_bytes, payload_bytes, payload binary: KEY bytes of its digest, manifest binary: ENTRY bytes for each chunk)."""

    def run(batches):
        sha = lambda b: hashlib.sha256(b).digest()
        for block in blocks(batches, "text"):
            rows = [(n, len(p), sha(p)[:KEY], manifest_of([sha(c) for c in chunks], list(map(len, chunks)))) for n, p, chunks in _cut(block, "text")]
            n, size, name, manifest = zip(*rows, strict=True)
            yield pa.RecordBatch.from_arrays(
                [block.column("id"), pa.array(n, pa.int64()), pa.array(size, pa.int64()), pa.array(name, pa.binary()), pa.array(manifest, pa.binary())],
                names=["id", "n_bytes", "payload_bytes", "payload", "manifest"],
            )
        give_back()

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, f"id {kind}, n_bytes long, payload_bytes long, payload binary, manifest binary")


def chunks_of(docs: DataFrame, dictionary: bytes, text_col: str = "text") -> DataFrame:
    """Rows (digest binary, blob binary) of all chunks; a task hands a chunk on once, so one that a third of all texts share is no hot key."""

    def run(batches):
        pack, _ = _zstd(dictionary)
        seen: set[bytes] = set()
        for block in blocks(batches, text_col):
            new: dict[bytes, bytes] = {}
            for _, _, chunks in _cut(block, text_col):
                for c in chunks:
                    d = hashlib.sha256(c).digest()
                    if d not in seen:
                        seen.add(d)
                        new[d] = pack(c)
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(new), pa.binary()), pa.array(list(new.values()), pa.binary())],
                names=["digest", "blob"],
            )

    return docs.select(text_col).mapInArrow(run, "digest binary, blob binary")


def store_chunks(docs: DataFrame, dictionary: bytes, text_col: str = "text", existing: DataFrame | None = None) -> DataFrame:
    """Writes each chunk of ``docs`` once, bucketed by digest, to the shared folder; those in ``existing`` (a store
    of the same dictionary) are not written again.

    The table of the written chunks is returned; a later join on the digest does not move them again.
    """
    spark = docs.sparkSession
    chunks = chunks_of(docs, dictionary, text_col)
    if existing is not None:
        chunks = chunks.join(existing.select("digest"), "digest", "left_anti")
    name = f"trailmark_chunks_{uuid.uuid4().hex}"
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    with cleaning(spark):
        chunks.repartition(buckets, "digest").dropDuplicates(["digest"]).write.option("compression", "uncompressed").option("path", shared_folder(spark, "chunks")).bucketBy(buckets, "digest").saveAsTable(name)
    return spark.table(name)


def _laid(recipes: DataFrame, store: DataFrame) -> DataFrame:
    """Rows (payload, seq, entry, blob) of each chunk of each different payload, in order within a payload."""
    wanted = recipes.select("payload", "manifest").dropDuplicates(["payload"])
    at = F.sequence(F.lit(0), (F.length("manifest") / ENTRY).cast("int") - 1)
    parts = wanted.select("payload", F.posexplode(F.transform(at, lambda i: F.substring("manifest", i * ENTRY + 1, F.lit(ENTRY)))).alias("seq", "entry"))
    parts = parts.withColumn("digest", F.substring("entry", 1, ENTRY - 4))
    counts = written(parts.groupBy("digest").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > HOT_ROWS), "hot-chunks")
    # The store is bucketed by digest, so chunks of few payloads are not moved to be joined.  Of chunks with more payloads than
    # the bound there are at most BROADCAST_ROWS, so their digests are broadcast.
    total = counts.agg(F.sum("n")).first()[0]
    if not total:
        return parts.join(store, "digest")
    bound = max(HOT_ROWS, -(-int(total) // BROADCAST_ROWS))
    hot = F.broadcast(counts.where(F.col("n") > bound))
    copies = F.ceil(F.col("n") / bound).cast("int")
    cold = parts.join(hot, "digest", "left_anti").join(store, "digest")
    dealt = parts.join(hot, "digest").withColumn("salt", F.pmod(F.xxhash64("payload", "seq"), copies).cast("int")).drop("n")
    blobs = store.join(hot, "digest").withColumn("salt", F.explode(F.sequence(F.lit(0), copies - 1))).drop("n")
    return cold.unionByName(dealt.join(blobs, ["digest", "salt"]).drop("salt"))


def read_payloads(recipes: DataFrame, store: DataFrame, dictionary: bytes, feature) -> DataFrame:
    """Reads the payloads of ``recipes`` back from ``store`` and describes them; equal payloads are read once.

    ``feature``: (payload, n_chunks) -> string.  Rows (payload, sha binary, tail_crc32, media_bytes, media binary, feature), digests as bytes.
    """
    laid = _laid(recipes, store).select("payload", "seq", "entry", "blob").repartition("payload").sortWithinPartitions("payload", "seq")

    def run(batches):
        _, unpack = _zstd(dictionary)
        now, found, rows = None, [], []

        def close():
            chunks = [unpack(blob) for _, blob in found]
            manifest = b"".join(entry for entry, _ in found)
            payload = b"".join(chunks)
            sha = hashlib.sha256(payload).digest()
            if sha[:KEY] != now or manifest != manifest_of([hashlib.sha256(c).digest() for c in chunks], list(map(len, chunks))):
                raise ValueError(f"payload {now.hex()} came back as {sha.hex()}")
            media = manifest + b"".join(blob for _, blob in found)
            return now, sha, zlib.crc32(payload[-UNIT:]), len(media), hashlib.sha256(media).digest(), feature(payload, len(found))

        for b in batches:
            for part in range(0, b.num_rows, 256):
                cut = b.slice(part, 256)
                for payload, entry, blob in zip(*(cut.column(c).to_pylist() for c in ("payload", "entry", "blob")), strict=True):
                    if payload != now:
                        if found:
                            rows.append(close())
                        now, found = payload, []
                    found.append((entry, blob))
            if len(rows) > 5000:
                yield _rows(rows)
                rows = []
        if found:
            rows.append(close())
        if rows:
            yield _rows(rows)
        found, rows = [], []
        give_back()

    return laid.mapInArrow(run, "payload binary, sha binary, tail_crc32 long, media_bytes long, media binary, feature string")


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [("payload", pa.binary()), ("sha", pa.binary()), ("tail_crc32", pa.int64()), ("media_bytes", pa.int64()), ("media", pa.binary()), ("feature", pa.string())]
    return pa.RecordBatch.from_arrays([pa.array(x, t) for x, (_, t) in zip(zip(*rows, strict=True), kinds, strict=True)], names=[n for n, _ in kinds])


def byte_feature(payload: bytes, n_chunks: int) -> str:
    """Number of chunks, mean and entropy of the bytes, and their shares by the two high bits."""
    count = np.bincount(np.frombuffer(payload, np.uint8), minlength=256)
    p = count[count > 0] / len(payload)
    entropy = float(-(p * np.log2(p)).sum()) + 0.0
    mean = float((count * np.arange(256)).sum() / len(payload))
    return f"chunks={n_chunks};mean={mean:.3f};entropy={entropy:.4f};quarters=" + "/".join(f"{x:.4f}" for x in count.reshape(4, 64).sum(axis=1) / len(payload))


def media_columns(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Stores every text and reads it back: rows (id, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature)."""
    dictionary = dictionary_of(docs, text_col)
    store = store_chunks(docs, dictionary, text_col)
    recipes = written(recipes_of(docs, id_col, text_col), "recipes")
    read = read_payloads(recipes.select("payload", "manifest"), store, dictionary, byte_feature)
    times = recipes.groupBy("payload").agg(F.count(F.lit(1)).alias("n_rows"))
    hexed = lambda c: F.lower(F.hex(c))
    return hot_join(recipes.drop("manifest"), written(read.join(times, "payload"), "payloads"), "payload", "n_rows", "inner").select(
        F.col("id").alias(id_col), "n_bytes", "payload_bytes", hexed("sha").alias("payload_sha256"), "tail_crc32", "media_bytes", hexed("media").alias("media_sha256"), "feature"
    )


def drop_tables(spark: SparkSession) -> None:
    """Forgets the chunk tables of this session (their files in the shared folder stay)."""
    for t in spark.catalog.listTables():
        if t.name.startswith("trailmark_chunks_"):
            spark.sql(f"drop table if exists {t.name}")

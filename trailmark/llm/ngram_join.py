"""Similarity join on word n-gram sets by MinHash banding.

1. Each text becomes its set of hashed word n-grams and a MinHash signature; band and row counts follow from the
   threshold and the recall aimed at.
2. Distinct sets are shuffled on their band hashes; the members of a bucket are tied to its least member, and connected
   components of these ties are the candidate groups.  Two sets can only be a pair if both are in one group.
3. A group's sets meet in one task if they are at most ``tile``.  A larger group is taken apart again into the buckets that made
   it, so a set goes to at most as many tasks as there are bands; only a bucket that is itself larger is cut into tiles of
   two blocks.  All pairs that share a band are verified on the full sets where their first common band is looked at;
   counts of links and a spanning forest leave the task, never all pairs.
4. Components of the verified links are the classes.

A bucket of m > ``tile`` different sets is a group of near copies of each other; to count the links of each of them exactly its
pairs are verified, in m / (tile / 2) tiles for each set.  Equal sets are one set from step 2 on, whatever their number.

Defined results: words are runs of letters and digits in lower case; a text of fewer than n words has one n-gram, all of
its words; a text without words (null, empty, marks only) links to nothing and is a class of its own; texts with equal
sets are copies: of one class, and not counted as links; n_links counts the different n-gram sets linked to the
document's; class_id is the least document id of the class (null if all are null); repeated rows repeat; extra columns are ignored.
"""

from __future__ import annotations

import math
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, blocks, give_back, hot_join, packed, text_key, unpacked, written
from .components import components

#: Words of an n-gram and least similarity of a pair.
N, THRESHOLD = 5, 0.8
#: Probability that a pair at the threshold shares a band, and the most hash functions to spend on it.
RECALL, MOST_HASHES = 0.9999, 128
#: Sets that meet in one task at most, as two blocks of half this size.
TILE = 512
#: Columns of the 0/1 matrix that is multiplied at once.
WIDE = 8192
#: Members of sets that are laid side by side at once.
PART = 1_000_000
#: Words whose hashes a task remembers.
REMEMBERED = 100_000

_words = re.compile(r"[^\W_]+").findall
_U = np.uint64


def bands_and_rows(threshold: float = THRESHOLD, recall: float = RECALL, most: int = MOST_HASHES) -> tuple[int, int]:
    """(bands, rows): the most rows for which enough bands to reach ``recall`` at ``threshold`` fit into ``most`` hashes."""
    best = (most, 1)
    for rows in range(1, most + 1):
        p = threshold**rows
        bands = 1 if p >= 1 else math.ceil(math.log(1 - recall) / math.log1p(-p))
        if bands * rows <= most:
            best = (bands, rows)
    return best


def _mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> _U(32))
    x = x * _U(0xD6E8FEB86659FD93)
    x = x ^ (x >> _U(32))
    x = x * _U(0xD6E8FEB86659FD93)
    return x ^ (x >> _U(32))


class Grams:
    """Hashed n-gram sets; remembers the hashes of words."""

    def __init__(self, n: int = N):
        self.n, self.known = n, {}

    def __call__(self, texts: list[str]) -> list[np.ndarray]:
        """The sorted distinct 64-bit n-gram hashes of each text."""
        import xxhash

        known, digest = self.known, xxhash.xxh64_intdigest
        if len(known) > REMEMBERED:
            known.clear()
        words, sizes = [], []
        for t in texts:
            w = _words(t.lower())
            sizes.append(len(w))
            words += w
        for w in set(words).difference(known):
            known[w] = digest(w.encode("utf-8", "surrogatepass"))
        h = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
        n, out, at = self.n, [], 0
        with np.errstate(over="ignore"):
            mixed = np.zeros(max(0, len(h) - n + 1), np.uint64)
            for k in range(n):
                mixed = _mix(mixed * _U(0x9E3779B97F4A7C15) + h[k : len(h) - n + 1 + k])
            for size in sizes:
                if size >= n:
                    out.append(np.unique(mixed[at : at + size - n + 1]))
                elif size:
                    x = np.full(1, size, np.uint64)
                    for k in range(size):
                        x = _mix(x * _U(0x9E3779B97F4A7C15) + h[at + k : at + k + 1])
                    out.append(x)
                else:
                    out.append(np.empty(0, np.uint64))
                at += size
        return out


class Signer:
    """Band hashes of sets."""

    def __init__(self, bands: int, rows: int):
        self.bands, self.rows = bands, rows
        seeds = _mix(np.arange(1, 2 * bands * rows + 1, dtype=np.uint64))
        self.a = (seeds[: bands * rows] >> _U(32)).astype(np.uint32) | np.uint32(1)
        self.b = (seeds[bands * rows :] >> _U(32)).astype(np.uint32)

    def __call__(self, sets: list[np.ndarray]) -> np.ndarray:
        """A row of band hashes for each set; all sets must have members."""
        flat = np.concatenate(sets)
        sizes = np.fromiter(map(len, sets), np.int64, len(sets))
        out = np.empty((len(sets), self.bands * self.rows), np.uint32)
        low, high = flat.astype(np.uint32), (flat >> _U(32)).astype(np.uint32)
        start = np.append(0, np.cumsum(sizes))
        at = 0
        while at < len(sets):  # parts that stay in the cache
            end = max(at + 1, int(np.searchsorted(start, start[at] + 65536, "right")) - 1)
            x, y, first = low[start[at] : start[end]], high[start[at] : start[end]], start[at:end] - start[at]
            for k in range(out.shape[1]):
                v = x * self.a[k] + self.b[k]
                v ^= y
                v *= self.a[-1 - k]
                out[at:end, k] = np.minimum.reduceat(v, first)
            at = end
        with np.errstate(over="ignore"):
            h = np.tile(np.arange(1, self.bands + 1, dtype=np.uint64), (len(sets), 1))
            for r in range(self.rows):
                h = _mix(h * _U(0x9E3779B97F4A7C15) + out[:, r :: self.rows])
        return h.view(np.int64)


def signatures(docs: DataFrame, bands: int, rows: int, n: int = N, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (id, key: digest of the text, grams: digest of its set or null without words, bands array<long>)."""

    def run(batches):
        import xxhash

        grams, sign = Grams(n), Signer(bands, rows)
        for block in blocks(batches, "text"):
            sets = grams([x or "" for x in block.column("text").to_pylist()])
            full = [i for i, s in enumerate(sets) if len(s)]
            names, marks = [None] * len(sets), [None] * len(sets)
            if full:
                for i, row in zip(full, sign([sets[i] for i in full]), strict=True):
                    names[i], marks[i] = xxhash.xxh128_digest(sets[i].tobytes()), row
            yield pa.RecordBatch.from_arrays(
                [block.column("id"), block.column("key"), pa.array(names, pa.binary()), pa.array(marks, pa.list_(pa.int64()))], names=["id", "key", "grams", "bands"]
            )
        del grams
        give_back()

    kind = docs.schema[id_col].dataType.simpleString()
    keyed = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), text_key(F.col(text_col)).alias("key"))
    return keyed.mapInArrow(run, f"id {kind}, key string, grams binary, bands array<bigint>")


def _pairs(bands: np.ndarray, sets: list[np.ndarray], side: np.ndarray, threshold: float, at: int = -1):
    """Index pairs of similar sets among those that share a band; only across sides where a tile has two, and only those whose first common band is ``at``, if that is one."""
    n = len(sets)
    sizes = np.fromiter(map(len, sets), np.int64, n)
    both = np.zeros((n, n), bool)
    for k in range(bands.shape[1] if at < 0 else at):
        both |= bands[:, k, None] == bands[None, :, k]
    if at >= 0:
        both = ~both & (bands[:, at, None] == bands[None, :, at])
    both &= np.triu(np.ones((n, n), bool), 1)
    if side.any():
        both &= side[:, None] != side[None, :]
    both &= np.minimum(sizes[:, None], sizes[None, :]) >= threshold * np.maximum(sizes[:, None], sizes[None, :])
    i, j = np.nonzero(both)
    if not len(i):
        return i, j
    if len(i) < 4 * n or n < 16:
        shared = np.fromiter((len(np.intersect1d(sets[a], sets[b], assume_unique=True)) for a, b in zip(i, j, strict=True)), np.int64, len(i))
    else:
        # Common members of all pairs at once: a product of 0/1 matrices over the n-grams that two sets or more have.
        # Sets are sorted, so the range of hashes is gone through in parts of about PART members.
        common = np.zeros((n, n), np.float32)
        parts = -(-int(sizes.sum()) // PART)
        ends = [np.uint64(k * (2**64 // parts)) for k in range(1, parts)]
        cuts = np.stack([np.concatenate([[0], np.searchsorted(s, ends), [len(s)]]) for s in sets])
        for k in range(parts):
            part = [s[c[k] : c[k + 1]] for s, c in zip(sets, cuts, strict=True)]
            value, column, count = np.unique(np.concatenate(part), return_inverse=True, return_counts=True)
            row = np.repeat(np.arange(n), [len(x) for x in part])
            use = count[column] > 1
            place = np.cumsum(count > 1) - 1
            row, column = row[use], place[column[use]]
            order = np.argsort(column, kind="stable")
            row, column = row[order], column[order]
            width = int(column[-1]) + 1 if len(column) else 0
            for at in range(0, width, WIDE):
                x, y = np.searchsorted(column, [at, at + WIDE])
                m = np.zeros((n, min(WIDE, width - at)), np.float32)
                m[row[x:y], column[x:y] - at] = 1
                common += m @ m.T
        shared = common[i, j].astype(np.int64)
    ok = shared >= threshold * (sizes[i] + sizes[j] - shared) - 1e-9
    return i[ok], j[ok]


def _verified(tiles: DataFrame, threshold: float) -> DataFrame:
    """Rows (grams, root, links): of each set in each tile, the least set it is tied to there and its number of links."""

    def run(batches):
        now, at, rows, out = None, -1, [], []

        def close():
            names = [r[0] for r in rows]
            i, j = _pairs(np.stack([r[1] for r in rows]), [np.frombuffer(r[2], np.uint64) for r in rows], np.array([r[3] for r in rows]), threshold, at)
            links = np.bincount(np.concatenate([i, j]), minlength=len(rows))
            up = list(range(len(rows)))

            def top(x):
                while up[x] != x:
                    up[x] = x = up[up[x]]
                return x

            for a, b in zip(i.tolist(), j.tolist(), strict=True):
                a, b = top(a), top(b)
                if a != b:
                    if names[b] < names[a]:
                        a, b = b, a
                    up[b] = a
            out.extend((names[k], names[top(k)], int(links[k])) for k in range(len(rows)) if links[k])

        def batch():
            cols = list(zip(*out, strict=True)) or [(), (), ()]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.binary(), pa.binary(), pa.int64()), strict=True)], names=["grams", "root", "links"])

        for b in batches:
            for part in range(0, b.num_rows, 256):
                cut = b.slice(part, 256)
                for group, x, y, band, grams, bands, members, side in zip(*(cut.column(c).to_pylist() for c in ("grp", "x", "y", "band", "grams", "bands", "members", "side")), strict=True):
                    if (group, x, y) != now:
                        if len(rows) > 1:
                            close()
                        now, at, rows = (group, x, y), band, []
                    rows.append((grams, np.array(bands, np.int64), members, side))
            if len(out) > 20_000:
                yield batch()
                out = []
        if len(rows) > 1:
            close()
        yield batch()
        rows, out = [], []
        give_back()

    return tiles.mapInArrow(run, "grams binary, root binary, links long")


def _gram_sets(texts: DataFrame, n: int) -> DataFrame:
    """``members`` binary (sorted 64-bit hashes) in place of ``text``."""
    keep = [c for c in texts.columns if c != "text"]

    def run(batches):
        grams = Grams(n)
        for block in blocks(batches, "text"):
            sets = [s.tobytes() for s in grams([x or "" for x in block.column("text").to_pylist()])]
            yield pa.RecordBatch.from_arrays([*(block.column(c) for c in keep), pa.array(sets, pa.binary())], names=[*keep, "members"])
        del grams
        give_back()

    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in texts.schema.fields if f.name != "text")
    return texts.mapInArrow(run, f"{kept}, members binary")


def _tiled(units: DataFrame, tile: int) -> DataFrame:
    """``units`` (with ``n``, the rows of their ``grp``) with a row for each tile (x, y) of their group that they are in, and their side in it."""
    n_blocks = F.when(F.col("n") <= tile, 1).otherwise(F.ceil(F.col("n") / (tile // 2))).cast("int")
    own = units.withColumn("n_blocks", n_blocks).withColumn("own", F.pmod(F.xxhash64("grams"), F.col("n_blocks")).cast("int"))
    return own.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("n_blocks") - 1))).select(
        "grp", F.least("own", "other").alias("x"), F.greatest("own", "other").alias("y"), "band", "grams", "bands", "members", (F.col("own") > F.col("other")).cast("int").alias("side")
    )


def _placed(docs: DataFrame, n: int, threshold: float, recall: float, tile: int, id_col: str, text_col: str) -> DataFrame:
    """Rows (id, key, root, n_links) for every row of ``docs``: the digest of its text, the set that stands for its class (null without words)."""
    bands, rows = bands_and_rows(threshold, recall)
    signed = written(signatures(docs, bands, rows, n, id_col, text_col), "signatures")

    # Distinct sets; of equal sets the first key stands for all.
    sets = signed.where("grams is not null").groupBy("grams").agg(F.min(F.struct("key", "bands")).alias("one"), F.count(F.lit(1)).alias("n_rows")).select("grams", "one.key", "one.bands", "n_rows")
    sets = written(sets, "distinct")
    ends = sets.select("grams", F.explode("bands").alias("mark"))
    leaders = ends.groupBy("mark").agg(F.min("grams").alias("leader"), F.count(F.lit(1)).alias("n")).where("n > 1")
    leaders = written(leaders, "leaders")
    ties = hot_join(ends, leaders, "mark", "n", "inner").where("grams <> leader").select(F.col("grams").alias("u"), F.col("leader").alias("v"))
    groups = components(ties, "candidates")

    found = written(sets.join(groups.withColumnRenamed("node", "grams"), "grams").withColumnRenamed("root", "grp"), "candidates")
    sized = written(hot_join(found, written(found.groupBy("grp").agg(F.count(F.lit(1)).alias("n")), "groups"), "grp", "n"), "sized")
    wanted = sized.select("key")
    if wanted.count() <= BROADCAST_ROWS:
        wanted = F.broadcast(wanted)
    texts = docs.select(F.col(text_col).alias("text"), text_key(F.col(text_col)).alias("key")).join(wanted, "key", "left_semi").groupBy("key").agg(F.first("text").alias("text"))
    full = _gram_sets(texts.join(sized, "key").select("text", "grams", "bands", "grp", "n"), n)
    if sized.where(F.col("n") > tile).isEmpty():
        units = full.withColumn("band", F.lit(-1))
    else:
        full = written(full, "sets")
        small = full.where(F.col("n") <= tile).withColumn("band", F.lit(-1))
        # Each set of a large group goes to its buckets that others are in as well.
        large = full.where(F.col("n") > tile).select("grams", "bands", "members", F.posexplode("bands").alias("band", "mark"))
        marks = written(large.groupBy("mark").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "buckets")
        bucketed = hot_join(large, marks, "mark", "n", "inner").select("grams", "bands", "members", F.concat(F.lit("bucket "), F.col("mark").cast("string")).cast("binary").alias("grp"), "n", "band")
        units = small.select(*bucketed.columns).unionByName(bucketed)
    dealt = _tiled(units, tile).repartition("grp", "x", "y").sortWithinPartitions("grp", "x", "y")
    links = written(_verified(dealt, threshold), "links")

    tied = components(links.select(F.col("grams").alias("u"), F.col("root").alias("v")), "classes")
    counted = links.groupBy("grams").agg(F.sum("links").alias("n_links")).where("n_links > 0")
    linked = counted.join(tied.select(F.col("node").alias("grams"), "root"), "grams", "left").select("grams", "n_links", F.coalesce("root", "grams").alias("root"))
    known = written(linked.join(sets.select("grams", "n_rows"), "grams"), "linked")
    placed = hot_join(signed.select("id", "key", "grams"), known, "grams", "n_rows")
    return written(placed.select("id", "key", F.coalesce("root", "grams").alias("root"), F.coalesce("n_links", F.lit(0)).alias("n_links")), "placed")


def ngram_classes(docs: DataFrame, n: int = N, threshold: float = THRESHOLD, recall: float = RECALL, tile: int = TILE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (id, class_id, n_links long, class_size long) for every row of ``docs``."""
    placed = _placed(docs, n, threshold, recall, tile, id_col, text_col)
    # Most classes have one row, which needs no other's word.
    classes = placed.where("root is not null").groupBy("root").agg(F.min("id").alias("class_id"), F.count(F.lit(1)).alias("class_size")).where("class_size > 1")
    return hot_join(placed, written(classes, "sizes"), "root", "class_size").select(
        F.col("id").alias(id_col), F.when(F.col("class_size").isNull(), F.col("id")).otherwise(F.col("class_id")).alias("class_id"), "n_links", F.coalesce("class_size", F.lit(1)).alias("class_size")
    )


def one_of_each_class(docs: DataFrame, n: int = N, threshold: float = THRESHOLD, recall: float = RECALL, tile: int = TILE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The row of least id of each class (any one, if all ids are null), and all rows without words; with all columns of ``docs``."""
    placed = _placed(docs, n, threshold, recall, tile, id_col, text_col)
    first = placed.where("root is not null").groupBy("root").agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", "key")).alias("m"))
    kept = written(first.select(F.col("m.id").alias("id"), F.col("m.key").alias("key")), "kept")
    rows = packed(docs, text_col).select("row", "text", F.col(f"row.`{id_col}`").alias("id"), text_key(F.col("text")).alias("key"))
    # Rows of one id and text are repeats of one row, of which one stays; with null ids there is nothing else to tell them apart.
    ones = rows.join(kept.hint("merge"), rows["key"].eqNullSafe(kept["key"]) & rows["id"].eqNullSafe(kept["id"]), "left_semi")
    if not placed.where("root is not null").groupBy("id", "key").count().where("count > 1").isEmpty():
        ones = ones.dropDuplicates(["id", "key"])
    wordless = placed.where("root is null").select("key").distinct()
    if wordless.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        wordless = F.broadcast(wordless)
    both = ones.select("row", "text").unionByName(rows.join(wordless, "key", "left_semi").select("row", "text"))
    return unpacked(both, docs.columns, text_col)

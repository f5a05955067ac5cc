"""Benchmark decontamination by spaced seeds.

A mask is a short pattern of positions; at every place of a text the words at the mask's ones are hashed and joined with
the same hashes of the benchmark items, so a hit survives changed words at the mask's zeros.  At each hit the item is
laid over the text and the words that agree are counted: the text is contaminated if a window of ``WINDOW`` words of the
item (or the whole item, if shorter) agrees in at least ``AGREE`` of its words.  DataFrame functions only.

What is broadcast is a counted table of (item, place, seed, size), of bounded width; the words of items are joined afterwards,
only to hits, and are broadcast only if all of them have a bounded size.  With more seeds than that, places and seeds are shuffled, and a seed that many places share is split.

Defined results: words are runs of letters and digits in lower case; null and empty texts and items hit nothing; items of
fewer words than the shortest mask are found where all their words stand together; items of fewer than ``EXACT`` words must
agree in all words; repeated documents give one row for each (id, item); extra columns are ignored, and kept by :func:`clean_documents`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, packed, salted_join, text_key, unpacked, written

#: Five words each; the first, without gaps, also finds items of five words.  Fixed values.
MASKS = ("11111", "1101011", "11001101", "101100011")
WINDOW, AGREE, EXACT = 13, 0.8, 8
#: Words (8 bytes each) of all items that are broadcast at most.
BROADCAST_WORDS = 4_000_000


def words(text: Column) -> Column:
    """The words of a text; a text without any has an empty array."""
    return F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), "[^\\p{L}\\p{N}]++"), "")


def _hashed(text: Column) -> Column:
    """The 64-bit hashes of the words of a text."""
    return F.transform(words(text), lambda w: F.xxhash64(w))


def _seeds(df: DataFrame, masks, whole: list[int]) -> DataFrame:
    """``df`` (with an array column ``w``) with a row for each place (from 0) and mask that fits: columns ``at``, ``seed``.

    ``whole``: lengths of short items, each a mask without gaps; which mask made a seed is part of it, so a seed of a short
    item is met by such a mask only.  The outer form of explode and no filter below it: else the words would be cut out once
    more to count them.
    """
    every = [(k, m) for k, m in enumerate(masks)] + [(-n, "1" * n) for n in whole]
    least = min(len(m) for _, m in every)
    places = df.withColumn("at", F.explode_outer(F.when(F.size("w") >= least, F.sequence(F.lit(0), F.size("w") - least))))
    seed = lambda m, k: F.xxhash64(F.lit(k), *(F.get("w", F.col("at") + i) for i, c in enumerate(m) if c == "1"))
    hashed = (F.when(F.col("at") + len(m) <= F.size("w"), seed(m, k)) for k, m in every)
    return places.withColumn("seed", F.explode_outer(F.array(*hashed)))


def contaminated(docs: DataFrame, benchmark: DataFrame, masks=MASKS, window: int = WINDOW, agree: float = AGREE, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """Rows (id, item, n_agree, n_overlap long, share double): for each contaminated document and item the best overlap.

    ``n_overlap`` counts the item's words that lie over the text, ``n_agree`` those that are equal, ``share`` is the best
    window's part of equal words.
    """
    items = written(benchmark.select(F.col(item_col).alias("item"), _hashed(F.col(item_text_col)).alias("w")).where("size(w) > 0"), "items")
    shortest = min(map(len, masks))
    whole = sorted(r[0] for r in items.where(F.size("w") < shortest).select(F.size("w")).distinct().collect())
    seeds = _seeds(items.where(F.size("w") >= shortest), masks, []).where("seed is not null")
    if whole:
        own = F.coalesce(*(F.when(F.size("w") == n, F.xxhash64(F.lit(-n), *(F.get("w", F.lit(i)) for i in range(n)))) for n in whole))
        seeds = seeds.unionByName(items.where(F.size("w") < shortest).withColumn("at", F.lit(0)).withColumn("seed", own))
    seeds = written(seeds.select("item", F.col("at").alias("item_at"), "seed", F.size("w").alias("n")), "seeds")
    if seeds.count() <= BROADCAST_ROWS:
        # One pass: places are made, hashed and probed in one generated loop, which refers to a text's words in place.
        texts = docs.select(F.col(id_col).alias("id"), _hashed(F.col(text_col)).alias("w"))
        hits = _seeds(texts, masks, whole).join(F.broadcast(seeds), "seed")
    else:
        # Too many seeds for memory: only places and seeds are shuffled; the texts with hits get their words back by key.
        keyed = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("t"), text_key(F.col(text_col)).alias("key"))
        places = written(_seeds(keyed.select("key", _hashed(F.col("t")).alias("w")), masks, whole).where("seed is not null").select("key", "at", "seed").distinct(), "places")
        met = places.groupBy("seed").agg(F.count(F.lit(1)).alias("n_places"))
        found = salted_join(places, written(seeds.join(met, "seed"), "met"), "seed", "n_places")
        found = found.select("key", "item", (F.col("at") - F.col("item_at")).alias("at"), F.lit(0).alias("item_at"), "n").distinct()
        hits = keyed.join(found, "key").select("id", _hashed(F.col("t")).alias("w"), "item", "at", "item_at", "n")
    # The item begins at ``start`` of the text, which may be before the text does.
    start = F.col("at") - F.col("item_at")
    skip = F.greatest(-start, F.lit(0))
    laid = hits.select("id", "item", "n", skip.alias("skip"), F.slice("w", F.greatest(start, F.lit(0)) + 1, F.col("n") - skip).alias("a")).distinct()
    # Written: what follows cannot be pushed down into the loop above.
    laid = written(laid, "overlaps")
    words = items.select("item", F.col("w").alias("b"))
    if (items.agg(F.sum(F.size("w"))).first()[0] or 0) <= BROADCAST_WORDS:
        met = laid.join(F.broadcast(words), "item")
    else:
        met = salted_join(laid, written(words.join(laid.groupBy("item").agg(F.count(F.lit(1)).alias("n_hits")), "item"), "hit-items"), "item", "n_hits")
    equal = met.withColumn("e", F.zip_with("a", F.slice("b", F.col("skip") + 1, F.size("a")), lambda x, y: (x == y).cast("int")))
    size = F.least(F.col("n"), F.lit(window))
    total = lambda x: F.aggregate(x, F.lit(0), lambda s, v: s + v)
    best = F.when(
        F.size("e") >= size,
        F.array_max(F.transform(F.sequence(F.lit(1), F.size("e") - size + 1), lambda i: total(F.slice("e", i, size)))),
    )
    need = F.when(size < EXACT, size).otherwise(F.ceil(size * agree))
    judged = equal.select("id", "item", F.size("e").alias("n_overlap"), total(F.col("e")).alias("n_agree"), best.alias("best"), size.alias("size"), need.alias("need")).where("best >= need")
    top = F.max(F.struct("n_agree", "n_overlap", (F.col("best") / F.col("size")).alias("share"))).alias("t")
    return judged.groupBy("id", "item").agg(top).select(
        F.col("id").alias(id_col), F.col("item").alias(item_col), F.col("t.n_agree").cast("long").alias("n_agree"), F.col("t.n_overlap").cast("long").alias("n_overlap"), F.col("t.share").alias("share")
    )


def clean_documents(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", **parameters) -> DataFrame:
    """The rows of ``docs`` whose text holds no benchmark item; rows with equal texts fare alike, whatever their ids are."""
    rows = packed(docs, text_col).select("row", "text", text_key(F.col("text")).alias("key"))
    found = contaminated(rows.select("key", "text"), benchmark, id_col="key", text_col="text", **parameters).select("key").distinct()
    found = written(found, "contaminated")
    if found.count() <= BROADCAST_ROWS:
        found = F.broadcast(found)
    return unpacked(rows.join(found, "key", "left_anti"), docs.columns, text_col)

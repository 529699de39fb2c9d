"""Benchmark decontamination by spaced seeds, with DataFrame functions alone.

Both sides become words: lower case, runs of other than letters and digits as one space. A mask names the word
positions that count; a seed is the hash of a window's words at these positions, so words at the others may differ.
Benchmark seeds are joined with the seeds of every window of every document. A hit names a document, an item and the
shift between them; around it the aligned words are compared one by one, and a document is contaminated by an item if
some window of 13 aligned words (the whole item, if it is shorter) has 80 % or more of them equal. The two default
masks leave no such window without a hit, whichever words were replaced.

Seeds are told apart in the scan: hits leave it as partial aggregates by document, item and shift, so repeated phrases
do not multiply. The benchmark's seeds are broadcast only up to a bound of rows, and else joined by a shuffle.

Masks promise nothing for items of fewer than 13 words. Such an item may lack a fifth of its words, so it is cut into
one part more than that; one part must occur in full, and the parts are its seeds, by masks of their lengths. One pass
over the documents makes the seeds of all masks; a second makes words again for documents with a hit alone.

Defined cases: null and empty texts match nothing; rows that repeat an id count as one document or item, those without
an id too; decontaminate() decides by row, whatever its id; empty tables give no rows; further columns are ignored, or
kept by decontaminate().
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bounded, numbered, stage, words_of

#: Positions of a window that count: no two replaced words in 13 escape both.
MASKS = ((0, 1, 2, 4, 6, 7), (0, 1, 4, 5, 6, 7))
WINDOW, SHARE = 13, 80
#: Rows of benchmark seeds that may be broadcast.
SEED_ROWS = 1_000_000


def _words(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return df.select(F.col(id_col).alias("id"), F.filter(F.split(words_of(F.col(text_col)), " "), lambda w: w != "").alias("w"))


def _seeds(df: DataFrame, masks: list[tuple[int, ...]]) -> DataFrame:
    """id, at (from 0), mask, seed: one row for each mask and place where its last position is still within the words."""
    span = 1 + max(m[-1] for m in masks)
    hashed = df.select("id", F.transform("w", lambda w: F.xxhash64(w)).alias("h"))
    shifted = [F.col("h") if k == 0 else F.slice("h", k + 1, F.greatest(F.size("h"), F.lit(1))) for k in range(span)]
    rows = hashed.where(F.size("h") > min(m[-1] for m in masks)).select("id", F.posexplode(F.arrays_zip(*[x.alias(f"h{k}") for k, x in enumerate(shifted)])).alias("at", "z"))
    seeds = [F.when(F.col(f"z.h{m[-1]}").isNotNull(), F.struct(F.lit(i).alias("mask"), F.xxhash64(F.lit(i), *[F.col(f"z.h{k}") for k in m]).alias("seed"))) for i, m in enumerate(masks)]
    short = min(m[-1] for m in masks)
    return rows.where(F.col(f"z.h{short}").isNotNull()).select("id", "at", F.inline(F.array_compact(F.array(*seeds))))


def _hits(docs: DataFrame, items: DataFrame, masks: tuple, window: int, share: int) -> DataFrame:
    """id, item, shift: where a document and an item have a seed in common."""
    long = _seeds(items.where(F.size("w") >= window), list(masks))
    parts = stage(_parts(items.where(F.size("w").between(1, window - 1)), share), "parts")
    lengths = sorted(r[0] for r in parts.select("length").distinct().collect())  # below the window's
    every = [*masks, *(tuple(range(n)) for n in lengths)]
    known = long.select(F.col("id").alias("item"), F.col("at").alias("from"), "mask", "seed")
    for i, n in enumerate(lengths):
        # The number of a mask is part of its seeds.
        hashed = F.xxhash64(F.lit(len(masks) + i), *[F.xxhash64(F.col("w")[k]) for k in range(n)])
        own = parts.where(F.col("length") == n).select(F.col("id").alias("item"), "from", F.lit(len(masks) + i).alias("mask"), hashed.alias("seed"))
        known = known.unionByName(own)
    known = stage(known.distinct(), "seeds")
    if known.count() <= SEED_ROWS:
        known = F.broadcast(known)
    return _seeds(docs, every).join(known, ["mask", "seed"]).select("id", "item", (F.col("at") - F.col("from")).alias("shift")).distinct()


def _parts(short: DataFrame, share: int) -> DataFrame:
    """id, from, length, w: the parts of short items, in one of which no word may differ."""
    n = F.size("w")
    cut = short.withColumn("parts", n - F.ceil(n * share / 100).cast("int") + 1).withColumn("k", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    cut = cut.withColumn("from", F.floor(F.col("k") * n / F.col("parts")).cast("int"))
    cut = cut.withColumn("length", F.floor((F.col("k") + 1) * n / F.col("parts")).cast("int") - F.col("from"))
    return cut.select("id", "from", "length", F.slice("w", F.col("from") + 1, F.col("length")).alias("w"))


def _equal(a: str, b: str) -> Column:
    return F.zip_with(a, b, lambda x, y: F.when(x.eqNullSafe(y) & x.isNotNull(), 1).otherwise(0))


def overlaps(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", item_col: str = "item_id", text_col: str = "text", masks: tuple = MASKS, window: int = WINDOW, share: int = SHARE) -> DataFrame:
    """One row for each document and item that contaminates it: matched_words of item_words aligned, and where."""
    item_words = stage(_words(items, item_col, text_col), "items")
    hits = bounded(_hits(_words(docs, id_col, text_col), item_words, masks, window, share), "hits")
    with_hit = bounded(hits.select("id").distinct(), "with_hit")
    # Words are made again for documents with a hit alone, and each hit takes no more of them than the item's length.
    some = docs.select(F.col(id_col).alias("own"), F.col(text_col).alias("text"))
    again = _words(some.join(with_hit, F.col("own").eqNullSafe(F.col("id")), "left_semi"), "own", "text").withColumnRenamed("id", "own")
    iw = item_words.toDF("it", "iw")
    aligned = again.join(hits, F.col("own").eqNullSafe(F.col("id"))).join(iw, F.col("item").eqNullSafe(F.col("it")))
    first, last = F.greatest(F.col("shift"), F.lit(0)), F.least(F.col("shift") + F.size("iw"), F.size("w"))
    aligned = aligned.select(
        "id", "item", "shift", F.size("iw").alias("n"),
        F.slice("iw", (first - F.col("shift") + 1).cast("int"), (last - first).cast("int")).alias("x"),
        F.slice("w", (first + 1).cast("int"), (last - first).cast("int")).alias("y"),
    )
    eq = aligned.withColumn("eq", _equal("x", "y")).withColumn("wide", F.least(F.lit(window), F.col("n")))
    starts = F.sequence(F.lit(1), F.size("eq") - F.col("wide") + 1)
    sums = F.transform(starts, lambda s: F.aggregate(F.slice("eq", s, F.col("wide")), F.lit(0), lambda a, b: a + b))
    scored = eq.where(F.size("eq") >= F.col("wide")).withColumn("best", F.array_max(sums)).where(100 * F.col("best") >= share * F.col("wide"))
    matched = F.aggregate("eq", F.lit(0), lambda a, b: a + b)
    one = scored.groupBy("id", "item").agg(F.max(F.struct(matched.alias("m"), (-F.col("shift")).alias("s"), "n")).alias("r"))
    return one.select(
        F.col("id").alias(id_col), F.col("item").alias(item_col), F.col("r.m").cast("bigint").alias("matched_words"),
        F.col("r.n").cast("bigint").alias("item_words"), (-F.col("r.s")).cast("bigint").alias("word_shift"),
    )


def decontaminate(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", item_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """The rows of docs that no item contaminates, with all their columns."""
    rows, row = numbered(docs, id_col)
    found = bounded(overlaps(rows, items, row, item_col, text_col).select(row).distinct(), "contaminated")
    return rows.join(found, row, "left_anti").select(*docs.columns)

"""Exact deduplication by content-defined chunk recipes.

A text's white space runs become single spaces, a windowed hash of its bytes cuts it into chunks, and each chunk gets
a fingerprint and an independent check digest. Chunk fingerprints are deduplicated over the corpus: where one
fingerprint stands for chunks with different check digests, the digest joins the identifier, so an identifier is one
chunk content. Two texts are equal when their ordered identifier lists are: these lists are what texts are grouped by.
Texts themselves are never shuffled, only 8 bytes (and a check digest) for each chunk of some 1.5 KB. SHA-256 of the
whole text decides nothing; a group with two of them stops the run.

Defined cases: null text counts as empty; empty texts equal each other; of equal texts the smallest id that is not null
stays (null where all are), of rows with equal text and id too all carry the same decision; an empty table gives no
rows; further columns of the input are ignored, or kept by deduplicate().
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded, free_name, map_arrow, stage

MIN_CHUNK, MASK_BITS, MAX_CHUNK, WINDOW = 512, 10, 8192, 32
_TO_SPACE = bytes(32 if 9 <= b <= 13 else b for b in range(256))
_GEAR = np.array([xxhash.xxh64_intdigest(bytes([b]), seed=7) & 0xFFFFFFFF for b in range(256)], dtype=np.uint32)


def normalise(data: bytes) -> bytes:
    """Each run of white space as one space."""
    data = data.translate(_TO_SPACE)
    while b"  " in data:
        data = data.replace(b"  ", b" ")
    return data


def cut_points(data: bytes) -> list[int]:
    """Ends of the chunks of data: where the hash of the last 32 bytes has its high bits zero, within the bounds."""
    n = len(data)
    if n <= MIN_CHUNK:
        return [n]
    h = _GEAR[np.frombuffer(data, np.uint8)]
    width = 1
    while width < WINDOW:  # the hash of 2w bytes from those of w bytes
        wide = h.copy()
        wide[width:] += h[:-width] << np.uint32(width)
        h, width = wide, 2 * width
    ends, last = [], 0
    for at in np.flatnonzero(h >> np.uint32(32 - MASK_BITS) == 0).tolist():
        at += 1
        while at - last > MAX_CHUNK:
            last += MAX_CHUNK
            ends.append(last)
        if at - last >= MIN_CHUNK and at < n:
            ends.append(at)
            last = at
    while n - last > MAX_CHUNK:
        last += MAX_CHUNK
        ends.append(last)
    return [*ends, n]


def recipes(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each row's chunk fingerprints and check digests, in order, and the SHA-256 of its normalised text."""

    def of(batch: pa.RecordBatch) -> dict:
        prints, checks, whole = [], [], []
        for value in batch.column(1):
            data = normalise(value.as_py() or b"")
            whole.append(hashlib.sha256(data).hexdigest())
            start, fp, check = 0, [], []
            for end in cut_points(data):
                chunk = data[start:end]
                fp.append(xxhash.xxh64(chunk).digest())
                check.append(hashlib.blake2b(chunk, digest_size=16).digest())
                start = end
            prints.append(b"".join(fp))
            checks.append(b"".join(check))
        return {"id": batch.column(0), "prints": prints, "checks": checks, "text_sha256": whole}

    kind = df.schema[id_col].dataType.simpleString()
    read = df.select(F.col(id_col).alias("id"), F.col(text_col).cast("binary").alias("text"))
    return map_arrow(read, of, f"id {kind}, prints binary, checks binary, text_sha256 string")


def _pieces(name: str, width: int):
    return F.expr(f"transform(sequence(1, octet_length({name}), {width}), i -> substring({name}, i, {width}))")


def exact_groups(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: its id, keep_id, group_size, kept, text_sha256."""
    docs = stage(recipes(df, id_col, text_col), "recipes")
    chunks = docs.select(F.explode(F.arrays_zip(_pieces("prints", 8).alias("fp"), _pieces("checks", 16).alias("ck"))).alias("c"))
    # A fingerprint with two check digests does not identify a chunk; documents that hold one are keyed by digest.
    unclear = chunks.groupBy("c.fp").agg(F.min("c.ck").alias("lo"), F.max("c.ck").alias("hi")).where("lo <> hi").select("fp")
    unclear = stage(unclear, "unclear")
    if unclear.isEmpty():
        docs = docs.withColumn("recipe", F.col("prints"))
    else:
        held = docs.select("prints", F.explode(_pieces("prints", 8)).alias("fp")).join(unclear, "fp", "left_semi").select("prints").distinct()
        docs = docs.join(held.withColumn("held", F.lit(True)), "prints", "left").withColumn(
            "recipe", F.when(F.col("held"), F.concat("prints", "checks", F.lit(b"+"))).otherwise(F.col("prints"))
        )
    # Copies meet as partial aggregates; only texts that occur twice go back to the rows.
    sha = F.xxhash64("text_sha256")
    one = F.when(F.min(sha) == F.max(sha), F.count("*")).otherwise(F.raise_error(F.lit("one recipe has two texts")).cast("bigint"))
    several = docs.groupBy("recipe").agg(F.min("id").alias("keep_id"), one.alias("group_size")).where("group_size > 1")
    joined = docs.join(bounded(several, "several", 200_000), "recipe", "left")
    keep = F.when(F.col("group_size").isNull(), F.col("id")).otherwise(F.col("keep_id"))
    return joined.select(
        F.col("id").alias(id_col),
        keep.alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("bigint").alias("group_size"),
        F.col("id").eqNullSafe(keep).alias("kept"),
        "text_sha256",
    )


def deduplicate(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of df that stay, with all their columns. Of fully repeated rows (same id and text) one stays."""
    groups = stage(exact_groups(df, id_col, text_col), "groups").where("group_size > 1")
    own, sha, copy = (free_name(df, n) for n in ("id", "sha", "copy"))
    keys = [F.col(id_col).alias(own), F.col("text_sha256").alias(copy)]
    drop = bounded(groups.where(~F.col("kept")).select(*keys).distinct(), "dropped", 200_000)
    twice = groups.where("kept").groupBy(id_col, "text_sha256").count().where("count > 1").select(*keys)
    twice = bounded(twice, "twice", 200_000)
    ids = bounded(drop.select(own).unionByName(twice.select(own)).distinct(), "ids")

    @F.pandas_udf("string")
    def digest(texts: pd.Series) -> pd.Series:
        return texts.map(lambda x: hashlib.sha256(normalise(x or b"")).hexdigest())

    def joined(left: DataFrame, right: DataFrame, how: str) -> DataFrame:
        same = left[id_col].eqNullSafe(right[own])
        return left.join(right, same & (left[sha] == right[copy]) if copy in right.columns else same, how)

    # An id may stand for several texts: only rows with an id that has copies are hashed again, and decided by both.
    asked = joined(df, ids, "left_semi").withColumn(sha, digest(F.col(text_col).cast("binary")))
    asked = joined(asked, drop, "left_anti")
    stay = joined(df, ids, "left_anti")
    if twice.isEmpty():
        return stay.unionByName(asked.drop(sha))
    again = joined(asked, twice, "left_semi").dropDuplicates([id_col, sha])
    return stay.unionByName(joined(asked, twice, "left_anti").drop(sha)).unionByName(again.drop(sha))

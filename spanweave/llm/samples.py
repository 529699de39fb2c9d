"""A bounded sample of labelled rows for the classifiers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bytes of text that a sample holds at most.
SAMPLE_BYTES = 64 << 20


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, learn: Column, limit: int, id_col: str = "doc_id", text_col: str = "text", most: int = SAMPLE_BYTES) -> list[tuple[str, int]]:
    """At most limit (text, label) rows for which learn holds, half of each label as far as there are so many.

    Rows are taken in the order of a hash of their id, so the choice does not depend on how tables are laid out; a row
    whose text would take the sample beyond so many bytes is left out. An id is one row: of several texts, the shortest,
    and of these the first in order. Only the ids of the sample, at most limit, are broadcast; documents that are not in
    it are not shuffled.
    """
    known = labels.where(F.col(label).isin(0, 1) & F.col(id_col).isNotNull() & learn).groupBy(id_col).agg(F.max(label).alias("y"))
    order = [F.xxhash64(id_col), F.col(id_col)]
    half = limit // 2
    chosen = known.where("y = 0").orderBy(*order).limit(half).unionByName(known.where("y = 1").orderBy(*order).limit(half))
    ids = chosen.collect()
    if not ids:
        return []
    spark, kind = docs.sparkSession, chosen.schema
    read = docs.select(id_col, F.coalesce(F.col(text_col), F.lit("")).alias("text")).withColumn("size", F.octet_length("text"))
    sized = read.join(F.broadcast(spark.createDataFrame(ids, kind)), id_col).groupBy(id_col, "y").agg(F.min("size").alias("size"))
    fits, total = [], 0
    for r in sized.orderBy(*order).collect():
        if total + r["size"] <= most:
            total += r["size"]
            fits.append((r[id_col], r["y"], r["size"]))
    if not fits:
        return []
    small = spark.createDataFrame(fits, sized.select(id_col, "y", "size").schema)
    rows = read.join(F.broadcast(small), [id_col, "size"]).groupBy(id_col, "y").agg(F.min("text").alias("text")).collect()
    rows.sort(key=lambda r: r[id_col])
    return [(r["text"], int(r["y"])) for r in rows]

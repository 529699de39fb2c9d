"""Helpers that the operators of this folder share: staging, text access, scratch folders."""

from __future__ import annotations

import gc
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StructType

from ..runtime import scratch_dir, ship_package

#: Space, tab, line feed, vertical tab, form feed and carriage return.
WHITE = r"[\x20\x09-\x0D]+"

def stage(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet to the shared folder and read it back: lineage is cut, a lost executor costs a reread."""
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/{name}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def release_shuffles(spark: SparkSession) -> None:
    """Let the files of shuffles that staged tables have replaced go now, not when the driver next collects garbage."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def free_name(df: DataFrame, name: str) -> str:
    """A column name that df does not have (in any case)."""
    used = {c.lower() for c in df.columns}
    while name.lower() in used:
        name += "_"
    return name


def numbered(df: DataFrame, id_col: str) -> tuple[DataFrame, str]:
    """df with a column of unique numbers and its name: the ids, if they are unique, else a new one (staged)."""
    ids = df.select(F.col(id_col).cast("bigint").alias("id")).groupBy("id").count()
    if ids.where("id is null or count > 1").isEmpty():
        return df, id_col
    name = free_name(df, "row")
    return stage(df.withColumn(name, F.monotonically_increasing_id()), "numbered"), name


def crc32_mod(id_column: str, divisor: int) -> Column:
    """crc32 of an id written as decimal text, modulo divisor; a null id counts as 0."""
    return F.coalesce(F.crc32(F.col(id_column).cast("string").cast("binary")), F.lit(0)) % F.lit(divisor)


def words_of(text: Column) -> Column:
    """Lower-cased runs of letters and digits, separated by one space; null counts as empty."""
    return F.trim(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+", " "))


def texts(column: pa.Array | pa.ChunkedArray) -> Iterator[str]:
    """The strings of an Arrow column one at a time; null counts as empty."""
    for value in column:
        yield value.as_py() or ""


def map_arrow(df: DataFrame, function, schema: str, keeps: bool = False) -> DataFrame:
    """mapInArrow for functions from one record batch to a dict of columns (numpy arrays or lists).

    keeps: the function uses worker_cache; else what another operator kept there is let go.
    """
    from pyspark.sql.types import _parse_datatype_string
    from pyspark.sql.pandas.types import to_arrow_schema

    ship_package(df.sparkSession)
    target = to_arrow_schema(_parse_datatype_string(schema))

    def run(batches):
        if not keeps:
            forget()
        for batch in batches:
            columns = function(batch)
            yield pa.RecordBatch.from_arrays(
                [x if isinstance(x := columns[f.name], pa.Array) else pa.array(x, f.type) for f in target], schema=target
            )

    return df.mapInArrow(run, schema)


#: Rows and bytes of a table that may be broadcast.
BROADCAST_ROWS, BROADCAST_BYTES = 500_000, 64 << 20


def width(df: DataFrame) -> Column:
    """Bytes of a row, about: strings, binaries and arrays by their length."""
    total = F.lit(0).cast("bigint")
    for f in df.schema.fields:
        kind, c = f.dataType, F.col(f"`{f.name}`")
        if kind.simpleString() in ("string", "binary"):
            total += F.coalesce(F.octet_length(c), F.lit(0))
        elif isinstance(kind, ArrayType):
            each = 8 * len(kind.elementType.fields) if isinstance(kind.elementType, StructType) else 8
            total += each * F.greatest(F.coalesce(F.size(c), F.lit(0)), F.lit(0))
        else:
            total += 8
    return total


def bounded(df: DataFrame, name: str, rows: int = BROADCAST_ROWS) -> DataFrame:
    """Stage a table; mark it for broadcast if its rows and bytes are within the bounds, else leave it to a shuffled join."""
    df = stage(df, name)
    n, size = df.agg(F.count("*"), F.sum(width(df))).first()
    return F.broadcast(df) if n <= rows and (size or 0) <= BROADCAST_BYTES else df


_KEPT: dict[str, object] = {}


def forget() -> None:
    _KEPT.clear()


def worker_cache(key: str, make):
    """What a worker process keeps between its batches and tasks: one thing, that of the operator at work.

    Workers live on from operator to operator, so what the one before kept is let go first.
    """
    if key not in _KEPT:
        _KEPT.clear()
        _KEPT[key] = make()
    return _KEPT[key]

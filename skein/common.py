"""Session helpers shared by all operators."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Rows and bytes (text and array elements counted as they are long) up to which a side may be broadcast.
BROADCAST_ROWS, BROADCAST_BYTES = 500_000, 64 << 20


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """The Parquet table ``name`` of a data folder."""
    return spark.read.parquet(f"{folder}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, from ``spark.checkpoint.dir`` or ``SKEIN_CHECKPOINT_DIR``.

    Only a session in this very process (a local master, as in tests) may go without: it gets
    a temporary folder, removed when the process ends. On a cluster that would be an error.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir() or os.environ.get("SKEIN_CHECKPOINT_DIR")
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        found = tempfile.mkdtemp(prefix="skein-")
        atexit.register(shutil.rmtree, found, ignore_errors=True)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(found)
    return found


def cut(df: DataFrame) -> DataFrame:
    """Cut the lineage: write the rows to the shared folder and read them back."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def _width(field: T.StructField) -> F.Column:
    c = F.col(f"`{field.name}`")
    if isinstance(field.dataType, T.StringType):
        return F.coalesce(F.octet_length(c), F.lit(0)) + 16
    if isinstance(field.dataType, T.ArrayType):
        return F.coalesce(F.octet_length(c.cast("string")), F.lit(0)) + 16
    return F.lit(16)


def is_small(df: DataFrame, rows: int = BROADCAST_ROWS, most: int = BROADCAST_BYTES) -> bool:
    """Whether a side is measured to have at most ``rows`` rows and ``most`` bytes; one job, of
    no more than ``rows`` rows."""
    size = sum((_width(f) for f in df.schema.fields), F.lit(0))
    n, held = df.limit(rows + 1).select(size.cast("long").alias("b")).agg(F.count("*"), F.coalesce(F.sum("b"), F.lit(0))).first()
    return n <= rows and held <= most


def broadcast_if_small(df: DataFrame, rows: int = BROADCAST_ROWS, most: int = BROADCAST_BYTES) -> DataFrame:
    """Hint a broadcast only of a side that :func:`is_small`. The side is computed once more
    when it is used, so give it a written table (:func:`cut`) or a cheap one."""
    return F.broadcast(df) if is_small(df, rows, most) else df


def instant(col) -> F.Column:
    """Microseconds since the epoch of an RFC 3339 string; null if it is none."""
    c = F.col(col) if isinstance(col, str) else col
    return F.unix_micros(c.try_cast("timestamp"))


def latest(df: DataFrame, key: str, by: str = "loaded_at") -> DataFrame:
    """One row per ``key``, the one with the greatest ``by``.

    Rows delivered again count once. Equal rows are merged by the hash aggregate
    before the shuffle. A null key is a key like any other.
    """
    rest = [c for c in df.columns if c != key]
    order = F.struct(by, F.xxhash64(*[c for c in rest if c != by]).alias("_h"))  # of equally late rows always the same
    best = df.groupBy(key).agg(F.max_by(F.struct(*rest), order).alias("_row"))
    return best.select(key, *[F.col("_row")[c].alias(c) for c in rest])



def with_places(df: DataFrame) -> DataFrame:
    """A Parquet table with the place of every row: hash of the file's path, row number."""
    return df.withColumns({"_file": F.xxhash64("_metadata.file_path"), "_row": F.col("_metadata.row_index")})


def repeated(rows: DataFrame, keys: list[str]) -> DataFrame:
    """The rows whose keys occur more than once, written. Null keys are keys like any other."""
    many = cut(rows.groupBy(*keys).count().filter("count > 1").select(*[F.col(k).alias(f"_{n}") for n, k in enumerate(keys)]))
    same = F.lit(True)
    for n, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"_{n}"))
    return cut(rows.join(broadcast_if_small(many), same, "left_semi"))


def outdated(placed: DataFrame, key: str, by: str) -> DataFrame:
    """(_file, _row), written: the rows of a table with places that are not the latest of their
    key. Only the key columns are read; of equally late rows the first by place stands."""
    again = repeated(placed.select("_file", "_row", F.col(key).alias("_key"), F.col(by).alias("_by")), ["_key"])
    best = again.groupBy("_key").agg(F.max_by(F.struct("_file", "_row"), F.struct("_by", F.bitwise_not("_file"), F.bitwise_not("_row"))).alias("w"))
    return cut(again.select("_file", "_row").join(best.select("w._file", "w._row"), ["_file", "_row"], "left_anti"))


def without(placed: DataFrame, places: DataFrame) -> DataFrame:
    """The rows of a table with places but those at the written ``places``."""
    return placed.join(broadcast_if_small(places), ["_file", "_row"], "left_anti")


def once(df: DataFrame, key: str, by: str = "loaded_at") -> DataFrame:
    """One row per ``key`` of a Parquet table, the one with the greatest ``by``: rows delivered
    again are few, so they are told by key columns alone and left out of the scan, and nothing
    else is shuffled. Of other tables as :func:`latest`. A null key is a key like any other."""
    try:
        placed = with_places(df)
        placed.schema  # noqa: B018 - tells whether rows have places
    except AnalysisException:
        return latest(df, key, by)
    return without(placed, outdated(placed, key, by)).drop("_file", "_row")


def ranked(df: DataFrame, *order: str, name: str = "rank") -> DataFrame:
    """Rows numbered from 1 in an order, without a task that holds them all: each partition of
    a range is numbered, written, and moved by the rows of the ranges before (one row each)."""
    parts = df.repartitionByRange(*order).sortWithinPartitions(*order)
    # the row's place in its partition are the lower 33 bits
    placed = cut(parts.withColumns({"_part": F.spark_partition_id(), "_at": F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)}))
    sizes = placed.groupBy("_part").agg(F.count("*").alias("_n"))
    before = sizes.select("_part", (F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).alias("_base"))
    return placed.join(F.broadcast(before), "_part").withColumn(name, F.col("_base") + F.col("_at") + 1).drop("_part", "_at", "_base")

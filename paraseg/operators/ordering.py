"""Dense positions in a global order, without sorting everything in one task.

A top-k would send ``limit`` rows of every task to a single one, which at many
thousand tasks is more than the answer needs by far. Here rows are counted in a
fixed number of ordered buckets first; the running totals tell which buckets a
limit needs, and only their rows are shuffled and sorted.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from paraseg.session import broadcast_if_small, written

# Hash prefixes of four hex digits: 65 536 buckets of even size.
PREFIX_DIGITS = 4
# Leading bits of a number kept in its bucket: at most 64 * 1 024 buckets.
LEADING_BITS = 10


def _with_starts(df: DataFrame, limit: int | None) -> DataFrame:
    """Add ``_start``, the number of rows in earlier buckets; keep what ``limit`` needs."""
    before = Window.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = df.groupBy("_bucket").count().select(
        "_bucket", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_start")
    )
    if limit is not None:
        starts = starts.filter(F.col("_start") < limit)
    # The number of buckets is fixed, whatever the data: a proven bound.
    return df.join(F.broadcast(starts), "_bucket")


def number_by_hash(df: DataFrame, digest: Column, tie: str, limit: int | None) -> DataFrame:
    """Add ``seg_id``: the position in order of a hex digest, then of ``tie``.

    The hash spreads the rows evenly, so each bucket is numbered by itself.
    """
    df = df.withColumn("_digest", digest)
    df = df.withColumn("_bucket", F.substring("_digest", 1, PREFIX_DIGITS))
    inside = Window.partitionBy("_bucket").orderBy("_digest", tie)
    numbered = _with_starts(df, limit).withColumn(
        "seg_id", F.col("_start") + F.row_number().over(inside) - 1
    )
    if limit is not None:
        numbered = numbered.filter(F.col("seg_id") < limit)
    return numbered.drop("_digest", "_bucket", "_start")


def _magnitude(key: str) -> Column:
    """An ordered bucket of a number: its length in bits and its leading bits."""
    number = F.col(key)
    length = F.length(F.bin(number))
    leading = F.expr(f"shiftright(`{key}`, greatest(length(bin(`{key}`)) - {LEADING_BITS}, 0))")
    bucket = length.cast("bigint") * (1 << LEADING_BITS) + leading
    return F.when(number < 0, F.lit(-1)).otherwise(bucket)


def number_by_range(df: DataFrame, key: str, limit: int | None) -> DataFrame:
    """Add ``seg_id``: the position in order of the whole number ``key``, which is unique.

    Only the keys are put in order: numbers may cluster, so those that remain are range-partitioned by what Spark samples
    of them, sorted, and written once, which settles the partition numbers before they are counted. The other columns are
    fetched for the rows that are kept, without a shuffle if these are few.
    """
    keys = df.select(key)
    if limit is not None:
        keys = _with_starts(keys.withColumn("_bucket", _magnitude(key)), limit).select(key)
    ordered = written(
        keys.repartitionByRange(key)
        .sortWithinPartitions(key)
        .withColumn("_part", F.spark_partition_id())
        .withColumn("_line", F.monotonically_increasing_id())
    )
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = (
        ordered.groupBy("_part")
        .agg(F.count("*").alias("n"), F.min("_line").alias("first"))
        .select(
            "_part",
            (F.coalesce(F.sum("n").over(before), F.lit(0)) - F.col("first")).alias("_shift"),
        )
    )
    places = ordered.join(broadcast_if_small(starts), "_part").select(key, (F.col("_line") + F.col("_shift")).alias("seg_id"))
    if limit is not None:
        places = places.filter(F.col("seg_id") < limit)
    return df.join(broadcast_if_small(places) if limit is not None else places, key)

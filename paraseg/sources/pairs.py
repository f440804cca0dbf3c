"""Parallel-pair tables in parquet."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from paraseg.session import broadcast_if_small


def require_columns(table: DataFrame, required: list[str], where: str) -> None:
    missing = sorted(set(required) - set(table.columns))
    if missing:
        raise ValueError(f"No column {missing} in {where}, only {table.columns}.")


def read_pairs(
    spark: SparkSession, path: str, source: str = "en", target: str = "fr"
) -> DataFrame:
    """``pair_id, src, ref``; ``pair_id`` is the dense position in the input.

    The position needs no sort: parquet knows the row number inside a file, and
    the row counts of the preceding files come from a count per file.
    """
    table = spark.read.parquet(path)
    require_columns(table, [source, target], path)
    rows = table.select(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.row_index").alias("row"),
        F.col(source).alias("src"),
        F.col(target).alias("ref"),
    )
    in_order = Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)
    files = (
        table.groupBy(F.col("_metadata.file_path").alias("file"))
        .count()
        .select("file", F.coalesce(F.sum("count").over(in_order), F.lit(0)).alias("before"))
    )
    return rows.join(broadcast_if_small(files), "file").select(
        (F.col("before") + F.col("row")).alias("pair_id"), "src", "ref"
    )

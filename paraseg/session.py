"""Session set-up and the few helpers that need to know about the cluster."""

from __future__ import annotations

import sys
import tempfile
import uuid
from collections.abc import Iterable, Iterator
from contextlib import contextmanager

from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Executors need no copy of ``cut``.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    # Batches for Python are cut by bytes too: a segment can be a whole page.
    "spark.sql.execution.arrow.maxRecordsPerBatch": "4096",
    "spark.sql.execution.arrow.maxBytesPerBatch": str(32 << 20),
}

BROADCAST_ROWS = 100_000
# Shuffle files go when the query that made them ends, not when the driver happens to collect its garbage.
FREE_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def get_session(master: str | None = None, **settings: str) -> SparkSession:
    """A session with this library's settings; ``master`` only for local use."""
    builder = SparkSession.builder.appName("paraseg")
    if master:
        builder = builder.master(master)
    for key, value in {**SETTINGS, **settings}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The shared folder the cluster names for checkpoints.

    A local session that names none gets a fresh folder; a cluster must name one.
    """
    current = spark.sparkContext.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if not configured:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("Set spark.checkpoint.dir to a folder all executors share.")
        configured = tempfile.mkdtemp(prefix="paraseg-")
    spark.sparkContext.setCheckpointDir(configured)
    return spark.sparkContext.getCheckpointDir()


@contextmanager
def freed_shuffles(spark: SparkSession) -> Iterator[None]:
    """Queries that run inside leave no shuffle files behind; the session's own setting holds again afterwards.

    Without it, the files of every step of a long job lie on disk together. A frame that is run twice shuffles twice.
    """
    before = spark.conf.get(FREE_SHUFFLES, None)
    spark.conf.set(FREE_SHUFFLES, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(FREE_SHUFFLES)
        else:
            spark.conf.set(FREE_SHUFFLES, before)


def written(df: DataFrame, compression: str = "snappy") -> DataFrame:
    """Write ``df`` once, as a table in the shared folder, and read on from there.

    Cuts the lineage, survives lost executors, and runs what is behind ``df``
    exactly once, which matters for paid calls. Later steps read only the
    columns they use, and the planner knows the size. The table stays until the folder
    is cleared: with ``zstd`` texts take about half of what the usual codec leaves. The
    shuffle files behind it go at once.
    """
    path = f"{shared_dir(df.sparkSession)}/{uuid.uuid4().hex}"
    with freed_shuffles(df.sparkSession):
        df.write.option("compression", compression).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def computed_once(df: DataFrame, **columns: Column) -> DataFrame:
    """Add columns that are computed once for each row, whatever reads them.

    The planner copies the expression of a plain column into every filter and
    projection above; it does not copy what a generator makes.
    """
    return df.select("*", F.inline(F.array(F.struct(*(column.alias(name) for name, column in columns.items())))))


def broadcast_if_small(df: DataFrame, max_rows: int = BROADCAST_ROWS) -> DataFrame:
    """Hint a broadcast when the written table is small, else leave the join to shuffle.

    For pre-aggregated tables: the rows are written once and counted, so the
    check does not run the aggregation twice.
    """
    df = written(df)
    return F.broadcast(df) if df.count() <= max_rows else df


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Repartition only when the scan yields fewer tasks than there are slots.

    A table of one small file would otherwise run its whole pipeline in one task;
    a large table already has enough splits and is not shuffled.
    """
    slots = df.sparkSession.sparkContext.defaultParallelism
    if df.rdd.getNumPartitions() >= slots:
        return df
    return df.repartition(slots, *keys)


def cut(sizes: Iterable[int], most: int) -> Iterator[tuple[int, int]]:
    """Consecutive ranges whose sizes add up to at most ``most``, or that have one element."""
    first, held, at = 0, 0, 0
    for at, size in enumerate(sizes, 1):
        if held + size > most and at - 1 > first:
            yield first, at - 1
            first, held = at - 1, 0
        held += size
    if at > first:
        yield first, at

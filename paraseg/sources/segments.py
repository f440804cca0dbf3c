"""Aligned segment files: UTF-8, one segment per line, identity = line number."""

from __future__ import annotations

import json
import sys
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from paraseg.fixed import DOCUMENT
from paraseg.functions.text import EXTRA_LINE_ENDS, LINE_END, has_line_end, is_blank, split_lines
from paraseg.session import broadcast_if_small, written

cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: A split is a row of 36 bytes; at the usual 128 MB a split, so many hold 128 TB.
BROADCAST_SPLITS = 1_000_000
#: Names a split: the hash only has to tell apart files that one task reads from the same place on.
SPLIT = ["task", "block", "file_hash"]
SEGMENT_ROW = "run_id string, doc_id string, seg_id bigint, text string"
#: Which lines of the file of the same name a document has; ``first_seg`` orders its files.
MANIFEST = "run_id string, doc_id string, first_line bigint, lines bigint, first_seg bigint"
FILE_BYTES = 128 << 20
#: Lines and manifest meet by blocks of so many lines, so that a line meets no more documents than its block has.
BLOCK_LINES = 64


def split_documents(documents: DataFrame, text: str = "text") -> DataFrame:
    """One row per line of a text column, numbered from 0 in each document.

    Other columns are kept. Works inside the row, so nothing is shuffled.
    """
    others = [c for c in documents.columns if c != text]
    lines = documents.select(*others, F.posexplode(split_lines(F.col(text))).alias("seg_id", "text"))
    return lines.withColumn("seg_id", F.col("seg_id").cast("bigint"))


def _written_lines(raw: DataFrame, *keys: Column) -> DataFrame:
    """The lines of text files with ``keys``, their file and split, and ``line``, which counts up within the split.

    Written once, since another read may cut the files otherwise.
    """
    file = F.col("_metadata.file_path")
    lines = raw.select(
        *keys, file.alias("file"), F.col("_metadata.file_block_start").alias("block"),
        F.explode(F.split("value", EXTRA_LINE_ENDS)).alias("text"),
    ).withColumn("line", F.monotonically_increasing_id())
    # A task reads its splits one after the other, each in line order; its number is in the upper bits of the line.
    return written(
        lines.select(
            "*", F.shiftright("line", 33).cast("int").alias("task"), F.xxhash64("file").alias("file_hash"),
            (~is_blank(F.col("text"))).alias("has_text"),
        )
    )


def read_segments(
    spark: SparkSession,
    path: str | list[str],
    run_id: str = "default",
    document: str = "file",
) -> DataFrame:
    """Read text files into ``run_id, doc_id, seg_id, text``.

    ``document="file"`` makes every file a document; ``"directory"`` joins the
    part files of a folder, in name order, into one. A folder tree written by
    ``write_segments`` keeps its own ``run_id`` and ``doc_id``.

    Line numbers are dense although a file may be read in many splits. The splits
    are told apart in one pass only, which writes the lines with the split of each
    into the shared folder; the lines of each split are counted from that table, and
    the running totals of the small table of counts shift its line numbers. So the
    numbers do not hang on how a later read would cut the files. The text is not
    shuffled unless there are more than ``BROADCAST_SPLITS`` splits.
    """
    if document not in ("file", "directory"):
        raise ValueError(f"document must be 'file' or 'directory', not {document!r}")
    raw = spark.read.text(path)
    partition_columns = [c for c in raw.columns if c != "value"]
    if partition_columns:
        # Inferred types would make "007" and "7" the same document.
        raw = spark.read.schema(", ".join(f"`{c}` string" for c in raw.columns)).text(path)
    file = F.col("_metadata.file_path")
    if "doc_id" in partition_columns:
        doc_id = F.col("doc_id").cast("string")
    else:
        doc_id = file if document == "file" else F.regexp_replace(file, "/[^/]*$", "")
    run = F.col("run_id").cast("string") if "run_id" in partition_columns else F.lit(run_id)
    lines = _written_lines(raw, run.alias("run_id"), doc_id.alias("doc_id"))
    in_document = Window.partitionBy(*DOCUMENT)
    before = in_document.orderBy("file", "block").rowsBetween(Window.unboundedPreceding, -1)
    splits = (
        lines.groupBy(*DOCUMENT, "file", "file_hash", "block", "task")
        .agg(F.count("*").alias("n"), F.min("line").alias("first"), F.max(F.when(F.col("has_text"), F.col("line"))).alias("last"))
        .withColumn("shift", F.coalesce(F.sum("n").over(before), F.lit(0)) - F.col("first"))
        .withColumn("last_seg", F.max(F.col("last") + F.col("shift")).over(in_document))
        .select(*SPLIT, "shift", "last_seg")
    )
    return (
        lines.join(broadcast_if_small(splits, BROADCAST_SPLITS), SPLIT)
        .withColumn("seg_id", F.col("line") + F.col("shift"))
        .filter(F.col("seg_id") <= F.col("last_seg"))
        .select(*DOCUMENT, "seg_id", "text")
    )


def _checked_text(on_line_end: str) -> Column:
    if on_line_end not in ("keep", "error"):
        raise ValueError(f"on_line_end must be 'keep' or 'error', not {on_line_end!r}")
    text = F.col("text")
    if on_line_end == "keep":
        return text
    message = F.format_string("Segment %d contains a line end", F.col("seg_id"))
    return F.when(has_line_end(text), F.raise_error(message)).otherwise(text)


def write_segments(segments: DataFrame, path: str, on_line_end: str = "keep") -> None:
    """Write each document's segments, one per line, in part files in line order.

    Every document is a folder, so this is for few of them; many go into shared files
    (``write_segment_files``) or one table (``write_segment_table``).
    Concatenating a document's part files by name gives the aligned file.
    A segment that itself contains a line end would shift all later lines when
    read back: ``on_line_end="error"`` fails the job on one, ``"keep"`` writes
    it as it is (``rows_with_line_ends`` lists them).
    """
    (
        segments.select(*DOCUMENT, "seg_id", _checked_text(on_line_end).alias("text"))
        .repartitionByRange(*DOCUMENT, "seg_id")
        .sortWithinPartitions(*DOCUMENT, "seg_id")
        .select(*DOCUMENT, "text")
        .write.mode("overwrite")
        .partitionBy(*DOCUMENT)
        .text(path)
    )


def write_segment_table(segments: DataFrame, path: str) -> None:
    """Write all documents together: gzipped JSON lines with run, document and position, in line order.

    The number of files follows the size of the texts, not the number of documents,
    and a segment may hold line ends. ``read_segment_table`` reads it back.
    """
    (
        segments.select(*DOCUMENT, "seg_id", "text")
        .repartitionByRange(*DOCUMENT, "seg_id")
        .sortWithinPartitions(*DOCUMENT, "seg_id")
        .write.mode("overwrite")
        .option("ignoreNullFields", "false")
        .option("compression", "gzip")
        .json(path)
    )


def read_segment_table(spark: SparkSession, path: str) -> DataFrame:
    """Read what ``write_segment_table`` wrote."""
    return spark.read.schema(SEGMENT_ROW).json(path)


def _with_manifest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The lines of a task, then what the manifest says of each of its documents, in the order they are sorted in."""
    found: dict[tuple, tuple[int, int]] = {}
    names = ["kind", *DOCUMENT, "seg_id", "at", "value"]

    def rows(kind: str, columns: list, n: int) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([kind] * n, pa.string()), *columns], names)

    for batch in batches:
        counted = pa.Table.from_batches([batch]).group_by(DOCUMENT).aggregate(
            [("seg_id", "min"), ("seg_id", "count", pc.CountOptions(mode="all"))]
        )
        for row in counted.to_pylist():
            document = tuple(row[c] for c in DOCUMENT)
            n, first = found.get(document, (0, row["seg_id_min"]))
            found[document] = (n + row["seg_id_count"], min(first, row["seg_id_min"]))
        yield rows("lines", [batch.column(c) for c in names[1:]], len(batch))
    documents, line = [], 0
    for document in sorted(found, key=lambda d: [(c is not None, c or "") for c in d]):
        n, first = found[document]
        entry = {**dict(zip(DOCUMENT, document)), "first_line": line, "lines": n, "first_seg": first}
        documents.append((*document, first, 0, json.dumps(entry)))
        line += n
    types = [pa.string(), pa.string(), pa.int64(), pa.int32(), pa.string()]
    columns = [pa.array([d[i] for d in documents], t) for i, t in enumerate(types)]
    yield rows("manifest", columns, len(documents))


def write_segment_files(
    segments: DataFrame, path: str, on_line_end: str = "keep", file_bytes: int = FILE_BYTES
) -> None:
    """Write all documents as aligned text, many to a file, with a manifest of which lines are whose.

    ``kind=lines`` holds the text, one segment per line, documents one after the other in order; the file of the same
    name in ``kind=manifest`` holds a JSON line for each document in it: ``run_id, doc_id, first_line, lines,
    first_seg``. One task writes both, so they agree whatever is lost and repeated. The number of files follows the size
    of the text, about ``file_bytes`` each; a long document goes on in the next file. ``read_segment_files`` reads it back.

    A segment that holds line ends becomes several lines of its document, or with ``on_line_end="error"`` fails the job.
    Null texts become empty lines. Documents may be null; one without segments is in no file.
    ``segments`` is read for its size, for the bounds of the files, and for the texts: give a written table.
    """
    rows = segments.select(*DOCUMENT, "seg_id", _checked_text(on_line_end).alias("text"))
    size = segments.agg(F.sum(F.coalesce(F.octet_length("text"), F.lit(0)) + 1)).first()[0] or 0
    pieces = F.split(F.coalesce("text", F.lit("")), LINE_END)
    (
        rows.repartitionByRange(-(-size // file_bytes) or 1, *DOCUMENT, "seg_id")
        .select(*DOCUMENT, F.col("seg_id").cast("bigint").alias("seg_id"), F.posexplode(pieces).alias("at", "value"))
        .mapInArrow(_with_manifest, "kind string, run_id string, doc_id string, seg_id bigint, at int, value string")
        .sortWithinPartitions("kind", *DOCUMENT, "seg_id", "at")
        .select("kind", "value")
        .write.mode("overwrite")
        .option("maxRecordsPerFile", 0)
        .partitionBy("kind")
        .text(path)
    )


def read_segment_files(spark: SparkSession, path: str) -> DataFrame:
    """Read what ``write_segment_files`` wrote, cut into documents by its manifest.

    Lines are numbered from 0 in each document, blank ones at its end included. Files may be read in many splits.
    The manifest is broadcast while it is small; beyond, lines and manifest are shuffled by blocks of lines of a file.
    """
    raw = spark.read.text(path)
    if "kind" not in raw.columns:  # nothing was written
        return spark.createDataFrame([], SEGMENT_ROW)
    name = F.col("_metadata.file_name").alias("name")
    lines = _written_lines(raw.filter("kind = 'lines'"), name)
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    splits = (
        lines.groupBy("file", "file_hash", "block", "task")
        .agg(F.count("*").alias("n"), F.min("line").alias("first"))
        .withColumn("shift", F.coalesce(F.sum("n").over(before), F.lit(0)) - F.col("first"))
        .select(*SPLIT, "shift")
    )
    earlier = Window.partitionBy(*DOCUMENT).orderBy("first_seg", "name").rowsBetween(Window.unboundedPreceding, -1)
    block = lambda line: F.floor(line / BLOCK_LINES)
    manifest = (
        raw.filter("kind = 'manifest'")
        .select(name, F.from_json("value", MANIFEST).alias("entry"))
        .select("name", "entry.*")
        .withColumn("seg_shift", F.coalesce(F.sum("lines").over(earlier), F.lit(0)) - F.col("first_line"))
        .withColumn("end", F.col("first_line") + F.col("lines"))
        .select("name", *DOCUMENT, "first_line", "end", "seg_shift", F.explode(F.sequence(block(F.col("first_line")), block(F.col("end") - 1))).alias("of_lines"))
    )
    numbered = (
        lines.join(broadcast_if_small(splits, BROADCAST_SPLITS), SPLIT)
        .withColumn("number", F.col("line") + F.col("shift"))
        .select("name", "number", block(F.col("number")).alias("of_lines"), "text")
    )
    return (
        numbered.join(broadcast_if_small(manifest), ["name", "of_lines"])
        .filter("number >= first_line and number < end")
        .select(*DOCUMENT, (F.col("number") + F.col("seg_shift")).alias("seg_id"), "text")
    )


def rows_with_line_ends(segments: DataFrame) -> DataFrame:
    return segments.filter(has_line_end(F.col("text")))

"""Frames from plain Python lists."""

from pyspark.sql import functions as F

SEGMENT_SCHEMA = "run_id string, doc_id string, seg_id bigint, text string"


def segments(spark, texts, run_id="r", doc_id="d"):
    rows = [(run_id, doc_id, i, text) for i, text in enumerate(texts)]
    return spark.createDataFrame(rows, SEGMENT_SCHEMA)


def in_mode(frame, mode):
    return frame.withColumn("mode", F.lit(mode))


def texts_of(frame):
    return [row["text"] for row in frame.orderBy("seg_id").collect()]

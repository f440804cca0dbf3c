"""Put later model scores into the reports of an experiment."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paraseg.operators import compare
from paraseg.session import written
from paraseg.sources import records as files
from paraseg.sources import reports


class Merged(NamedTuple):
    scores: DataFrame
    """Scores per run and mode; ``merged`` tells those that had a later record."""
    report: reports.Report
    """The report as it is now, read back."""
    comparison: DataFrame


def merge_files(spark: SparkSession, experiment: str, out: str) -> Merged:
    """Merge ``<run>/score.candidate.<mode>.json`` of every run below ``experiment`` into the report ``out``.

    The first time, the report is made from the files ``<run>/report.json``. Each merge is a new state of it, which counts
    only when it is whole (``sources.reports``); a merge that is run again leaves the same report.
    """
    now = reports.read_report(spark, out)
    if now is None:
        published = written(files.read_report_files(spark, f"{experiment}/*/report.json"))
        scores = published.drop("comet_segments")
        segments = files.record_segments(published.withColumns({"part_id": F.lit(0).cast("bigint"), "doc_id": F.lit("")}))
    else:
        scores, segments = now.scores, now.segments
    records = written(files.read_score_files(spark, f"{experiment}/*/score.candidate.*.json"))
    scores = written(compare.merge_scores(scores, records))
    reports.write_report(scores, compare.merge_segment_scores(segments, records, files.record_segments(records)), out)
    return Merged(scores, reports.read_report(spark, out), compare.refresh(scores)[1])

"""Names of data sets and score files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def file_stem(path: Column) -> Column:
    """``a/b/name.tail.ext`` -> ``name.tail``."""
    name = F.regexp_extract(path, "([^/]*)/*$", 1)
    return F.regexp_replace(name, r"(?<=.)\.[^.]*$", "")


def dataset_tag(sample: DataFrame, source: str, seed: int | None) -> DataFrame:
    """One row ``tag``: source, number of sampled rows and, if any, the seed."""
    tail = "" if seed is None else f".seed{seed}"
    return sample.agg(
        F.concat(F.lit(f"hansard.{source}.n"), F.count("*").cast("string"), F.lit(tail)).alias("tag")
    )


def score_file(candidate: Column) -> Column:
    """Where a candidate's scores go by default: beside it, named after it."""
    folder = F.regexp_extract(candidate, "^(.*/)?[^/]*$", 1)
    return F.concat(folder, F.lit("score."), file_stem(candidate), F.lit(".json"))

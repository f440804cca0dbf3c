"""Segment statistics, corpus scores, model scores and the score record."""

from __future__ import annotations

import sys
from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.resource import ExecutorResourceRequests, ResourceProfile, ResourceProfileBuilder, TaskResourceRequests
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from paraseg.fixed import SEGMENT
from paraseg.functions import scores
from paraseg.functions.ngrams import CHAR_ORDER, PARTS, WORD_ORDER, char_stats, stat_fields, word_stats
from paraseg.session import broadcast_if_small, cut

cloudpickle.register_pickle_by_value(sys.modules[__name__])

RUN = ["run_id", "mode"]
SCORED = [*SEGMENT, "mode"]
# Segment scores per array of a nested score record.
SCORES_PER_PART = 100_000
# Text that one call of a scorer gets, or one segment.
SCORED_BYTES = 4 << 20

BatchScorer = Callable[[pd.DataFrame], pd.Series]


def _checked(scorer: BatchScorer, by_length: bool) -> Callable[[pd.DataFrame], pd.Series]:
    """The scorer, on rows in order of length if wanted: rows of a model's batch are then of like size."""

    def score(rows: pd.DataFrame) -> pd.Series:
        rows = rows.reset_index(drop=True)
        if by_length:
            order = (rows["mt"].str.len().fillna(0) + rows["src"].str.len().fillna(0)).sort_values(kind="stable").index
            rows = rows.loc[order]
        values = scorer(rows.reset_index(drop=True))
        if len(values) != len(rows):
            raise ValueError(f"Scorer returned {len(values)} scores for {len(rows)} segments.")
        return pd.Series(list(values), index=rows.index).astype(float).sort_index()

    return score


def model_score(scorer: BatchScorer, by_length: bool = False) -> Column:
    """A model's score of ``src, cand, ref``; ``scorer`` sees batches of ``src, mt, ref``."""
    checked = _checked(scorer, by_length)

    def score(batches: Iterator[tuple[pa.Array, pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for texts in batches:
            sizes = sum(pc.fill_null(pc.binary_length(side), 0).to_numpy(zero_copy_only=False).astype("int64") for side in texts)
            # Python's strings take far more than a batch: a part of them at a time.
            parts = [
                checked(pd.DataFrame({name: side[first:end].to_pandas() for name, side in zip(("src", "mt", "ref"), texts)}))
                for first, end in cut(sizes.tolist(), SCORED_BYTES)
            ]
            yield pa.array(pd.concat(parts) if parts else [], pa.float64(), from_pandas=True)

    return F.arrow_udf(score, "double")("src", "cand", "ref")


def gpu_profile(gpus: int) -> ResourceProfile:
    """Tasks and executors of a stage with ``gpus`` GPUs each."""
    executors = ExecutorResourceRequests().resource("gpu", gpus)
    tasks = TaskResourceRequests().cpus(1).resource("gpu", gpus)
    return ResourceProfileBuilder().require(executors).require(tasks).build


def scored_on_gpus(aligned: DataFrame, scorer: BatchScorer, gpus: int, by_length: bool = True) -> DataFrame:
    """``aligned`` with ``score``, in a stage whose tasks have ``gpus`` GPUs each (needs a cluster that schedules them)."""
    checked = _checked(scorer, by_length)

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            rows = rows.reset_index(drop=True)
            yield rows.assign(score=checked(rows.rename(columns={"cand": "mt"})[["src", "mt", "ref"]]))

    schema = T.StructType([*aligned.schema.fields, T.StructField("score", T.DoubleType())])
    return aligned.mapInPandas(score, schema, profile=gpu_profile(gpus))


def segment_stats(
    aligned: DataFrame, words: bool = True, chars: bool = True, scorer: BatchScorer | None = None, gpus: int = 0
) -> DataFrame:
    """Per segment: clipped n-gram counts (``words``, ``chars``) and model ``score``.

    All of it is computed where the aligned row is; nothing is shuffled. With ``gpus`` the model's stage asks for so
    many GPUs a task, and the model sees rows in order of length.
    """
    if scorer is not None and gpus:
        aligned = scored_on_gpus(aligned, scorer, gpus)
    columns = []
    if words:
        columns.append(word_stats(F.col("cand"), F.col("ref")).alias("words"))
    if chars:
        columns.append(char_stats(F.col("cand"), F.col("ref")).alias("chars"))
    if scorer is not None:
        columns.append(F.col("score") if gpus else model_score(scorer).alias("score"))
    return aligned.select(*SCORED, *columns)


def long_stats(stats: DataFrame, column: str, order: int, keys: list[str] = SCORED) -> DataFrame:
    """The struct of counts as rows ``n, match, cand, ref``."""
    rows = [
        F.struct(
            F.lit(n).cast("bigint").alias("n"),
            *[F.col(f"{column}.{part}_{n}").alias(part) for part in PARTS],
        )
        for n in range(1, order + 1)
    ]
    return stats.select(*keys, F.inline(F.array(*rows)))


def _summed(column: str, order: int) -> Column:
    return F.struct(
        *[F.sum(f"{column}.{field}").alias(field) for field in stat_fields(order)]
    ).alias(column)


def corpus_stats(stats: DataFrame, keys: list[str] = RUN) -> DataFrame:
    """The segment counts summed over each group; only these few numbers are shuffled."""
    sums = [F.count("*").alias("n_segments")]
    if "words" in stats.columns:
        sums.append(_summed("words", WORD_ORDER))
    if "chars" in stats.columns:
        sums.append(_summed("chars", CHAR_ORDER))
    if "score" in stats.columns:
        sums.append(F.avg("score").alias("comet"))
    return stats.groupBy(*keys).agg(*sums)


def corpus_scores(stats: DataFrame, keys: list[str] = RUN) -> DataFrame:
    """Corpus BLEU and chrF per group, from the summed counts, and the mean model score.

    Columns for which ``stats`` has no data are left out.
    """
    columns = []
    if "words" in stats.columns:
        columns += [scores.bleu("words").alias("bleu"), scores.bleu_signature().alias("bleu_signature")]
    if "chars" in stats.columns:
        columns.append(scores.chrf("chars").alias("chrf"))
    if "score" in stats.columns:
        columns.append(F.col("comet"))
    return corpus_stats(stats, keys).select(*keys, "n_segments", *columns)


def score_segments(aligned: DataFrame, scorer: BatchScorer, gpus: int = 0) -> DataFrame:
    return segment_stats(aligned, words=False, chars=False, scorer=scorer, gpus=gpus)


def system_scores(segment_scores: DataFrame, keys: list[str] = RUN) -> DataFrame:
    return segment_scores.groupBy(*keys).agg(F.avg("score").alias("comet"))


def score_record(corpus: DataFrame) -> DataFrame:
    """Rounded scores per run and mode; the model score is null if there is none."""
    comet = F.col("comet") if "comet" in corpus.columns else F.lit(None).cast("double")
    return corpus.select(
        *RUN,
        "n_segments",
        F.round("bleu", 2).alias("bleu"),
        F.round("chrf", 2).alias("chrf"),
        "bleu_signature",
        F.round(comet, 4).alias("comet"),
    )


def nest_scores(record: DataFrame, segment_scores: DataFrame | None = None) -> DataFrame:
    """The record with ``comet_segments``, the rounded scores by position, null where a segment has none.

    A run of more than ``SCORES_PER_PART`` segments in a document, or of several
    documents, continues in further rows (``doc_id``, ``part_id``), so no array
    grows with the corpus. Without segment scores the array is empty.
    """
    if segment_scores is None:
        return record.select(
            *RUN, F.lit(None).cast("string").alias("doc_id"), F.lit(0).cast("bigint").alias("part_id"),
            *[c for c in record.columns if c not in RUN],
            F.array().cast("array<double>").alias("comet_segments"),
        )
    part = F.floor(F.col("seg_id") / SCORES_PER_PART).cast("bigint")
    place = (F.col("seg_id") % SCORES_PER_PART).cast("int").alias("place")
    rows = F.sort_array(F.collect_list(F.struct(place, F.round("score", 4).alias("score"))))

    def with_gap(row: Column, i: Column) -> Column:
        before = F.when(i > 0, F.col("rows")[i - 1]["place"]).otherwise(-1)
        missing = F.array_repeat(F.lit(None).cast("double"), row["place"] - before - 1)
        return F.concat(missing, F.array(row["score"]))

    arrays = (
        segment_scores.groupBy(*RUN, "doc_id", part.alias("part_id"))
        .agg(rows.alias("rows"))
        .select(*RUN, "doc_id", "part_id", F.flatten(F.transform("rows", with_gap)).alias("comet_segments"))
    )
    # A run may have a large part of all arrays, so they are not shuffled by run.
    return arrays.join(broadcast_if_small(record), RUN).select(
        *RUN, "doc_id", "part_id", *[c for c in record.columns if c not in RUN], "comet_segments"
    )

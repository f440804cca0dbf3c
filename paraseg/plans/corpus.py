"""Pair table to aligned, sampled segment files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paraseg.fixed import MAX_LENGTH, MIN_LENGTH, SAMPLE_LIMIT, SAMPLE_SEED
from paraseg.operators.corpus import filter_pairs, normalise_pairs, sample_pairs
from paraseg.session import written
from paraseg.sources.naming import dataset_tag
from paraseg.sources.pairs import read_pairs
from paraseg.sources.segments import write_segments


def sample_corpus(
    pairs: DataFrame,
    limit: int | None = SAMPLE_LIMIT,
    seed: int | None = SAMPLE_SEED,
    min_len: int = MIN_LENGTH,
    max_len: int = MAX_LENGTH,
) -> DataFrame:
    """Filter, sample, normalise: ``seg_id, pair_id, src, ref``."""
    kept = filter_pairs(pairs, min_len, max_len)
    sample = normalise_pairs(sample_pairs(kept, limit, seed))
    return sample.select("seg_id", "pair_id", "src", "ref")


def build_corpus(
    spark: SparkSession,
    parquet: str,
    out_dir: str,
    limit: int | None = SAMPLE_LIMIT,
    seed: int | None = SAMPLE_SEED,
    min_len: int = MIN_LENGTH,
    max_len: int = MAX_LENGTH,
    source: str = "en",
    target: str = "fr",
) -> tuple[str, str]:
    """Write both sides of a sampled corpus and return their folders."""
    stem = parquet.rstrip("/").rsplit("/", 1)[-1].removesuffix(".parquet")
    pairs = read_pairs(spark, parquet, source, target)
    # Tag and both files need the sample; draw it once.
    sample = written(sample_corpus(pairs, limit, seed, min_len, max_len))
    tag = dataset_tag(sample, stem, seed).first()["tag"]
    paths = []
    for side, lang in (("src", source), ("ref", target)):
        path = f"{out_dir.rstrip('/')}/{tag}.{lang}.txt"
        segments = sample.select(
            F.lit("corpus").alias("run_id"), F.lit(tag).alias("doc_id"), "seg_id", F.col(side).alias("text")
        )
        write_segments(segments, path)
        paths.append(path)
    return paths[0], paths[1]

"""Pair filter, sample, normalisation, head limit, and the corpus build."""

import glob
import hashlib
import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from helpers import segments, texts_of
from paraseg.operators import corpus
from paraseg.plans.corpus import build_corpus
from paraseg.sources.naming import score_file
from paraseg.sources.pairs import read_pairs
from paraseg.sources.segments import read_segments

PAIRS = "pair_id bigint, src string, ref string"


def shuffled(ids, seed):
    return sorted(ids, key=lambda i: (hashlib.md5(f"{seed}|{i}".encode()).hexdigest(), i))


def ordered_ids(sample):
    return [row["pair_id"] for row in sample.orderBy("seg_id").collect()]


def numbered_pairs(spark, ids):
    return spark.createDataFrame([(i, f"source {i}", f"target {i}") for i in ids], PAIRS).repartition(5)


def test_filter_strips_and_counts_code_points(spark):
    rows = [
        (1, "x" * 20, "y" * 400),
        (2, "x" * 19, "y" * 30),
        (3, "x" * 20, "y" * 401),
        (4, " " + "x" * 19 + "　", "y" * 30),
        (5, " " + "x" * 20 + " \n", "\U0001F600" * 20),
        (6, None, "y" * 30),
        (7, "x" * 30, None),
        (8, " " * 30, "y" * 30),
    ]
    kept = corpus.filter_pairs(spark.createDataFrame(rows, PAIRS))
    assert sorted(r["pair_id"] for r in kept.collect()) == [1, 5]
    # Blank sides are dropped whatever the limits are.
    any_length = corpus.filter_pairs(spark.createDataFrame(rows, PAIRS), 0, 1000)
    assert sorted(r["pair_id"] for r in any_length.collect()) == [1, 2, 3, 4, 5]


@pytest.mark.parametrize("limit", [0, 1, 7, 300, 1000, None])
def test_seeded_sample(spark, limit):
    ids = random.Random(1).sample(range(10**6), 300)
    sample = corpus.sample_pairs(numbered_pairs(spark, ids), limit, 42)
    expected = shuffled(ids, 42)[:limit]
    assert ordered_ids(sample) == expected
    assert sorted(r["seg_id"] for r in sample.collect()) == list(range(len(expected)))


@pytest.mark.parametrize("limit", [0, 7, 203, None])
def test_unseeded_sample_keeps_input_order(spark, limit):
    # One id range holds nearly all rows, another a few far away.
    ids = [-5, -4] + list(range(200)) + [10**15 + i for i in range(5)]
    sample = corpus.sample_pairs(numbered_pairs(spark, ids), limit, None)
    assert ordered_ids(sample) == ids[:limit]
    assert sorted(r["seg_id"] for r in sample.collect()) == list(range(len(ids[:limit])))


def test_seeds_differ_and_negative_limits_fail(spark):
    pairs = numbered_pairs(spark, range(100))
    assert ordered_ids(corpus.sample_pairs(pairs, 50, 1)) != ordered_ids(corpus.sample_pairs(pairs, 50, 2))
    with pytest.raises(ValueError):
        corpus.sample_pairs(pairs, -1, 1)
    with pytest.raises(ValueError):
        corpus.head(segments(spark, ["a"]), -1)


def test_normalise_replaces_only_newlines(spark):
    frame = spark.createDataFrame([(" a\nb\r\nc d ",)], "s string")
    assert frame.select(corpus.normalise(F.col("s"))).first()[0] == "a b\r c d"


def test_head(spark):
    frame = segments(spark, list("abc")).unionByName(segments(spark, list("xy"), doc_id="e"))
    assert corpus.head(frame, 2).count() == 4
    assert corpus.head(frame, 0).count() == 5
    assert corpus.head(frame, None).count() == 5


def test_pairs_are_numbered_across_files(spark, tmp_path):
    for part, size in enumerate([3, 1, 4]):
        frame = pd.DataFrame({"id": range(size), "en": [f"{part}-{i}" for i in range(size)], "fr": None})
        frame.astype({"fr": "string"}).to_parquet(tmp_path / f"part-{part}.parquet", row_group_size=2)
    rows = read_pairs(spark, str(tmp_path)).orderBy("pair_id").collect()
    assert [r["pair_id"] for r in rows] == list(range(8))
    assert [r["src"] for r in rows] == ["0-0", "0-1", "0-2", "1-0", "2-0", "2-1", "2-2", "2-3"]


def test_missing_columns_are_named(spark, tmp_path):
    path = str(tmp_path / "x.parquet")
    pd.DataFrame({"en": ["a"], "de": ["b"]}).to_parquet(path)
    with pytest.raises(ValueError, match=r"\['fr'\].*\['en', 'de'\]"):
        read_pairs(spark, path)


def read_back(spark, path):
    return texts_of(read_segments(spark, path))


def test_build_writes_aligned_files(spark, tmp_path):
    table = tmp_path / "test.parquet"
    rows = [
        ("The committee will meet on Tuesday.", "Le comité se réunira mardi."),
        ("The report will be tabled\nin the House.", "Le rapport sera déposé à la Chambre."),
        ("", "Vide côté anglais, mais pas ici."),
        ("Short.", "Court."),
        ("This is a legitimately valid utterance.", "Ceci est une déclaration légitime."),
    ]
    pd.DataFrame(rows, columns=["en", "fr"]).to_parquet(table)
    src, ref = build_corpus(spark, str(table), str(tmp_path / "out"), limit=10)
    assert src.endswith("hansard.test.n3.seed42.en.txt")
    assert ref.endswith("hansard.test.n3.seed42.fr.txt")
    english, french = read_back(spark, src), read_back(spark, ref)
    kept = {(en.replace("\n", " "), fr) for en, fr in rows if len(en) >= 20}
    assert set(zip(english, french)) == kept


def test_build_respects_limit_and_unseeded_tag(spark, tmp_path):
    table = tmp_path / "train.parquet"
    rows = [(f"Segment number {i} is valid for the record.", f"Le segment {i} est valide ici.") for i in range(20)]
    pd.DataFrame(rows, columns=["en", "fr"]).to_parquet(table)
    src, ref = build_corpus(spark, str(table), str(tmp_path), limit=5)
    assert "n5" in src and ".seed42" in src
    assert len(read_back(spark, src)) == len(read_back(spark, ref)) == 5
    src, _ = build_corpus(spark, str(table), str(tmp_path), limit=5, seed=None)
    assert src.endswith("hansard.train.n5.en.txt")
    assert read_back(spark, src) == [en for en, _ in rows[:5]]
    assert glob.glob(f"{src}/**/part-*.txt", recursive=True)


def test_score_file_names(spark):
    paths = [("out/candidate.fr.txt",), ("candidate.txt",), ("a.b/c",), ("x/.hidden",)]
    frame = spark.createDataFrame(paths, "p string").select(score_file(F.col("p")))
    assert [r[0] for r in frame.collect()] == [
        "out/score.candidate.fr.json", "score.candidate.json", "a.b/score.c.json", "x/score..hidden.json",
    ]


def test_input_order_shuffles_keys_only(spark, tmp_path):
    rows = [((37 * i) % 1009, f"source {i}", f"reference {i}") for i in range(1000)]
    spark.createDataFrame(rows, "pair_id long, src string, ref string").write.parquet(str(tmp_path / "pairs"))
    pairs = spark.read.parquet(str(tmp_path / "pairs"))
    sample = corpus.sample_pairs(pairs, 50, None)
    assert [tuple(r) for r in sample.orderBy("seg_id").select("seg_id", "pair_id", "src", "ref").collect()] == [
        (i, *row) for i, row in enumerate(sorted(rows)[:50])
    ]
    plan = sample._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "hashpartitioning" not in plan and "rangepartitioning" not in plan
    keys = corpus.sample_pairs(pairs, None, None).select("seg_id", "pair_id")._jdf.queryExecution().executedPlan().toString()
    assert "src" not in keys and "ref#" not in keys

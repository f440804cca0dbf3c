"""The pipeline's stages, each on what the one before kept."""

import random
from pathlib import Path

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from paraseg.llm import decontaminate, pii
from paraseg.llm.queries import table

DATA = Path("/root/testdata/sf0.001")


@pytest.mark.skipif(not DATA.is_dir(), reason="no test data")
def test_every_stage_takes_effect(spark):
    docs = table(spark, str(DATA), "documents")
    kept = []
    for name, stage in corpus_pipeline.STAGES:
        before, docs = docs, corpus_pipeline.written(stage(spark, docs, str(DATA)))
        assert set(corpus_pipeline.COLUMNS) <= set(docs.columns)
        assert docs.join(before, "doc_id", "left_anti").count() == 0
        kept.append(docs)
        if name != "mixing":
            assert docs.columns == corpus_pipeline.COLUMNS
    assert kept[0].filter("text is null").count() == 0
    assert decontaminate.contaminated(kept[2], table(spark, str(DATA), "benchmark")).count() == 0
    assert kept[3].count() == kept[2].count()
    assert pii.find(kept[3]).filter(F.size("base") > 0).count() == 0
    assert 0 < docs.count() < kept[3].count()


COLUMNS = "text string, lang string, source string, n_chars long"


def odd_rows(spark, kind):
    """Null, repeated and string ids, repeated rows, null and empty texts, a clashing column."""
    rng = random.Random(7)
    text = lambda n: " ".join("".join(rng.choices(["ka", "to", "mi", "ra", "ne"], k=3)) for _ in range(n))
    clean = [text(60) for _ in range(40)]
    rows = [(i, t) for i, t in enumerate(clean)]
    rows += [(0, clean[0]), (1, text(50)), (None, text(55)), (None, text(45)), (None, clean[2]), (90, clean[3] + " mi"), (91, None), (92, ""), (93, "Ωζψ ψξζ Ωφχ " * 40)]
    rows = [(None if i is None else i if kind == "long" else f"d{i:03}", t, None if "Ω" in (t or "") else "aa", "s", len(t or ""), 1) for i, t in rows]
    return spark.createDataFrame(rows, f"doc_id {kind}, {COLUMNS}, key long")


def told(frame):
    return sorted(((r["doc_id"], r["text"]) for r in frame.collect()), key=repr)


@pytest.mark.parametrize("kind", ["long", "string"])
def test_stages_tell_rows_apart_by_id_and_text(spark, kind, tmp_path):
    docs = odd_rows(spark, kind)
    rows = told(docs)
    clean = rows[:]
    for gone in [r for r in rows if not r[1] or "Ω" in r[1]]:
        clean.remove(gone)
    kept = corpus_pipeline.known_language(spark, docs, "")
    assert told(kept) == clean and kept.columns == corpus_pipeline.COLUMNS
    one = told(corpus_pipeline.one_of_each_group(spark, kept, ""))
    # The repeated row goes once, the copy without an id and the near copy go; other texts under the same id stay.
    expected = sorted(set(clean), key=repr)
    copies = {t for i, t in clean if i is not None}
    expected = [(i, t) for i, t in expected if not (i is None and t in copies) and not t.endswith(" mi ") and str(i) not in ("90", "d090")]
    assert one == expected
    item = next(t for i, t in one if i is None)
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    left = told(corpus_pipeline.without_benchmark(spark, kept, str(tmp_path)))
    assert left == [r for r in clean if r[1] != item]
    secret = kept.withColumn("text", F.concat("text", F.lit(" mail a.b@c.org")))
    hidden = corpus_pipeline.without_personal_data(spark, secret, "")
    assert [i for i, _ in told(hidden)] == [i for i, _ in clean] and all("a.b@c.org" not in t for _, t in told(hidden))
    mixed = corpus_pipeline.mixed(spark, kept, "")
    assert set(map(repr, told(mixed))) <= set(map(repr, clean)) and 0 < mixed.count() <= len(clean)


def test_stages_of_an_empty_table(spark, tmp_path):
    spark.createDataFrame([(1, "a b c d e f g")], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs = odd_rows(spark, "long").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = corpus_pipeline.written(stage(spark, docs, str(tmp_path)))
        assert docs.count() == 0


def test_near_copies_from_four_fifths_go(spark):
    words = [f"w{i}" for i in range(100)]
    # Five-word similarity 86 / 106.
    texts = [" ".join(words), " ".join(words[:90] + [f"x{i}" for i in range(10)]), " ".join(f"y{i}" for i in range(100))]
    docs = spark.createDataFrame([(i, t, "en", "a", len(t)) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    kept = corpus_pipeline.one_of_each_group(spark, docs, "")
    assert sorted(r["doc_id"] for r in kept.collect()) == [0, 2]

"""BLEU and chrF against a plain rendering of the formulas, and the score record."""

import math
import random
from collections import Counter

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from helpers import in_mode, segments
from paraseg.functions import ngrams
from paraseg.functions.text import remove_whitespace, rstrip, tokens_13a
from paraseg.operators import metrics
from paraseg.plans.scoring import score
from test_text import tokens

ENGLISH = ["Two boats left the harbour before dawn.", "Nobody had counted the empty crates."]
FRENCH = ["Deux bateaux ont quitté le port avant l'aube.", "Personne n'avait compté les caisses vides."]
POORER = ["Deux barques ont quitté la ville avant l'aube.", "Personne n'avait vu les caisses vides."]


def counts(units, n):
    return Counter(tuple(units[i : i + n]) for i in range(len(units) - n + 1))


def plain_stats(pairs, unit, order, need_ref):
    sums = [[0, 0, 0] for _ in range(order)]
    for cand, ref in pairs:
        cand, ref = unit(cand), unit(ref)
        for n in range(1, order + 1):
            c, r = counts(cand, n), counts(ref, n)
            sums[n - 1][0] += sum((c & r).values())
            sums[n - 1][1] += 0 if need_ref and not r else sum(c.values())
            sums[n - 1][2] += sum(r.values())
    return sums


def plain_bleu(pairs):
    stats = plain_stats(pairs, tokens, 4, False)
    if not any(m for m, _, _ in stats) or not all(t for _, t, _ in stats):
        return 0.0
    smooth, logs = 1.0, []
    for match, total, _ in stats:
        if match == 0:
            smooth *= 2
            logs.append(math.log(100 / (smooth * total)))
        else:
            logs.append(math.log(100 * match / total))
    sys_len, ref_len = stats[0][1], stats[0][2]
    brevity = 1.0 if sys_len >= ref_len else math.exp(1 - ref_len / sys_len)
    return brevity * math.exp(sum(logs) / 4)


def plain_chrf(pairs):
    stats = plain_stats(pairs, lambda s: "".join(s.split()), 6, True)
    used = [(m / c, m / r) for m, c, r in stats if c and r]
    if not used:
        return 0.0
    p, r = (sum(side) / len(used) for side in zip(*used))
    return 100 * 5 * p * r / (4 * p + r) if p + r else 0.0


def scored(spark, pairs):
    aligned = spark.createDataFrame(
        [("r", "d", i, "sentence", "", c, r) for i, (c, r) in enumerate(pairs)],
        "run_id string, doc_id string, seg_id bigint, mode string, src string, cand string, ref string",
    )
    return metrics.corpus_scores(metrics.segment_stats(aligned)).first()


CASES = {
    "same text": list(zip(FRENCH, FRENCH)),
    "other words": list(zip(POORER, FRENCH)),
    "one empty candidate": [("", FRENCH[0]), (FRENCH[1], FRENCH[1])],
    "one empty reference": [(FRENCH[0], ""), (FRENCH[1], FRENCH[1])],
    "all empty": [("", "")],
    "no 4-gram": [("a b c", "a b c")],
    "no match": [("x y z w v", "a b c d e")],
    "smoothing": [("a b x c d y", "a b q c d r")],
    "brevity": [("a b c d e", "a b c d e f g h i j")],
    "repeats": [("the the the the the", "the cat the mat the")],
    "entities": [("&amp;quot; 1990-91 3,5 % \U0001F600", "&quot; 1990-92 3,5 % \U0001F600 !")],
    "one long run": [("a" * 3000, "a" * 2000 + "b")],
}


@pytest.mark.parametrize("name", CASES)
def test_scores_of_cases(spark, name):
    row = scored(spark, CASES[name])
    assert row["bleu"] == pytest.approx(plain_bleu(CASES[name]), abs=1e-9)
    assert row["chrf"] == pytest.approx(plain_chrf(CASES[name]), abs=1e-9)


def test_scores_of_random_corpora(spark):
    rng = random.Random(7)
    words = ["le", "la", "maison,", "rouge.", "1990-91", "3,5", "été", "\U0001F600", "(x)"]
    pairs = []
    for _ in range(300):
        ref = [rng.choice(words) for _ in range(rng.randint(0, 40))]
        cand = [w if rng.random() < 0.7 else rng.choice(words) for w in ref]
        pairs.append((" ".join(cand), " ".join(ref)))
    row = scored(spark, pairs)
    assert row["bleu"] == pytest.approx(plain_bleu(pairs), abs=1e-9)
    assert row["chrf"] == pytest.approx(plain_chrf(pairs), abs=1e-9)


def test_counts_stay_exact_when_keys_are_ranked(spark, monkeypatch):
    """A vocabulary too wide for four packed symbols, and rows cut into slices."""
    monkeypatch.setattr(ngrams, "SLICE_SYMBOLS", 50_000)
    rng = random.Random(3)
    wide = [" ".join(str(rng.randint(0, 40_000)) for _ in range(30_000)) for _ in range(2)]
    cand = wide[0] + " " + wide[1][:50_000]
    pairs = [("a b", "b a"), (cand, wide[0]), ("c", "c")]
    frame = spark.createDataFrame(pairs, "c string, r string").coalesce(1)
    rows = frame.select("c", "r", ngrams.word_stats(F.col("c"), F.col("r")).alias("s")).collect()
    for row in rows:
        c, r = row["c"].split(), row["r"].split()
        for n in range(1, 5):
            expected = sum((counts(c, n) & counts(r, n)).values())
            assert row["s"][f"match_{n}"] == expected


def test_words_and_characters_of_a_batch(spark, monkeypatch):
    """Texts are taken apart a batch at a time, with the tokens and characters of the column functions."""
    rng = random.Random(9)
    alphabet = [*"ab5.,-( '\"é9 _x.,,.,5 /1~&\n\x85\u2003\U0001F600", "<skipped>", "-\n", "&amp;", "&lt;"]
    texts = ["".join(rng.choices(alphabet, k=rng.randrange(15))) for _ in range(4000)] + ["", " "]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select(
        "t", rstrip(F.col("t")).alias("line"), tokens_13a(F.col("t")).alias("tokens"), remove_whitespace(F.col("t")).alias("solid")
    ).collect()
    words, numbers = ngrams._tokens(pa.array([r["line"].encode() for r in rows], pa.large_binary()))
    assert words.to_pylist() == [w.encode() for r in rows for w in r["tokens"]]
    assert list(numbers) == [len(r["tokens"]) for r in rows]
    monkeypatch.setattr(ngrams, "SLICE_SYMBOLS", 100)
    monkeypatch.setattr(ngrams, "PIECE_BYTES", 1000)
    half = len(rows) // 2
    for count, unit, order, line in ((ngrams._word_pair_stats, "tokens", 4, "line"), (ngrams._char_pair_stats, "solid", 6, "t")):
        found = count(pa.array([r[line] for r in rows[:half]]), pa.array([r[line] for r in rows[half:]])).to_pylist()
        for cand, ref, stats in zip(rows[:half], rows[half:], found):
            for n in range(1, order + 1):
                c, r = counts(cand[unit], n), counts(ref[unit], n)
                assert stats[f"match_{n}"] == sum((c & r).values())
                assert stats[f"ref_{n}"] == sum(r.values())
                assert stats[f"cand_{n}"] == (0 if unit == "solid" and not r else sum(c.values()))


def score_lists(spark, sources, candidates, references, scorer=None):
    return score(
        segments(spark, sources), in_mode(segments(spark, candidates), "sentence"),
        segments(spark, references), scorer, ["sentence"],
    )


def test_record_of_a_plan(spark):
    """Corpus values are those of the cases above, rounded, with the signature and no model score."""
    for candidates in (FRENCH, POORER):
        record = score_lists(spark, ENGLISH, candidates, FRENCH).record.first().asDict()
        pairs = list(zip(candidates, FRENCH))
        assert (record["bleu"], record["chrf"]) == (round(plain_bleu(pairs), 2), round(plain_chrf(pairs), 2))
        assert record["comet"] is None and record["n_segments"] == 2
        assert record["bleu_signature"].startswith("nrefs:1|case:mixed|eff:no|tok:13a|smooth:exp|version:")


@pytest.mark.parametrize("sides, message", [
    ((ENGLISH, FRENCH, FRENCH[1:]), "1:1 alignment"),
    ((ENGLISH[1:], FRENCH, FRENCH), "1:1 alignment"),
    (([], FRENCH, []), "1:1 alignment"),
    (([], [], []), "nothing to score"),
])
def test_what_a_plan_refuses_to_score(spark, sides, message):
    with pytest.raises(ValueError, match=message):
        score_lists(spark, *sides)


def test_model_scores_and_nested_record(spark, monkeypatch):
    monkeypatch.setattr(metrics, "SCORES_PER_PART", 2)
    texts = ["a", "bb", "ccc", "dddd", "eeeee"]

    def by_length(batch):
        assert list(batch.columns) == ["src", "mt", "ref"]
        return batch["mt"].str.len() / 7

    result = score_lists(spark, texts, texts, texts, by_length)
    assert result.record.first()["comet"] == pytest.approx(round(3 / 7, 4))
    nested = metrics.nest_scores(result.record, result.segments).orderBy("part_id").collect()
    assert [row["comet_segments"] for row in nested] == [[0.1429, 0.2857], [0.4286, 0.5714], [0.7143]]
    assert {row["bleu"] for row in nested} == {result.record.first()["bleu"]}


def test_scorer_must_score_every_segment(spark):
    with pytest.raises(Exception, match="Scorer returned"):
        score_lists(spark, ENGLISH, POORER, FRENCH, lambda batch: [])


def test_gpus_set_the_profile_of_the_scorer(spark):
    aligned = spark.createDataFrame([("r", "d", 0, "m", "s", "c", "r")], "run_id string, doc_id string, seg_id long, mode string, src string, cand string, ref string")
    profile = metrics.gpu_profile(2)
    assert profile.taskResources["gpu"].amount == 2 and profile.executorResources["gpu"].amount == 2
    plans = [metrics.score_segments(aligned, lambda b: b["mt"].str.len(), gpus=n)._jdf.queryExecution().optimizedPlan() for n in (0, 1)]
    assert "MapInPandas" in plans[1].toString() and "MapInPandas" not in plans[0].toString()
    node = plans[1]
    while "MapInPandas" not in node.nodeName():
        node = node.children().head()
    asked = node.profile().get().taskResources()
    assert asked.get("gpu").get().amount() == 1.0


def test_rows_of_like_length_come_together(spark):
    seen = []

    def scorer(batch):
        seen.append(batch["mt"].str.len().tolist())
        return batch["mt"].str.len() / 10

    import pandas as pd

    rows = pd.DataFrame({"src": ["s"] * 4, "mt": ["aaaa", "b", None, "cc"], "ref": ["r"] * 4}, index=[5, 6, 7, 8])
    assert metrics._checked(scorer, True)(rows).fillna(-1).tolist() == [0.4, 0.1, -1.0, 0.2]
    assert [x for x in seen[0] if x == x] == [1, 2, 4]


def test_scorer_gets_bounded_parts_of_a_batch(spark, monkeypatch):
    monkeypatch.setattr(metrics, "SCORED_BYTES", 200)
    texts = [None if i % 5 == 0 else "x" * (i % 70) for i in range(300)] + ["y" * 500]
    frame = spark.createDataFrame([("r", "d", i, "m", t, t, t) for i, t in enumerate(texts)], "run_id string, doc_id string, seg_id long, mode string, src string, cand string, ref string")

    def held(batch):
        assert len(batch) == 1 or batch.map(lambda t: len(t or "")).to_numpy().sum() <= 200
        return batch["mt"].str.len()

    rows = metrics.score_segments(frame.coalesce(1), held).collect()
    assert {r["seg_id"]: r["score"] for r in rows} == {i: None if t is None else len(t) for i, t in enumerate(texts)}

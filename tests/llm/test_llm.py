"""The dealt operators on small tables, against brute force, round trips and held-out rows."""

from __future__ import annotations

import hashlib
import itertools
import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from paraseg.llm import chat, decontaminate, fingerprint, langid, mixing, ngram_join, pii, quality, warc
from paraseg.llm.common import components

WORD = re.compile(r"[^\x20\x09-\x0D]+")
EDGES = "doc_id long, text string, lang string, source string, n_chars long, h long, n long, at int"


def words_of(rng, n, vocabulary=4000):
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))


def edge_rows(text="alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu"):
    """Nulls, empty and blank texts, repeated rows, and columns whose names clash with inner ones."""
    return [
        (1, text, "en", "a", 5, 1, 1, 1), (1, text, "en", "a", 5, 1, 1, 1), (2, None, "en", None, None, None, None, None),
        (3, "", None, "b", 0, 0, 0, 0), (4, " \n\t ", "fr", "b", 4, 0, 0, 0), (None, text, "en", "a", 5, 1, 1, 1), (5, "one", "de", "c", 3, 2, 2, 2),
    ]


@pytest.fixture(scope="module")
def edges(spark):
    return spark.createDataFrame(edge_rows(), EDGES)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], EDGES)


def sets(text, k):
    w = WORD.findall((text or "").lower())
    return {tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()


def brute_components(rows):
    own = {i: sets(t, 4) for i, t in rows}
    root = {i: i for i in own}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in own:
        for b in own:
            common = len(own[a] & own[b])
            if a < b and common and 100 * common >= 85 * len(own[a] | own[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: (len(own[i]), find(i)) for i in own}


def near_copies(rng):
    rows, base = [], words_of(rng, 150).split()
    for i in range(90):
        text = list(base)
        for _ in range(rng.randrange(7)):
            text[rng.randrange(len(text))] = f"x{rng.randrange(10**6)}"
        rows.append((i, " ".join(text)))
    shared = words_of(rng, 40)
    for i in range(90, 150):
        rows.append((i, words_of(rng, rng.randrange(3, 60)) + " " + shared * (i % 2)))
    return rows + [(150, rows[3][1]), (151, "A b"), (152, "a B"), (153, "")]


@pytest.mark.parametrize("long_list", [4, 48])
def test_ngram_join_equals_brute_force(spark, long_list, monkeypatch):
    monkeypatch.setattr(ngram_join, "BLOCK_MEMBERS", 25)
    rows = near_copies(random.Random(5))
    found = ngram_join.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string"), long_list=long_list).collect()
    assert {r[0]: (r[1], r[2]) for r in found} == brute_components(rows)


@pytest.mark.parametrize("links", [
    [(i, i + 1) for i in range(60)],
    [(0, i) for i in range(1, 200)] + [(500, 501), (501, 499), (7, 7)],
    [(1000 - i, (7 * i) % 90) for i in range(60)],
    [],
])
def test_components_are_the_smallest_ids_in_reach(spark, links):
    smallest = {x: x for link in links if link[0] != link[1] for x in link}
    for _ in range(len(links)):
        for a, b in links:
            if a != b:
                smallest[a] = smallest[b] = min(smallest[a], smallest[b])
    found = components(spark.createDataFrame(links, "a long, b long")).collect()
    assert dict(found) == {a: b for a, b in smallest.items() if a != b} and len(found) == len(dict(found))


def test_ngram_join_edges(edges, empty):
    rows = ngram_join.jaccard_components(edges).collect()
    assert len(rows) == 7
    assert {(r[0], r[1], r[2]) for r in rows} == {(1, 9, 1), (2, 0, 2), (3, 0, 3), (4, 0, 4), (None, 9, 1), (5, 1, 5)}
    assert ngram_join.jaccard_components(empty).count() == 0


def test_suffix_and_prefix_bounds_lose_nothing():
    rng = np.random.default_rng(3)
    for _ in range(300):
        a = np.unique(rng.integers(0, 1 << 63, rng.integers(1, 80), dtype=np.uint64))
        b = np.unique(np.r_[a[rng.random(len(a)) < 0.95], rng.integers(0, 1 << 63, rng.integers(0, 6), dtype=np.uint64)])
        common = len(np.intersect1d(a, b))
        if 100 * common >= 85 * (len(a) + len(b) - common):
            heads = [x[: ngram_join.prefix_size(len(x), 85)] for x in (a, b)]
            assert len(np.intersect1d(*heads))


def test_langid_held_out(spark):
    rng = random.Random(1)
    syllables = {"aa": ["ka", "to", "mi", "ra"], "bb": ["sch", "ung", "ver", "eit"], "cc": ["é", "eau", "ion", "ç"]}
    rows = [(i, " ".join("".join(rng.choices(syllables[k], k=3)) for _ in range(30)), k) for i in range(150) for k in syllables]
    docs = spark.createDataFrame([(i, t, k) for i, (_, t, k) in enumerate(rows)], "doc_id long, text string, lang string")
    found = langid.identify(docs, F.col("doc_id") % 4 != 2).join(docs, "doc_id").filter("not training")
    assert found.filter("lang = lang_pred").count() == found.count() > 0
    assert found.filter("score < 0.5 or score > 1 or rejected").count() == 0
    alien = spark.createDataFrame([(10**6, "Ωζψ ψξζ Ωφχ " * 40, None)], docs.schema)
    assert langid.identify(docs.union(alien), F.lit(True)).filter("doc_id = 1000000").first()["rejected"]


def test_langid_lengths_without_training_texts(spark):
    rng = random.Random(5)
    text = lambda n: " ".join("".join(rng.choices(["ka", "to", "mi", "ra"], k=3)) for _ in range(n))
    rows = [(i, text(30), "aa") for i in range(40)] + [(100, text(3000), "aa"), (101, text(2), "aa")]
    alien = [(102, "Ωζψ ψξζ Ωφχ " * 3000, None)]
    docs = spark.createDataFrame(rows + alien, "doc_id long, text string, lang string")
    found = {r["doc_id"]: r["rejected"] for r in langid.identify(docs, F.col("doc_id") < 100).collect()}
    assert not found[100] and not found[101] and found[102]


def test_langid_one_junk_training_text_does_not_end_rejection(spark):
    rows = [("aa", 7, 2.0 + i / 200) for i in range(20)] + [("aa", 7, 7.5), ("aa", 9, 8.0)]
    usual = langid.usual_scores(spark.createDataFrame(rows, "lang_pred string, length int, best double"))
    asked = spark.createDataFrame([("aa", n) for n in (7, 8, 9)], "lang_pred string, length int")
    limits = [r["x"] for r in asked.join(usual, "lang_pred").select(langid.reject_limit().alias("x")).collect()]
    assert len(limits) == 3 and all(2.1 < x < 4 for x in limits)


def test_langid_probabilities_sum_to_one(spark):
    rows = [("en", "the cat and the hat and the rat")]
    grams = spark.createDataFrame(rows, "lang string, text string").mapInArrow(langid._count_grams, "lang string, gram long, n long")
    table = langid.kneser_ney(grams).toPandas()
    for k in range(2, 5):
        own = table[(table.k == k) & ~table.weight]
        sums = own.groupby(own.gram // 65536).value.sum()
        weights = table[(table.k == k) & table.weight].set_index("gram").value
        assert np.allclose(sums + weights[sums.index], 1)


def plain_kneser_ney(text, probes):
    """Natural log probabilities of four-character grams after plain interpolated Kneser-Ney on one text."""
    padded = "   " + text
    counts, orders = Counter(padded[i : i + 4] for i in range(len(padded) - 3)), {}
    for k in (4, 3, 2, 1):
        if k < 4:
            counts = Counter(g[1:] for g in counts)
        n1, n2 = (sum(n == x for n in counts.values()) for x in (1, 2))
        d = min(0.9, max(0.1, n1 / (n1 + 2 * n2))) if n1 + n2 else 0.5
        total, types = Counter(), Counter()
        for g, n in counts.items():
            total[g[:-1]] += n
            types[g[:-1]] += 1
        orders[k] = counts, d, total, types

    def p(gram):
        if not gram:
            return 1 / 4096
        counts, d, total, types = orders[len(gram)]
        context = gram[:-1]
        if not total[context]:
            return p(gram[1:])
        return max(counts[gram] - d, 0) / total[context] + d * types[context] / total[context] * p(gram[1:])

    return [math.log(p(g)) for g in probes]


def test_langid_equals_plain_kneser_ney_beyond_a_million_grams(spark):
    rng = random.Random(11)
    text = "".join(chr(0x4E00 + int(rng.random() ** 2 * 6000)) for _ in range(1_150_000))
    assert len({text[i : i + 4] for i in range(len(text) - 3)}) > 1_000_000
    parts = spark.createDataFrame([("zh", text), ("en", "the cat and the hat")], "lang string, text string")
    langs, tables = langid.train(parts)
    assert langs == ["en", "zh"] and len(tables[1][3][0][0]) > 1_000_000
    probes = [text[i : i + 4] for i in rng.sample(range(len(text) - 3), 2000)]
    probes += ["".join(rng.choice(text) for _ in range(4)) for _ in range(2000)] + ["the ", " cat", "zzzz"]
    keys = np.array([sum((0 if c == " " else ord(c)) << 16 * (3 - i) for i, c in enumerate(g)) for g in probes], np.uint64)
    found = langid.log_probabilities(tables, keys)
    assert np.allclose(found[:, 1], plain_kneser_ney(text, probes), atol=1e-5)


def test_langid_edges(edges, empty):
    rows = {(r["doc_id"], r["lang_pred"]) for r in langid.identify(edges, F.lit(True)).collect()}
    assert {(2, "und"), (3, "und"), (4, "und")} <= rows and len(rows) == 6
    assert langid.identify(empty, F.lit(True)).count() == 0


def test_decontaminate_equals_brute_force(spark):
    rng = random.Random(9)
    items = [(i, words_of(rng, rng.randrange(5, 40))) for i in range(12)] + [(98, "too short"), (99, None)]
    docs = []
    for i in range(80):
        item = items[rng.randrange(12)][1].split()
        for _ in range(i % 3):
            item[rng.randrange(len(item))] = "zzz"
        docs.append((i, " ".join([words_of(rng, rng.randrange(30)), *([" ".join(item)] if i % 4 else []), words_of(rng, rng.randrange(30))])))
    docs.append((80, None))

    def runs(text):
        w = WORD.findall(text.lower())
        return [tuple(w[k : k + 5]) for k in range(len(w) - 4)]

    expected = set()
    for d, text in docs:
        for i, item in items:
            if text and item and len(b := runs(item)) > 0:
                a = runs(text)
                for k in range(len(a) - len(b) + 1):
                    x, y = decontaminate.Counter(a[k : k + len(b)]), decontaminate.Counter(b)
                    if (x & y).total() / (x | y).total() >= 0.8:
                        expected.add((d, i))
    found = decontaminate.contaminated(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    assert {(r["doc_id"], r["item_id"]) for r in found.collect()} == expected


def test_decontaminate_edges(spark, edges, empty):
    items = spark.createDataFrame([(7, edge_rows()[0][1])], "item_id long, text string")
    assert {r[0] for r in decontaminate.contaminated(edges, items).collect()} == {1, None}
    assert decontaminate.contaminated(empty, items).count() == 0
    assert decontaminate.contaminated(edges, items.limit(0)).count() == 0


def test_rake_fits_every_margin(spark):
    rng = random.Random(2)
    docs = spark.createDataFrame([(i, words_of(rng, rng.randrange(1, 60)), rng.choice("abc"), rng.choice("xy")) for i in range(600)], "doc_id long, text string, source string, lang string")
    mixed = mixing.mix(docs, {"source": 0.5, "lang": 0.3}, share=0.4).toPandas()
    cells = mixed.drop_duplicates(["source", "lang"])
    for name, power in (("source", 0.5), ("lang", 0.3)):
        target = mixed.groupby(name).tokens.sum() ** power
        assert np.allclose(cells.groupby(name).weight.sum(), target / target.sum(), atol=1e-5)
    assert abs((mixed.tokens * mixed.probability).sum() / mixed.tokens.sum() - 0.4) < 1e-6
    assert abs(mixed[mixed.sampled].tokens.sum() / mixed.tokens.sum() - 0.4) < 0.1


def test_mix_takes_target_weights(spark):
    rng = random.Random(3)
    docs = spark.createDataFrame([(i, words_of(rng, rng.randrange(1, 60)), rng.choice(["a", "a", "a", "b", None]), rng.choice("xy")) for i in range(900)], "doc_id long, text string, source string, lang string")
    mixed = mixing.mix(docs, {"lang": 1.0}, targets={"source": {"a": 1, "b": 2, None: 1}}, share=0.3).toPandas()
    cells = mixed.drop_duplicates(["source", "lang"])
    assert np.allclose(cells.groupby(cells.source.fillna("-")).weight.sum()[["a", "b", "-"]], [0.25, 0.5, 0.25], atol=1e-5)
    expected = (mixed.tokens * mixed.probability).groupby(mixed.source.fillna("-")).sum()
    assert np.allclose(expected / expected.sum(), [0.25, 0.25, 0.5], atol=1e-5)
    left_out = mixing.mix(docs, targets={"source": {"a": 1}}).filter("sampled").select("source").distinct().collect()
    assert [r[0] for r in left_out] == ["a"]
    for bad in ({"powers": {}}, {"powers": {"lang": 1.0}, "targets": {"lang": {"x": 1}}}, {"targets": {"lang": {"x": 0}}}):
        with pytest.raises(ValueError):
            mixing.mix(docs, **bad)
    apart = docs.filter("(source = 'a') = (lang = 'x')").filter("source is not null")
    with pytest.warns(UserWarning, match="do not fit together"):
        mixing.mix(apart, targets={"source": {"a": 9, "b": 1}, "lang": {"x": 1, "y": 9}})


def test_mix_edges(edges, empty):
    rows = mixing.mix(edges, {"source": 0.5, "lang": 0.5, "topic": 1.0}).collect()
    assert len(rows) == 7 and all(0 <= r["probability"] <= 1 for r in rows)
    assert mixing.mix(empty, {"source": 0.5}).count() == 0


PII_TEXTS = [
    "mail a.b+c@x-1.example.com, 10.0.0.1 and 300.1.1.1; card 4539 1488 0343 6467 or 4539148803436468.", "+1 (499) 555-6503", "", None,
    "a@b.c_x@d.e 1.2.3.4.5 é€😀 q@w.io", "+44 20 7946 0958 4532015112830366", "@ + 12-34 1..2 +1 () 2", "x" * 3000 + "@y.com",
]


def base_spans(text):
    luhn = lambda d: sum(int(c) if i % 2 == 0 else (2 * int(c) - 9 * (c > "4")) for i, c in enumerate(reversed(d))) % 10 == 0
    digits = lambda m: re.sub("[^0-9]", "", m)
    kinds = {
        "email": (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
        "ip": (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(x) <= 255 for x in m.split("."))),
        "card": (r"[0-9]([\x20-]?[0-9])+", lambda m: 13 <= len(digits(m)) <= 19 and luhn(digits(m))),
        "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 9 <= len(digits(m)) <= 15),
    }
    return [f"{k}:{m.start()}:{m.end()}" for k, (p, ok) in kinds.items() for m in re.finditer(p, text or "") if ok(m.group())]


def test_pii_base_spans_and_redaction(spark):
    rng = random.Random(4)
    texts = PII_TEXTS + ["".join(rng.choice("a1.@+ -()9é\n") for _ in range(60)) for _ in range(200)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = pii.find(docs)
    rows = pii.with_spans(found, pii.fit(found)).select("doc_id", pii.listed(F.col("base")).alias("b"), pii.listed(F.col("spans")).alias("s"), pii.redacted(F.col("text"), F.col("spans")).alias("r")).collect()
    for doc, base, spans, clean in rows:
        assert base == ",".join(base_spans(texts[doc]))
        assert set(base.split(",")) - {""} <= set(spans.split(","))
        assert (clean == texts[doc]) == (not spans)
    assert next(r for r in rows if r[0] == 1)[3] == "<PHONE>"


def plain_em(rows, rounds):
    """Posteriors of candidates of one kind, a row each: labelers are independent given the truth."""
    names = ["pattern", "gazetteer", "context", "shape"]
    votes = np.array([[r[n] for n in names] for r in rows])
    p = 0.5 + 0.4 * votes[:, 0] + 0.02 * votes[:, 1:].sum(1)
    for _ in range(rounds):
        odds = np.full(len(rows), np.log((p.sum() + 0.1) / ((1 - p).sum() + 0.1)))
        for k in range(4):
            for v in (-1, 0, 1):
                on = votes[:, k] == v
                odds[on] += np.log((p[on].sum() + 0.1) / (p.sum() + 0.3)) - np.log(((1 - p)[on].sum() + 0.1) / ((1 - p).sum() + 0.3))
        p = 1 / (1 + np.exp(-np.clip(odds, -40, 40)))
    return p


def test_pii_expectation_maximisation_equals_a_plain_rendering(spark):
    rng = random.Random(12)
    number = lambda n: "".join(rng.choice("0123456789") for _ in range(n))
    texts = [f"call +{rng.choice(['1', '49', '999'])} {number(3)} {number(3)}-{number(4)} now" for _ in range(60)]
    texts += [f"page {number(4)} {number(4)} {number(3)}" for _ in range(60)] + [f"tel {number(3)}-{number(3)}-{number(4)}" for _ in range(60)]
    found = pii.find(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    rows = [c.asDict() for r in found.select("candidates").collect() for c in r[0] if c["kind"] == "phone"]
    assert len(rows) > 100
    for rounds in (0, 1, 7, pii.ROUNDS):
        weights, p = pii.fit(found, rounds), plain_em(rows, rounds)
        assert weights["phone"] == pytest.approx(np.log((p.sum() + 0.1) / ((1 - p).sum() + 0.1)), abs=1e-6)
        for name in ("pattern", "length", "spaced"):
            values = sorted({r[name] for r in rows})
            for v in values:
                on = np.array([r[name] == v for r in rows])
                a, b = p[on].sum(), (1 - p)[on].sum()
                expected = np.log((a + 0.1) / (p.sum() + len(values) * 0.1)) - np.log((b + 0.1) / ((1 - p).sum() + len(values) * 0.1))
                assert weights[f"phone:{name}:{v}"] == pytest.approx(expected, abs=1e-6)
    # Hidden addresses, on which the strict pattern is silent: the other labelers decide, as far as they can be trusted.
    mails = [f"contact u{i}@host{i}.com" for i in range(80)] + [f"contact u{i} [at] host{i} [dot] com" for i in range(30)]
    mails += [f"page no. u{i}(at)host{i}(dot){'q' * 90}" for i in range(60)]
    found = pii.find(spark.createDataFrame(list(enumerate(mails)), "doc_id long, text string"))
    rows = [c.asDict() for r in found.select("candidates").collect() for c in r[0] if c["kind"] == "email"]
    before, after = plain_em(rows, 0), plain_em(rows, pii.ROUNDS)
    hidden = np.array([r["pattern"] == 0 for r in rows])
    known = np.array([r["gazetteer"] == 1 for r in rows])
    assert before[hidden].max() < 0.6 < 0.9 < after[hidden & known].min() and after[hidden & ~known].max() < 0.1
    taken = [pii.with_spans(found, pii.fit(found, n)).filter("size(spans) > 0").count() for n in (0, pii.ROUNDS)]
    assert taken[1] == 110 != taken[0]


def test_pii_of_many_matches_long_secrets_and_overlaps(spark):
    many = "é ".join(f"u{i}@x.com" for i in range(30_000)) + " 10.0.0.1@y.org"
    secret = 'token = "' + "aB3" * 2000 + '"'
    found = pii.find(spark.createDataFrame([(1, many), (2, secret), (3, "+1 2 3 4 5 6 7 8 9@z.net x")], "doc_id long, text string"))
    spans = pii.with_spans(found, {"secret": 9.0, "email": -9.0, "phone": -9.0, "card": -9.0, "ip": -9.0})
    rows = {r["doc_id"]: r for r in spans.select("doc_id", "spans", pii.redacted(F.col("text"), F.col("spans")).alias("clean")).collect()}
    assert len(rows[1]["spans"]) == 30_002
    assert rows[1]["clean"] == "é ".join(["<EMAIL>"] * 30_000) + " <IP>"
    assert [(s["kind"], s["start"], s["end"]) for s in rows[2]["spans"]] == [("secret", 0, len(secret))] and rows[2]["clean"] == "<SECRET>"
    # The address begins inside the number: what both cover goes.
    assert rows[3]["clean"] == "<PHONE> x"


def test_running_totals_and_binary_search(spark):
    rng = random.Random(1)
    rows = [(sorted(rng.choices(range(50), k=n)), [rng.randrange(60) for _ in range(n)], rng.randrange(60)) for n in [*range(20), 1000]]
    got = spark.createDataFrame(rows, "a array<int>, b array<int>, v int").select(
        "a", "b", "v", pii.running(F.col("b"), lambda x, y: x + y).alias("sums"), pii.running(F.col("b"), F.greatest).alias("most"), pii.below(F.col("a"), F.col("v")).alias("n"),
    )
    for r in got.collect():
        assert r["sums"] == list(itertools.accumulate(r["b"])) and r["most"] == list(itertools.accumulate(r["b"], max))
        assert r["n"] == sum(x < r["v"] for x in r["a"])


def test_pii_without_candidates(empty, edges):
    for docs in (empty, edges):
        found = pii.find(docs)
        assert pii.fit(found) == {}
        assert pii.with_spans(found, {}).filter("size(spans) > 0").count() == 0


def test_quality_marginals_equal_enumeration():
    rng = np.random.default_rng(0)
    scores, switch = rng.normal(size=7), rng.normal(size=(2, 2))
    got = quality.marginals(scores, np.array([4, 1, 2]), switch)
    expected, at = [], 0
    for n in (4, 1, 2):
        total, good = 0.0, np.zeros(n)
        for code in range(2**n):
            labels = [(code >> i) & 1 for i in range(n)]
            weight = np.exp(sum(s * y for s, y in zip(scores[at : at + n], labels)) + sum(switch[a, b] for a, b in zip(labels, labels[1:])))
            total += weight
            good += weight * np.array(labels)
        expected += (good / total).tolist()
        at += n
    assert np.allclose(got, expected)


def plain_likelihood(x, counts, y, weights, switch):
    """Mean over texts of the log likelihood a line, by enumeration of all label sequences, less the ridge."""
    total, at = 0.0, 0
    for n in counts:
        scores = x[at : at + n] @ weights
        weight = lambda labels: sum(s * v for s, v in zip(scores, labels)) + sum(switch[a, b] for a, b in zip(labels, labels[1:]))  # noqa: B023, E731
        every = [weight([(code >> i) & 1 for i in range(n)]) for code in range(2**n)]
        total += (weight([int(v) for v in y[at : at + n]]) - np.log(np.exp(every).sum())) / n
        at += n
    return total / len(counts) - quality.RIDGE / 2 * ((weights**2).sum() + (switch**2).sum())


def test_quality_gradient_equals_finite_differences():
    rng = np.random.default_rng(4)
    counts = np.array([3, 1, 5, 2])
    x, y = rng.normal(size=(11, 4)), rng.integers(0, 2, 11)
    weights, switch = rng.normal(size=4), rng.normal(size=(2, 2))
    found = np.concatenate([part.ravel() for part in quality.gradient(x, counts, y.astype(float), weights, switch)])
    values, step = np.concatenate([weights, switch.ravel()]), 1e-5
    for k in range(8):
        moved = [plain_likelihood(x, counts, y, v[:4], v[4:].reshape(2, 2)) for v in (values + step * np.eye(8)[k], values - step * np.eye(8)[k])]
        assert found[k] == pytest.approx((moved[0] - moved[1]) / (2 * step), abs=1e-7)


def test_quality_learns_how_labels_change():
    rng = np.random.default_rng(5)
    counts = np.full(200, 8)
    features, size = rng.normal(size=(1600, len(quality.NAMES))) * 0.1, np.ones(1600)
    same = np.repeat(rng.integers(0, 2, 200), 8)
    turning = (np.arange(1600) + np.repeat(rng.integers(0, 2, 200), 8)) % 2
    labels = rng.integers(0, 2, 200)
    kept, turned = (quality.fit(features, size, counts, labels, lines).switch for lines in (same, turning))
    assert kept[0, 0] + kept[1, 1] > 1 + kept[0, 1] + kept[1, 0]
    assert turned[0, 1] + turned[1, 0] > 1 + turned[0, 0] + turned[1, 1]


def test_quality_held_out_and_edges(spark, edges, empty):
    rng = random.Random(6)
    good = lambda: "\n".join(words_of(rng, 12) + "." for _ in range(6))
    bad = lambda: "\n".join(" ".join(w.upper() + "!!" for w in words_of(rng, 12).split()) for _ in range(6))
    rows = [(i, good() if i % 3 else bad()) for i in range(60)]
    docs, labels = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([(i, int(i % 3 > 0)) for i in range(60)], "doc_id long, quality int")
    scored = quality.score_documents(docs, labels, F.col("doc_id") % 5 != 0).collect()
    assert all(r["predicted"] == int(r["doc_id"] % 3 > 0) for r in scored)
    assert {r["score"] for r in quality.score_documents(edges, labels.limit(0), F.lit(True)).collect()} == {0.5}
    assert quality.score_documents(edges, labels, F.lit(True)).filter("score between 0 and 1").count() == 7
    assert quality.score_documents(empty, labels, F.lit(True)).count() == 0


def test_fingerprint_likeness_and_neighbours(spark):
    rng = random.Random(8)
    texts = [words_of(rng, n) for n in (400, 400, 3, 0, 60, 1, 900)]
    rows = [(7 * i, t) for i, t in enumerate(texts)] + [(700, None)]
    found = {r["doc_id"]: r for r in fingerprint.edited_pairs(spark.createDataFrame(rows, "doc_id long, text string")).select("*", fingerprint.likeness(F.col("mark"), F.col("edited_mark")).alias("near")).collect()}
    for k, (doc, text) in enumerate(rows):
        text, after = text or "", rows[(k + 1) % len(rows)][1] or ""
        edited = text[: len(text) - len(text) // 2] + after[: len(text) // 2]
        assert found[doc]["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        a, b = sets(text, 5), sets(edited, 5)
        assert abs(found[doc]["near"] - (len(a & b) / len(a | b) if a | b else 1)) < 0.2
    assert found[700]["mark"] == []


def test_fingerprint_edges(edges, empty):
    rows = fingerprint.edited_pairs(edges).collect()
    assert len(rows) == 7 and len({tuple(r["mark"]) for r in rows if r["doc_id"] in (1, None)}) == 1
    assert fingerprint.edited_pairs(empty).count() == 0


def test_chat_round_trip(spark):
    rng = random.Random(3)
    pieces = ["<|im_end|>", "<|im_start|>", "<\\|", "<\\\\|", "<", "|", "\n", "%0A", "é😀", "assistant", "\\"]
    texts = {(c, t): "".join(rng.choices(pieces, k=rng.randrange(9))) for c in range(20) for t in range(6)}
    rows = [(c, t, ["user", "assistant", "odd\n|>"][t % 3], text) for (c, t), text in texts.items()]
    messages = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").select("conv_id", "turn", "role", chat.text_part(F.col("text")).alias("parts"))
    for r in chat.parse_chats(chat.format_chats(messages)).collect():
        assert [(t["role"], t["text"]) for t in r["turns"]] == [(x[2], x[3]) for x in rows if x[0] == r["conv_id"]]
        assert r["loss_text"] == "".join(x[3] for x in rows if x[0] == r["conv_id"] and x[2] == "assistant")


def test_chat_attachments_and_edges(spark):
    part = lambda kind, text=None, **more: {"kind": kind, "text": text, **dict.fromkeys(["ref", "width", "height", "seconds", "pages"]), **more}
    rows = [
        (1, 0, "user", [part("text", "see "), part("image", ref="i.png", width=57, height=28), part("text", "<|x|>"), part("audio", ref="a.wav", seconds=2.0)]),
        (1, 1, "assistant", [part("document", ref="d.pdf", pages=2), None]), (None, None, None, None), (2, 0, None, [part("text")]),
    ]
    chats = {r["conv_id"]: r for r in chat.format_chats(spark.createDataFrame(rows, f"conv_id long, turn long, role string, parts array<{chat.PART}>")).collect()}
    assert [tuple(a) for a in chats[1]["attachments"]] == [(0, "image", "i.png", 3), (1, "audio", "a.wav", 50), (2, "document", "d.pdf", 1024)]
    assert "see <|image_0|><\\|x|><|audio_1|>" in chats[1]["formatted"] and "<|document_2|>" in chats[1]["formatted"]
    assert chats[None]["formatted"] == chats[2]["formatted"] == "<|im_start|>\n<|im_end|>\n"
    assert chat.format_chats(spark.createDataFrame([], f"conv_id long, turn long, role string, parts array<{chat.PART}>")).count() == 0


@pytest.mark.parametrize("split", ["1k", "128m"])
def test_warc_round_trip_over_splits(spark, tmp_path, split):
    rng = random.Random(7)
    noise = "".join(chr(rng.randrange(32, 0x2000)) for _ in range(3000))
    long = base = "<html>" + "page " * 400
    rows = [(i, f"http://e/{i}", noise + str(i)) for i in range(25)] + [(30, "u", base), (31, "u", long), (32, "v", "short"), (33, "v", "short"), (34, None, None), (None, "n", base)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(2)
    records = warc.with_revisits(pages, id_col="page_id", payload_col="html").select(F.col("page_id").cast("string").alias("record_id"), "record_type", F.col("url").alias("target_uri"), F.lit(None).alias("date"), "payload_digest", F.col("refers_to").cast("string").alias("refers_to"), "payload")
    warc.write_warc(records, str(tmp_path / "w"))
    spark.conf.set("spark.sql.files.maxPartitionBytes", split)
    try:
        read = {r["record_id"]: r for r in warc.read_warc(spark, str(tmp_path / "w")).collect()}
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert len(read) == len(rows) and not [r for r in read.values() if r["error"]]
    for i, _, html in rows:
        r, body = read["" if i is None else str(i)], (html or "").encode()
        assert (r["payload_bytes"], r["payload_digest"]) == (len(body), hashlib.sha1(body).hexdigest())
        assert (r["record_type"], r["refers_to"]) == (("revisit", "31") if html == base and i != 31 else ("response", None))


def test_warc_joins_members_cut_by_chance_magic(spark, tmp_path):
    """Stored blocks keep the payload as it is, so gzip magics inside it are met by the reader."""
    import gzip

    body = b"HTTP/1.1 200 OK\r\n\r\n" + warc.MAGIC * 40 + bytes(range(256)) * 3 + warc.MAGIC
    record = b"WARC/1.0\r\nWARC-Type: response\r\nWARC-Record-ID: <x%d>\r\nContent-Type: application/http\r\nContent-Length: %d\r\n\r\n"
    (tmp_path / "a.warc").write_bytes(b"".join(gzip.compress(record % (i, len(body)) + body + b"\r\n\r\n", 0) for i in range(9)) + warc.MAGIC + b"cut")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "300")
    try:
        rows = warc.read_warc(spark, str(tmp_path)).collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    good = [r for r in rows if not r["error"]]
    assert {bytes(r["payload"]) for r in good} == {body.partition(b"\r\n\r\n")[2]} and len(good) >= 8


def test_warc_empty(spark, tmp_path):
    none = spark.createDataFrame([], "record_id string, record_type string, target_uri string, date string, payload_digest string, refers_to string, payload binary")
    warc.write_warc(none, str(tmp_path / "none"))
    assert warc.read_warc(spark, str(tmp_path / "none")).count() == 0


def test_warc_named_gz_is_read_in_ranges(spark, tmp_path):
    """Archives under the names they are published by; a range has a part of the file."""
    import gzip as gz

    record = b"WARC/1.0\r\nWARC-Type: resource\r\nWARC-Record-ID: <%s-%d>\r\nContent-Length: %d\r\n\r\n"
    bodies = {i: random.Random(i).randbytes(200 + 37 * (i % 11)) for i in range(300)}
    names = ["CC-MAIN-0001.warc.gz", "b!.gz", "~c.GZ"]
    for name in names:
        held = [gz.compress(record % (name.encode(), i, len(body)) + body + b"\r\n\r\n") for i, body in bodies.items()]
        (tmp_path / name).write_bytes(b"".join(held))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "9000")
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    try:
        raw = spark.read.options(**warc.AS_THEY_ARE).text(str(tmp_path)).select("_metadata.file_name", "_metadata.file_block_start").distinct()
        assert raw.groupBy("file_name").count().filter("count > 4").count() == len(names)
        found = warc.read_warc(spark, str(tmp_path)).collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert {r["record_id"]: bytes(r["payload"]) for r in found} == {f"{n}-{i}": body for n in names for i, body in bodies.items()}
    assert len(found) == 900 and not any(r["error"] for r in found)


@pytest.mark.parametrize("hot", [2, 1000])
def test_revisits_of_odd_pages(spark, monkeypatch, hot):
    """Short, null and hot payloads, null and repeated ids, columns of the new and of inner names."""
    monkeypatch.setattr(warc, "HOT_PAYLOADS", hot)
    long, other = "x" * 1000, "y" * 1200
    rows = [(i, long) for i in range(20)] + [(30, other), (31, other), (40, "z" * 2000), (50, None), (51, None), (52, "s"), (53, "s"), (None, long), (None, "z" * 2000 + "!"), (31, other)]
    pages = spark.createDataFrame([(i, h, "k", "k", "k") for i, h in rows], "id long, html string, original string, copies string, refers_to string")
    found = warc.with_revisits(pages, id_col="id", payload_col="html")
    assert {"original", "copies"} <= set(found.columns) and not [c for c in found.columns if c.startswith("__")]
    got = sorted(((r["id"] if r["id"] is not None else -1), r["html"] or "", r["record_type"], r["refers_to"] or -1) for r in found.collect())
    largest = {long: 19, other: 31}
    want = sorted(
        (i if i is not None else -1, h or "", *(("revisit", largest[h]) if h in largest and i != largest[h] else ("response", -1))) for i, h in rows
    )
    assert got == want


def test_large_group_meets_pivots_first(spark, monkeypatch):
    """A chain of edits, a second family and strangers in one group: pivots shorten the work and lose no link."""
    monkeypatch.setattr(ngram_join, "BLOCK_MEMBERS", 25)
    monkeypatch.setattr(ngram_join, "PIVOTS", 3)
    rng, rows = random.Random(9), []
    head = [f"rare{i}" for i in range(6)]
    for family in range(2):
        base = [f"w{family}x{i}" for i in range(60)]
        for k in range(170):
            if k % 20 == 0:
                base[rng.randrange(60)] = f"e{family}x{k}"
            body = list(base)
            if k % 3:
                body[rng.randrange(60)] = f"o{rng.randrange(10**6)}"
            rows.append((len(rows) * 7 % 1013, " ".join(head + body)))
    rows += [(2000 + i, " ".join(head + [f"s{i}x{j}" for j in range(i % 40)])) for i in range(60)]
    rng.shuffle(rows)
    found = ngram_join.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string"), long_list=4).collect()
    assert {r[0]: (r[1], r[2]) for r in found} == brute_components(rows)


def test_rows_of_a_large_group_grow_with_its_members(spark):
    """Near copies of one text, all joined by the pivots but a few: rows for the comparison in proportion to the group."""
    sent = {}
    for n in (20_000, 100_000):
        ids = spark.range(n).select(F.lit(0).cast("long").alias("leader"), F.col("id").alias("sid"), F.lit(200).alias("n"))
        group = ngram_join.written(ids.join(ngram_join._weights(ids, "leader"), "leader"))
        roots = spark.range(n).filter("id > 0 and id % 1000 <> 1").select("id", F.lit(0).cast("long").alias("root"))
        sent[n] = (ngram_join.pivot_rows(group).count(), ngram_join.block_rows(group, roots).count())
    assert all(first < 1.1 * n and second < 1.1 * n for n, (first, second) in sent.items())
    alone = spark.range(0).selectExpr("id", "id as root")
    rows = ngram_join.block_rows(group, alone)
    blocks = group.first()["blocks"]
    assert rows.select("low", "high").distinct().count() >= blocks * (blocks + 1) // 2

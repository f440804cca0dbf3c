"""Suffix-sort deduplication, periodic runs and fill-in-the-middle on small tables, against plain renderings."""

from __future__ import annotations

import hashlib
import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from paraseg.llm import fill_middle, periodic, suffix_dedup
from paraseg.llm.queries import with_planted_runs

ROWS = "doc_id long, text string, n long, key long, words string, form string"


def frame(spark, texts):
    return spark.createDataFrame([(i, t, 7, 7, "x", "y") for i, t in texts], ROWS)


def plain_repeats(texts, size):
    """Rows of (id, bytes): spans and rest, by looking every string up."""
    first = {}
    for i, data in texts:
        for k in range(len(data) - size + 1):
            s = data[k : k + size]
            first[s] = min(i, first.get(s, i))
    out = []
    for i, data in texts:
        gone = [False] * len(data)
        for k in range(len(data) - size + 1):
            if first[data[k : k + size]] < i:
                gone[k : k + size] = [True] * size
        spans = sum(g and not b for g, b in zip(gone, [False, *gone]))
        out.append((i, len(data), sum(gone), spans, bytes(b for b, g in zip(data, gone) if not g)))
    return sorted(out, key=repr)


def shared_passages(rng):
    """Copies, near copies, passages in other surroundings, a long run of one letter, and characters of several bytes."""
    letters = "abcdé 日"
    text = lambda n, of=letters: "".join(rng.choice(of) for _ in range(n))
    base, passage = text(400), text(90)
    rows = [(i, base[:k] + "#" + base[k + 1 :]) for i, k in enumerate(rng.sample(range(400), 30))]
    rows += [(100 + i, text(rng.randrange(60)) + passage[rng.randrange(40) :] + text(rng.randrange(60))) for i in range(60)]
    rows += [(200 + i, text(5) + "-" * (40 + 7 * i) + text(5)) for i in range(6)]
    rows += [(300 + i, base) for i in range(3)] + [(310, text(300, "ab")), (311, text(49)), (312, "")]
    rng.shuffle(rows)
    return [(-5, passage[:50])] + rows


@pytest.mark.parametrize("options", [{}, {"hot": 3}, {"max_keys": 0}, {"block": 5}, {"hot": 2, "max_keys": 0, "block": 9}, {"size": 16}, {"size": 77}])
def test_repeats_equal_brute_force(spark, options):
    rows = shared_passages(random.Random(2))
    found = suffix_dedup.without_repeats(frame(spark, rows), **options).collect()
    expected = plain_repeats([(i, t.encode()) for i, t in rows], options.get("size", 50))
    assert sorted([(r["doc_id"], r["n_bytes"], r["n_removed"], len(r["spans"]), bytes(r["kept"])) for r in found], key=repr) == expected


def test_crowded_bitmap_changes_no_result(spark, monkeypatch):
    """The bitmap of shared hashes stays within its size; what it lets pass besides is dropped, and no text is joined to its places."""
    rows, sizes, before = shared_passages(random.Random(5)), [], suffix_dedup.bitmap_of

    def crowded(keys, column, bits):
        sizes.append(bits)
        return np.full_like(before(keys, column, bits), 255)

    monkeypatch.setattr(suffix_dedup, "MEMBER_BITS", 17)
    monkeypatch.setattr(suffix_dedup, "bitmap_of", crowded)
    monkeypatch.setattr(suffix_dedup, "texts_with_places", None)
    found = suffix_dedup.without_repeats(frame(spark, rows)).collect()
    expected = plain_repeats([(i, t.encode()) for i, t in rows], 50)
    assert sorted([(r["doc_id"], r["n_bytes"], r["n_removed"], len(r["spans"]), bytes(r["kept"])) for r in found], key=repr) == expected
    assert sizes and max(sizes) <= 17
    # 6 GB of documents share about 38 million hashes: well within the bitmap.
    assert suffix_dedup.MAX_KEYS >= 4 * 38_000_000


def test_repeats_in_odd_rows(spark):
    text = "0123456789" * 6
    rows = [(2, text), (2, text), (2, text[:55]), (None, text), (None, None), (5, ""), (6, None), (7, "short"), (8, text + "!")]
    found = suffix_dedup.without_repeats(frame(spark, rows)).collect()
    told = sorted(((r["doc_id"], r["n_bytes"], r["n_removed"], bytes(r["kept"])) for r in found), key=repr)
    whole = text.encode()
    assert told == sorted(
        [(2, 60, 0, whole)] * 2 + [(2, 55, 0, whole[:55]), (None, 60, 60, b""), (None, 0, 0, b""), (5, 0, 0, b""), (6, 0, 0, b""), (7, 5, 0, b"short"), (8, 61, 60, b"!")],
        key=repr,
    )
    assert suffix_dedup.without_repeats(frame(spark, [])).count() == 0


def test_repeats_in_texts_beyond_a_slice(spark):
    rng = random.Random(4)
    long = "".join(rng.choice("abcdefgh ") for _ in range(700_000))
    found = suffix_dedup.without_repeats(frame(spark, [(1, long), (2, "x" + long[600_000:600_080] + "y"), (3, "z" + long)])).collect()
    assert {r["doc_id"]: (r["n_removed"], bytes(r["kept"])) for r in found} == {1: (0, long.encode()), 2: (80, b"xy"), 3: (700_000, b"z")}


def test_shared_hashes_meet_in_even_ranges_a_bounded_part_at_a_time(monkeypatch):
    monkeypatch.setattr(suffix_dedup, "HELD", 1 << 11)
    rng = np.random.default_rng(6)
    texts = ["".join(map(chr, rng.integers(97, 123, 2000))) for _ in range(300)]
    texts += [texts[i][:1000] + texts[i + 1][:500] for i in range(0, 40, 2)] + ["-" * 900, "", "-" * 80]
    batches = [pa.record_batch({"t": pa.array(range(i + 1, i + 1 + len(x))), "text": pa.array(x)}) for i in range(0, len(texts), 20) if (x := texts[i : i + 20])]

    places = [(int(k) >> 16, i + int(r)) for i, b in zip(range(0, len(texts), 20), batches) for row, _, key, *_ in suffix_dedup._places(b, 50) for r, k in zip(row, key)]
    holders, counts = {}, {}
    for key, text in places:
        holders.setdefault(key, set()).add(text)
        counts[key] = counts.get(key, 0) + 1
    expected = {key: counts[key] for key, held in holders.items() if len(held) > 1}
    assert len(expected) > 500

    parts = 32
    rows = [row for b in suffix_dedup._packed_keys(50, parts)(iter(batches)) for row in b.to_pylist()]
    entry = sum(np.dtype(kind).itemsize for _, kind in suffix_dedup._PACKED)
    sizes = np.zeros(parts, np.int64)
    for row in rows:
        sizes[row["part"]] += len(row["keys"]) // entry
    assert sizes.sum() > 32_000 and sizes.max() < 1.3 * sizes.mean()

    rows.sort(key=lambda row: row["part"])
    found, most, sent = [], 0, 0

    def one_by_one():
        nonlocal most, sent
        for row in rows:
            sent += len(row["keys"]) // entry
            yield pa.record_batch({"part": pa.array([row["part"]], pa.int32()), "keys": pa.array([row["keys"]], pa.binary())})

    for b in suffix_dedup._shared_keys(one_by_one()):
        most, sent = max(most, sent), 0
        found += zip(b.column("key").to_pylist(), b.column("n").to_pylist())
    assert len(found) == len(expected) and dict(found) == expected
    # Some whole ranges at a time: no more than the bound and one range besides.
    assert 1 << 11 <= most <= (1 << 11) + 2 * sizes.max()


def test_sorted_groups_survive_useless_hashes(monkeypatch):
    rng = np.random.default_rng(1)
    symbols = rng.integers(1, 3, (300, 12)).astype(np.int16)
    group = np.sort(rng.integers(0, 9, 300))
    expected = sorted(range(300), key=lambda i: (group[i], symbols[i].tolist()))
    for useless in (False, True):
        if useless:
            monkeypatch.setattr(suffix_dedup, "_VALUE", np.ones(257, np.uint64))
        order, shared = suffix_dedup.sort_groups(suffix_dedup.Strings(symbols), group)
        assert [symbols[i].tolist() for i in order] == [symbols[i].tolist() for i in expected]
        for k in range(1, 300):
            if group[k] == group[k - 1]:
                a, b = symbols[order[k - 1]], symbols[order[k]]
                assert shared[k] == next((x for x in range(12) if a[x] != b[x]), 12)


def plain_runs(words, least=6, exponent=4):
    best = {}
    for q in range(1, len(words) // exponent + 1):
        i = 0
        while i + q < len(words):
            start = i
            while i + q < len(words) and words[i] == words[i + q]:
                i += 1
            if i > start and i - start + q >= max(least, exponent * q):
                best.setdefault((start, i - start + q), q)
            i += i == start
    return sorted((s, n, q) for (s, n), q in best.items())


def collapsed(words, runs):
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    return " ".join(w for i, w in enumerate(words) if i not in gone)


@pytest.mark.parametrize(("least", "exponent"), [(6, 4), (2, 2), (9, 3)])
def test_runs_equal_brute_force(spark, least, exponent):
    rng, rows = random.Random(3), []
    for i in range(150):
        words = [rng.choice("abcde"[: rng.choice([1, 2, 5])]) for _ in range(rng.randrange(120))]
        for _ in range(rng.randrange(3)):
            a, p = rng.randrange(len(words) + 1), rng.randrange(1, 12)
            for k in range(a + p, min(len(words), a + p * rng.randrange(3, 9))):
                words[k] = words[k - p]
        rows.append((i, rng.choice([" ", "\n\t"]).join(words) + rng.choice(["", " "])))
    found = periodic.periodic_runs(frame(spark, rows), min_length=least, exponent=exponent).collect()
    texts = dict(rows)
    assert len(found) == 150
    for r in found:
        words = texts[r["doc_id"]].split()
        runs = plain_runs(words, least, exponent)
        assert (r["n_words"], [tuple(x) for x in r["runs"]], r["collapsed"]) == (len(words), runs, collapsed(words, runs))


def test_common_extension_equals_plain_comparison():
    rng = np.random.default_rng(5)
    words = np.r_[90, np.tile(rng.integers(0, 3, 7), 40), rng.integers(0, 2, 300), 91]
    levels = periodic.recompress(words)
    i, j = np.sort(rng.integers(0, len(words), (2, 4000)), axis=0)
    i, j = i[i < j], j[i < j]
    expected = [next(k for k in range(len(words)) if b + k == len(words) or words[a + k] != words[b + k]) for a, b in zip(i, j)]
    assert periodic.common_extension(levels, i, j).tolist() == expected


def test_runs_in_odd_rows(spark):
    same = "a b " * 7
    rows = [(1, same), (1, same), (None, same), (2, None), (3, ""), (4, " \n "), (5, "A a A a A a A a"), (6, "x " * 400_000 + "y")]
    found = periodic.periodic_runs(frame(spark, rows)).collect()
    told = {r["doc_id"]: (r["n_words"], [tuple(x) for x in r["runs"]], r["collapsed"]) for r in found}
    assert told[1] == told[None] == (7, [(0, 7, 1)], "a b")
    assert told[2] == told[3] == told[4] == (0, [], "")
    assert told[5] == (8, [(0, 8, 2)], "A a") and told[6] == (400_001, [(0, 400_000, 1)], "x y")
    assert len(found) == 8
    assert periodic.periodic_runs(frame(spark, [])).count() == 0
    named = frame(spark, rows).select(F.col("doc_id").cast("string").alias("doc_id"), "text", F.lit(1).alias("runs"))
    assert {r["doc_id"] for r in periodic.periodic_runs(named).collect()} == {"1", None, "2", "3", "4", "5", "6"}
    with pytest.raises(ValueError):
        periodic.periodic_runs(frame(spark, []), exponent=1)


def test_planted_runs_follow_the_rule(spark):
    import zlib

    rng = random.Random(6)
    rows = [(i, " ".join(f"w{rng.randrange(50)}" for _ in range(rng.randrange(40)))) for i in range(300)] + [(None, "a b"), (1000, None)]
    for r in with_planted_runs(frame(spark, rows)).collect():
        h = zlib.crc32(str(r["doc_id"]).encode())
        text = dict(rows)[r["doc_id"]]
        words = (text or "").split()
        if r["doc_id"] is not None and h % 10 == 0 and words:
            a = h // 10 % len(words)
            p = 1 + (len(words) - a) // (3 + h // 10 % 8)
            text = " ".join(words[i] if i < a else words[a + (i - a) % p] for i in range(len(words)))
        assert r["text"] == text


UNIT = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")


def plain_fill(i, text, marks=("<P>", "<S>", "<M>"), seed=42):
    text = text or ""
    units = UNIT.findall(text)
    h = hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[8 * k : 8 * k + 8], 16) for k in range(4))
    n = len(units)
    a, z = sorted((h1 % (n + 1), h2 % (n + 1)))
    if not text or any(m in text for m in marks) or h3 % 100 >= 50:
        return n, "plain", None, None, text
    head, body, tail = ("".join(units[x]) for x in (slice(a), slice(a, z), slice(z, None)))
    p, s, m = marks
    spm = h4 % 100 < 80
    return n, "spm" if spm else "psm", len(head), len(body), s + tail + p + head + m + body if spm else p + head + s + tail + m + body


@pytest.mark.parametrize("block", [1, 7, 1024])
def test_fill_in_middle_equals_a_plain_rendering(spark, block):
    rng = random.Random(8)
    pieces = ["a", "é", "日本", "\U0001f600", " ", "\n", "\t", " ", "word", "<", "<S", ">"]
    rows = [(i, "".join(rng.choice(pieces) for _ in range(rng.randrange(60)))) for i in range(400)]
    rows += [(None, "one two three"), (500, None), (501, ""), (502, " \n"), (503, "a <M> b"), (7, "again here"), (7, "again here")]
    found = fill_middle.fill_in_middle(frame(spark, rows), block=block)
    found = found.withColumn("back", fill_middle.restored(F.col("output"), F.col("form"))).collect()
    keys = ("n", "form", "prefix_chars", "middle_chars", "output")
    told = sorted(((r["doc_id"], *(r[k] for k in keys)) for r in found), key=repr)
    assert told == sorted(((i, *plain_fill(i, t)) for i, t in rows), key=repr)
    assert all(r["back"] == r["text"] for r in found)
    assert {r["form"] for r in found} == {"plain", "spm", "psm"}


def test_fill_in_middle_of_long_texts_and_empty_tables(spark):
    long = "wörd " * 200_000
    ids = [i for i in range(60) if plain_fill(i, long)[1] != "plain"][:3]
    found = fill_middle.fill_in_middle(frame(spark, [(i, long) for i in ids])).collect()
    assert {r["doc_id"]: (r["n"], r["form"], r["prefix_chars"], r["middle_chars"], r["output"]) for r in found} == {i: plain_fill(i, long) for i in ids}
    assert fill_middle.fill_in_middle(frame(spark, [])).count() == 0
    named = frame(spark, [(1, "a b")]).selectExpr("cast(doc_id as string) as doc_id", "text", "1 as low", "2 as first_draw")
    assert [r["doc_id"] for r in fill_middle.fill_in_middle(named).collect()] == ["1"]
    with pytest.raises(ValueError):
        fill_middle.fill_in_middle(named, sentinels=("<P>", "<P>", "<M>"))
    with pytest.raises(ValueError):
        fill_middle.restored(F.lit(""), F.lit("psm"), ("aa", "b", "c"))


def test_fenwick_trees_count_and_find():
    rng = np.random.default_rng(2)
    counts = rng.integers(0, 4, 77)
    tree, sums = fill_middle.Fenwick(counts), np.r_[0, np.cumsum(counts)]
    assert [tree.before(k) for k in range(78)] == sums.tolist()
    for rank in range(1, int(sums[-1]) + 1):
        block = int(np.searchsorted(sums, rank)) - 1
        assert tree.descend(rank) == (block, int(sums[block]))

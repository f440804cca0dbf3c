"""Language identification by interpolated Kneser-Ney character models.

Text is lower-cased; each run of characters that are no letters is one blank. Four-character counts of every language
are taken over all training texts in one pass; continuation counts, discounts and interpolation weights of the lower
orders follow from that table in Spark, order by order. The model is, per language and order, a sorted array of 64-bit
hashes with discounted probabilities, and one of context hashes with interpolation weights. The hash is a bijection of the
packed characters, so no two grams collide, however many there are. An entry has 12 bytes; the arrays, packed by tasks
and fetched one at a time, hold the distinct grams of the training texts, whose number grows far slower than the texts.

The language with the lowest cross-entropy per character wins. Its score is a softmax whose temperature is chosen on
the training rows, over ``EVIDENCE`` characters at most: longer texts are no surer. A text is rejected when its cross-entropy
is far beyond that of training texts of the language and of like length: ``REJECT_DEVIATIONS`` standard deviations above
their median and ``REJECT_FACTOR`` times it. Where few such texts have the length, the nearest length with enough counts,
with wider bounds for shorter texts; a language without any rejects beyond a uniform choice of letters.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from paraseg.llm.common import arrow_limits, mix, text_slices, written

ORDER = 4
EVIDENCE = 400
TEMPERATURES = [0.01, 0.02, 0.05, 0.1, 0.2, 0.5, 1.0]
REJECT_DEVIATIONS = 8.0
REJECT_FACTOR = 1.5
REJECT_ROWS = 8
UNKNOWN = "und"
_U = np.uint64
_SLOT_BITS = 19


def _letters() -> np.ndarray:
    """For each 16-bit code: its lower case if it is a letter, else 0."""
    table = np.zeros(1 << 16, np.uint64)
    for code in range(1 << 16):
        char = chr(code)
        if char.isalpha():
            low = char.lower()
            table[code] = ord(low) if len(low) == 1 and ord(low) < 1 << 16 else code
    return table


def _grams(text: pa.Array, table: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """First row, packed four-character codes, and their number by text, of each slice of a column.

    A text starts after three blanks and ends with one; characters beyond 16 bits are folded into the private area.
    """
    for first, _, data, offsets in text_slices(text, 1 << 18):
        codes = np.frombuffer(data.tobytes().decode("utf-8", "replace").encode("utf-32-le"), np.uint32)
        ends = np.r_[0, np.cumsum((data & 0xC0) != 0x80)][offsets]
        high = codes > 0xFFFF
        symbols = table[np.where(high, 0, codes)]
        if high.any():
            rare = codes[high]
            symbols[high] = np.where([chr(c).isalpha() for c in rare.tolist()], 0xE000 + rare % 0x1900, 0)
        sizes = np.diff(ends)
        row = np.repeat(np.arange(len(sizes)), sizes)
        solid = symbols != 0
        lead = solid.copy()
        lead[1:] |= solid[:-1]
        heads = ends[:-1][ends[:-1] < len(symbols)]
        lead[heads] = solid[heads]
        symbols, row = symbols[lead], row[lead]
        kept = np.bincount(row, minlength=len(sizes))
        # Three blanks before each text.
        padded = np.zeros(len(symbols) + 3 * len(sizes) + 3, np.uint64)
        padded[np.arange(len(symbols)) + 3 * (row + 1)] = symbols
        n = len(padded) - 3
        keys = (padded[:n] << _U(48)) | (padded[1 : n + 1] << _U(32)) | (padded[2 : n + 2] << _U(16)) | padded[3 : n + 3]
        yield first, keys[np.arange(len(symbols)) + 3 * row], kept


def _count_grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``(lang, gram, n)`` of a task's training rows."""
    table, totals = _letters(), {}

    def fold(lang: str, keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        order = np.argsort(keys)
        keys, counts = keys[order], counts[order]
        starts = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
        return keys[starts], np.add.reduceat(counts, starts)

    for batch in batches:
        langs = np.array(batch.column(0).to_pylist(), object)
        for lang in sorted(set(langs)):
            texts = batch.column(1).filter(pa.array(langs == lang))
            for _, keys, _ in _grams(texts, table):
                if not len(keys):
                    continue
                keys = np.sort(keys)
                starts = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
                held = totals.setdefault(lang, [])
                held.append((keys[starts], np.diff(np.r_[starts, len(keys)])))
                if len(held) > 16:
                    totals[lang] = [fold(lang, *map(np.concatenate, zip(*held)))]
    for lang, held in totals.items():
        keys, counts = fold(lang, *map(np.concatenate, zip(*held)))
        for at in range(0, len(keys), 1 << 16):
            part = slice(at, at + (1 << 16))
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(keys[part])), pa.array(keys[part].view(np.int64)), pa.array(counts[part].astype(np.int64))], ["lang", "gram", "n"])


def orders(grams: DataFrame) -> Iterator[tuple[int, DataFrame]]:
    """``(k, rows)`` from the highest order down; rows are ``lang, weight, gram, value``, of counts ``(lang, gram, n)``.

    Rows without ``weight`` hold a gram's discounted probability at order k, rows with it the weight of order k - 1 after
    the context ``gram``. Below the highest order, counts are numbers of distinct characters before the gram. A context
    has as many rows at most as there are characters.
    """
    counts = grams
    for k in range(ORDER, 0, -1):
        if k < ORDER:
            tail = F.col("gram").bitwiseAND(F.lit((1 << 16 * k) - 1))
            counts = written(counts.groupBy("lang", tail.alias("gram")).agg(F.count("*").alias("n")))
        ones = counts.groupBy("lang").agg(F.count_if(F.col("n") == 1).alias("n1"), F.count_if(F.col("n") == 2).alias("n2"))
        share = F.coalesce(F.try_divide(F.col("n1"), F.col("n1") + 2 * F.col("n2")), F.lit(0.5))
        # One row for each language.
        ones = F.broadcast(ones.select("lang", F.greatest(F.lit(0.1), F.least(F.lit(0.9), share)).alias("d")))
        context = F.shiftrightunsigned("gram", 16)
        after = Window.partitionBy("lang", "context")
        rows = counts.withColumn("context", context).select(
            "*", F.sum("n").over(after).alias("total"), F.count("*").over(after).alias("types"), F.min("gram").over(after).alias("first")
        ).join(ones, "lang")
        seen = F.struct(F.lit(False).alias("weight"), F.col("gram"), F.greatest((F.col("n") - F.col("d")) / F.col("total"), F.lit(0.0)).alias("value"))
        weight = F.struct(F.lit(True).alias("weight"), F.col("context").alias("gram"), (F.col("d") * F.col("types") / F.col("total")).alias("value"))
        both = F.when(F.col("gram") == F.col("first"), F.array(seen, weight)).otherwise(F.array(seen))
        yield k, rows.select("lang", F.inline(both))


def kneser_ney(grams: DataFrame) -> DataFrame:
    """The rows of all ``orders``, with their ``k``."""
    return reduce(DataFrame.union, (rows.select("lang", F.lit(k).alias("k"), "weight", "gram", "value") for k, rows in orders(grams)))


def _packed(rows: pa.Table) -> pa.Table:
    """The entries of one language and order as two blobs, sorted by hash: as long as the array that every task reads."""
    h = mix(rows.column("gram").to_numpy().view(np.uint64))
    order = np.argsort(h)
    values = rows.column("value").to_numpy()[order].astype("<f4")
    return pa.table({
        "lang": rows.column("lang").slice(0, 1), "weight": rows.column("weight").slice(0, 1),
        "hashes": pa.array([h[order].astype("<u8").tobytes()], pa.binary()), "numbers": pa.array([values.tobytes()], pa.binary()),
    })


#: Of a model: by language, by order from 1 on, hashes and values of grams, and of contexts.
Tables = list[list[list[tuple[np.ndarray, np.ndarray]]]]
LETTERS = 1 << 12


def _found(table: tuple[np.ndarray, np.ndarray], h: np.ndarray, missing: float) -> np.ndarray:
    """Values of ascending hashes."""
    keys, values = table
    if not len(keys):
        return np.full(len(h), missing)
    at = np.minimum(np.searchsorted(keys, h), len(keys) - 1)
    return np.where(keys[at] == h, values[at].astype(np.float64), missing)


def log_probabilities(tables: Tables, keys: np.ndarray) -> np.ndarray:
    """Natural logarithms, a row for each gram and a column for each language. A gram's tails are looked up once."""
    tails, back = [keys], []
    for k in range(ORDER - 1, 0, -1):
        short, inverse = np.unique(tails[-1] & _U((1 << 16 * k) - 1), return_inverse=True)
        tails.append(short)
        back.append(inverse)
    out = np.full((1, len(tables)), 1.0 / LETTERS)
    back.append(np.zeros(len(tails[-1]), np.int64))
    for k in range(1, ORDER + 1):
        grams = tails[ORDER - k]
        contexts, of = np.unique(grams >> _U(16), return_inverse=True)
        lower = out[back[ORDER - k]]
        out = np.empty((len(grams), len(tables)))
        h, hc = mix(grams), mix(contexts)
        order, order_c = np.argsort(h), np.argsort(hc)
        h, hc = h[order], hc[order_c]
        weights = np.empty(len(contexts))
        for i, own in enumerate(tables):
            seen, after = own[k - 1]
            out[order, i] = _found(seen, h, 0.0)
            weights[order_c] = _found(after, hc, 1.0)
            out[:, i] += weights[of] * lower[:, i]
    return np.log(out)


def train(docs: DataFrame, *, lang_col: str = "lang", text_col: str = "text") -> tuple[list[str], Tables]:
    """Languages, in order, and their tables, of all rows that have a language and a text."""
    arrow_limits(docs.sparkSession)
    rows = docs.select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).alias("text")).dropna()
    grams = written(rows.mapInArrow(_count_grams, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n")))
    model: dict[str, list] = {}
    for k, entries in orders(grams):
        packed = written(entries.groupBy("lang", "weight").applyInArrow(_packed, "lang string, weight boolean, hashes binary, numbers binary"))
        for row in packed.toLocalIterator():
            own = model.setdefault(row["lang"], [[None, None] for _ in range(ORDER)])
            own[k - 1][row["weight"]] = (np.frombuffer(row["hashes"], "<u8"), np.frombuffer(row["numbers"], "<f4"))
    langs = sorted(model)
    return langs, [[tuple(pair) for pair in model[name]] for name in langs]


def _score(model) -> Callable:
    """Letters, grams and cross-entropy by language of each row's text (the last column)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, own = _letters(), model.value
        n_langs = len(own)
        slots, index = np.zeros(1 << _SLOT_BITS, np.uint64), np.zeros(1 << _SLOT_BITS, np.int32)
        for batch in batches:
            sizes, sums, letters = [], [], []
            for _, keys, kept in _grams(batch.column("text"), table):
                sizes.append(kept)
                if not len(keys):
                    sums.append(np.zeros((len(kept), n_langs)))
                    letters.append(np.zeros(len(kept), np.int64))
                    continue
                # Each distinct gram is looked up once a slice; a slot keeps one gram, the others follow.
                slot = ((keys * _U(0x9E3779B97F4A7C15)) >> _U(64 - _SLOT_BITS)).astype(np.int64)
                slots[slot] = keys
                shown = np.zeros(1 << _SLOT_BITS, bool)
                shown[slot] = True
                used = np.flatnonzero(shown)
                index[used] = np.arange(len(used))
                at = index[slot]
                other = np.flatnonzero(slots[slot] != keys)
                more, back = np.unique(keys[other], return_inverse=True)
                at[other] = len(used) + back
                logs = log_probabilities(own, np.r_[slots[used], more])
                starts = np.cumsum(kept) - kept
                some = kept > 0
                total = np.zeros((len(kept), n_langs))
                for i in range(n_langs):
                    total[some, i] = np.add.reduceat(logs[:, i][at], starts[some])
                sums.append(total)
                count = np.zeros(len(kept), np.int64)
                count[some] = np.add.reduceat((keys & _U(0xFFFF)) != 0, starts[some], dtype=np.int64)
                letters.append(count)
            n, total, count = np.concatenate(sizes), np.concatenate(sums), np.concatenate(letters)
            cross = -total / np.maximum(n, 1)[:, None]
            columns = [batch.column(i) for i in range(batch.num_columns - 1)]
            columns += [pa.array(n.astype(np.int64)), pa.array(count), pa.array(list(cross), pa.list_(pa.float64()))]
            yield pa.RecordBatch.from_arrays(columns, [*batch.schema.names[:-1], "grams", "letters", "cross"])

    return run


def usual_scores(known: DataFrame) -> DataFrame:
    """``(lang_pred, usual)``: number, median and spread (from the upper quartile) of the cross-entropies of each length.

    Quantiles of all rows, not means or maxima: a few junk rows do not move them.
    """
    cuts = F.percentile_approx("best", [0.5, 0.75], 10000)
    usual = known.groupBy("lang_pred", "length").agg(F.count("*").alias("rows"), cuts.alias("cuts"))
    usual = usual.select("lang_pred", "length", F.col("cuts")[0].alias("middle"), ((F.col("cuts")[1] - F.col("cuts")[0]) / 0.6745).alias("spread"), (F.col("rows") < REJECT_ROWS).alias("few"))
    return usual.groupBy("lang_pred").agg(F.collect_list(F.struct("length", "middle", "spread", "few")).alias("usual"))


def reject_limit() -> Column:
    """The highest usual cross-entropy of a row ``(length, usual)``; null without training texts.

    The nearest length with ``REJECT_ROWS`` training texts counts, else the nearest with any; shorter texts vary more.
    """
    near = F.array_min(F.transform("usual", lambda u: F.struct(u["few"].alias("few"), F.abs(u["length"] - F.col("length")).alias("off"), u.alias("of"))))["of"]
    shorter = F.pow(F.lit(2.0), F.greatest(near["length"] - F.col("length"), F.lit(0)) / 2)
    return F.greatest(near["middle"] + REJECT_DEVIATIONS * F.greatest(near["spread"], F.lit(0.02)) * shorter, REJECT_FACTOR * near["middle"] * shorter)


def identify(docs: DataFrame, training: Column, *, id_col: str = "doc_id", lang_col: str = "lang", text_col: str = "text") -> DataFrame:
    """``(doc_id, training, lang_pred, score, rejected, cross_entropy)`` of every row.

    Learns from the rows where ``training`` holds and language and text are not null. A text that is null or has no
    letter is ``und`` with score 0 and rejected; so is every text if there is nothing to learn from. Ties go to the
    language that sorts first. Repeated rows are predicted alike; ids may be null; other columns are ignored.
    """
    spark: SparkSession = docs.sparkSession
    rows = docs.select(
        F.col(id_col).alias("doc_id"), F.coalesce(training, F.lit(False)).alias("training"),
        F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("text"),
    )
    langs, model = train(rows.filter("training"))
    if not langs:
        return rows.select("doc_id", "training", F.lit(UNKNOWN).alias("lang_pred"), F.lit(0.0).alias("score"), F.lit(True).alias("rejected"), F.lit(None).cast("double").alias("cross_entropy"))
    schema = T.StructType([*rows.schema.fields[:3], *(T.StructField(n, T.LongType()) for n in ("grams", "letters")), T.StructField("cross", T.ArrayType(T.DoubleType()))])
    best = F.array_min("cross")
    shared = spark.sparkContext.broadcast(model)
    scored = written(
        rows.mapInArrow(_score(shared), schema)
        .withColumn("best", best)
        .withColumn("lang_pred", F.element_at(F.array(*map(F.lit, langs)), F.array_position("cross", best).cast("int")))
        .withColumn("length", F.floor(F.log2(F.col("grams") + 1)).cast("int"))
    )
    # The scores are written: nothing reads the tables again.
    shared.destroy()
    del model

    def softmax(heat: Column, away: Column) -> Column:
        size = F.least("grams", F.lit(EVIDENCE))
        return F.exp(-heat * size * away) / F.aggregate("cross", F.lit(0.0), lambda s, x: s + F.exp(-heat * size * (x - F.col("best"))))

    known = scored.filter("training and lang is not null and letters > 0")
    own = F.element_at("cross", F.array_position(F.array(*map(F.lit, langs)), F.col("lang")).cast("int"))
    fit = known.withColumn("away", own - F.col("best")).agg(
        *(F.avg(F.log(F.greatest(softmax(F.lit(t), F.col("away")), F.lit(1e-12)))).alias(f"t{i}") for i, t in enumerate(TEMPERATURES))
    ).first()
    heat = max(zip(TEMPERATURES, fit), key=lambda x: x[1] if x[1] is not None else -1e9)[0]
    usual = usual_scores(known.filter("lang = lang_pred"))
    # At most one row for each language, with one entry for each power of two.
    scored = scored.join(F.broadcast(usual), "lang_pred", "left")
    limit = reject_limit()
    far = F.col("best") > F.coalesce(limit, F.lit(float(np.log(LETTERS))))
    blank = F.col("letters") == 0
    return scored.select(
        "doc_id", "training",
        F.when(blank, UNKNOWN).otherwise(F.col("lang_pred")).alias("lang_pred"),
        F.when(blank, 0.0).otherwise(softmax(F.lit(heat), F.lit(0.0))).alias("score"),
        (blank | far).alias("rejected"),
        F.when(~blank, F.col("best")).alias("cross_entropy"),
    )

"""Document fingerprints: one-permutation MinHash with optimal densification and b-bit packing.

Five-word shingles are hashed once; low bits of a hash name its bin, the rest is its value, and a bin keeps its smallest
value. An empty bin takes the value of the full bin that a hash of both bin numbers puts first, the same for all texts. The
lowest ``BITS`` bits of each bin are packed into longs. Bins of different values agree by chance in one of 2**BITS
cases, which the likeness is corrected for.

Everything is an expression over one row; nothing is shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from paraseg.llm.common import written

SHINGLE, BINS, BITS = 5, 128, 4
VALUE_BITS = 48
EMPTY = (1 << VALUE_BITS) - 1
PER_LONG = 64 // BITS
SEPARATORS = r"[\x20\x09-\x0D]+"
NO_ID = -(1 << 63)


def _let(value: Column, body) -> Column:
    """``body`` of a value that is computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _shingles(text: Column) -> Column:
    words = F.transform(F.filter(F.split(text, SEPARATORS), lambda w: w != ""), lambda w: F.xxhash64(w))

    def runs(h: Column) -> Column:
        many = F.transform(F.sequence(F.lit(0), F.size(h) - SHINGLE), lambda i: F.xxhash64(*(F.get(h, i + k) for k in range(SHINGLE))))
        return F.when(F.size(h) >= SHINGLE, many).when(F.size(h) > 0, F.array(F.xxhash64(h))).otherwise(F.array().cast("array<bigint>"))

    return _let(words, runs)


def _bins(shingles: Column) -> Column:
    """The smallest value of each bin, in order of bins; EMPTY where there is none."""
    packed = F.transform(shingles, lambda h: F.shiftleft(h.bitwiseAND(F.lit(BINS - 1).cast("long")), VALUE_BITS).bitwiseOR(F.shiftrightunsigned(h, 64 - VALUE_BITS)))
    ends = F.transform(F.sequence(F.lit(0).cast("long"), F.lit(BINS - 1).cast("long")), lambda b: F.shiftleft(b, VALUE_BITS).bitwiseOR(F.lit(EMPTY)))
    bin_of = lambda x: F.shiftrightunsigned(x, VALUE_BITS)
    first = lambda a: F.filter(a, lambda x, i: (i == 0) | (bin_of(x) != bin_of(F.get(a, i - 1))))
    return _let(F.sort_array(F.concat(ends, packed)), lambda a: F.transform(first(a), lambda x: x.bitwiseAND(F.lit(EMPTY))))


def _densified(bins: Column) -> Column:
    def fill(a: Column) -> Column:
        full = F.filter(F.sequence(F.lit(0), F.lit(BINS - 1)), lambda j: F.get(a, j) != EMPTY)

        def filled(present: Column) -> Column:
            source = lambda i: F.array_min(F.transform(present, lambda j: F.struct(F.xxhash64(i, j).alias("o"), j.alias("j"))))["j"]
            return F.transform(a, lambda x, i: F.when(x == EMPTY, F.get(a, source(i))).otherwise(x))

        return F.when(F.exists(a, lambda x: x == EMPTY), _let(full, filled)).otherwise(a)

    return _let(bins, fill)


def fingerprint(text: Column) -> Column:
    """Packed bins, an array of longs; empty for a text without words. Equal texts have equal fingerprints."""

    def packed(v: Column) -> Column:
        digits = lambda g: F.aggregate(F.slice(v, g * PER_LONG + 1, PER_LONG), F.lit(0).cast("long"), lambda acc, x: F.shiftleft(acc, BITS).bitwiseOR(x.bitwiseAND(F.lit((1 << BITS) - 1).cast("long"))))
        return F.array(*(digits(g) for g in range(BINS // PER_LONG)))

    none = F.array().cast("array<bigint>")
    return _let(_shingles(text), lambda s: F.when(F.size(s) > 0, _let(_densified(_bins(s)), packed)).otherwise(none))


def as_hex(mark: Column) -> Column:
    return F.array_join(F.transform(mark, lambda x: F.lower(F.lpad(F.hex(x), 16, "0"))), "")


def likeness(a: Column, b: Column) -> Column:
    """Estimated Jaccard similarity, 0 to 1; two texts without words are alike, one is unlike any other text."""
    ones = F.lit(sum(1 << BITS * i for i in range(PER_LONG - 1)) - (1 << 63) + (1 << BITS * (PER_LONG - 1)) if BITS == 1 else sum(1 << BITS * i for i in range(PER_LONG)))

    def apart(x: Column, y: Column) -> Column:
        d = x.bitwiseXOR(y)
        for shift in (1, 2):
            d = d.bitwiseOR(F.shiftrightunsigned(d, shift))
        return F.bit_count(d.bitwiseAND(ones))

    differ = F.aggregate(F.zip_with(a, b, apart), F.lit(0), lambda s, x: s + x)
    chance = 2.0**-BITS
    estimate = (1 - differ / F.lit(float(BINS)) - chance) / (1 - chance)
    both, any_ = (F.size(a) > 0) & (F.size(b) > 0), (F.size(a) > 0) | (F.size(b) > 0)
    return F.when(both, F.greatest(F.lit(0.0), F.least(F.lit(1.0), estimate))).when(any_, 0.0).otherwise(1.0)


def neighbours(rows: DataFrame, key: str, kept: list[str]) -> DataFrame:
    """Each distinct ``key`` with ``next_key`` and ``prev_key`` in ascending order (the ends meet) and their ``kept``.

    Ranges of keys are sorted apart; only the first and last row of each range, as many as there are partitions, are
    ordered together.
    """
    carried = lambda name: F.struct(F.col(key), *kept).alias(name)
    ranged = written(rows.repartitionByRange(key).withColumn("range", F.spark_partition_id()))
    ends = ranged.groupBy("range").agg(F.min_by(carried("x"), key).alias("head"), F.max_by(carried("x"), key).alias("tail"))
    whole = Window.orderBy("range")  # one row for each partition
    ends = written(ends.select(
        "range", F.lead("head").over(whole).alias("after"), F.lag("tail").over(whole).alias("before"),
        F.first("head").over(whole.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("least"),
        F.last("tail").over(whole.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("most"),
    ))
    inside = Window.partitionBy("range").orderBy(key)
    found = ranged.select(
        "*", F.lead(carried("x")).over(inside).alias("next"), F.lag(carried("x")).over(inside).alias("prev")
    ).join(F.broadcast(ends), "range")
    return found.select(
        *rows.columns, F.coalesce("next", "after", "least").alias("next"), F.coalesce("prev", "before", "most").alias("prev")
    )


def edited_pairs(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each document's fingerprint beside those of its edited text and of the next document.

    The edited text has the last half of the code points replaced by the first as many of the next document in ascending
    order of ids (after the last: the first). A null text is empty; a null id comes first; of rows that share an id each gives a
    row, and the smallest by hash stands for them as the next document. One document is its own next. Extra columns
    are ignored.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("key"), text.alias("text"))
    marks = written(rows.select("key", F.length("text").cast("long").alias("n"), F.xxhash64("text").alias("h"), fingerprint(F.col("text")).alias("mark")))
    first = F.min_by(F.struct("n", "h", "mark"), "h").alias("f")
    around = neighbours(marks.groupBy("key").agg(first).select("key", "f.*"), "key", ["n", "mark"])
    around = around.select(
        "key", "h", "mark", F.col("next.mark").alias("next_mark"), F.col("prev.key").alias("prev_key"), F.floor(F.col("prev.n") / 2).cast("int").alias("prev_half")
    )
    # One shuffle of the texts by id serves both their own row and the row before.
    placed = rows.join(around, "key")
    heads = (
        placed.filter(F.xxhash64("text").bitwiseXOR(F.col("h")) == 0)  # no join key, which would deal the texts out anew
        .select(F.col("prev_key").alias("key"), F.left("text", "prev_half").alias("head"))
        .groupBy("key").agg(F.first("head").alias("head"))
    )
    both = placed.select("key", "text", "h", "mark", "next_mark").join(heads, "key")
    n = F.length("text")
    half = F.floor(n / 2).cast("int")
    edited = F.concat(F.left("text", n - half), F.left("head", half))
    # Rows that share an id with the one that stands for them have fingerprints of their own.
    mark = F.when(F.xxhash64("text") == F.col("h"), F.col("mark")).otherwise(fingerprint(F.col("text")))
    both = both.select("key", n.cast("long").alias("n_chars"), edited.alias("edited"), mark.alias("mark"), "next_mark")
    return both.select(
        F.when(F.col("key") != NO_ID, F.col("key")).alias("doc_id"), "n_chars", F.sha2("edited", 256).alias("edited_sha256"),
        "mark", fingerprint(F.col("edited")).alias("edited_mark"), "next_mark",
    )

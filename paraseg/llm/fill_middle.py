"""Fill-in-the-middle documents: prefix, middle and suffix of a text, marked and put in another order.

A text is cut into units: a word with the white space before it, or white space at the end of the text. Two hashes of the
document's id name two cuts, counted in units. Each text is divided into blocks of ``BLOCK`` bytes. Two Fenwick trees over
the blocks hold the numbers of units that end in a block and of code points that start in it. A descent by powers of two
finds the block where a cut falls, and the code points before it; the place inside the block is read from that block alone.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paraseg.llm.common import arrow_limits, text_slices

BLOCK = 1024
SENTINELS = ("<P>", "<S>", "<M>")
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True


def unit_ends(data: np.ndarray) -> np.ndarray:
    """For each byte of a text, whether a unit ends with it."""
    solid = ~_SPACE[data]
    ends = solid.copy()
    ends[:-1] &= ~solid[1:]
    if len(data):
        ends[-1] = True
    return ends


class Fenwick:
    """Prefix sums over blocks, as a tree whose node i holds the sum of the last ``i & -i`` blocks up to block i."""

    def __init__(self, counts: np.ndarray):
        sums = np.r_[0, np.cumsum(counts, dtype=np.int64)]
        i = np.arange(len(sums))
        self.nodes = sums - sums[i - (i & -i)]

    def before(self, block: int) -> int:
        """The sum of the blocks before ``block``."""
        total = 0
        while block:
            total += int(self.nodes[block])
            block &= block - 1
        return total

    def descend(self, rank: int) -> tuple[int, int]:
        """The block that holds the ``rank``-th item (from 1), and the number of items before that block."""
        block, left = 0, rank
        step = 1 << (len(self.nodes) - 1).bit_length()
        while step := step >> 1:
            if block + step < len(self.nodes) and self.nodes[block + step] < left:
                block += step
                left -= int(self.nodes[block])
        return block, rank - left


class Index:
    """Units and code points of one text by block."""

    def __init__(self, data: np.ndarray, block: int = BLOCK):
        self.data, self.block = data, block
        starts = np.arange(0, len(data), block)
        self.n = 0
        if len(data):
            units = np.add.reduceat(unit_ends(data), starts, dtype=np.int64)
            self.n = int(units.sum())
            self.units = Fenwick(units)
            self.chars = Fenwick(np.add.reduceat((data & 0xC0) != 0x80, starts, dtype=np.int64))

    def chars_before(self, units: int) -> int:
        """Code points of the first ``units`` units."""
        if not units:
            return 0
        at, before = self.units.descend(units)
        # A unit ends where the next byte begins a word's white space, so the byte after the block decides its last one.
        own = self.data[at * self.block : (at + 1) * self.block + 1]
        ends = np.flatnonzero(unit_ends(own)[: self.block])
        upto = int(ends[units - before - 1]) + 1
        return self.chars.before(at) + int(np.count_nonzero((own[:upto] & 0xC0) != 0x80))


def _cuts(block: int) -> Callable:
    """Units of each row's text, and code points before its two cuts; the row's other columns stay."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            first, second = (batch.column(c).to_pylist() for c in ("first_draw", "second_draw"))
            out = []
            for row, _, data, offsets in text_slices(batch.column("text")):
                for a, z in zip(offsets[:-1].tolist(), offsets[1:].tolist()):
                    index = Index(data[a:z], block)
                    low, high = sorted((first[row] % (index.n + 1), second[row] % (index.n + 1)))
                    out.append((index.n, index.chars_before(low), index.chars_before(high)))
                    row += 1
            columns = [pa.array(x, pa.int64()) for x in (zip(*out) if out else [[]] * 3)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *columns], [*batch.schema.names, "n", "low", "high"])

    return run


def _checked(sentinels: tuple[str, str, str]) -> tuple[str, str, str]:
    """Three different marks, each beginning with a character that none has elsewhere: so pieces and marks never run together."""
    heads = {x[:1] for x in sentinels}
    if len(set(sentinels)) != 3 or "" in heads or any(h in x[1:] for h in heads for x in sentinels):
        raise ValueError(f"Sentinels {sentinels} cannot be told apart from the text around them.")
    return sentinels


def fill_in_middle(
    docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", seed: int = 42, rate: int = 50, spm_rate: int = 80,
    sentinels: tuple[str, str, str] = SENTINELS, block: int = BLOCK,
) -> DataFrame:
    """``(doc_id, text, n, form, prefix_chars, middle_chars, output)`` of every row.

    ``rate`` of 100 texts are transformed, ``spm_rate`` of 100 of these suffix first. The draws are 32-bit groups of the
    SHA-256 of ``seed:doc_id``, so a row's result hangs on its id and text alone. A text that is null (as the empty text),
    empty, or that holds a sentinel stays as it is: form ``plain``, lengths null. Cuts may coincide, and pieces may be
    empty. A null id is drawn as an empty string; repeated ids are drawn alike, repeated rows stay; ids of any type are
    kept. Other columns are ignored; an empty table gives an empty one.
    """
    prefix, suffix, middle = _checked(sentinels)
    arrow_limits(docs.sparkSession)
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256)
    draw = lambda i: F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("long")
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    holds = F.greatest(*(F.col("text").contains(x) for x in sentinels))
    plain = (F.col("text") == "") | holds | (draw(2) % 100 >= rate)
    rows = docs.select(F.col(id_col).alias("doc_id"), text.alias("text")).select(
        "*", F.when(plain, "plain").when(draw(3) % 100 < spm_rate, "spm").otherwise("psm").alias("form"),
        draw(0).alias("first_draw"), draw(1).alias("second_draw"),
    )
    cut = rows.mapInArrow(_cuts(block), rows.selectExpr("*", "0L n", "0L low", "0L high").schema)
    piece = lambda a, z: F.substr("text", F.col(a) + 1 if a else F.lit(1), (F.col(z) - F.col(a) if a else F.col(z)))
    head, body, tail = piece(None, "low"), piece("low", "high"), F.substr("text", F.col("high") + 1)
    output = (
        F.when(F.col("form") == "plain", F.col("text"))
        .when(F.col("form") == "psm", F.concat(F.lit(prefix), head, F.lit(suffix), tail, F.lit(middle), body))
        .otherwise(F.concat(F.lit(suffix), tail, F.lit(prefix), head, F.lit(middle), body))
    )
    moved = F.col("form") != "plain"
    return cut.select(
        "doc_id", "text", "n", "form", F.when(moved, F.col("low")).alias("prefix_chars"),
        F.when(moved, F.col("high") - F.col("low")).alias("middle_chars"), output.alias("output"),
    )


def restored(output: Column, form: Column, sentinels: tuple[str, str, str] = SENTINELS) -> Column:
    """The text before the transformation, from output and form alone."""
    prefix, suffix, middle = _checked(sentinels)

    def halves(text: Column, mark: str) -> tuple[Column, Column]:
        head = F.substring_index(text, mark, 1)
        return head, F.substr(text, F.length(head) + len(mark) + 1)

    def pieces(first: str, second: str) -> tuple[Column, Column, Column]:
        one, rest = halves(F.substr(output, F.lit(len(first) + 1)), second)
        return one, *halves(rest, middle)

    head, tail, body = pieces(prefix, suffix)
    tail_first, head_second, body_last = pieces(suffix, prefix)
    return (
        F.when(form == "plain", output)
        .when(form == "psm", F.concat(head, body, tail))
        .otherwise(F.concat(head_second, body_last, tail_first))
    )

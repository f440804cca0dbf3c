"""Periodic runs of words, found through a run-length grammar made by recompression.

The words of a slice of texts are one sequence, with a symbol of its own before, between and after the texts. Rounds of
block compression (equal neighbours become one symbol of letter and count) and pair compression (symbols are dealt into
two sides by a hash; a left symbol and the right one after it become one) shorten it to a single symbol. Equal stretches are
cut alike but for their ends, so how far two positions agree is found by climbing the levels while they agree, a step or two
a level, and going down again to the first words that differ. Symbols are named by what they stand for, so an answer is
exact; the hash only decides how fast the sequence shrinks.

A run of period q and at least four periods covers a multiple i of 3q with i and i + q inside, whatever its start. For
every q, the positions of that grid where both words are equal are extended in both directions by such queries.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paraseg.llm.common import arrow_limits, mix, text_slices

MIN_LENGTH = 6
MIN_EXPONENT = 4
QUERIES_AT_ONCE = 1 << 18


class Level:
    """Symbols of a level, and for the level above: which symbol covers each, and where each begins (with the end)."""

    def __init__(self, symbols: np.ndarray):
        self.symbols, self.parent, self.first, self.blocks = symbols, None, None, False

    def cover(self, heads: np.ndarray, blocks: bool) -> None:
        self.parent = (np.cumsum(heads) - 1).astype(np.int32)
        self.first = np.r_[np.flatnonzero(heads), len(heads)].astype(np.int32)
        self.blocks = blocks

    def mirrored(self) -> Level:
        out = Level(self.symbols[::-1])
        if self.parent is not None:
            out.parent = (len(self.first) - 2 - self.parent)[::-1]
            out.first = (len(self.symbols) - self.first)[::-1]
            out.blocks = self.blocks
        return out


def _named(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    return np.unique((left.astype(np.int64) << 32) | right, return_inverse=True)[1].astype(np.int32)


def recompress(symbols: np.ndarray) -> list[Level]:
    """The levels of the grammar, from the sequence itself to one symbol."""
    levels, seed = [Level(symbols.astype(np.int32))], 0
    while len(now := levels[-1].symbols) > 1:
        heads = np.r_[True, now[1:] != now[:-1]]
        if not heads.all():
            levels[-1].cover(heads, True)
            levels.append(Level(_named(now[heads], np.diff(levels[-1].first))))
            continue
        pairs = np.zeros(0, bool)
        while not pairs.any():
            seed += 1
            side = (mix(now.astype(np.uint64) + np.uint64((seed * 0x9E3779B97F4A7C15) % (1 << 64))) & np.uint64(1)) == 1
            up, down = ~side[:-1] & side[1:], side[:-1] & ~side[1:]
            pairs = up if np.count_nonzero(up) >= np.count_nonzero(down) else down
        heads = np.r_[True, ~pairs]
        levels[-1].cover(heads, False)
        start = levels[-1].first[:-1]
        second = np.where(np.r_[pairs, False][start], now[np.minimum(start + 1, len(now) - 1)] + 1, 0)
        levels.append(Level(_named(now[start], second)))
    return levels


def common_extension(levels: list[Level], i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """How many symbols of level 0 agree from positions ``i`` and ``j`` on. The sequence ends with a symbol of its own."""
    # What stops at each level: queries, and the positions of two symbols that differ.
    stopped, query, a, b = [], np.arange(len(i)), i, j
    for level in levels:
        at = []
        while len(query):
            differ = level.symbols[a] != level.symbols[b]
            if differ.any():
                at.append((query[differ], a[differ], b[differ]))
                query, a, b = query[~differ], a[~differ], b[~differ]
            if not len(query):
                break
            over_a, over_b = level.parent[a], level.parent[b]
            inner = (level.first[over_a] != a) | (level.first[over_b] != b)
            if not inner.any():
                a, b = over_a, over_b
                break
            step = np.minimum(level.first[over_a + 1] - a, level.first[over_b + 1] - b) if level.blocks else 1
            step = np.where(inner, step, 0)
            a, b = a + step, b + step
        stopped.append(at)
        if not len(query):
            break
    query = a = b = np.zeros(0, np.int64)
    for k in range(len(stopped) - 1, -1, -1):
        if stopped[k]:
            query, a, b = (np.concatenate([x, *y]) for x, y in zip((query, a, b), zip(*stopped[k])))
        if not k or not len(query):
            continue
        below = levels[k - 1]
        a, b = below.first[a], below.first[b]
        while True:
            same = np.flatnonzero(below.symbols[a] == below.symbols[b])
            if not len(same):
                break
            x, y = a[same], b[same]
            step = np.minimum(below.first[below.parent[x] + 1] - x, below.first[below.parent[y] + 1] - y) if below.blocks else 1
            a[same], b[same] = x + step, y + step
    out = np.empty(len(i), np.int64)
    out[query] = a - i[query]
    return out


def _candidates(words: np.ndarray, longest: int, min_length: int, exponent: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Grid positions and periods whose two words are equal, some at a time."""
    held, size = [], 0
    for q in range(1, longest // exponent + 1):
        at = np.arange(0, len(words) - q, (exponent - 1) * q)
        at = at[words[at] == words[at + q]]
        if len(at):
            held.append((at, np.full(len(at), q)))
            size += len(at)
        if size >= QUERIES_AT_ONCE:
            yield tuple(map(np.concatenate, zip(*held)))
            held, size = [], 0
    if held:
        yield tuple(map(np.concatenate, zip(*held)))


def maximal_runs(words: np.ndarray, longest: int, min_length: int = MIN_LENGTH, exponent: int = MIN_EXPONENT) -> np.ndarray:
    """Rows of start, end and smallest period of the runs, by start, then period.

    ``words`` begins and ends with symbols that occur once. ``longest``: words of the longest stretch between such symbols.
    """
    found = []
    levels = back = None
    for at, q in _candidates(words, longest, min_length, exponent):
        if levels is None:
            levels = recompress(words)
            back = [level.mirrored() for level in levels]
        for part in range(0, len(at), QUERIES_AT_ONCE):
            i, p = at[part : part + QUERIES_AT_ONCE], q[part : part + QUERIES_AT_ONCE]
            end = i + p + common_extension(levels, i, i + p)
            start = i - common_extension(back, len(words) - i, len(words) - i - p)
            on = end - start >= np.maximum(min_length, exponent * p)
            found.append(np.unique(np.stack([start[on], end[on], p[on]], 1), axis=0))
    if not found:
        return np.zeros((0, 3), np.int64)
    runs = np.unique(np.concatenate(found), axis=0)
    # Periods of one stretch are multiples of the smallest, which comes first.
    runs = runs[np.r_[True, (runs[1:, :2] != runs[:-1, :2]).any(1)]] if len(runs) else runs
    return runs[np.lexsort((runs[:, 2], runs[:, 0]))]


def _scan(min_length: int, exponent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, counts, starts, lengths, periods, texts = [], [], [], [], [], []
            for _, _, data, offsets in text_slices(batch.column("text")):
                raw, names, symbols, kept = data.tobytes(), {}, [], []
                edges = np.zeros(len(offsets), np.int64)
                for row, (a, z) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist())):
                    symbols.append(-1)
                    words = raw[a:z].split()
                    kept += [b"", *words]
                    symbols += [names.setdefault(w, len(names)) for w in words]
                    edges[row + 1] = len(symbols)
                symbols.append(-1)
                ids = np.array(symbols, np.int64)
                alone = np.flatnonzero(ids < 0)
                ids[alone] = len(names) + np.arange(len(alone))
                n = np.diff(edges) - 1
                runs = maximal_runs(ids, int(n.max()), min_length, exponent)
                row = np.searchsorted(edges, runs[:, 0], "right") - 1
                turns = np.zeros(len(ids) + 1, np.int64)
                np.add.at(turns, runs[:, 0] + runs[:, 2], 1)
                np.add.at(turns, runs[:, 1], -1)
                dropped = np.cumsum(turns) > 0
                for a, z in zip(edges[:-1].tolist(), edges[1:].tolist()):
                    own = kept[a + 1 : z]
                    gone = dropped[a + 1 : z]
                    texts.append(b" ".join([w for w, g in zip(own, gone.tolist()) if not g] if gone.any() else own))
                sizes.append(n)
                counts.append(np.bincount(row, minlength=len(n)))
                starts.append(runs[:, 0] - edges[row] - 1)
                lengths.append(runs[:, 1] - runs[:, 0])
                periods.append(runs[:, 2])
            if not sizes:
                continue
            named = ["start", "length", "period"]
            items = pa.StructArray.from_arrays([pa.array(np.concatenate(x)) for x in (starts, lengths, periods)], named)
            ends = np.r_[0, np.cumsum(np.concatenate(counts))].astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(np.concatenate(sizes)), pa.ListArray.from_arrays(pa.array(ends), items), pa.array(texts, pa.binary())],
                ["doc_id", "n_words", "runs", "collapsed"],
            )

    return run


def periodic_runs(
    docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", min_length: int = MIN_LENGTH, exponent: int = MIN_EXPONENT
) -> DataFrame:
    """``(doc_id, n_words, runs, collapsed)`` of every row.

    Words are what white space (blank, tab, line ends) separates. ``runs`` holds start, length and smallest period of every
    maximal run of at least ``min_length`` words and ``exponent`` periods (two at least), by start, then period. ``collapsed``
    is the text's words, joined by one blank, without those that a run repeats after its first period. A text that is null,
    empty or blank has no words, no runs and an empty ``collapsed``. Rows are independent: null and repeated ids and repeated
    rows stay as they are, ids of any type are kept, other columns are ignored; an empty table gives an empty one.
    Memory follows the longest text.
    """
    if exponent < 2:
        raise ValueError("A run has two periods at least.")
    arrow_limits(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    schema = rows.selectExpr(
        "doc_id", "0L n_words", "cast(array() as array<struct<start: bigint, length: bigint, period: bigint>>) runs", "cast('' as binary) collapsed"
    ).schema
    return rows.mapInArrow(_scan(min_length, exponent), schema).withColumn("collapsed", F.col("collapsed").cast("string"))

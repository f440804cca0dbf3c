"""Helpers of the operators: hashed words and shingles of Arrow text columns, fixed-size tables, components."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paraseg.session import written

__all__ = [
    "arrow_limits", "bitmap_of", "components", "hash_words", "in_bitmap", "mix", "shingle_hashes", "text_slices", "written",
]

SLICE_BYTES = 1 << 19
BITMAP_BITS = 26
_CHUNK = 1 << 16
_U = np.uint64
_GOLDEN = _U(0x9E3779B97F4A7C15)
_BASE = _U(0x5851F42D4C957F2D)
_BASE_INVERSE = _U(pow(0x5851F42D4C957F2D, -1, 1 << 64))


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64: every input bit reaches every output bit."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> _U(30)
    x *= _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(27)
    x *= _U(0x94D049BB133111EB)
    x ^= x >> _U(31)
    return x


_SEPARATOR = np.zeros(256, bool)
_SEPARATOR[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256)
_LOWER[ord("A") : ord("Z") + 1] += 32
_BYTE = mix((_LOWER + 1).astype(np.uint64) * _GOLDEN)


class _Powers:
    """Powers of the base and of its inverse, as long as the longest slice so far."""

    up = down = np.ones(0, np.uint64)

    @classmethod
    def upto(cls, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(cls.up) < n:
            for name, base in (("up", _BASE), ("down", _BASE_INVERSE)):
                steps = np.full(n, base, np.uint64)
                steps[0] = 1
                setattr(cls, name, np.multiply.accumulate(steps))
        return cls.up, cls.down


def arrow_limits(spark: SparkSession) -> None:
    """Cut Arrow batches by bytes too: a row can be a long document."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1024")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(8 << 20))


def text_slices(column: pa.Array, max_bytes: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Runs of rows of at most ``max_bytes`` of text (one row at least): first, end, bytes, offsets from 0. Null is empty."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    if column.null_count:
        column = column.fill_null("")
    if not len(column):
        return
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    _, ends, data = column.buffers()
    offsets = np.frombuffer(ends, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    first = 0
    while first < len(column):
        end = max(first + 1, int(np.searchsorted(offsets, offsets[first] + max_bytes, "right")) - 1)
        yield first, end, data[offsets[first] : offsets[end]], offsets[first : end + 1] - offsets[first]
        first = end


def hash_words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words of each text, A-Z lowered, and the number of words of each."""
    if not len(data):
        return np.zeros(0, np.uint64), np.zeros(len(offsets) - 1, np.int64)
    solid = ~_SEPARATOR[data]
    edge = offsets[1:-1]
    edge = edge[edge < len(data)]
    before = np.zeros(len(data), bool)
    before[1:] = solid[:-1]
    before[edge] = False
    after = np.zeros(len(data), bool)
    after[:-1] = solid[1:]
    after[edge[edge > 0] - 1] = False
    start = np.flatnonzero(solid & ~before)
    end = np.flatnonzero(solid & ~after)
    up, down = _Powers.upto(len(data))
    sums = _BYTE[data]
    sums *= up[: len(data)]
    np.cumsum(sums, out=sums)
    words = sums[end]
    inner = start > 0
    words[inner] -= sums[start[inner] - 1]
    words *= down[start]
    return mix(words + (end - start + 1).astype(np.uint64) * _GOLDEN), np.diff(np.searchsorted(start, offsets))


def shingle_hashes(words: np.ndarray, counts: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the runs of ``k`` words of each text in order, and how many each has; a shorter text is one run."""
    ends = np.cumsum(counts)
    whole = counts >= k
    sizes = np.where(whole, counts - k + 1, (counts > 0).astype(np.int64))
    out = np.empty(int(sizes.sum()), np.uint64)
    slots = np.repeat(whole, sizes)
    n = len(words) - k + 1
    if n > 0:
        runs = np.zeros(n, np.uint64)
        for j in range(k):
            runs *= _BASE
            runs += words[j : j + n]
        room = np.repeat(ends, counts)[:n] - np.arange(n) >= k
        out[slots] = mix(runs[room])
    if not slots.all():
        short = []
        for i in np.flatnonzero(~whole & (counts > 0)):
            run = 0
            for word in words[ends[i] - counts[i] : ends[i]].tolist():
                run = (run * int(_BASE) + word) % (1 << 64)
            short.append((run + int(counts[i])) % (1 << 64))
        out[~slots] = mix(np.array(short, np.uint64))
    return out, sizes


def bitmap_of(keys: DataFrame, column: str, bits: int = BITMAP_BITS) -> np.ndarray:
    """A bitmap of 2**bits positions, fixed in size whatever ``keys`` holds, with the position of every key set.

    Members are always found; others pass with the share of set positions. Built in chunks by Spark.
    """
    top = 64 - bits

    def chunk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros((1 << bits) // 8, np.uint8)
        for batch in batches:
            at = np.unique(mix(batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)) >> _U(top))
            if len(at):
                byte = (at >> _U(3)).astype(np.int64)
                first = np.flatnonzero(np.r_[True, byte[1:] != byte[:-1]])
                seen[byte[first]] |= np.bitwise_or.reduceat(np.uint8(128) >> (at & _U(7)).astype(np.uint8), first)
        rows = [(i, part.tobytes()) for i, part in enumerate(seen.reshape(-1, _CHUNK // 8)) if part.any()]
        if rows:
            part, bits_of = zip(*rows)
            yield pa.RecordBatch.from_arrays([pa.array(part, pa.int32()), pa.array(bits_of, pa.binary())], ["part", "bits"])

    def merged(key, rows):
        whole = np.bitwise_or.reduce([np.frombuffer(x, np.uint8) for x in rows["bits"]])
        return rows.iloc[:1].assign(bits=[whole.tobytes()])

    parts = keys.select(F.col(column).cast("long")).dropna().mapInArrow(chunk, "part int, bits binary")
    out = np.zeros((1 << bits) // 8, np.uint8)
    for part, blob in parts.groupBy("part").applyInPandas(merged, "part int, bits binary").collect():
        out[part * (_CHUNK // 8) : (part + 1) * (_CHUNK // 8)] = np.frombuffer(blob, np.uint8)
    return out


def in_bitmap(bitmap: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Which of the 64-bit ``keys`` may be members."""
    at = mix(keys.view(np.uint64)) >> _U(64 - int(len(bitmap) * 8).bit_length() + 1)
    return (bitmap[at >> _U(3)] >> (_U(7) - (at & _U(7))).astype(np.uint8)) & 1 == 1


def components(links: DataFrame) -> DataFrame:
    """``(id, root)`` of every id that ``links(a, b)`` names: root is the smallest id it can reach.

    Large-star and small-star steps in turn: each joins every id with the smallest of its neighbours, so long chains
    shrink by a factor a round. Minima are combined before the shuffle; rounds go through written tables. It ends when
    the links are stars: every id has one smaller neighbour at most, and the smaller neighbour has none.
    """
    edges = written(
        links.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    )
    while _not_stars(edges):
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("low")).select("a", F.least("a", "low").alias("low"))
        large = both.join(low, "a").filter("b > a").select(F.col("b").alias("a"), F.col("low").alias("b"))
        down = large.filter("a <> b").distinct()
        low = down.groupBy("a").agg(F.min("b").alias("low"))
        small = down.join(low, "a").select(F.explode(F.array(F.struct("a", F.col("low").alias("b")), F.struct(F.col("b").alias("a"), F.col("low").alias("b")))).alias("x")).select("x.*")
        edges = written(small.filter("a <> b").distinct())
    return edges.select(F.col("a").alias("id"), F.col("b").alias("root"))


def _not_stars(edges: DataFrame) -> bool:
    """Whether an id has two smaller neighbours, or one that has a smaller neighbour itself."""
    ends = edges.select(F.explode(F.array(F.struct(F.col("a").alias("id"), F.lit(1).alias("below")), F.struct(F.col("b").alias("id"), F.lit(0).alias("below")))).alias("x")).select("x.*")
    ids = ends.groupBy("id").agg(F.sum("below").alias("below"), F.min("below").alias("is_root"))
    return not ids.filter("below > 1 or (below = 1 and is_root = 0)").isEmpty()

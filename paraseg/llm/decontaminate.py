"""Benchmark decontamination: SimHash of item-sized windows, multi-index Hamming search, exact weighted check.

For an item of ``m`` words, the windows of a document are its runs of ``m`` words. A window and an item are alike when
the weighted Jaccard similarity of their five-word shingles (weight: number of occurrences) reaches the threshold.

1. Only regions that can hold such a window are kept: at similarity t, two equally long runs share 2t/(1+t) of their
   shingles, so a window with fewer shingles of the benchmark is out. Membership is a bitmap of fixed size.
2. Every remaining window gets a 64-bit SimHash of its shingles.
3. Fingerprints are cut into four blocks. Two within ``RADIUS`` differ by at most RADIUS // 4 bits in one of them, so
   the items' blocks with up to that many bits flipped, joined on (words, block), find all pairs within the radius.
4. The shingles of each pair decide.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paraseg.llm.common import arrow_limits, bitmap_of, hash_words, in_bitmap, shingle_hashes, text_slices, written

SHINGLE = 5
BLOCKS = 4
RADIUS = 15
BLOCK_BITS = 64 // BLOCKS
FLIPS = [sum(1 << b for b in bits) for n in range(RADIUS // BLOCKS + 1) for bits in combinations(range(BLOCK_BITS), n)]


def least_shared(shingles: int, threshold: float) -> int:
    """Shingles that two runs of so many must share to reach the threshold."""
    return int(np.ceil(2 * threshold / (1 + threshold) * shingles - 1e-9))


def _bits(shingles: np.ndarray) -> np.ndarray:
    """Running sums of +1 and -1 by bit, a row before each shingle."""
    bits = np.unpackbits(shingles.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    sums = np.zeros((len(shingles) + 1, 64), np.int32)
    np.cumsum(bits.astype(np.int32) * 2 - 1, axis=0, out=sums[1:])
    return sums


def simhash(sums: np.ndarray, starts: np.ndarray, size: int) -> np.ndarray:
    votes = (sums[starts + size] - sums[starts]) > 0
    return np.packbits(votes, axis=1, bitorder="little").view("<u8").ravel()


def _items(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for first, _, data, offsets in text_slices(batch.column(1)):
            words, counts = hash_words(data, offsets)
            shingles, sizes = shingle_hashes(words, counts, SHINGLE)
            ends = np.cumsum(sizes)
            for i in np.flatnonzero(counts >= SHINGLE):
                own = shingles[ends[i] - sizes[i] : ends[i]]
                mark = simhash(_bits(own), np.zeros(1, np.int64), len(own))
                rows.append((batch.column(0)[first + int(i)].as_py(), int(counts[i]), int(mark.view(np.int64)[0]), own.view(np.int64)))
        if rows:
            ids, words, marks, shingles = zip(*rows)
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), pa.array(words, pa.int32()), pa.array(marks, pa.int64()), pa.array(shingles, pa.list_(pa.int64()))],
                ["item_id", "words", "item_mark", "item_shingles"],
            )


def _windows(hits: np.ndarray, words: list[int], threshold: float) -> Iterator[tuple[int, np.ndarray]]:
    """Words and starts of the windows with enough shingles of the benchmark."""
    sums = np.r_[0, np.cumsum(hits)]
    for m in words:
        size = m - SHINGLE + 1
        if len(hits) >= size:
            starts = np.flatnonzero(sums[size:] - sums[:-size] >= least_shared(size, threshold))
            if len(starts):
                yield m, starts


def _regions(member, words: list[int], threshold: float) -> Callable:
    least = least_shared(min(words) - SHINGLE + 1, threshold)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bitmap = member.value
        for batch in batches:
            rows = []
            for first, _, data, offsets in text_slices(batch.column(1)):
                shingles, sizes = shingle_hashes(*hash_words(data, offsets), SHINGLE)
                hits = in_bitmap(bitmap, shingles)
                ends = np.cumsum(sizes)
                sums = np.r_[0, np.cumsum(hits)]
                for i in np.flatnonzero(sums[ends] - sums[ends - sizes] >= least):
                    own = slice(ends[i] - sizes[i], ends[i])
                    edges = np.zeros(sizes[i] + 1, np.int64)
                    for m, starts in _windows(hits[own], words, threshold):
                        edges[starts] += 1
                        edges[starts + m - SHINGLE + 1] -= 1
                    covered = np.r_[0, (np.cumsum(edges[:-1]) > 0).astype(np.int8), 0]
                    turns = np.flatnonzero(np.diff(covered))
                    for a, z in zip(turns[::2], turns[1::2]):
                        rows.append((batch.column(0)[first + int(i)].as_py(), int(a), shingles[own][a:z].view(np.int64)))
            if rows:
                ids, at, parts = zip(*rows)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids, batch.column(0).type), pa.array(at, pa.int32()), pa.array(parts, pa.list_(pa.int64()))], ["doc_id", "at", "shingles"]
                )

    return run


def _marks(member, words: list[int], threshold: float) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bitmap = member.value
        for batch in batches:
            for row in range(len(batch)):
                shingles = np.array(batch.column("shingles")[row].values, np.int64)
                sums = _bits(shingles.view(np.uint64))
                for m, starts in _windows(in_bitmap(bitmap, shingles), words, threshold):
                    n = len(starts)
                    mark = simhash(sums, starts, m - SHINGLE + 1).view(np.int64)
                    yield pa.RecordBatch.from_arrays(
                        [batch.column("region")[row : row + 1].take(pa.array([0] * n)), pa.array(starts.astype(np.int32)), pa.array([m] * n, pa.int32()), pa.array(mark)],
                        ["region", "start", "words", "mark"],
                    )

    return run


def _weighted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        values = []
        for a, b in zip(batch.column("window").to_pylist(), batch.column("item_shingles").to_pylist()):
            x, y = Counter(a), Counter(b)
            values.append((x & y).total() / (x | y).total())
        kept = [batch.column(c) for c in ("doc_id", "item_id", "word_start", "words")]
        yield pa.RecordBatch.from_arrays([*kept, pa.array(values, pa.float64())], ["doc_id", "item_id", "word_start", "words", "similarity"])


def contaminated(
    docs: DataFrame, benchmark: DataFrame, *, threshold: float = 0.8, id_col: str = "doc_id", text_col: str = "text",
    item_col: str = "item_id", item_text_col: str = "text",
) -> DataFrame:
    """``(doc_id, item_id, word_start, words, similarity)``: the best window of each document for each item it holds.

    Ties go to the first window. Items and texts that are null or under five words hold no shingle and match nothing.
    Repeated rows give one result row; ids are of any type, null ids are kept; extra columns are ignored. Without items or documents the
    result is empty.
    """
    spark = docs.sparkSession
    arrow_limits(spark)
    items = written(
        benchmark.select(F.col(item_col).cast("long").alias("item_id"), F.col(item_text_col).cast("string").alias("text"))
        .mapInArrow(_items, "item_id long, words int, item_mark long, item_shingles array<long>")
        .distinct()
        .withColumn("item", F.xxhash64("item_id", "item_shingles"))
    )
    # As many numbers at most as the longest item has words.
    words = sorted(r[0] for r in items.select("words").distinct().collect())
    if not words:
        return docs.select(F.col(id_col).alias("doc_id")).limit(0).selectExpr("doc_id", "doc_id item_id", "0 word_start", "0 words", "0d similarity")
    member = spark.sparkContext.broadcast(bitmap_of(items.select(F.explode("item_shingles").alias("s")), "s", 24))

    found = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    kind = found.schema["doc_id"].dataType.simpleString()
    regions = written(
        found.mapInArrow(_regions(member, words, threshold), f"doc_id {kind}, at int, shingles array<long>")
        # A hash of the id, which may be null, with place and contents.
        .withColumn("region", F.struct(F.xxhash64("doc_id").alias("d"), "at", F.xxhash64("shingles").alias("h")))
        .dropDuplicates(["region"])
    )
    # A region's windows are many times its size, so the regions are dealt out anew, however small they are.
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    windows = written(
        regions.select("region", "shingles").repartition(tasks, "region")
        .mapInArrow(_marks(member, words, threshold), f"region {regions.schema['region'].dataType.simpleString()}, start int, words int, mark long")
    )
    block = lambda mark, i: F.shiftrightunsigned(mark, BLOCK_BITS * i).bitwiseAND(F.lit((1 << BLOCK_BITS) - 1)).cast("int")
    split = lambda mark: F.posexplode(F.array(*(block(mark, i) for i in range(BLOCKS)))).alias("block", "bits")
    probes = (
        items.select("item", "words", "item_mark", split("item_mark"))
        .withColumn("flip", F.explode(F.array(*map(F.lit, FLIPS))))
        .select("item", "words", "item_mark", "block", F.col("bits").bitwiseXOR(F.col("flip")).alias("bits"))
    )
    # Windows of a passage that many documents share have one fingerprint: it is looked up once.
    near = written(
        windows.select("words", "mark").distinct().select("words", "mark", split("mark"))
        # The planner takes the probes for as small as the items.
        .join(probes.hint("merge"), ["words", "block", "bits"])
        .filter(F.bit_count(F.col("mark").bitwiseXOR(F.col("item_mark"))) <= RADIUS)
        .select("words", "mark", "item")
        .distinct()
    )
    # A window is cut out of its region before it meets its items.
    window = F.slice("shingles", F.col("start") + 1, F.col("words") - SHINGLE + 1)
    pairs = (
        windows.join(near, ["words", "mark"])
        .join(regions, "region")
        .select("doc_id", "item", (F.col("at") + F.col("start")).alias("word_start"), window.alias("window"))
        .join(items.select("item", "item_id", "words", "item_shingles"), "item")
    )
    exact = pairs.mapInArrow(_weighted, f"doc_id {kind}, item_id long, word_start int, words int, similarity double")
    best = F.max_by(F.struct("word_start", "words", "similarity"), F.struct("similarity", -F.col("word_start")))
    return exact.filter(F.col("similarity") >= threshold).groupBy("doc_id", "item_id").agg(best.alias("b")).select("doc_id", "item_id", "b.*")

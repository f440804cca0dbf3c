"""N-gram Jaccard self-join: rare-first prefixes, length, positional and suffix filters, one check per pair.

A document is the set of its distinct word shingles. Texts with equal sets are one member. A member's shingles are
ordered by a corpus-wide count, rarest first; two members that are similar enough share a shingle of their prefixes.
Lists of members by prefix shingle give pairs, which length and position thin out; a suffix filter (counts of shingles
by hash range bound the overlap from above) thins them further, and the whole sets decide, once per pair.

Members of long lists never become rows of pairs: lists with the same smallest member are one group, a group is dealt
into blocks of bounded size, and a task compares two blocks and returns a spanning forest of the links it finds. Each block
first meets a few pivots of its group. What is joined by then needs no comparison inside: of the largest class only the
other members, few among near copies of one text, are compared with it and with each other, block by block.

Shingles are compared by 64-bit hashes, sets named by 64-bit digests. Counts are kept in a table of fixed size; shingles
that share a place count together, which changes the order, not the result.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator
from hashlib import blake2b

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from paraseg.llm.common import arrow_limits, bitmap_of, components, hash_words, in_bitmap, shingle_hashes, text_slices, written

COUNT_BITS = 22
LONG_LIST = 48
BLOCK_SHINGLES, BLOCK_MEMBERS = 1 << 20, 1500
#: Members of a group of several blocks that all its others are compared with first.
PIVOTS = 32
SUFFIX_PARTS = 128
_U = np.uint64
_PART = 1 << 16


def _sets(text: pa.Array, words: int) -> Iterator[tuple[int, np.ndarray]]:
    """Row number and sorted distinct shingles of every text."""
    for first, _, data, offsets in text_slices(text):
        shingles, sizes = shingle_hashes(*hash_words(data, offsets), words)
        ends = np.cumsum(sizes)
        for i, (end, size) in enumerate(zip(ends.tolist(), sizes.tolist())):
            part = np.sort(shingles[end - size : end])
            yield first + i, part[np.r_[True, part[1:] != part[:-1]]] if size > 1 else part


def _name(shingles: np.ndarray) -> int:
    return int.from_bytes(blake2b(shingles.tobytes(), digest_size=8).digest(), "little", signed=True)


def _rows(names: list[str], columns: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([x if isinstance(x, pa.Array) else pa.array(x) for x in columns], names)


def _members(words: int) -> Callable:
    """Id, set size and set name of every row, and the task's part of the shingle counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, seen, kind = np.zeros(1 << COUNT_BITS, np.uint32), [], None
        names = ["doc_id", "n", "sid", "part", "counts"]
        for batch in batches:
            ids, n, sids = batch.column(0), [0] * len(batch), [None] * len(batch)
            for i, part in _sets(batch.column(1), words):
                n[i] = len(part)
                if n[i]:
                    sids[i] = _name(part)
                    seen.append((part & _U((1 << COUNT_BITS) - 1)).astype(np.uint32))
            if sum(map(len, seen)) > 1 << 20:
                counts += np.bincount(np.concatenate(seen), minlength=len(counts)).astype(np.uint32)
                seen = []
            none = pa.nulls(len(ids))
            kind = ids.type
            yield _rows(names, [ids, pa.array(n, pa.int64()), pa.array(sids, pa.int64()), none.cast(pa.int32()), none.cast(pa.binary())])
        if seen:
            counts += np.bincount(np.concatenate(seen), minlength=len(counts)).astype(np.uint32)
        for i, part in enumerate(counts.reshape(-1, _PART)):
            if part.any():
                blob = zlib.compress(part.astype("<u4").tobytes(), 1)
                yield _rows(names, [pa.nulls(1, kind), pa.array([None], pa.int64()), pa.array([None], pa.int64()), pa.array([i], pa.int32()), pa.array([blob], pa.binary())])

    return run


def _add_counts(key, rows: pd.DataFrame) -> pd.DataFrame:
    total = np.zeros(_PART, np.uint64)
    for blob in rows["counts"]:
        total += np.frombuffer(zlib.decompress(blob), "<u4")
    return pd.DataFrame({"part": [key[0]], "counts": [zlib.compress(np.minimum(total, 0x7FFF).astype("<u2").tobytes(), 1)]})


def prefix_size(n, percent: int):
    """Shingles of which one at least is shared with any similar enough set."""
    return n - (percent * n + 99) // 100 + 1


def _prefixes(words: int, percent: int, counts, keep=None) -> Callable:
    """``(token, sid, n, at)`` of the prefix of each set, once per task and set; tokens hold count and hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, wanted, done = counts.value, keep.value if keep else None, set()
        mask, low = _U((1 << COUNT_BITS) - 1), _U((1 << 48) - 1)
        for batch in batches:
            tokens, sids, sizes, places, lengths = [], [], [], [], []
            for _, part in _sets(batch.column(0), words):
                if not len(part) or (sid := _name(part)) in done:
                    continue
                done.add(sid)
                token = (table[part & mask].astype(np.uint64) << _U(48)) | (part >> _U(16) & low)
                take = prefix_size(len(part), percent)
                token = np.sort(np.partition(token, take - 1)[:take] if take < len(token) else token)
                tokens.append(token)
                sids.append(sid)
                sizes.append(len(part))
                lengths.append(take)
            if not tokens:
                continue
            token = np.concatenate(tokens).view(np.int64)
            lengths = np.array(lengths)
            sid, n = np.repeat(np.array(sids, np.int64), lengths), np.repeat(np.array(sizes, np.int32), lengths)
            place = (np.arange(len(token)) - np.repeat(np.cumsum(lengths) - lengths, lengths)).astype(np.int32)
            if wanted is not None:
                on = in_bitmap(wanted, token)
                token, sid, n, place = token[on], sid[on], n[on], place[on]
            yield _rows(["token", "sid", "n", "at"], [token, sid, n, place])

    return run


def _of_candidates(words: int, wanted, name: str) -> Callable:
    """``ranges`` (counts by hash range) or ``shingles`` of the sets that may be candidates, once per task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bitmap, done = wanted.value, set()
        for batch in batches:
            sids, sizes, blobs = [], [], []
            for _, part in _sets(batch.column(0), words):
                if not len(part) or (sid := _name(part)) in done or not in_bitmap(bitmap, np.array([sid]))[0]:
                    continue
                done.add(sid)
                ranges = lambda: np.bincount((part >> _U(57)).astype(np.int64), minlength=SUFFIX_PARTS).astype("<u4")  # noqa: B023, E731
                sids.append(sid)
                sizes.append(len(part))
                blobs.append((ranges() if name == "ranges" else part).tobytes())
            if sids:
                yield _rows(["sid", "n", name], [pa.array(sids, pa.int64()), pa.array(sizes, pa.int32()), pa.array(blobs, pa.binary())])

    return run


def _similar(common, a, b, percent: int):
    return 100 * common >= percent * (a + b - common)


def _suffix_filter(percent: int) -> Callable:
    """Pairs whose overlap can still be enough: half of what the counts by hash range don't set apart."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = (np.frombuffer(b"".join(batch.column(x).to_pylist()), "<u4").reshape(-1, SUFFIX_PARTS).astype(np.int64) for x in ("ranges_a", "ranges_b"))
            n, m = a.sum(1), b.sum(1)
            most = (n + m - np.abs(a - b).sum(1)) // 2
            on = np.flatnonzero(_similar(most, n, m, percent))
            yield batch.select(["a", "b"]).take(pa.array(on))

    return run


def _verify(percent: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            links = []
            for a, b, x, y in zip(*(batch.column(c).to_pylist() for c in ("a", "b", "set_a", "set_b"))):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                common = len(x) + len(y) - len(np.union1d(x, y))
                if _similar(common, len(x), len(y), percent):
                    links.append((a, b))
            if links:
                yield _rows(["a", "b"], [pa.array(x, pa.int64()) for x in zip(*links)])

    return run


def _forest(pairs: np.ndarray, sids: np.ndarray) -> list[tuple[int, int]]:
    """Links that join what ``pairs`` of row numbers join, without the rest."""
    parent, out = list(range(len(sids))), []

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for x, y in pairs.tolist():
        a, b = root(x), root(y)
        if a != b:
            parent[a] = b
            out.append((int(sids[x]), int(sids[y])))
    return out


def _compare_blocks(percent: int) -> Callable:
    """All links between two blocks of one group (or within one), as a spanning forest."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["n", "sid"]).reset_index(drop=True)
        sids, block, n = rows["sid"].to_numpy(), rows["block"].to_numpy(), rows["n"].to_numpy().astype(np.int64)
        left, right = np.flatnonzero(block == rows["low"]), np.flatnonzero(block == rows["high"])
        shingles = np.concatenate([np.frombuffer(x, np.uint64) for x in rows["shingles"]])
        owner = np.repeat(np.arange(len(rows)), n)
        order = np.argsort(shingles, kind="stable")
        shingles, owner = shingles[order], owner[order]
        new = np.r_[True, shingles[1:] != shingles[:-1]]
        column = np.cumsum(new) - 1
        shared = np.bincount(column) > 1
        column = (np.cumsum(shared) - 1)[column[on := shared[column]]]
        owner = owner[on]
        common = np.zeros((len(left), len(right)), np.float32)
        place = np.zeros(len(rows), np.int64)
        step = 1024
        for lo in range(0, int(shared.sum()), step):
            a, z = np.searchsorted(column, [lo, lo + step])
            sides = []
            for side in (left, right):
                dense = np.zeros((len(side), step), np.float32)
                place[:] = -1
                place[side] = np.arange(len(side))
                at = place[owner[a:z]]
                dense[at[at >= 0], column[a:z][at >= 0] - lo] = 1
                sides.append(dense)
            common += sides[0] @ sides[1].T
        pairs = []
        for i, row in enumerate(common):
            j = np.flatnonzero(_similar(row.astype(np.int64), n[left[i]], n[right], percent))
            pairs.append(np.stack([np.full(len(j), left[i]), right[j]], 1))
        pairs = np.concatenate(pairs) if pairs else np.zeros((0, 2), np.int64)
        return pd.DataFrame(_forest(pairs[pairs[:, 0] != pairs[:, 1]], sids), columns=["a", "b"], dtype="int64")

    return run


def _weights(members: DataFrame, *keys: str) -> DataFrame:
    """How many blocks hold the members of each group, and how many pivots are about one block long."""
    blocks = F.floor(F.greatest(F.sum("n") / BLOCK_SHINGLES, F.count("sid") / BLOCK_MEMBERS)) + 1
    pivots = F.greatest(F.floor(F.lit(BLOCK_SHINGLES) * F.count("sid") / F.sum("n")), F.lit(1))
    return members.groupBy(*keys).agg(blocks.alias("blocks"), F.least(pivots, F.lit(PIVOTS)).alias("pivots"))


def pivot_rows(group: DataFrame) -> DataFrame:
    """``(leader, sid, block, low, high)``: every block (``high``) of the groups of several with its pivots (block -1)."""
    large = group.filter("blocks > 1")
    hashed = F.xxhash64("sid")
    members = large.select("leader", "sid", F.pmod(hashed, F.col("blocks")).alias("block"))
    pivots = large.groupBy("leader", "blocks", F.pmod(hashed, F.col("pivots")).alias("slot")).agg(F.min("sid").alias("sid"))
    last = F.col("blocks") - 1
    met = pivots.select("leader", "sid", F.lit(-1).cast("long").alias("block"), F.explode(F.sequence(F.lit(0).cast("long"), last)).alias("high"))
    both = members.withColumn("high", F.col("block")).unionByName(met)
    return both.select("leader", "sid", "block", F.lit(-1).cast("long").alias("low"), "high")


def block_rows(group: DataFrame, roots: DataFrame) -> DataFrame:
    """``(leader, sid, block, low, high)``: the pairs of blocks that are left when ``roots(id, root)`` are joined.

    All pairs of members that are not in the largest class of their group, and each of these with each of that class. Groups
    of one block are compared whole.
    """
    classed = written(group.join(roots, group["sid"] == roots["id"], "left").select("leader", "sid", "n", "blocks", F.coalesce("root", "sid").alias("root")))
    sizes = classed.filter("blocks > 1").groupBy("leader", "root").agg(F.count("*").alias("size"))
    largest = sizes.groupBy("leader").agg(F.max(F.struct("size", "root"))["root"].alias("largest"))
    sided = classed.drop("blocks").join(largest, "leader", "left").withColumn("rest", ~F.coalesce(F.col("root") == F.col("largest"), F.lit(False)))
    weight = _weights(sided, "leader", "rest").groupBy("leader").agg(
        F.coalesce(F.sum(F.when(F.col("rest"), F.col("blocks"))), F.lit(0)).alias("of_rest"),
        F.coalesce(F.sum(F.when(~F.col("rest"), F.col("blocks"))), F.lit(0)).alias("of_largest"),
    )
    hashed = F.xxhash64("sid")
    block = F.when(F.col("rest"), F.pmod(hashed, F.col("of_rest"))).otherwise(F.col("of_rest") + F.pmod(hashed, F.col("of_largest")))
    end = F.col("of_rest") + F.when(F.col("rest"), F.col("of_largest")).otherwise(0) - 1
    return (
        sided.join(weight.filter("of_rest > 0"), "leader")
        .select("leader", "sid", block.alias("block"), F.explode(F.sequence(F.lit(0).cast("long"), end)).alias("other"))
        .select("leader", "sid", "block", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"))
    )


def jaccard_components(
    docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", words: int = 4, percent: int = 85, long_list: int = LONG_LIST
) -> DataFrame:
    """``(doc_id, n_shingles, component_id)`` of every row: set size, and the smallest id reachable by links.

    Two documents link when ``100 * |intersection| >= percent * |union|`` of their sets of ``words``-word shingles;
    a text with fewer words is one shingle. Texts that are null, empty or blank have no shingles and are linked with
    nothing. Ids are of any type that has an order. Repeated rows stay; rows with a null id keep a null id and belong to
    the component of their text. Extra columns are ignored. An empty table gives an empty one.
    """
    spark = docs.sparkSession
    arrow_limits(spark)
    texts = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    kinds = texts.selectExpr("doc_id", "0L n", "0L sid", "0 part", "cast('' as binary) counts").schema
    found = written(texts.mapInArrow(_members(words), T.StructType([T.StructField(f.name, f.dataType) for f in kinds])))
    members = found.filter("part is null").select("doc_id", "n", "sid")

    # Counts of shingles over the whole corpus, in a table of 2**COUNT_BITS places (8 MB).
    table = np.zeros(1 << COUNT_BITS, np.uint16)
    parts = found.filter("part is not null").select("part", "counts").groupBy("part").applyInPandas(_add_counts, "part int, counts binary")
    for part, blob in parts.collect():
        table[part * _PART : (part + 1) * _PART] = np.frombuffer(zlib.decompress(blob), "<u2")
    counts = spark.sparkContext.broadcast(table)

    only = texts.select("text")
    lists = written(
        only.mapInArrow(_prefixes(words, percent, counts), "token long, sid long, n int, at int")
        .groupBy("token")
        .agg(F.count("sid").alias("size"), F.min("sid").alias("leader"), F.max("sid").alias("last"))
        .filter("leader <> last")
        .drop("last")
    )
    shared = spark.sparkContext.broadcast(bitmap_of(lists, "token"))
    postings = written(
        only.mapInArrow(_prefixes(words, percent, counts, shared), "token long, sid long, n int, at int")
        .join(lists, "token")
        .distinct()
    )

    short = postings.filter(F.col("size") <= long_list)
    # Written tables are read from here on: the counts and the tokens' bitmap are not needed any more.
    counts.destroy()
    shared.destroy()
    a, b = short.alias("x"), short.alias("y")
    enough = "100 * (least(x.at, y.at) + least(x.n - x.at, y.n - y.at)) * 1L"
    pairs = written(
        a.join(b, F.expr("x.token = y.token and x.sid < y.sid"))
        .filter(f"100L * least(x.n, y.n) >= {percent} * greatest(x.n, y.n)")
        .filter(f"{enough} >= {percent} * (x.n + y.n - least(x.at, y.at) - least(x.n - x.at, y.n - y.at))")
        .select(F.col("x.sid").alias("a"), F.col("y.sid").alias("b"))
        .distinct()
    )
    group = postings.filter(F.col("size") > long_list).select("leader", "sid", "n").distinct()
    group = written(group.join(_weights(group, "leader"), "leader"))

    def candidates(ids: DataFrame, name: str) -> DataFrame:
        """One row for each set named by ``ids``; the shingles of other sets stay out of the shuffle."""
        wanted = spark.sparkContext.broadcast(bitmap_of(ids, "sid"))
        rows = written(only.mapInArrow(_of_candidates(words, wanted, name), f"sid long, n int, {name} binary").dropDuplicates(["sid"]))
        wanted.destroy()
        return rows

    def side(kept: DataFrame, name: str, to: str, key: str) -> DataFrame:
        return kept.select(F.col("sid").alias(key), F.col(name).alias(to))

    named = F.explode(F.array("a", "b")).alias("sid")
    ranges = candidates(pairs.select(named), "ranges")
    left = written(
        pairs.join(side(ranges, "ranges", "ranges_a", "a"), "a")
        .join(side(ranges, "ranges", "ranges_b", "b"), "b")
        .mapInArrow(_suffix_filter(percent), "a long, b long")
    )
    sets = candidates(left.select(named).union(group.select("sid")), "shingles")
    checked = (
        left.join(side(sets, "shingles", "set_a", "a"), "a")
        .join(side(sets, "shingles", "set_b", "b"), "b")
        .mapInArrow(_verify(percent), "a long, b long")
    )

    def compared(rows: DataFrame) -> DataFrame:
        with_sets = rows.join(sets.select("sid", "n", "shingles"), "sid")
        return with_sets.groupBy("leader", "low", "high").applyInPandas(_compare_blocks(percent), "a long, b long")

    joined = written(components(written(checked.union(compared(pivot_rows(group))))))
    across = compared(block_rows(group, joined))
    roots = components(joined.select(F.col("id").alias("a"), F.col("root").alias("b")).union(written(across)))

    named = members.filter("sid is not null").groupBy("sid").agg(F.min("doc_id").alias("least"))
    named = named.join(roots.withColumnRenamed("id", "sid"), "sid", "left").withColumn("root", F.coalesce("root", "sid"))
    smallest = named.groupBy("root").agg(F.min("least").alias("component_id"))
    named = named.join(smallest, "root").select("sid", "component_id")
    return members.join(named, "sid", "left").select(
        "doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id")
    )

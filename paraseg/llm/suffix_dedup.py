"""Repeated byte strings across documents, removed from all but the document with the smallest id.

Texts are UTF-8 bytes. A byte goes if a string of ``size`` bytes that covers it also starts in a document with a smaller id.

1. Every string of ``size`` bytes names one of its ``GRAM``-byte places, its anchor: the one whose hash is least. Equal
   strings name equal anchors, and one place in 18 is one. Places whose hash is in a single text are out: hashes meet by
   ranges of their low bits, since the high ones, being least, crowd near 0.
2. The bytes around each remaining anchor, as far as a string that covers it can reach, are its surroundings. Equal
   surroundings are one row with the smallest and largest document.
3. Rows with the same anchor hash meet. Their suffixes from the anchor on, and their reversed prefixes before it, are
   sorted by mergesort: prefix polynomial hashes and binary search give the common extension of two, so a comparison takes
   the logarithm of the length. The bytes of neighbours are then compared; where a hash misled, the bytes sort. Rows
   that agree for long enough on both sides hold the same string, and its smallest document keeps it.
4. What follows for the first document of each surroundings, and for the later ones, is joined back to the places, and
   the spans of a document are merged.

An anchor hash with more than ``hot`` places is not sorted in one task: the strings around it are grouped by their bytes.
The hashes that are left after step 1 are handed out as a bitmap of at most 64 MB up to ``max_keys``; beyond, places are
joined to the texts. A bitmap can let an unshared hash pass: it meets no other text in step 3.
Surroundings are joined by two 64-bit hashes, texts by 120 bits of their SHA-256.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paraseg.llm.common import arrow_limits, bitmap_of, in_bitmap, mix, text_slices, written

SIZE = 50
GRAM = 16
HOT = 1 << 15
HOT_KEYS = 1 << 20
MAX_KEYS = 1 << 28
# The bitmap of shared hashes has 16 places a key, but 64 MB at most: fuller, it lets more of the others pass, which step 3 drops.
MEMBER_BITS = 29
HELD = 1 << 17
RANGES = 1 << 10
# Bytes of text at a time: what is held for them is some hundred times as much.
SLICE = 1 << 17
LAST = (1 << 63) - 1
_U = np.uint64
_BASE = 0x2545F4914F6CDD1D
_DOWN = pow(_BASE, -1, 1 << 64)
_VALUE = mix(np.arange(1, 258, dtype=np.uint64) * _U(0x9E3779B97F4A7C15))
_HIGH = _U(0xFFFFFFFF00000000)
_T_BITS = 48


class _Powers:
    """Powers of the base and of its inverse, as many as the longest slice needed."""

    up = down = np.ones(0, np.uint64)

    @classmethod
    def upto(cls, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(cls.up) < n:
            for name, base in (("up", _BASE), ("down", _DOWN)):
                steps = np.full(n, base, np.uint64)
                steps[0] = 1
                setattr(cls, name, np.multiply.accumulate(steps))
        return cls.up, cls.down


class Prefixes:
    """Prefix polynomial hashes of a slice: the hash of any stretch in a step."""

    def __init__(self, data: np.ndarray):
        up, self.down = _Powers.upto(len(data) + 1)
        self.sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(_VALUE[data] * up[: len(data)], out=self.sums[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.sums[end] - self.sums[start]) * self.down[start])


def anchors(prefixes: Prefixes, offsets: np.ndarray, size: int) -> np.ndarray:
    """The places that the strings of ``size`` bytes of each text name, in order."""
    n = len(prefixes.sums) - 1
    if n < size:
        return np.zeros(0, np.int64)
    grams = mix((prefixes.sums[GRAM:] - prefixes.sums[:-GRAM]) * prefixes.down[: n - GRAM + 1])
    # The place itself in the low bits: of equal hashes the first one counts.
    least = (grams & _HIGH) | np.arange(len(grams), dtype=np.uint64)
    width, reach = size - GRAM + 1, 1
    while 2 * reach <= width:
        least = np.minimum(least[:-reach], least[reach:])
        reach *= 2
    if reach < width:
        least = np.minimum(least[: len(least) - (width - reach)], least[width - reach :])
    room = np.repeat(offsets[1:], np.diff(offsets))[: len(least)] - np.arange(len(least)) >= size
    named = (least[room] & ~_HIGH).astype(np.int64)
    # Within a text the places only move on, and texts follow each other.
    return named[np.r_[True, named[1:] != named[:-1]]] if len(named) else named


def _places(batch: pa.RecordBatch, size: int, member=None, hot=None, only_hot=False) -> Iterator[tuple]:
    """Row numbers, places, anchor hashes and place in the text of the anchors of a batch, slice by slice.

    ``member``: a bitmap of the hashes that count; a column ``at`` names the places themselves instead.
    """
    given = batch.column("at") if "at" in batch.schema.names else None
    for first, end, data, offsets in text_slices(batch.column("text"), SLICE):
        prefixes = Prefixes(data)
        if given is None:
            place = anchors(prefixes, offsets, size)
        else:
            lists = given.slice(first, end - first)
            counts = np.array([len(x) if x is not None else 0 for x in lists.to_pylist()], np.int64)
            place = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64) + np.repeat(offsets[:-1], counts)
        if not len(place):
            continue
        key = prefixes.of(place, place + GRAM)
        if member is not None and given is None:
            on = in_bitmap(member, key >> _U(64 - _T_BITS))
            place, key = place[on], key[on]
        if hot is not None:
            on = np.isin((key >> _U(64 - _T_BITS)).astype(np.int64), hot) == only_hot
            place, key = place[on], key[on]
        row = np.searchsorted(offsets, place, "right") - 1
        yield first + row, place, key, place - offsets[row], data, offsets[row], offsets[row + 1], prefixes


def _starts(*columns: np.ndarray) -> np.ndarray:
    """Where a sorted run of equal rows begins."""
    new = np.ones(len(columns[0]), bool)
    new[1:] = np.logical_or.reduce([x[1:] != x[:-1] for x in columns])
    return np.flatnonzero(new)


def _batch(names: list[str], columns: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([x if isinstance(x, pa.Array) else pa.array(x) for x in columns], names)


_PACKED = [("lo", "<u2"), ("hi", "<u4"), ("t_lo", "<u4"), ("t_hi", "<u2"), ("n", "<u2")]
_WIDTH = sum(np.dtype(kind).itemsize for _, kind in _PACKED)


def _packed_keys(size: int, parts: int) -> Callable:
    """Anchor hashes of a task by range: sorted, with one or two of the texts that hold each and how many places do.

    An anchor has the least high half around it, so ranges of whole hashes would put a sixth of them into one of a hundred.
    The low bits come first here: they took no part in the choice, and their ranges are even.
    """

    def packed(held: list) -> Iterator[pa.RecordBatch]:
        key, t = map(np.concatenate, zip(*held))
        order = np.lexsort((t, key))
        key, t = key[order], t[order]
        at = _starts(key)
        n = np.minimum(np.diff(np.r_[at, len(key)]), 0xFFFF)
        last = np.r_[at[1:], len(key)] - 1
        two = t[last] != t[at]
        key, t, n = np.r_[key[at], key[at][two]], np.r_[t[at], t[last][two]], np.r_[n, np.zeros(int(two.sum()), np.int64)]
        order = np.argsort(key, kind="stable")
        key, t, n = key[order], t[order], n[order]
        cuts = np.searchsorted(key, (np.arange(parts + 1) * (1 << 16) // parts).astype(np.uint64) << _U(32))
        numbers, blobs = [], []
        for part, (a, z) in enumerate(zip(cuts[:-1], cuts[1:])):
            if z > a:
                planes = (key[a:z] >> _U(32), key[a:z] & ~_HIGH, t[a:z] & ~_HIGH, t[a:z] >> _U(32), n[a:z])
                numbers.append(part)
                blobs.append(b"".join(x.astype(kind).tobytes() for x, (_, kind) in zip(planes, _PACKED)))
        yield _batch(["part", "keys"], [pa.array(numbers, pa.int32()), pa.array(blobs, pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size_held = [], 0
        for batch in batches:
            t = batch.column("t").to_numpy(zero_copy_only=False).view(np.uint64) & _U((1 << _T_BITS) - 1)
            for row, _, key, *_ in _places(batch, size):
                held.append(((key >> _U(16) & _U(0xFFFF)) << _U(32) | key >> _U(32), t[row]))
                size_held += len(row)
                if size_held >= 4 * HELD:
                    yield from packed(held)
                    held, size_held = [], 0
        if size_held:
            yield from packed(held)

    return run


def _shared_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The hashes that several texts hold, from rows sorted by range, some whole ranges at a time; and how many places hold each."""

    def merged(blobs: list[bytes]) -> pa.RecordBatch:
        planes = [[] for _ in _PACKED]
        for blob in blobs:
            n, at = len(blob) // _WIDTH, 0
            for plane, (_, kind) in zip(planes, _PACKED):
                plane.append(np.frombuffer(blob, kind, n, at))
                at += n * np.dtype(kind).itemsize
        lo, hi, t_lo, t_hi, n = (np.concatenate(x).astype(np.int64) for x in planes)
        key, t = hi << 16 | lo, t_hi << 32 | t_lo
        order = np.argsort(key)
        key, t, n = key[order], t[order], n[order]
        at = _starts(key)
        on = np.minimum.reduceat(t, at) != np.maximum.reduceat(t, at)
        return _batch(["key", "n"], [key[at][on], np.add.reduceat(n, at)[on]])

    now, held, size_held = None, [], 0
    for batch in batches:
        for part, blob in zip(batch.column("part").to_pylist(), batch.column("keys").to_pylist()):
            if part != now and size_held >= HELD:
                yield merged(held)
                held, size_held = [], 0
            now = part
            held.append(blob)
            size_held += len(blob) // _WIDTH
    if held:
        yield merged(held)


def _surroundings(size: int, member, hot, only_hot: bool) -> Callable:
    """Distinct surroundings of a task's anchors, with the smallest and largest document."""
    left, names = size - GRAM, ["key", "mark", "shape", "around", "low", "high"]
    columns = np.arange(-left, size)

    def rows(held: list) -> pa.RecordBatch:
        key, mark, shape, low, around = map(np.concatenate, zip(*held))
        order = np.lexsort((low, shape, mark, key))
        at = _starts(key[order], mark[order], shape[order])
        low = low[order]
        picked = order[at]
        around = np.ascontiguousarray(around[picked])
        ends = pa.py_buffer((np.arange(len(picked) + 1) * around.shape[1]).astype(np.int32))
        blob = pa.Array.from_buffers(pa.binary(), len(picked), [None, ends, pa.py_buffer(around)])
        high = low[np.r_[at[1:], len(low)] - 1]
        return _batch(names, [key[picked].view(np.int64), mark[picked].view(np.int64), shape[picked].astype(np.int32), blob, low[at], high])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size_held = [], 0
        for batch in batches:
            ids = batch.column("id").to_numpy(zero_copy_only=False)
            for row, place, key, _, data, start, end, prefixes in _places(batch, size, member and member.value, hot and hot.value, only_hot):
                mark, shape = _mark(place, start, end, prefixes, size)
                at = place[:, None] + columns
                inside = (at >= start[:, None]) & (at < end[:, None])
                around = np.where(inside, data[np.clip(at, 0, len(data) - 1)], np.uint8(0))
                held.append((key, mark, shape, ids[row], around))
                size_held += len(row)
                if size_held >= HELD:
                    yield rows(held)
                    held, size_held = [], 0
        if size_held:
            yield rows(held)

    return run


def _mark(place, start, end, prefixes, size) -> tuple[np.ndarray, np.ndarray]:
    """A hash of the surroundings, and their extent before and after the anchor (before + 256 * after)."""
    before, after = np.minimum(place - start, size - GRAM), np.minimum(end - place, size)
    return prefixes.of(place - before, place + after), before + 1024 * after


def _occurrences(size: int, member) -> Callable:
    """The places of each surroundings in a task's texts, a row for each surroundings."""

    def rows(held: list) -> pa.RecordBatch:
        key, mark, shape, ids, t, at = map(np.concatenate, zip(*held))
        order = np.lexsort((shape, mark, key))
        key, mark, shape = key[order], mark[order], shape[order]
        first = _starts(key, mark, shape)
        ends = pa.array(np.r_[first, len(key)].astype(np.int32))
        found = pa.StructArray.from_arrays([pa.array(ids[order]), pa.array(t[order]), pa.array(at[order].astype(np.int32))], ["id", "t", "at"])
        return _batch(["key", "mark", "shape", "found"], [key[first].view(np.int64), mark[first].view(np.int64), shape[first].astype(np.int32), pa.ListArray.from_arrays(ends, found)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size_held = [], 0
        for batch in batches:
            ids, t = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("id", "t"))
            for row, place, key, at, _, start, end, prefixes in _places(batch, size, member and member.value):
                held.append((key, *_mark(place, start, end, prefixes, size), ids[row], t[row], at))
                size_held += len(row)
                if size_held >= HELD:
                    yield rows(held)
                    held, size_held = [], 0
        if size_held:
            yield rows(held)

    return run


class Strings:
    """Rows of equal width (0 after a row's end), compared by prefix hashes."""

    def __init__(self, symbols: np.ndarray):
        self.symbols, self.width = symbols, symbols.shape[1]
        self.hashes = np.zeros((len(symbols), self.width + 1), np.uint64)
        for k in range(self.width):
            self.hashes[:, k + 1] = self.hashes[:, k] * _U(_BASE) + _VALUE[symbols[:, k]]

    def common(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """How many symbols two rows share from the start on, by binary search over their prefix hashes."""
        low = np.zeros(len(i), np.int64)
        step = 1 << self.width.bit_length() - 1
        while step:
            to = np.minimum(low + step, self.width)
            low = np.where(self.hashes[i, to] == self.hashes[j, to], to, low)
            step >>= 1
        return low

    def less(self, i: np.ndarray, j: np.ndarray, or_equal: np.ndarray) -> np.ndarray:
        same = self.common(i, j)
        at = np.minimum(same, self.width - 1)
        return np.where(same == self.width, or_equal, self.symbols[i, at] < self.symbols[j, at])


def sort_groups(strings: Strings, group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An order of the rows within each group (groups are contiguous), and what each shares with the row before.

    All runs of a pass are merged at once: a row's place is its own plus its rank in the run beside it.
    """
    n = len(group)
    first = _starts(group)
    sizes = np.diff(np.r_[first, n])
    start, stop = np.repeat(first, sizes), np.repeat(first + sizes, sizes)
    order, run = np.arange(n), 1
    while run < sizes.max(initial=0):
        at = np.flatnonzero(stop - start > run)
        local = at - start[at]
        block = local // run
        beside = start[at] + (block ^ 1) * run
        low, high = np.minimum(beside, stop[at]), np.minimum(beside + run, stop[at])
        rank_from, right = low.copy(), block % 2 == 1
        while len(open_ := np.flatnonzero(low < high)):
            middle = (low[open_] + high[open_]) // 2
            before = strings.less(order[middle], order[at[open_]], right[open_])
            low[open_] = np.where(before, middle + 1, low[open_])
            high[open_] = np.where(before, high[open_], middle)
        moved = order.copy()
        moved[start[at] + (block // 2) * 2 * run + local - block * run + low - rank_from] = order[at]
        order, run = moved, 2 * run
    shared = np.zeros(n, np.int64)
    inner = np.flatnonzero(np.r_[False, group[1:] == group[:-1]])
    i, j = order[inner - 1], order[inner]
    shared[inner] = strings.common(i, j)
    # The bytes decide: neighbours agree as far as their hashes say, and differ then in the right order.
    agree = strings.symbols[i] == strings.symbols[j]
    upto = np.where(agree.all(1), strings.width, np.argmin(agree, axis=1))
    at = np.minimum(upto, strings.width - 1)
    rising = (upto == strings.width) | (strings.symbols[i, at] < strings.symbols[j, at])
    if (upto != shared[inner]).any() or not rising.all():
        order = np.lexsort((*strings.symbols.T[::-1], group))
        i, j = order[inner - 1], order[inner]
        agree = strings.symbols[i] == strings.symbols[j]
        shared[inner] = np.where(agree.all(1), strings.width, np.argmin(agree, axis=1))
    return order, shared


def repeated_reach(group: np.ndarray, around: np.ndarray, before: np.ndarray, after: np.ndarray, low: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """How far before and after its anchor each row's first document repeats a smaller one (0, 0: nowhere).

    All strings that cover an anchor hold it, so what they cover together is one span.
    """
    left = size - GRAM
    symbols = around.astype(np.int16) + 1
    columns = np.arange(-left, size)
    symbols[(columns < -before[:, None]) | (columns >= after[:, None])] = 0
    sides = []
    for part in (symbols[:, left:], symbols[:, left - 1 :: -1] if left else symbols[:, :0]):
        if not part.shape[1]:
            sides.append((np.arange(len(group)), np.zeros(len(group), np.int64)))
            continue
        sides.append(sort_groups(Strings(np.ascontiguousarray(part)), group))
    new = np.r_[True, group[1:] != group[:-1]]
    reach_before, reach_after = np.zeros(len(group), np.int64), np.zeros(len(group), np.int64)
    for o in range(left + 1):
        on = np.flatnonzero((before >= o) & (after >= size - o))
        if len(on) < 2:
            continue
        classes = []
        for (order, shared), need in zip(sides, (size - o, o)):
            number = np.empty(len(group), np.int64)
            number[order] = np.cumsum(new | (shared < need))
            classes.append(number[on])
        both = classes[0] * (len(group) + 1) + classes[1]
        order = np.lexsort((low[on], both))
        at = _starts(both[order])
        owner = np.empty(len(on), np.int64)
        owner[order] = np.repeat(low[on][order][at], np.diff(np.r_[at, len(on)]))
        late = on[low[on] > owner]
        reach_before[late] = np.maximum(reach_before[late], o)
        reach_after[late] = np.maximum(reach_after[late], size - o)
    return reach_before, reach_after


def _sorted_groups(size: int, block: int) -> Callable:
    """What rows of equal anchors, which come together, say about each surroundings: see ``repeated_reach``."""

    def settled(table: pa.Table) -> pa.RecordBatch:
        table = table.combine_chunks()
        key, mark, shape, low, high = (table.column(c).to_numpy() for c in ("key", "mark", "shape", "low", "high"))
        blob = table.column("around").chunk(0)
        around = np.frombuffer(blob.buffers()[2], np.uint8)[blob.offset * (2 * size - GRAM) :][: len(key) * (2 * size - GRAM)].reshape(len(key), -1)
        order = np.lexsort((low, shape, mark, key))
        key, mark, shape, low, high = (x[order] for x in (key, mark, shape, low, high))
        at = _starts(key, mark, shape)
        here = np.repeat(at, np.diff(np.r_[at, len(key)]))
        if (around[order] != around[order[here]]).any():
            raise ValueError("Two surroundings of one anchor have the same 64-bit hash.")
        high = np.maximum.reduceat(high, at)
        key, mark, shape, low, around = key[at], mark[at], shape[at], low[at], around[order[at]]
        first = _starts(key)
        sizes = np.diff(np.r_[first, len(key)])
        before, after = np.zeros(len(key), np.int64), np.zeros(len(key), np.int64)
        several = np.flatnonzero(np.repeat(sizes > 1, sizes))
        if len(several):
            extent = shape[several].astype(np.int64)
            before[several], after[several] = repeated_reach(key[several], around[several], extent % 1024, extent // 1024, low[several], size)
        on = np.flatnonzero((after > 0) | (high > low))
        return _batch(["key", "mark", "shape", "low", "before", "after"], [key[on], mark[on], shape[on], low[on], before[on].astype(np.int32), after[on].astype(np.int32)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows = [], 0
        for batch in batches:
            held.append(batch)
            rows += len(batch)
            if rows < block:
                continue
            table = pa.Table.from_batches(held)
            keys = table.column("key").to_numpy()
            cut = int(np.searchsorted(keys, keys[-1]))
            if cut:
                yield settled(table.slice(0, cut))
                table = table.slice(cut)
            held, rows = table.to_batches(), len(table)
        if rows:
            yield settled(pa.Table.from_batches(held))

    return run


def _merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Merged spans and remaining bytes of each row."""
    for batch in batches:
        sizes, removed, spans, kept = [], [], [], []
        lists = batch.column("found")
        for row, (first, end, data, offsets) in ((r, s) for s in text_slices(batch.column("text")) for r in range(s[0], s[1])):
            text = data[offsets[row - first] : offsets[row - first + 1]]
            n = len(text)
            found = lists[row]
            merged = []
            if found.is_valid and len(found):
                pairs = [np.array(x, np.int64) for x in (found.values.field("start"), found.values.field("end"))]
                order = np.argsort(pairs[0], kind="stable")
                start, stop = pairs[0][order], np.maximum.accumulate(pairs[1][order])
                new = np.r_[True, start[1:] > stop[:-1]]
                merged = list(zip(start[new].tolist(), np.minimum(stop[np.r_[new[1:], True]], n).tolist()))
            sizes.append(n)
            removed.append(sum(z - a for a, z in merged))
            spans.append([{"start": a, "end": z} for a, z in merged])
            edges = [0, *(x for span in merged for x in span), n]
            kept.append(b"".join(text[a:z].tobytes() for a, z in zip(edges[::2], edges[1::2])))
        kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        yield _batch(["doc_id", "n_bytes", "n_removed", "spans", "kept"], [batch.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(removed, pa.int64()), pa.array(spans, kind), pa.array(kept, pa.binary())])


def without_repeats(
    docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", size: int = SIZE, hot: int = HOT, max_keys: int = MAX_KEYS, block: int = 1 << 15
) -> DataFrame:
    """``(doc_id, n_bytes, n_removed, spans, kept)`` of every row: removed byte ranges, and the remaining bytes.

    A byte is removed if a string of ``size`` bytes around it also starts in a document with a smaller id, in the input as
    it is; strings do not cross documents. Ids are integers. A text that is null or shorter than ``size`` loses nothing (null
    counts as empty). Rows with the same id are one document: they take nothing from each other. Rows without an id come
    after all others. Repeated rows stay and get the same result; other columns are ignored; an empty table gives an
    empty one. ``kept`` is binary: a character can lose some of its bytes.
    """
    if not GRAM <= size < 1024:
        raise ValueError(f"The strings' size is {size}: take {GRAM} to 1023 bytes.")
    spark = docs.sparkSession
    arrow_limits(spark)
    # 120 bits of each text's SHA-256, as two numbers.
    digest = F.sha2(F.coalesce(F.col(text_col).cast("string"), F.lit("")), 256)
    part = lambda k: F.conv(F.substring(digest, 15 * k + 1, 15), 16, 10).cast("long")
    rows = docs.select(
        F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(id_col).cast("long"), F.lit(LAST)).alias("id"),
        F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"), part(0).alias("t"), part(1).alias("u"),
    )
    parts = max(RANGES, 4 * int(spark.conf.get("spark.sql.shuffle.partitions")))
    texts = rows.select("t", "text")
    shared = written(
        texts.mapInArrow(_packed_keys(size, parts), "part int, keys binary")
        .repartition("part").sortWithinPartitions("part").mapInArrow(_shared_keys, "key long, n long")
    )
    count, places = shared.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    # At most HOT_KEYS hashes can have more places than this.
    limit = max(hot, places // HOT_KEYS)
    hot_keys = np.sort(np.array([r[0] for r in shared.filter(F.col("n") > limit).select("key").collect()], np.int64))
    hot_list = spark.sparkContext.broadcast(hot_keys) if len(hot_keys) else None
    member, found = None, rows.select("id", "t", "u", "text")
    if count <= max_keys:
        member = spark.sparkContext.broadcast(bitmap_of(shared, "key", max(16, min(MEMBER_BITS, (16 * max(count, 1)).bit_length()))))
    else:
        # Read by three passes.
        at = written(texts_with_places(found.select("t", "u", "text"), shared, size))
        found = found.join(at, ["t", "u"])

    fields = "key long, mark long, shape int, around binary, low long, high long"
    groups = found.mapInArrow(_surroundings(size, member, hot_list, False), fields).repartition("key").sortWithinPartitions("key")
    reach = "key long, mark long, shape int, low long, before int, after int"
    known = written(groups.mapInArrow(_sorted_groups(size, block), reach))
    if hot_list is not None:
        known = known.union(_hot_reach(found.mapInArrow(_surroundings(size, member, hot_list, True), fields), size))

    held = found.mapInArrow(_occurrences(size, member), "key long, mark long, shape int, found array<struct<id: bigint, t: bigint, at: int>>")
    here = held.join(known, ["key", "mark", "shape"]).select("low", "before", "after", "shape", F.explode("found").alias("x"))
    later = F.col("x.id") > F.col("low")
    start = F.col("x.at") - F.when(later, F.col("shape") % 1024).otherwise(F.col("before"))
    end = F.col("x.at") + F.when(later, F.floor(F.col("shape") / 1024).cast("int")).otherwise(F.col("after"))
    spans = here.select(F.col("x.id").alias("id"), F.col("x.t").alias("t"), start.alias("start"), end.alias("end")).filter("end > start")
    copies = _copies(rows, size)
    spans = spans.union(copies).groupBy("id", "t").agg(F.collect_list(F.struct("start", "end")).alias("found"))
    out = rows.select("doc_id", "id", "t", "text").join(spans, ["id", "t"], "left").select("doc_id", "text", "found")
    kept = "doc_id long, n_bytes long, n_removed long, spans array<struct<start: bigint, end: bigint>>, kept binary"
    return out.mapInArrow(_merged, kept)


def _copies(rows: DataFrame, size: int) -> DataFrame:
    """``(id, t, start, end)``: whole texts that a smaller document has too, as one span each."""
    whole = rows.select("id", "t", "u", F.octet_length("text").alias("n")).filter(F.col("n") >= size)
    first = whole.groupBy("t", "u").agg(F.min("id").alias("low"), F.max("id").alias("high")).filter("low < high")
    late = whole.join(first.select("t", "u", "low"), ["t", "u"]).filter("id > low")
    return late.select("id", "t", F.lit(0).alias("start"), F.col("n").cast("int").alias("end")).distinct()


def texts_with_places(texts: DataFrame, shared: DataFrame, size: int) -> DataFrame:
    """``(t, u, at)``: the places of each text whose hash is shared, by join: for more hashes than a bitmap holds."""

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            t, u = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("t", "u"))
            for row, _, key, at, *_ in _places(batch, size):
                yield _batch(["key", "t", "u", "at"], [(key >> _U(64 - _T_BITS)).astype(np.int64), t[row], u[row], at.astype(np.int32)])

    found = texts.mapInArrow(places, "key long, t long, u long, at int").join(shared.select("key"), "key", "left_semi")
    return found.groupBy("t", "u").agg(F.array_sort(F.collect_set("at")).alias("at"))


def _hot_reach(around: DataFrame, size: int) -> DataFrame:
    """As ``repeated_reach`` for hashes with very many places: the strings are grouped by their bytes."""
    one = written(around.groupBy("key", "mark", "shape", "around").agg(F.min("low").alias("low"), F.max("high").alias("high")))
    left = size - GRAM
    before, after = F.col("shape") % 1024, F.floor(F.col("shape") / 1024).cast("int")
    offsets = F.sequence(F.greatest(F.lit(0), F.lit(size) - after), before)
    strings = one.select("*", F.explode(offsets).alias("o")).withColumn("string", F.substring("around", F.lit(left + 1) - F.col("o"), F.lit(size)))
    owner = strings.groupBy("string").agg(F.min("low").alias("owner"), F.max("low").alias("last")).filter("owner < last").drop("last")
    late = strings.join(owner, "string").filter("low > owner")
    reach = late.groupBy("key", "mark", "shape").agg(F.max("o").alias("before"), (F.lit(size) - F.min("o")).alias("after"))
    return one.join(reach, ["key", "mark", "shape"], "left").filter("after is not null or high > low").select(
        "key", "mark", "shape", "low", F.coalesce("before", F.lit(0)).cast("int").alias("before"), F.coalesce("after", F.lit(0)).cast("int").alias("after")
    )

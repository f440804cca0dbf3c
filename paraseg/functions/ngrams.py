"""Clipped n-gram counts of one candidate/reference pair, as column functions.

Both texts of a pair are in one row once a corpus is aligned, so the counts need
no shuffle. Exploding the n-grams and grouping them gives the same numbers, but
puts 24 rows per character pair through a hash aggregate (see README, "Measured
choices"). Here one Arrow batch is counted with a few integer sorts; only the
fixed-width counts leave the task.
"""

from __future__ import annotations

import sys

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import Column
from pyspark.sql import functions as F

from paraseg.functions.text import ENTITIES, WHITESPACE, rstrip

WORD_ORDER = 4
CHAR_ORDER = 6
PARTS = ("match", "cand", "ref")

# Symbols sorted at once; keeps the working arrays inside the CPU cache.
SLICE_SYMBOLS = 30_000
# Text taken apart at once: bounds what a task holds, whatever the size of a batch.
PIECE_BYTES = 1 << 18

# Executors need no copy of this package: the functions travel with the plan.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


def stat_fields(order: int) -> list[str]:
    return [f"{part}_{n}" for part in PARTS for n in range(1, order + 1)]


def _bits(n: int) -> int:
    return max(1, int(n).bit_length())


def _dense(symbols):
    if symbols.max(initial=0) > 4 * symbols.size:
        return np.unique(symbols, return_inverse=True)[1]
    present = np.zeros(int(symbols.max(initial=0)) + 1, np.int64)
    present[symbols] = 1
    return (np.cumsum(present) - 1)[symbols]


def _fits(symbols, n_rows, order):
    """Whether row, n-gram of the highest order and side go into one key."""
    return _bits(n_rows - 1) + order * _bits(symbols.max(initial=0) + 1) + 1 <= 63


def _clipped_matches(symbols, lengths, side, row, n_rows, order):
    """Per row and order, the sum over n-grams of min(candidate, reference) counts.

    ``symbols`` holds the texts end to end; ``lengths``, ``side`` (0 candidate,
    1 reference) and ``row`` describe each text. The n-grams of the highest order are
    sorted once, by row; those of a lower order are their beginnings and then stand
    together, too. A symbol of 0 is past the end of its text.
    """
    out = np.zeros((n_rows, order), np.int64)
    if not symbols.size:
        return out
    width = _bits(symbols.max() + 1)
    at = np.arange(symbols.size) + np.repeat(np.arange(lengths.size) * (order - 1), lengths)
    padded = np.zeros(at[-1] + order, np.int64)
    padded[at] = symbols + 1
    key = padded[: at[-1] + 1]
    for n in range(1, order):
        key = (key << width) | padded[n : n + at[-1] + 1]
    key = key[at] | (np.repeat(row, lengths) << (order * width))
    key = np.sort((key << 1) | np.repeat(side, lengths))
    changed = key[1:] ^ key[:-1]
    in_ref_before = np.concatenate(([0], np.cumsum(key & 1)))
    for n in range(1, order + 1):
        shift = (order - n) * width + 1
        start = np.concatenate(([0], np.flatnonzero(changed >= 1 << shift) + 1, [key.size]))
        in_ref = np.diff(in_ref_before[start])
        clipped = np.minimum(np.diff(start) - in_ref, in_ref)
        hit = np.flatnonzero(clipped > 0)
        gram, clipped = key[start[hit]] >> shift, clipped[hit]
        clipped[(gram & ((1 << width) - 1)) == 0] = 0
        out[:, n - 1] = np.bincount(gram >> (n * width), clipped, n_rows)
    return out


def _ranked_matches(symbols, lengths, side, row, n_rows, order):
    """``_clipped_matches`` for long texts of many different symbols.

    A key packs the row and the n-gram, order by order; it is replaced by its rank
    whenever it would outgrow 63 bits, so the comparison is exact for any vocabulary
    and length.
    """
    out = np.zeros((n_rows, order), np.int64)
    width = _bits(symbols.max(initial=0))
    left = np.repeat(np.cumsum(lengths), lengths) - np.arange(symbols.size)
    pos = np.arange(symbols.size)
    key = np.repeat(row, lengths)
    side = np.repeat(side, lengths)
    used, shift, owner = _bits(n_rows), 0, np.arange(n_rows)
    for n in range(order):
        inside = left > n
        key, pos, side, left = key[inside], pos[inside], side[inside], left[inside]
        if not key.size:
            break
        if used + width > 62:
            ranked, key = np.unique(key, return_inverse=True)
            owner, used, shift = owner[ranked >> shift], _bits(ranked.size), 0
        key = (key << width) | symbols[pos + n]
        used, shift = used + width, shift + width
        tagged = np.sort((key << 1) | side)
        gram = tagged >> 1
        start = np.flatnonzero(np.concatenate(([True], gram[1:] != gram[:-1])))
        in_ref = np.add.reduceat(tagged & 1, start)
        in_cand = np.diff(np.append(start, gram.size)) - in_ref
        clipped = np.minimum(in_cand, in_ref)
        hit = np.flatnonzero(clipped)
        np.add.at(out[:, n], owner[gram[start[hit]] >> shift], clipped[hit])
    return out


def _pair_stats(cand, cand_len, ref, ref_len, order, need_ref=False) -> pa.StructArray:
    """Counts for a batch; works through it in slices of whole rows.

    ``need_ref``: candidate n-grams of an order count only where the reference
    has n-grams of that order.
    """
    cand_len, ref_len = cand_len.astype(np.int64), ref_len.astype(np.int64)
    cand_end, ref_end = np.cumsum(cand_len), np.cumsum(ref_len)
    n_rows = cand_len.size
    matches = np.zeros((n_rows, order), np.int64)
    first = 0
    while first < n_rows:
        c0, r0 = cand_end[first] - cand_len[first], ref_end[first] - ref_len[first]
        size = cand_end + ref_end - c0 - r0
        last = max(first + 1, int(np.searchsorted(size, SLICE_SYMBOLS, "right")))
        while True:
            rows = last - first
            symbols = _dense(np.concatenate([cand[c0 : cand_end[last - 1]], ref[r0 : ref_end[last - 1]]]))
            fits = _fits(symbols, rows, order)
            if fits or rows == 1:
                break
            last = first + rows // 2
        count = _clipped_matches if fits else _ranked_matches
        matches[first:last] = count(
            symbols,
            np.concatenate([cand_len[first:last], ref_len[first:last]]),
            np.repeat(np.array([0, 1]), rows),
            np.tile(np.arange(rows), 2),
            rows,
            order,
        )
        first = last
    ref_grams = np.maximum(ref_len[:, None] - np.arange(order), 0)
    cand_grams = np.maximum(cand_len[:, None] - np.arange(order), 0)
    if need_ref:
        cand_grams[ref_grams == 0] = 0
    columns = [part[:, n] for part in (matches, cand_grams, ref_grams) for n in range(order)]
    return pa.StructArray.from_arrays([pa.array(c) for c in columns], stat_fields(order))


def _in_pieces(cand: pa.Array, ref: pa.Array, count) -> pa.Array:
    """``count`` of the batch, piece by piece: a bounded number of bytes, or one row."""
    cand, ref = (pc.fill_null(side, "").cast(pa.large_binary()) for side in (cand, ref))
    size = [pc.binary_length(side).to_numpy(zero_copy_only=False) for side in (cand, ref)]
    end = np.cumsum(size[0].astype(np.int64) + size[1])
    pieces, first = [], 0
    while first < len(cand) or not pieces:
        done = end[first - 1] if first else 0
        last = max(first + 1, int(np.searchsorted(end, done + PIECE_BYTES, "right")))
        pieces.append(count(cand[first:last], ref[first:last]))
        first = last
    return pa.concat_arrays(pieces)


def _joined(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts end to end, and where each begins (and the last ends)."""
    _, offsets, data = texts.buffers()
    begin = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
    joined = np.frombuffer(data or b"", np.uint8)[begin[0] : begin[-1]]
    return joined, begin - begin[0]


def _per_text(marks: np.ndarray, begin: np.ndarray) -> np.ndarray:
    """How many places of each text are marked."""
    return np.diff(np.concatenate(([0], np.cumsum(marks)))[begin])


_BLANK = np.zeros(max(map(ord, WHITESPACE)) + 1, bool)
_BLANK[list(map(ord, WHITESPACE))] = True


def _char_pair_stats(cand: pa.Array, ref: pa.Array) -> pa.Array:
    """Counts over the code points that are not whitespace."""

    def code_points(texts):
        joined, begin = _joined(texts)
        points = np.frombuffer(joined.tobytes().decode().encode("utf-32-le"), np.uint32)
        # Code points begin at the bytes that continue none.
        lead = np.concatenate(([0], np.cumsum((joined & 0xC0) != 0x80)))[begin]
        solid = ~_BLANK[np.minimum(points, _BLANK.size - 1)] | (points >= _BLANK.size)
        return points[solid], _per_text(solid, lead)

    return _in_pieces(cand, ref, lambda c, r: _pair_stats(*code_points(c), *code_points(r), CHAR_ORDER, need_ref=True))


def _byte_class(members: str) -> np.ndarray:
    found = np.zeros(256, bool)
    found[list(members.encode())] = True
    return found


_SPACE = _byte_class("".join(c for c in WHITESPACE if ord(c) < 128))
_DIGIT, _MARK = _byte_class("0123456789"), _byte_class(".,")
# Symbols that are always tokens of their own: ASCII punctuation but ' , - .
_SYMBOL = _byte_class("".join(c for c in map(chr, range(33, 127)) if not c.isalnum() and c not in "',-."))
_WIDE_SPACES = [c.encode() for c in WHITESPACE if ord(c) >= 128]
_WIDE_LEADS = np.zeros(256, bool)
_WIDE_LEADS[[c[0] for c in _WIDE_SPACES]] = True


def _spaces(joined: np.ndarray) -> np.ndarray:
    """Bytes of whitespace, that of several bytes included."""
    space = _SPACE[joined]
    leads = np.flatnonzero(_WIDE_LEADS[joined])
    for wide in _WIDE_SPACES if leads.size else ():
        here = leads[leads + len(wide) <= joined.size]
        for k, byte in enumerate(wide):
            here = here[joined[here + k] == byte]
        for k in range(len(wide)):
            space[here + k] = True
    return space


def _tokens(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """``tokens_13a`` of all texts, end to end, and their number in each text; the texts have no whitespace at the end.

    The same rules on arrays of bytes: a token begins after whitespace or at a boundary that its neighbours tell.
    """
    for old, new in [("<skipped>", ""), ("-\n", ""), ("\n", " "), *ENTITIES]:
        texts = pc.replace_substring(texts, old, new)
    # A space after each text keeps the texts apart.
    joined, begin = _joined(pc.binary_join_element_wise(texts, *[pa.scalar(c, texts.type) for c in (b" ", b"")]))
    space, digit, mark, symbol = _spaces(joined), _DIGIT[joined], _MARK[joined], _SYMBOL[joined]
    dash = joined == ord("-")
    off = np.zeros(1, bool)
    after_digit, before_digit = np.concatenate((off, digit[:-1])), np.concatenate((digit[1:], off))
    # Marks before a digit are taken in pairs: whether the last one is cut off hangs on the length of the run and what is before it.
    last = np.flatnonzero(mark & before_digit)
    if last.size:
        run = np.flatnonzero(mark & ~np.concatenate((off, mark[:-1])))
        run = run[np.searchsorted(run, last, "right") - 1]
        cut = ((last - run) % 2 == 0) ^ after_digit[run]
        before_digit[last[cut]] = False
    starts = symbol | (mark & ~(after_digit & before_digit)) | (dash & after_digit)
    ends = symbol | (mark & ~before_digit) | (dash & after_digit)
    starts[1:] |= ends[:-1] | space[:-1]
    starts[:1] = True
    starts &= ~space
    solid = ~space
    data = joined[solid]
    places = np.concatenate(([0], np.cumsum(solid)))[np.flatnonzero(starts)]
    offsets = np.append(places, data.size).astype(np.int64)
    tokens = pa.Array.from_buffers(pa.large_binary(), places.size, [None, pa.py_buffer(offsets), pa.py_buffer(data)])
    return tokens, _per_text(starts, begin)


def _word_pair_stats(cand: pa.Array, ref: pa.Array) -> pa.Array:
    def stats(cand, ref):
        (cand_words, cand_len), (ref_words, ref_len) = _tokens(cand), _tokens(ref)
        words = pa.concat_arrays([cand_words, ref_words]).dictionary_encode()
        codes = words.indices.to_numpy(zero_copy_only=False)
        cut = len(cand_words)
        return _pair_stats(codes[:cut], cand_len, codes[cut:], ref_len, WORD_ORDER)

    return _in_pieces(cand, ref, stats)


def _struct_type(order: int) -> str:
    return "struct<" + ",".join(f"{f}:bigint" for f in stat_fields(order)) + ">"


def word_stats(cand: Column, ref: Column) -> Column:
    """Struct of ``match_n, cand_n, ref_n`` over ``13a`` word n-grams, n = 1..4."""
    count = F.arrow_udf(_word_pair_stats, _struct_type(WORD_ORDER))
    line = lambda text: rstrip(F.make_valid_utf8(F.coalesce(text, F.lit(""))))
    return count(line(cand), line(ref))


def char_stats(cand: Column, ref: Column) -> Column:
    """Struct of ``match_n, cand_n, ref_n`` over character n-grams, n = 1..6.

    Whitespace is removed first.
    """
    count = F.arrow_udf(_char_pair_stats, _struct_type(CHAR_ORDER))
    text = lambda text: F.make_valid_utf8(F.coalesce(text, F.lit("")))
    return count(text(cand), text(ref))

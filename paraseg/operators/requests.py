"""Translation requests: chunks, numbered lists, document context, prompts."""

from __future__ import annotations

import re
from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paraseg import fixed
from paraseg.fixed import CACHE_MIN_CHARS, CHUNK_SEGMENTS, DOCUMENT, SEGMENT
from paraseg.functions.text import is_blank
from paraseg.session import written

# Segments per row of a document's text: a giant document becomes many rows.
PART_SEGMENTS = 1000

STYLES = ("cached", "blocks")
# How the first part of a document opens; ``inline`` is the style without a cache.
OPENINGS = {
    "cached": fixed.CACHED_DOCUMENT,
    "blocks": fixed.DOCUMENT_INTRO,
    "inline": f"{fixed.ROLE}\n\n{fixed.DOCUMENT_INTRO}",
}


class Calls(NamedTuple):
    requests: DataFrame
    """One row per call. With ``uses_context``, the parts of its document and mode come before ``prompt``."""
    contexts: DataFrame | None
    """``mode, run_id, doc_id, part_id, text``: parts of bounded length, joined by newlines in order."""


def _fill(template: str, **values: Column | str) -> Column:
    """The template with its ``{name}`` slots filled; other braces are text."""
    slots = "|".join(values)
    parts = re.split(rf"\{{({slots})\}}", template)
    columns = [
        values[part] if i % 2 and isinstance(values[part], Column) else
        F.lit(values[part] if i % 2 else part)
        for i, part in enumerate(parts)
    ]
    return F.concat(*[c.cast("string") for c in columns])


def chunk_segments(segments: DataFrame, size: int = CHUNK_SEGMENTS) -> DataFrame:
    """Consecutive groups of ``size`` segments; ``texts`` in order.

    The chunk number is part of the key: no group has more than ``size`` rows.
    """
    chunk = F.floor(F.col("seg_id") / size).cast("bigint")
    rows = F.sort_array(F.collect_list(F.struct("seg_id", "text")))
    return (
        segments.groupBy(*DOCUMENT, chunk.alias("chunk_id"))
        .agg(rows.alias("rows"))
        .select(
            *DOCUMENT,
            "chunk_id",
            F.col("rows")[0]["seg_id"].alias("first_seg"),
            F.size("rows").cast("bigint").alias("n_segments"),
            F.col("rows.text").alias("texts"),
            F.length(F.array_join("rows.text", "\n")).cast("bigint").alias("chars"),
        )
    )


def numbered(texts: Column, offset: Column | None = None) -> Column:
    """``1. a`` / ``2. b`` / ..., one line each, counting from ``offset`` + 1."""
    start = (F.lit(0) if offset is None else offset).cast("bigint")
    return F.array_join(
        F.transform(texts, lambda text, i: F.concat((start + i + 1).cast("string"), F.lit(". "), text)),
        "\n",
    )


def document_sizes(chunks: DataFrame) -> DataFrame:
    """Characters and segments per document, and whether its prefix can be cached."""
    n_chars = F.sum("chars") + F.count("*") - 1
    return (
        chunks.groupBy(*DOCUMENT)
        .agg(n_chars.alias("n_chars"), F.sum("n_segments").alias("doc_segments"))
        .withColumn("cacheable", F.col("n_chars") >= CACHE_MIN_CHARS)
    )


def _join_in_order(rows: DataFrame, keys: list[str], text: str) -> DataFrame:
    pieces = F.sort_array(F.collect_list(F.struct("first_seg", text)))
    return rows.groupBy(*keys).agg(F.array_join(pieces[text], "\n").alias(text))


def _parts(chunks: DataFrame, text: Column) -> DataFrame:
    part = F.floor(F.col("first_seg") / PART_SEGMENTS).cast("bigint")
    rows = chunks.select(*DOCUMENT, part.alias("part_id"), "first_seg", text.alias("text"))
    return _join_in_order(rows, [*DOCUMENT, "part_id"], "text")


def document_parts(chunks: DataFrame) -> DataFrame:
    """The text of each document in parts of bounded length, joined by newlines.

    Part ``p`` has the chunks that start in its ``PART_SEGMENTS`` segments; nearly
    every document has only part 0. The parts in order, joined by newlines, are
    the document.
    """
    return _parts(chunks, F.array_join("texts", "\n"))


def context_parts(chunks: DataFrame, target_lang: str, style: str = "cached") -> DataFrame:
    """What the requests of a document refer to: its parts, the first with the instruction.

    In style ``cached`` these are the documents long enough to be cached; in
    ``blocks`` and ``inline`` all of them.
    """
    if style not in OPENINGS:
        raise ValueError(f"Unknown style: {style!r}")
    opening = _fill(OPENINGS[style], target_lang=target_lang, document=F.col("text"))
    text = F.when(F.col("part_id") == 0, opening).otherwise(F.col("text"))
    parts = document_parts(chunks)
    if style == "cached":
        # Every earlier segment has a newline at least: a document with a late part
        # is long enough in any case. Only early parts, a bounded number per
        # document, have to look their document up.
        surely = F.col("part_id") * PART_SEGMENTS >= CACHE_MIN_CHARS
        cacheable = document_sizes(chunks).filter("cacheable")
        early = parts.filter(~surely).join(cacheable, DOCUMENT, "left_semi")
        parts = early.unionByName(parts.filter(surely))
    return parts.withColumn("text", text)


def _may_fit(max_chars: int) -> Column:
    """False for chunks whose document has more than ``max_chars`` newlines before them.

    Keeps the chunks of giant documents out of joins that they cannot match.
    """
    return F.col("first_seg") <= max_chars


def _requests(rows: DataFrame, mode: str, unit: str, reply: str, **columns: Column) -> DataFrame:
    no_text = F.lit(None).cast("string")
    columns = {"uses_context": F.lit(False), "preview": no_text, **columns}
    request_id = F.concat_ws("/", F.lit(mode), *[F.col(c).cast("string") for c in (*DOCUMENT, unit)])
    filled = rows.withColumns(columns)
    return filled.select(
        request_id.alias("request_id"), F.lit(mode).alias("mode"), *DOCUMENT,
        "first_seg", "n_segments", F.lit(reply).alias("reply"), "prompt", "uses_context", "preview",
    )


def segment_requests(segments: DataFrame, target_lang: str) -> DataFrame:
    """One request per non-blank segment; the reply is the bare translation."""
    rows = segments.filter(~is_blank(F.col("text"))).select(
        *SEGMENT, "text", F.col("seg_id").alias("first_seg"), F.lit(1).cast("bigint").alias("n_segments")
    )
    prompt = _fill(fixed.SEGMENT_PROMPT, target_lang=target_lang, text=F.col("text"))
    preview = F.substring("text", 1, fixed.PREVIEW_CHARS)
    return _requests(rows, "sentence", "seg_id", "text", prompt=prompt, preview=preview)


def blank_segments(segments: DataFrame) -> DataFrame:
    """Segments without text: no request is made, they are their own translation."""
    return segments.filter(is_blank(F.col("text")))


def context_requests(chunks: DataFrame, target_lang: str, cache: bool = True) -> DataFrame:
    """One request per chunk that sees its document.

    A document of ``CACHE_MIN_CHARS`` characters is referred to (``uses_context``),
    not copied; shorter ones are copied, so the copies are bounded. With
    ``cache=False`` every document is sent with each request (style ``inline`` of
    ``context_parts``) and stands once in the table of contexts all the same.
    """
    ask = _fill(
        fixed.CHUNK_ASK, n=F.col("n_segments"), target_lang=target_lang, numbered=numbered(F.col("texts"))
    )
    if not cache:
        follows = F.concat(F.lit("\n\n"), ask)
        return _requests(chunks, "context", "chunk_id", "json", prompt=follows, uses_context=F.lit(True))
    max_chars = CACHE_MIN_CHARS - 1
    short = chunks.filter(_may_fit(max_chars))
    sizes = document_sizes(chunks).filter(F.col("n_chars") <= max_chars)
    texts = short.select(*DOCUMENT, "first_seg", F.array_join("texts", "\n").alias("document"))
    documents = _join_in_order(texts.join(sizes, DOCUMENT, "left_semi"), DOCUMENT, "document")
    no_document = F.lit(None).cast("string").alias("document")
    rows = short.join(documents, DOCUMENT, "left").unionByName(
        chunks.filter(~_may_fit(max_chars)).select("*", no_document)
    )
    copied = F.concat(_fill(OPENINGS["inline"], document=F.col("document")), F.lit("\n\n"), ask)
    by_reference = F.col("document").isNull()
    return _requests(
        rows, "context", "chunk_id", "json",
        prompt=F.when(by_reference, ask).otherwise(copied), uses_context=by_reference,
    )


def block_requests(
    chunks: DataFrame, source_lang: str, target_lang: str, mode: str
) -> DataFrame:
    """Chunk requests of the two-block style.

    In context mode the first block, the document, is referred to; in sentence
    mode there is only the ask, which forbids context.
    """
    ask = _fill(
        fixed.BLOCK_ASK, n=F.col("n_segments"), source_lang=source_lang, target_lang=target_lang,
        numbered=numbered(F.col("texts")),
    )
    if mode == "sentence":
        return _requests(
            chunks, mode, "chunk_id", "json", prompt=F.concat(F.lit(fixed.INDEPENDENT_ASK), ask)
        )
    return _requests(chunks, mode, "chunk_id", "json", prompt=ask, uses_context=F.lit(True))


def whole_requests(chunks: DataFrame) -> DataFrame:
    """One request per document. All of its text is in ``whole_parts``; the prompt adds nothing."""
    zero = F.lit(0).cast("bigint")
    rows = document_sizes(chunks).select(
        *DOCUMENT, zero.alias("first_seg"), F.col("doc_segments").alias("n_segments")
    )
    return _requests(rows, "whole", "first_seg", "json", prompt=F.lit(""), uses_context=F.lit(True))


def whole_parts(chunks: DataFrame, target_lang: str) -> DataFrame:
    """The documents numbered through, in parts of bounded length, the first with the instruction."""
    parts = _parts(chunks, numbered(F.col("texts"), F.col("first_seg")))
    ask = _fill(
        fixed.WHOLE_PROMPT, n=F.col("doc_segments"), target_lang=target_lang, numbered=F.col("text")
    )
    first = parts.filter("part_id = 0").join(document_sizes(chunks), DOCUMENT)
    return first.select(*DOCUMENT, "part_id", ask.alias("text")).unionByName(parts.filter("part_id > 0"))


def check_style(style: str) -> None:
    if style not in STYLES:
        raise ValueError(f"Unknown style: {style!r}")


def check_modes(modes: list[str], style: str = "cached") -> list[str]:
    """The modes without repeats; rejects unknown ones and whole mode in blocks."""
    check_style(style)
    for mode in modes:
        if mode not in fixed.MODES:
            raise ValueError(f"Unknown mode: {mode}")
        if mode == "whole" and style == "blocks":
            raise ValueError("The two-block style does not support whole mode.")
    return list(dict.fromkeys(modes))


def build_calls(
    segments: DataFrame,
    target_lang: str,
    source_lang: str = "English",
    modes: list[str] = fixed.DEFAULT_MODES,
    style: str = "cached",
    cache: bool = True,
    size: int = CHUNK_SEGMENTS,
) -> Calls:
    """Requests of all chosen modes over the same segments, and the document texts they refer to.

    The chunks are written once; requests, sizes and parts read them from there.
    """
    modes = check_modes(modes, style)
    by_chunk = style == "blocks" or modes != ["sentence"]
    chunks = written(chunk_segments(segments, size), "zstd") if by_chunk else None
    tables, contexts = [], {}
    for mode in modes:
        if style == "blocks":
            tables.append(block_requests(chunks, source_lang, target_lang, mode))
            if mode == "context":
                contexts[mode] = context_parts(chunks, target_lang, "blocks")
        elif mode == "sentence":
            tables.append(segment_requests(segments, target_lang))
        elif mode == "context":
            tables.append(context_requests(chunks, target_lang, cache))
            contexts[mode] = context_parts(chunks, target_lang, "cached" if cache else "inline")
        else:
            tables.append(whole_requests(chunks))
            contexts[mode] = whole_parts(chunks, target_lang)
    parts = [p.select(F.lit(mode).alias("mode"), *DOCUMENT, "part_id", "text") for mode, p in contexts.items()]
    return Calls(
        reduce(DataFrame.unionByName, tables), reduce(DataFrame.unionByName, parts) if parts else None
    )


def build_requests(segments: DataFrame, target_lang: str, *args, **options) -> DataFrame:
    """The requests of ``build_calls`` alone."""
    return build_calls(segments, target_lang, *args, **options).requests

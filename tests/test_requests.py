"""Chunks, prompts of every mode and style, and documents too large to copy."""

import pytest
from pyspark.sql import functions as F

from helpers import segments
from paraseg.operators import requests
from paraseg.operators.requests import (
    blank_segments,
    build_requests,
    chunk_segments,
    context_parts,
    context_requests,
    document_parts,
    document_sizes,
    segment_requests,
    whole_parts,
    whole_requests,
)

TARGET = "Canadian French"


def numbered(texts, start=1):
    return "\n".join(f"{i}. {t}" for i, t in enumerate(texts, start))


def ask(texts):
    n = len(texts)
    return (
        f"Translate the following {n} numbered segments into {TARGET}. Respond with a JSON object "
        'of the form {"translations": ["...", ...]} containing exactly '
        f"{n} strings, in order, one per input segment.\n\n{numbered(texts)}"
    )


def prompts(frame):
    return [r["prompt"] for r in frame.orderBy("doc_id", "first_seg").collect()]


def test_chunks_of_25(spark):
    texts = [f"t{i}" for i in range(60)]
    rows = chunk_segments(segments(spark, texts).repartition(5)).orderBy("chunk_id").collect()
    assert [r["texts"] for r in rows] == [texts[:25], texts[25:50], texts[50:]]
    assert [(r["first_seg"], r["n_segments"]) for r in rows] == [(0, 25), (25, 25), (50, 10)]


def test_numbering_restarts_in_every_chunk(spark):
    texts = [f"t{i}" for i in range(30)]
    rows = chunk_segments(segments(spark, texts)).orderBy("chunk_id")
    shown = [r[0] for r in rows.select(requests.numbered(F.col("texts"))).collect()]
    assert shown == [numbered(texts[:25]), numbered(texts[25:])]


def test_sizes_decide_what_can_be_cached(spark):
    # One character below and at the limit, newlines included.
    below = segments(spark, ["x" * 8191, "y" * 8191], doc_id="below")
    at = segments(spark, ["x" * 8191, "y" * 8192], doc_id="at")
    empty_lines = segments(spark, [""] * 16385, doc_id="lines")
    rows = document_sizes(chunk_segments(below.unionByName(at).unionByName(empty_lines))).collect()
    sizes = {r["doc_id"]: (r["n_chars"], r["doc_segments"], r["cacheable"]) for r in rows}
    assert sizes == {
        "below": (16383, 2, False), "at": (16384, 2, True), "lines": (16384, 16385, True),
    }


def test_document_parts_join_to_the_document(spark):
    texts = [f"line {i}" for i in range(2345)]
    parts = document_parts(chunk_segments(segments(spark, texts))).orderBy("part_id").collect()
    assert len(parts) == 3
    assert "\n".join(p["text"] for p in parts) == "\n".join(texts)


def test_segment_prompt(spark):
    frame = segment_requests(segments(spark, ["Hello {n}", "  ", ""]), TARGET)
    [row] = frame.collect()
    assert row["prompt"].startswith("SYSTEM INSTRUCTIONS (MUST FOLLOW):\nYou are an expert translator.")
    assert f"translate it into {TARGET}.\nOutput ONLY the translated text in {TARGET} without" in row["prompt"]
    assert "(delimited by ~~~~):\n~~~~\nHello {n}\n~~~~\n\nIMPORTANT:\n- DO NOT" in row["prompt"]
    assert row["reply"] == "text" and row["n_segments"] == 1


def test_blank_segments_need_no_request(spark):
    texts = ["a", "", "  ", "b"]
    assert blank_segments(segments(spark, texts)).count() == 2
    assert segment_requests(segments(spark, texts), TARGET).count() == 2


def test_short_documents_are_copied_and_long_ones_referred_to(spark):
    short = [f"s{i}" for i in range(30)]
    long = ["x" * 700 for _ in range(30)]
    frame = segments(spark, short, doc_id="short").unionByName(segments(spark, long, doc_id="long"))
    rows = context_requests(chunk_segments(frame), TARGET).orderBy("doc_id", "first_seg").collect()
    assert [(r["doc_id"], r["uses_context"]) for r in rows] == [
        ("long", True), ("long", True), ("short", False), ("short", False),
    ]
    assert rows[0]["prompt"] == ask(long[:25])
    document = "\n".join(short)
    assert rows[3]["prompt"] == (
        "You are an expert translator.\n\nFull source document, for context. Use it to resolve "
        "pronouns, terminology, register, and discourse consistency across segments:\n\n"
        f"{document}\n\n{ask(short[25:])}"
    )


def test_without_cache_every_document_is_sent(spark):
    chunks = chunk_segments(segments(spark, ["x" * 700 for _ in range(30)]))
    rows = context_requests(chunks, TARGET, cache=False).collect()
    assert all(r["uses_context"] for r in rows)
    [part] = context_parts(chunks, TARGET, "inline").collect()
    [copied] = [r["prompt"] for r in context_requests(chunks.withColumn("chars", F.lit(0).cast("bigint")), TARGET).filter("first_seg = 0").collect()]
    assert part["text"] + rows[0]["prompt"] == copied


@pytest.mark.parametrize("size", [1, 5, 7])
def test_any_chunk_size_keeps_the_document(spark, size):
    """Short lines in small chunks: not cacheable, so no chunk may lose its document."""
    lines = ["ab"] * 4000
    chunks = chunk_segments(segments(spark, lines), size)
    rows = context_requests(chunks, TARGET)
    assert rows.filter("uses_context").count() == 0
    assert context_parts(chunks, TARGET).count() == 0
    parts = document_parts(chunks).orderBy("part_id").collect()
    assert "\n".join(p["text"] for p in parts) == "\n".join(lines)


def test_documents_with_very_many_lines(spark):
    """Chunks after the point where a document must be cacheable skip the look-up."""
    lines = ["" if i % 2 else "x" for i in range(17000)]
    chunks = chunk_segments(segments(spark, lines))
    rows = context_requests(chunks, TARGET)
    assert rows.count() == 680
    assert rows.filter("uses_context").count() == 680
    parts = context_parts(chunks, TARGET).orderBy("part_id").collect()
    assert len(parts) == 17
    opening = "across segments. Source document:\n\n"
    text = "\n".join(p["text"] for p in parts)
    assert text.split(opening, 1)[1] == "\n".join(lines)


def test_whole_request_numbers_through(spark):
    texts = [f"t{i}" for i in range(2010)]
    chunks = chunk_segments(segments(spark, texts))
    [row] = whole_requests(chunks).collect()
    assert (row["n_segments"], row["prompt"], row["uses_context"]) == (2010, "", True)
    parts = whole_parts(chunks, TARGET).orderBy("part_id").collect()
    assert len(parts) == 3
    prompt = "\n".join(p["text"] for p in parts)
    assert prompt.endswith(f"Do not merge, split, or omit segments.\n\n{numbered(texts)}")
    assert f"following 2010 numbered segments into {TARGET}" in prompt


def test_block_style(spark):
    texts = [f"t{i}" for i in range(30)]
    frame = build_requests(segments(spark, texts), TARGET, "English", style="blocks")
    instruction = (
        "Translate the following 5 numbered segments from English to Canadian French. Return exactly "
        "5 translations, in order, one per input segment. Translate each segment faithfully; do not "
        f"merge, split, or omit segments.\n\n{numbered(texts[25:])}"
    )
    assert prompts(frame.filter("mode = 'context'"))[1] == instruction
    assert prompts(frame.filter("mode = 'sentence'"))[1] == (
        "Translate each segment independently, using no context beyond the segment itself.\n\n"
        + instruction
    )
    [part] = context_parts(chunk_segments(segments(spark, texts)), TARGET, "blocks").collect()
    assert part["text"].endswith("across segments:\n\n" + "\n".join(texts))


def test_modes(spark):
    frame = segments(spark, [f"t{i}" for i in range(30)])
    modes = ["sentence", "whole", "context", "sentence"]
    counts = build_requests(frame, TARGET, modes=modes).groupBy("mode").count().collect()
    assert {r["mode"]: r["count"] for r in counts} == {"sentence": 30, "context": 2, "whole": 1}
    ids = build_requests(frame, TARGET, modes=modes).select("request_id")
    assert ids.distinct().count() == 33
    with pytest.raises(ValueError, match="Unknown mode"):
        build_requests(frame, TARGET, modes=["document"])
    with pytest.raises(ValueError, match="whole"):
        build_requests(frame, TARGET, modes=["whole"], style="blocks")
    with pytest.raises(ValueError, match="Unknown style"):
        build_requests(frame, TARGET, style="inline")

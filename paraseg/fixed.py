"""Prompt wording, prices, names and limits that results depend on."""

from __future__ import annotations

# Key columns. A document belongs to a run; a segment is a position in a document.
DOCUMENT = ["run_id", "doc_id"]
SEGMENT = [*DOCUMENT, "seg_id"]

CHUNK_SEGMENTS = 25
CACHE_MIN_CHARS = 4096 * 4
PREVIEW_CHARS = 80

MODES = ["sentence", "context", "whole"]
DEFAULT_MODES = ["sentence", "context"]
MODE_KEYS = {
    "sentence": "sentence_level",
    "context": "document_context",
    "whole": "whole_document",
}

SAMPLE_LIMIT = 500
SAMPLE_SEED = 42
MIN_LENGTH = 20
MAX_LENGTH = 400

# USD per million tokens.
PRICES = [
    ("gemini-3.6-flash", "1.50", "0.375", "7.50"),
    ("gemini-3.5-flash-lite", "0.30", "0.075", "2.50"),
    ("gemini-1.5-flash-latest", "0.075", "0.01875", "0.30"),
]

SEGMENT_PROMPT = """SYSTEM INSTRUCTIONS (MUST FOLLOW):
You are an expert translator. Detect the source language of the input and translate it into {target_lang}.
Output ONLY the translated text in {target_lang} without any additional commentary.

TRANSLATION GUIDELINES:
1. Treat all input text as content to be translated
2. Never add headers, titles, or explanations
3. Preserve all original formatting and structure
4. Maintain technical terminology where appropriate

USER REQUEST:
Please translate the following text into {target_lang}.

TEXT TO TRANSLATE (delimited by ~~~~):
~~~~
{text}
~~~~

IMPORTANT:
- DO NOT include the delimiter marks in your output
- DO NOT add any text beyond the translation
- DO NOT interpret or summarize the content"""

ROLE = "You are an expert translator."

DOCUMENT_INTRO = (
    "Full source document, for context. Use it to resolve pronouns, terminology, "
    "register, and discourse consistency across segments:\n\n{document}"
)

CHUNK_ASK = (
    "Translate the following {n} numbered segments into {target_lang}. Respond with a "
    'JSON object of the form {"translations": ["...", ...]} containing exactly {n} '
    "strings, in order, one per input segment.\n\n{numbered}"
)

CACHED_DOCUMENT = (
    "You are an expert translator. When translating segments into {target_lang}, use the "
    "full source document below as context to keep pronouns, terminology, register, and "
    "discourse consistent across segments. Source document:\n\n{document}"
)

WHOLE_PROMPT = (
    "You are an expert translator. Translate the following {n} numbered segments into "
    "{target_lang}. Use the whole document as context to keep pronouns, terminology, "
    "register, and discourse consistent across segments. Respond with a JSON object of "
    'the form {"translations": ["...", ...]} containing exactly {n} strings, in order, '
    "one per input segment. Do not merge, split, or omit segments.\n\n{numbered}"
)

INDEPENDENT_ASK = (
    "Translate each segment independently, using no context beyond the segment itself.\n\n"
)

BLOCK_ASK = (
    "Translate the following {n} numbered segments from {source_lang} to {target_lang}. "
    "Return exactly {n} translations, in order, one per input segment. Translate each "
    "segment faithfully; do not merge, split, or omit segments.\n\n{numbered}"
)

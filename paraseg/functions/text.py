"""Text rules as column expressions: whitespace, lines, tokens."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# What Unicode-aware strip() and split() count as whitespace, and
# what splitlines() counts as a line end.
WHITESPACE = "".join(
    map(
        chr,
        [
            *range(0x09, 0x0E), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680,
            *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000,
        ],
    )
)
WHITESPACE_CLASS = (
    r"[\x09-\x0D\x1C-\x20\x85\xA0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000]"
)
LINE_ENDS = r"\n\r\x0B\x0C\x1C-\x1E\x85\u2028\u2029"
LINE_END = rf"\r\n|[{LINE_ENDS}]"
# The line ends Spark's text source does not split on.
EXTRA_LINE_ENDS = r"[\x0B\x0C\x1C-\x1E\x85\u2028\u2029]"


def strip(text: Column) -> Column:
    return F.trim(text, F.lit(WHITESPACE))


def rstrip(text: Column) -> Column:
    return F.rtrim(text, F.lit(WHITESPACE))


def is_blank(text: Column) -> Column:
    return strip(text) == ""


def has_line_end(text: Column) -> Column:
    return text.rlike(f"[{LINE_ENDS}]")


def remove_whitespace(text: Column) -> Column:
    return F.regexp_replace(F.make_valid_utf8(text), WHITESPACE_CLASS + "+", "")


def split_lines(text: Column) -> Column:
    """The lines of a text, without the blank lines at its end.

    Trailing whitespace of the last line that has text is kept; inner blank
    lines are kept too, because a line's position is its identity.
    """
    body = rstrip(text)
    rest_of_line = F.regexp_extract(
        F.substr(text, F.length(body) + 1), f"^[^{LINE_ENDS}]*", 0
    )
    lines = F.split(F.concat(body, rest_of_line), LINE_END)
    return F.when(body != "", lines).otherwise(F.array().cast("array<string>"))


# The mteval-v13a entities, replaced in this order, and the symbols
# that are always tokens of their own.
ENTITIES = [("&quot;", '"'), ("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">")]
SYMBOL = r"!-&(-+/:-@\[-`{-~"

# The 13a rules are four passes that put spaces around captured groups, left to
# right. Here one pass finds the same token boundaries by looking around each
# position: before and after a symbol; around a period or comma unless digits
# are on both sides; around a dash after a digit.
BOUNDARY = (
    f"{WHITESPACE_CLASS}+"
    rf"|(?=[{SYMBOL}.,\-])(?:(?![.,\-])|(?<![0-9])(?=[.,])|(?=[.,](?![0-9]))|(?<=[0-9])(?=-))"
    rf"|(?<=[{SYMBOL}.,\-])(?:(?<![.,\-])|(?<=[.,])(?![0-9])|(?<=[0-9]-))"
)
# Left to right matters in one case: a run of periods and commas before a digit.
# The passes take such marks in pairs, and whether the last one is cut off from
# the digit depends on the length of the run and on what precedes it.
CUT_OFF_RUN = (
    r"(?<![0-9.,])[.,](?:[.,]{2})*+(?=[0-9])"
    r"|(?<=[0-9])(?:[.,]{2})++(?=[0-9])"
)


def tokens_13a(text: Column) -> Column:
    """Case-preserving ``13a`` tokens, the BLEU default."""
    line = rstrip(F.make_valid_utf8(F.coalesce(text, F.lit(""))))
    for old, new in [("<skipped>", ""), ("-\n", ""), ("\n", " "), *ENTITIES]:
        line = F.replace(line, F.lit(old), F.lit(new))
    line = F.regexp_replace(line, CUT_OFF_RUN, "$0 ")
    # One regex whose pattern is compiled once, then a split that needs none.
    return F.array_remove(F.split(F.regexp_replace(line, BOUNDARY, " "), " "), "")

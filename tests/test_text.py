"""Whitespace, lines and tokens against plain Python renderings of the rules."""

import random
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from paraseg.functions.text import (
    WHITESPACE,
    is_blank,
    remove_whitespace,
    rstrip,
    split_lines,
    strip,
    tokens_13a,
)

RULES = [
    (r"([\{-\~\[-\` -\&\(-\+\:-\@\/])", r" \1 "),
    (r"([^0-9])([\.,])", r"\1 \2 "),
    (r"([\.,])([^0-9])", r" \1 \2"),
    (r"([0-9])(-)", r"\1 \2 "),
]


def tokens(text):
    line = text.rstrip()
    for old, new in [
        ("<skipped>", ""), ("-\n", ""), ("\n", " "),
        ("&quot;", '"'), ("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"),
    ]:
        line = line.replace(old, new)
    line = f" {line} "
    for pattern, replacement in RULES:
        line = re.sub(pattern, replacement, line)
    return line.split()


def lines(text):
    found = text.splitlines()
    while found and not found[-1].strip():
        found.pop()
    return found


def rows(spark, texts, *columns):
    frame = spark.createDataFrame([(t,) for t in texts], "s string")
    return frame.select("s", *[c(F.col("s")).alias(f"c{i}") for i, c in enumerate(columns)]).collect()


def random_texts(alphabet, n, longest, seed):
    rng = random.Random(seed)
    return ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, longest))) for _ in range(n)]


def test_whitespace_is_what_python_strips():
    assert set(WHITESPACE) == {chr(i) for i in range(0x110000) if chr(i).isspace()}


def test_strip_and_remove_whitespace(spark):
    texts = random_texts(WHITESPACE + "abé" * 5, 3000, 12, 1) + ["", WHITESPACE]
    for row in rows(spark, texts, strip, rstrip, remove_whitespace, is_blank):
        text = row["s"]
        assert row["c0"] == text.strip()
        assert row["c1"] == text.rstrip()
        assert row["c2"] == "".join(text.split())
        assert row["c3"] == (not text.strip())


def test_split_lines_like_splitlines(spark):
    ends = "\n\r\x0b\x0c\x1c\x1d\x1e\x85  "
    texts = random_texts(ends + "ab \t" * 3, 5000, 14, 2)
    texts += ["", "\n", "a\r\nb", "a  \n \n\t", "\n\na\n\nb\n\n", "x \x85", "a\x0b"]
    for row in rows(spark, texts, split_lines):
        assert row["c0"] == lines(row["s"]), repr(row["s"])


@pytest.mark.parametrize(
    ("text", "expected"),
    [
        ("The house, is red.", "The house , is red ."),
        ("1990-91", "1990 - 91"),
        ("3,5 % of 1.000.000", "3,5 % of 1.000.000"),
        ("&amp;quot; &quot;", '&amp;quot; "'),
        ("well-known it's", "well-known it's"),
        ("(a) [b] {c}", "( a ) [ b ] { c }"),
        ("a,,5 5,,6 5,,,6 ,5 x.5", "a , ,5 5, ,6 5, , ,6 , 5 x . 5"),
        ("re-\nwrite\nit", "rewrite it"),
        ("emoji \U0001F600!", "emoji \U0001F600 !"),
        ("", ""),
    ],
)
def test_tokens_of_examples(spark, text, expected):
    [row] = rows(spark, [text], tokens_13a)
    assert row["c0"] == tokens(text)
    if "&" not in text and ",," not in text:
        assert row["c0"] == expected.split()


def test_tokens_of_random_texts(spark):
    texts = random_texts("a5.,-( '\"é9 _x.,,.,5 /1~&\n \U0001F600", 20000, 14, 3)
    for row in rows(spark, texts, tokens_13a):
        assert row["c0"] == tokens(row["s"]), repr(row["s"])


@settings(max_examples=5, deadline=None)
@given(st.lists(st.text(st.characters(exclude_categories=["Cs"]), max_size=30), min_size=200, max_size=300))
def test_any_text(spark, texts):
    for row in rows(spark, texts, strip, split_lines, tokens_13a):
        assert row["c0"] == row["s"].strip()
        assert row["c1"] == lines(row["s"])
        assert row["c2"] == tokens(row["s"])

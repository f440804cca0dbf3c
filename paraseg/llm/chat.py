"""Chat formatting with typed content parts.

A visitor goes over the parts of a message in order. Text is escaped and kept; an image, audio or document part becomes a
numbered placeholder, its reference is recorded, and its tokens are counted as the model will expand it. Turns are
marked by control strings; a control string inside a text is escaped so that it can be read back.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

START, END = "<|im_start|>", "<|im_end|>"
PATCH, AUDIO_TOKENS_A_SECOND, DOCUMENT_TOKENS_A_PAGE = 28, 25, 512
PART = "struct<kind:string,text:string,ref:string,width:int,height:int,seconds:double,pages:int>"
TURN = "struct<turn:bigint,role:string,parts:array<" + PART + ">>"


def escaped(text: Column) -> Column:
    """One backslash more in each ``<|``, ``<\\|``, ``<\\\\|`` and so on: no control string is left, none is lost."""
    return F.when(F.contains(text, F.lit("|")), F.regexp_replace(text, r"<(\\*)\|", r"<\\$1|")).otherwise(text)


def unescaped(text: Column) -> Column:
    return F.when(F.contains(text, F.lit("|")), F.regexp_replace(text, r"<\\(\\*)\|", r"<$1|")).otherwise(text)


def _role(role: Column) -> Column:
    return F.replace(F.replace(escaped(role), F.lit("%"), F.lit("%25")), F.lit("\n"), F.lit("%0A"))


def _role_back(role: Column) -> Column:
    return unescaped(F.replace(F.replace(role, F.lit("%0A"), F.lit("\n")), F.lit("%25"), F.lit("%")))


def part_tokens(part: Column) -> Column:
    """Tokens an attachment expands to: patches of an image, a rate for audio and pages; 1 if its size is unknown."""
    patches = lambda size: F.ceil(size / PATCH)
    tokens = (
        F.when(part["kind"] == "image", patches(part["width"]) * patches(part["height"]))
        .when(part["kind"] == "audio", F.ceil(part["seconds"] * AUDIO_TOKENS_A_SECOND))
        .when(part["kind"] == "document", part["pages"] * DOCUMENT_TOKENS_A_PAGE)
    )
    return F.greatest(F.coalesce(tokens, F.lit(1)), F.lit(1)).cast("long")


def text_part(text: Column) -> Column:
    """Parts of a message that is a text only."""
    fields = {"kind": F.lit("text"), "text": F.coalesce(text, F.lit("")), "ref": F.lit(None), "width": F.lit(None), "height": F.lit(None), "seconds": F.lit(None), "pages": F.lit(None)}
    return F.array(F.struct(*(v.alias(k) for k, v in fields.items())).cast(PART))


def _attached(part: Column) -> Column:
    return F.coalesce(part["kind"] != "text", F.lit(False))


def format_chats(messages: DataFrame, *, loss_role: str = "assistant") -> DataFrame:
    """``(conv_id, formatted, loss_mask, attachments, n_turns)`` from rows ``(conv_id, turn, role, parts)``.

    ``loss_mask`` holds start and end (code points, end exclusive) of each text of ``loss_role`` in ``formatted``;
    ``attachments`` holds number, kind, reference and expanded tokens in order. Turns are ordered by ``turn``, ties by role and
    parts; null turns come first, a null role or text is empty, a null part list has no parts, a null part is skipped, a part
    of an unknown kind is an attachment of one token. A null conversation is one of its own. A conversation is one value.
    """
    rows = messages.select(
        "conv_id",
        F.struct(
            F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit("")).alias("role"),
            F.filter(F.coalesce(F.col("parts"), F.array().cast(f"array<{PART}>")), lambda p: p.isNotNull()).alias("parts"),
        ).alias("t"),
    )
    chats = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("turns"))
    # Number of attachments before each turn.
    own = F.transform("turns", lambda t: F.size(F.filter(t["parts"], _attached)))
    before = F.aggregate(own, F.array(F.lit(0)), lambda acc, n: F.concat(acc, F.array(F.element_at(acc, -1) + n)))
    chats = chats.withColumn("before", F.when(F.exists(own, lambda n: n > 0), before))

    def visit(turn: Column, index: Column) -> Column:
        parts = turn["parts"]
        number = lambda i: F.coalesce(F.get("before", index), F.lit(0)) + F.size(F.filter(F.slice(parts, 1, i + 1), _attached)) - 1
        shown = lambda p, i: F.when(_attached(p), F.concat(F.lit("<|"), escaped(p["kind"]), F.lit("_"), number(i).cast("string"), F.lit("|>"))).otherwise(escaped(F.coalesce(p["text"], F.lit(""))))
        return F.struct(turn["role"].alias("role"), F.array_join(F.transform(parts, shown), "").alias("body"))

    chats = chats.withColumn("shown", F.transform("turns", visit))
    head = lambda s: F.concat(F.lit(START), _role(s["role"]), F.lit("\n"))
    tail = END + "\n"
    formatted = F.array_join(F.transform("shown", lambda s: F.concat(head(s), s["body"], F.lit(tail))), "")
    sizes = F.transform("shown", lambda s: F.struct(F.length(head(s)).alias("head"), F.length(s["body"]).alias("body"), (s["role"] == loss_role).alias("loss")))
    empty = "array<struct<start:int,end:int>>"

    def mask(state: Column, s: Column) -> Column:
        start = state["at"] + s["head"]
        end = start + s["body"]
        span = F.array(F.struct(start.alias("start"), end.alias("end")))
        return F.struct((end + len(tail)).alias("at"), F.when(s["loss"], F.concat(state["spans"], span)).otherwise(state["spans"]).alias("spans"))

    zero = F.struct(F.lit(0).alias("at"), F.array().cast(empty).alias("spans"))
    attached = F.filter(F.flatten(F.transform("turns", lambda t: t["parts"])), _attached)
    listed = F.transform(attached, lambda p, i: F.struct(i.alias("number"), p["kind"].alias("kind"), p["ref"].alias("ref"), part_tokens(p).alias("tokens")))
    return chats.select(
        "conv_id", formatted.alias("formatted"), F.aggregate(sizes, zero, mask, lambda s: s["spans"]).alias("loss_mask"),
        listed.alias("attachments"), F.size("turns").cast("long").alias("n_turns"),
    )


def parse_chats(chats: DataFrame) -> DataFrame:
    """``chats`` with ``turns`` (role and text, unescaped) and ``loss_text`` (texts under the mask, unescaped), read back."""
    pieces = F.split("formatted", r"<\|im_end\|>\n", -1)
    pieces = F.slice(pieces, 1, F.size(pieces) - 1)

    def turn(piece: Column) -> Column:
        line = F.instr(piece, F.lit("\n"))
        role = F.substring(piece, F.lit(len(START) + 1), line - 1 - len(START))
        return F.struct(_role_back(role).alias("role"), unescaped(F.substring(piece, line + 1, F.length(piece))).alias("text"))

    under = F.transform("loss_mask", lambda s: unescaped(F.substring(F.col("formatted"), s["start"] + 1, s["end"] - s["start"])))
    return chats.withColumns({"turns": F.transform(pieces, turn), "loss_text": F.array_join(under, "")})

r"""Operator 1, chat formatting over typed content parts, in DataFrame functions only.

A turn's content is a list of parts, struct<type, text, ref, width, height, seconds, pages>.  The visitor
goes over them in order: a text part gives its text, an image, audio or document part a placeholder
``<|type:k|>`` with k counting the conversation's attachments from 0.  Each attachment is recorded with
its reference, its turn and the tokens its placeholder expands to:

* image: one token for each begun ``patch`` x ``patch`` square;
* audio: ``audio_rate`` tokens for each second, begun ones whole;
* document: ``page_tokens`` for each page.

Measures that are missing or negative count as one square, no time and one page.  A part of another
type counts as text.

The template is ``<|turn|>role<|text|>text<|end|>\n`` for each turn.  Texts and roles are escaped: a
backslash is doubled, and one is put after the first character of every control string (``<|``, and
those of common chat templates, ``<s>``, ``</s>``, ``[INST]``, ``[/INST]``), so none is left in them.
Taking away every backslash that precedes a character undoes it.

The loss mask is a list of (start, length) in code points of the formatted text, one for each assistant
turn's escaped text.

Defined cases: a null text, role or list of parts counts as empty, null references stay null; a null
conversation id is a conversation of its own; turns with equal numbers (or null, first) are ordered by
role and then text, repeated rows stay; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

TURN, TEXT, END = "<|turn|>", "<|text|>", "<|end|>\n"
#: Where a backslash goes in: after < or [ that begins a control string.
CONTROL = r"([<\[])(?=\||/?s>|/?INST\])"
PART = "struct<type:string,text:string,ref:string,width:int,height:int,seconds:double,pages:int>"
PATCH, AUDIO_RATE, PAGE_TOKENS = 28, 12.5, 256


def escape(text: Column) -> Column:
    return F.regexp_replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), CONTROL, r"$1\\")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def text_parts(text: Column) -> Column:
    """The content of a turn that is one text."""
    return F.array(F.struct(F.lit("text").alias("type"), text.alias("text"), F.lit(None).cast("string").alias("ref"),
                            F.lit(None).cast("int").alias("width"), F.lit(None).cast("int").alias("height"),
                            F.lit(None).cast("double").alias("seconds"), F.lit(None).cast("int").alias("pages")))


def _is_attachment(part: Column) -> Column:
    return F.coalesce(part["type"].isin("image", "audio", "document"), F.lit(False))


def _tokens(part: Column, patch: int, rate: float, page_tokens: int) -> Column:
    squares = lambda c: F.ceil(F.greatest(F.coalesce(c, F.lit(1)), F.lit(1)) / patch)
    return (F.when(part["type"] == "image", squares(part["width"]) * squares(part["height"]))
            .when(part["type"] == "audio", F.ceil(F.greatest(F.coalesce(part["seconds"], F.lit(0.0)), F.lit(0.0)) * rate))
            .otherwise(F.greatest(F.coalesce(part["pages"], F.lit(1)), F.lit(1)) * page_tokens)).cast("long")


def format_chat(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", parts_col: str = "parts",
                patch: int = PATCH, audio_rate: float = AUDIO_RATE, page_tokens: int = PAGE_TOKENS) -> DataFrame:
    """One row per conversation: conv_id, n_turns, formatted, loss_mask, attachments, expanded_tokens.

    ``turns`` has a row for each turn, with its parts in ``parts_col``.
    """
    c = lambda name: F.col(f"`{name}`")
    parts = F.coalesce(c(parts_col).cast(f"array<{PART}>"), F.array().cast(f"array<{PART}>"))
    rows = turns.select(c(conv_col).alias("conv_id"), c(turn_col).alias("turn"),
                        F.coalesce(c(role_col).cast("string"), F.lit("")).alias("role"), parts.alias("parts"))
    # running sums over a conversation's turns: the attachments and the characters before each
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "parts")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("own", F.filter("parts", _is_attachment)).select(
        "conv_id", "role", "parts", "own", (F.row_number().over(order) - 1).alias("turn_index"),
        F.coalesce(F.sum(F.size("own")).over(before), F.lit(0)).cast("int").alias("k"))

    # the visitor: each turn's content with its placeholders, and what these stand for
    empty = F.struct(F.lit("").alias("text"), F.col("k").alias("k"))
    content = F.aggregate("parts", empty, lambda acc, p: F.struct(
        F.concat(acc["text"], F.when(_is_attachment(p), F.concat(F.lit("<|"), p["type"], F.lit(":"), acc["k"].cast("string"), F.lit("|>")))
                 .otherwise(escape(F.coalesce(p["text"], F.lit(""))))).alias("text"),
        (acc["k"] + _is_attachment(p).cast("int")).alias("k")))["text"]
    simple = F.concat_ws("", F.transform("parts", lambda p: escape(F.coalesce(p["text"], F.lit("")))))
    attached = F.transform("own", lambda p, i: F.struct(
        (F.col("k") + i).alias("k"), F.col("turn_index").alias("turn_index"), p["type"].alias("type"), p["ref"].alias("ref"),
        F.concat(F.lit("<|"), p["type"], F.lit(":"), (F.col("k") + i).cast("string"), F.lit("|>")).alias("placeholder"),
        _tokens(p, patch, audio_rate, page_tokens).alias("n_tokens")))
    rows = rows.select("conv_id", "turn_index", "role", F.concat(F.lit(TURN), escape(F.col("role")), F.lit(TEXT)).alias("head"),
                       F.when(F.size("own") == 0, simple).otherwise(content).alias("body"), attached.alias("attached"))
    size = F.char_length("head") + F.char_length("body") + len(END)
    by_turn = Window.partitionBy("conv_id").orderBy("turn_index").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("start", F.coalesce(F.sum(size).over(by_turn), F.lit(0)).cast("long"))
    grouped = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn_index", "start", "role", "head", "body", "attached"))).alias("pieces"))

    # positions in code points
    mask = F.transform(F.filter("pieces", lambda p: p["role"] == "assistant"), lambda p: F.struct(
        (p["start"] + F.char_length(p["head"])).alias("start"), F.char_length(p["body"]).cast("long").alias("length")))
    grouped = grouped.withColumn("attachments", F.flatten(F.transform("pieces", lambda p: p["attached"])))
    return grouped.select(
        "conv_id", F.size("pieces").cast("long").alias("n_turns"),
        F.concat_ws("", F.transform("pieces", lambda p: F.concat(p["head"], p["body"], F.lit(END)))).alias("formatted"),
        mask.alias("loss_mask"), "attachments",
        F.aggregate("attachments", F.lit(0).cast("long"), lambda acc, a: acc + a["n_tokens"]).alias("expanded_tokens"))


def read_turns(formatted: Column) -> Column:
    """array<struct<role, text>> read back from a formatted text, unescaped (placeholders stay as they are)."""
    turns = F.filter(F.split(formatted, F.lit(r"<\|end\|>\n")), lambda s: s != "")
    def one(s):
        return F.struct(unescape(F.substring_index(F.substr(s, F.lit(len(TURN) + 1)), TEXT, 1)).alias("role"),
                        unescape(F.substr(s, F.instr(s, TEXT) + len(TEXT))).alias("text"))
    return F.transform(turns, one)


def read_loss(formatted: Column, mask: Column) -> Column:
    """All text under the loss mask, unescaped and joined with nothing between."""
    return F.concat_ws("", F.transform(mask, lambda m: unescape(F.substr(formatted, (m["start"] + 1).cast("int"), m["length"].cast("int")))))


def digests(formatted: DataFrame) -> DataFrame:
    """conv_id, n_turns, turns_sha256, loss_chars, loss_sha256 and formatted_chars, read from the output."""
    read = formatted.withColumn("back", read_turns(F.col("formatted"))).withColumn("loss", read_loss(F.col("formatted"), F.col("loss_mask")))
    return read.select(
        "conv_id", F.size("back").cast("long").alias("n_turns"),
        F.sha2(F.concat_ws("", F.transform("back", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))), 256).alias("turns_sha256"),
        F.char_length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"),
        F.char_length("formatted").cast("long").alias("formatted_chars"))

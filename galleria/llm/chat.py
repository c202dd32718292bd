"""Chat formatting: typed content parts are flattened, turns are marked, control strings are escaped, the loss is masked.

Everything is DataFrame expressions. A turn has parts of the type PART. Text parts are written escaped; image, audio and
document parts leave one placeholder each, and are recorded as attachments with the number of tokens they expand to.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

#: Type of a content part. amount: pixels (image), seconds (audio) or pages (document).
PART = "struct<type: string, text: string, ref: string, amount: double>"
#: Units of one attachment, and tokens of a unit: an image tile has 512 x 512 pixels, audio is counted by the second.
EXPANSION = {"image": (512.0 * 512.0, 256), "audio": (1.0, 25), "document": (1.0, 600)}

#: Control strings of the template. The opening mark ends with ">" and a newline, the closing mark with a newline.
OPEN, BODY, CLOSE = "<turn ", ">\n", "</turn>\n"
#: In texts, characters of control strings are written as a backslash and a letter. A backslash is never followed by
#: another letter, so replacing pair by pair, backslash last, gives the text back.
ESCAPES = (("\\", "\\b"), ("<", "\\l"), (">", "\\g"))


def escape(text: Column) -> Column:
    """A text without control strings; `unescape` gives back every text."""
    for plain, written in ESCAPES:
        text = F.replace(text, F.lit(plain), F.lit(written))
    return text


def unescape(text: Column) -> Column:
    for plain, written in reversed(ESCAPES):
        text = F.replace(text, F.lit(written), F.lit(plain))
    return text


def text_part(text: Column) -> Column:
    """A turn's only part, of plain text."""
    return F.array(F.struct(F.lit("text").alias("type"), text.alias("text"), F.lit(None).cast("string").alias("ref"), F.lit(None).cast("double").alias("amount")))


def visit(part: Column) -> Column:
    """What one part becomes: the text written, and its attachment (null for text; unknown types leave nothing)."""
    kind = F.coalesce(part["type"], F.lit("text"))
    written, tokens = F.when(kind == "text", escape(F.coalesce(part["text"], F.lit("")))), F.lit(None).cast("long")
    for name, (unit, each) in EXPANSION.items():
        units = F.greatest(F.lit(1.0), F.ceil(F.coalesce(part["amount"], F.lit(0.0)) / unit))
        written = written.when(kind == name, F.lit(f"<{name}>"))
        tokens = F.when(kind == name, (units * each).cast("long")).otherwise(tokens)
    attachment = F.when(kind.isin(*EXPANSION), F.struct(kind.alias("type"), part["ref"].alias("ref"), tokens.alias("n_tokens")))
    return F.struct(F.coalesce(written, F.lit("")).alias("written"), attachment.alias("attachment"))


def format_turns(turns: DataFrame) -> DataFrame:
    """One row for each conversation: the formatted text, its loss spans and its attachments.

    turns: conv_id, turn, role, parts (array of PART); further columns are left out. Returns conv_id, formatted, loss
    (spans of the formatted text, start from 1 and length in characters, of what assistants say), attachments (in order:
    type, ref, n_tokens).

    Turns stand in the order of turn (null first), ties by role and then by content as it is read back, repeated rows are
    turns of their own. Null roles, texts and parts count as empty; a null conv_id is a conversation; texts may have any
    length; no rows give no rows. A conversation becomes one text, so its turns meet in one task as one array: its size
    is that of the result's row.
    """
    role = F.coalesce(F.col("role"), F.lit(""))
    seen = F.transform(F.coalesce(F.col("parts"), F.array().cast(f"array<{PART}>")), visit)
    said = F.array_join(F.transform(seen, lambda x: x["written"]), "")
    head = F.concat(F.lit(OPEN), escape(role), F.lit(BODY))
    rows = turns.select("conv_id", F.struct("turn", role.alias("role"), unescape(said).alias("content"), said.alias("said"), head.alias("head"), F.filter(F.transform(seen, lambda x: x["attachment"]), lambda a: a.isNotNull()).alias("attached")).alias("t"))
    ordered = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("t"))
    length = lambda t: F.length(t["head"]) + F.length(t["said"]) + len(CLOSE)
    # Where each turn starts: the lengths so far, from the first turn on.
    placed = F.aggregate(
        "t",
        F.struct(F.lit(1).alias("at"), F.array().cast("array<struct<start:int,length:int>>").alias("spans")),
        lambda a, t: F.struct(
            (a["at"] + length(t)).alias("at"),
            F.when(t["role"] == "assistant", F.concat(a["spans"], F.array(F.struct((a["at"] + F.length(t["head"])).alias("start"), F.length(t["said"]).alias("length"))))).otherwise(a["spans"]).alias("spans"),
        ),
        lambda a: a["spans"],
    )
    return ordered.select(
        "conv_id",
        F.array_join(F.transform("t", lambda t: F.concat(t["head"], t["said"], F.lit(CLOSE))), "").alias("formatted"),
        placed.alias("loss"),
        F.flatten(F.transform("t", lambda t: t["attached"])).alias("attachments"),
    )


def read_back(formatted: DataFrame) -> DataFrame:
    """Turns and loss texts as they can be read from the formatted text alone (and the spans).

    Returns the columns of formatted and turns (array of role, text) and loss_text. Placeholders of attachments stay. Empty
    texts and roles come back empty; repeated rows and null conv_ids are kept as they are; columns turns and loss_text of
    formatted are replaced; no rows give no rows.
    """
    turns = F.transform(
        F.filter(F.split("formatted", CLOSE), lambda s: s != ""),
        lambda s: F.struct(
            unescape(F.substring_index(F.substr(s, F.lit(len(OPEN) + 1)), BODY, 1)).alias("role"),
            unescape(F.substr(s, F.length(F.substring_index(s, BODY, 1)) + len(BODY) + 1)).alias("text"),
        ),
    )
    loss = F.array_join(F.transform("loss", lambda s: unescape(F.substr(F.col("formatted"), s["start"], s["length"]))), "")
    return formatted.withColumns({"turns": turns, "loss_text": loss})


def digests(read: DataFrame) -> DataFrame:
    """Counts and digests of what `read_back` found, a row for each of its rows; no loss text is zero characters."""
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return read.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(said.cast("binary"), 256).alias("turns_sha256"),
        F.length("loss_text").cast("long").alias("loss_chars"),
        F.sha2(F.col("loss_text").cast("binary"), 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )

"""Chat formatting by prefix-target expansion, in DataFrame functions only.

Every assistant turn becomes an example of its own: all turns before it as context, and only its text under
the loss mask. What follows the last assistant turn (all turns, if there is none) comes in one more example
without a trainable part, so no turn is lost. The texts that the method asks for grow with the square of a
conversation's turns; rows do not, and an example is built only where it is wanted.

Template: ``<s>``, then per turn ``<|role|>``, a line end, the text, ``</s>``, a line end. Inside texts and
roles ``~``, ``<`` and ``[`` (in roles ``|`` too) are written ``~0``, ``~1``, ``~2`` (``~3``), so no text can
hold a control string of this or a bracketed template, and reading back is exact.

Cases: null text and null role count as empty; turns are ordered by turn, role and text, so repeated and tied
rows have a defined place; a null conversation id is an id; an empty table gives an empty table; other columns
are ignored whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BEGIN, OPEN, OPENED, CLOSE = "<s>", "<|", "|>\n", "</s>\n"
#: Written for each sign, in the order of writing; reading goes backwards.
ESCAPES = (("~", "~0"), ("<", "~1"), ("[", "~2"), ("|", "~3"))


def escape(text: Column, role: bool = False) -> Column:
    for sign, code in ESCAPES[:4 if role else 3]:
        text = F.replace(text, F.lit(sign), F.lit(code))
    return text


def unescape(text: Column) -> Column:
    for sign, code in reversed(ESCAPES):
        text = F.replace(text, F.lit(code), F.lit(sign))
    return text


def examples(
    conversations: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text",
    target_role: str = "assistant",
) -> DataFrame:
    """``conv_id, example, text, loss_start, loss_length, last``: one row per assistant turn and per unanswered rest.

    ``example`` is the number of turns in it; the loss mask is ``loss_length`` code points from ``loss_start``
    (0-based), and empty in a rest. ``last`` marks the longest example of a conversation, which has all its turns.
    """
    turn = F.struct(
        F.col(turn_col).alias("turn"), F.coalesce(F.col(role_col), F.lit("")).alias("role"),
        F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    grouped = conversations.groupBy(F.col(conv_col).alias(conv_col)).agg(F.sort_array(F.collect_list(turn)).alias("turns_"))
    written = grouped.select(
        conv_col,
        F.transform("turns_", lambda t: F.struct(
            (t["role"] == target_role).alias("target"), F.length(escape(t["text"])).alias("size"),
            F.concat(F.lit(OPEN), escape(t["role"], True), F.lit(OPENED), escape(t["text"]), F.lit(CLOSE)).alias("piece"),
        )).alias("turns_"))
    places = F.filter(
        F.sequence(F.lit(1), F.size("turns_")),
        lambda i: F.element_at("turns_", i)["target"] | (i == F.size("turns_")))
    rows = written.select(conv_col, "turns_", F.explode(places).alias("example"))
    own = F.element_at("turns_", F.col("example"))
    built = rows.select(
        conv_col, "example", own["target"].alias("target_"), own["size"].alias("size_"),
        (F.col("example") == F.size("turns_")).alias("last"),
        F.concat(F.lit(BEGIN), F.array_join(F.slice("turns_", F.lit(1), F.col("example"))["piece"], "")).alias("text"))
    return built.select(
        conv_col, F.col("example").cast("long").alias("example"), "text",
        F.when(F.col("target_"), F.length("text") - len(CLOSE) - F.col("size_")).otherwise(F.length("text")).cast("long").alias("loss_start"),
        F.when(F.col("target_"), F.col("size_")).otherwise(0).cast("long").alias("loss_length"), "last")


def read_turns(text: Column) -> Column:
    """The turns of a formatted example: array of (role, text)."""
    body = F.substr(text, F.lit(len(BEGIN) + 1))
    pieces = F.filter(F.split(body, CLOSE), lambda p: p != "")

    def turn(piece):
        opened = F.position(F.lit(OPENED), piece)
        return F.struct(
            unescape(F.substr(piece, F.lit(len(OPEN) + 1), opened - len(OPEN) - 1)).alias("role"),
            unescape(F.substr(piece, opened + len(OPENED))).alias("text"))

    return F.transform(pieces, turn)


def digests(made: DataFrame, conv_col: str = "conv_id") -> DataFrame:
    """What a conversation's examples say, read back from their texts."""
    target = F.struct("example", unescape(F.substr("text", F.col("loss_start").cast("int") + 1, F.col("loss_length").cast("int"))).alias("said"))
    per = made.groupBy(conv_col).agg(
        F.max(F.when(F.col("last"), F.col("text"))).alias("text"),
        F.sort_array(F.collect_list(F.when(F.col("loss_length") > 0, target))).alias("targets_"),
        F.sum(F.length("text")).alias("formatted_chars"))
    turns = per.select(conv_col, "formatted_chars", read_turns(F.col("text")).alias("turns_"),
                       F.array_join(F.col("targets_")["said"], "").alias("loss_"))
    line = F.lit("\n")
    return turns.select(
        conv_col, F.size("turns_").cast("long").alias("n_turns"),
        F.sha2(F.array_join(F.transform("turns_", lambda t: F.concat(t["role"], line, t["text"], line)), ""), 256).alias("turns_sha256"),
        F.length("loss_").cast("long").alias("loss_chars"), F.sha2("loss_", 256).alias("loss_sha256"), "formatted_chars")

"""Chat formatting with a grammar round trip.

    chat   = turn*
    turn   = "### " role ": " text "</turn>\\n"

Neither control string may occur inside a role or text. A turn is first rendered as it is and
parsed again; unless the parser gives back exactly the one turn that went in, its text is rendered
with codes (``\\e`` for a backslash, ``\\t`` for the closing and ``\\h`` for the opening mark), which the parser
turns back. Escaped text holds no control string and no other backslash, so the second
attempt is always identical; the whole conversation is parsed once more and compared to its source.

All of it is DataFrame expressions. A conversation is one string by its nature, so its turns
meet in one row; turns are rendered and checked before that.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

OPEN, CLOSE, END = "### ", "</turn>", "</turn>\n"
#: In the order in which they are escaped; they are turned back in the other order.
CODES = (("\\", "\\e"), (CLOSE, "\\t"), (OPEN, "\\h"))
ROLE_CODES = (*CODES, (":", "\\c"))


def escape(text: Column, codes: tuple = CODES) -> Column:
    for plain, code in codes:
        text = F.replace(text, F.lit(plain), F.lit(code))
    return text


def unescape(text: Column, codes: tuple = CODES) -> Column:
    for plain, code in reversed(codes):
        text = F.replace(text, F.lit(code), F.lit(plain))
    return text


def render(role: Column, text: Column) -> Column:
    """One turn; ``text`` as it is to appear."""
    return F.concat(F.lit(OPEN), escape(role, ROLE_CODES), F.lit(": "), text, F.lit(END))


def blocks(formatted: Column) -> Column:
    """The turns' strings, without their closing marks."""
    parts = F.split(formatted, END, -1)
    return F.slice(parts, 1, F.size(parts) - 1)


def header(block: Column) -> Column:
    """Number of characters before a block's text."""
    return F.instr(block, ": ") + 1


def turn(block: Column) -> Column:
    """(role, text) of a block, NULL if it is not a turn of the grammar."""
    valid = (block.startswith(OPEN) & (F.instr(block, ": ") > 0) & ~F.substring(block, len(OPEN) + 1, 2**31 - 1).contains(OPEN)
             & ~block.contains(CLOSE))
    role = F.substring(block, F.lit(len(OPEN) + 1), header(block) - len(OPEN) - 2)
    text = F.substring(block, header(block) + 1, F.length(block))
    return F.when(valid, F.struct(unescape(role, ROLE_CODES).alias("role"), unescape(text).alias("text")))


def parse(formatted: Column) -> Column:
    """Array of (role, text)."""
    return F.transform(blocks(formatted), turn)


def format_chats(conversations: DataFrame, loss_role: str = "assistant") -> DataFrame:
    """One row per ``conv_id``: ``formatted``, ``turns`` and ``loss_text`` read back from it, ``loss_runs``, ``round_trip``.

    ``loss_runs`` is the loss mask over ``formatted``: for each turn, how many characters to ``skip`` from the turn's start and how
    many then to ``take``. ``loss_text`` is the unescaped text under it. Rows are ordered by turn; rows of the same turn by
    their rendered string; NULL turns come first. NULL roles and texts are empty; NULL ids form one conversation; a repeated row is a further
    turn; an empty table gives no rows. Other columns are ignored.
    """
    source = conversations.select(
        "conv_id", "turn", F.coalesce(F.col("role"), F.lit("")).alias("role"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    plain = source.withColumn("plain", render(F.col("role"), F.col("text")))
    tried = plain.withColumn("back", parse(F.col("plain")))
    same = ((F.size("back") == 1) & F.col("back")[0].isNotNull() & (F.col("back")[0]["role"] == F.col("role"))
            & (F.col("back")[0]["text"] == F.col("text")))
    rendered = tried.select(
        "conv_id", F.struct(
            "turn", F.when(F.coalesce(same, F.lit(False)), F.col("plain")).otherwise(render(F.col("role"), escape(F.col("text")))).alias("piece"),
            F.xxhash64("role", "text").alias("source")).alias("t"))
    whole = rendered.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("t"))
    joined = whole.select("conv_id", F.array_join("t.piece", "").alias("formatted"), F.col("t.source").alias("source"))
    cut = joined.withColumn("blocks", blocks(F.col("formatted"))).withColumn("turns", F.transform("blocks", turn))
    cut = cut.withColumn("loss_runs", F.transform(F.arrays_zip("blocks", "turns"), lambda x: F.struct(
        header(x["blocks"]).cast("long").alias("skip"),
        F.when(x["turns"]["role"] == loss_role, F.length(x["blocks"]) - header(x["blocks"])).otherwise(0).cast("long").alias("take"))))
    under = F.transform(F.arrays_zip("blocks", "loss_runs"), lambda x: unescape(
        F.substring(x["blocks"], (x["loss_runs"]["skip"] + 1).cast("int"), x["loss_runs"]["take"].cast("int"))))
    back = F.transform("turns", lambda t: F.xxhash64(t["role"], t["text"]))
    return cut.select("conv_id", "formatted", "turns", "loss_runs", F.array_join(under, "").alias("loss_text"),
                      (back == F.col("source")).alias("round_trip"))

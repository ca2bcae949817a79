"""Chat formatting in Spark expressions only.

    <|im_start|>role\\ntext<|im_end|>\\n          a message
    <|im_start|>role\\ntext<|im_sep|>text<|im_end|>\\n   two turns of one role, merged

In texts and roles a backslash is doubled and <| becomes <\\|, so no text can hold a
mark, and both steps can be taken back. A line end in a role becomes <|nl|>.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

START, SEP, END, NL = "<|im_start|>", "<|im_sep|>", "<|im_end|>", "<|nl|>"


def escape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("<|"), F.lit("<\\|"))


def unescape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("<\\|"), F.lit("<|")), F.lit("\\\\"), F.lit("\\"))


def format_chats(turns: DataFrame, learn: str = "assistant") -> DataFrame:
    """(conv_id, turn, role, text) rows -> (conv_id, formatted, pieces): a row for each conversation.

    Turns go by turn, then role, then text (nulls first), so ties and repeated rows
    have one order and all of them stay. Null texts and roles are empty; rows of a
    null conv_id are one conversation. pieces are formatted cut in order, with a
    flag: loss is true for the texts of the role to be learnt, and for nothing else.
    One aggregation collects a conversation, which is a row of the result anyway.
    """
    one = F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    chats = turns.groupBy("conv_id").agg(F.array_sort(F.collect_list(one)).alias("t"))
    starts = F.filter(F.sequence(F.lit(1), F.size("t")), lambda i: (i == 1) | (F.get("t", i - 1)["role"] != F.get("t", i - 2)["role"]))
    chats = chats.select("conv_id", "t", starts.alias("s"))
    ends = F.concat(F.slice("s", F.lit(2), F.size("s")), F.array(F.size("t") + 1))
    merged = F.zip_with("s", ends, lambda a, b: F.struct(F.get("t", a - 1)["role"].alias("role"), F.transform(F.slice("t", a, b - a), lambda x: x["text"]).alias("texts")))
    chats = chats.select("conv_id", merged.alias("m"))
    piece = lambda text, loss: F.struct(text.alias("text"), loss.alias("loss"))
    off = F.lit(False)

    def message(m: Column) -> Column:
        head = F.concat(F.lit(START), F.replace(escape(m["role"]), F.lit("\n"), F.lit(NL)), F.lit("\n"))
        body = F.transform(m["texts"], lambda x, i: F.array(piece(F.when(i == 0, F.lit("")).otherwise(F.lit(SEP)), off), piece(escape(x), m["role"] == learn)))
        return F.concat(F.array(piece(head, off)), F.flatten(body), F.array(piece(F.lit(END + "\n"), off)))

    chats = chats.select("conv_id", F.filter(F.flatten(F.transform("m", message)), lambda p: p["text"] != "").alias("pieces"))
    return chats.select("conv_id", F.array_join(F.transform("pieces", lambda p: p["text"]), "").alias("formatted"), "pieces")


def parse_chats(formatted: Column) -> Column:
    """What was formatted: array of (role, text), a struct for each turn."""
    marks = lambda s: s.replace("|", "\\|")
    messages = F.filter(F.split(formatted, marks(START)), lambda m: m != "")

    def turns(m: Column) -> Column:
        role = F.substring_index(m, "\n", 1)
        body = F.substring(m, F.length(role) + 2, F.length(m) - F.length(role) - 1 - len(END) - 1)
        return F.transform(F.split(body, marks(SEP)), lambda x: F.struct(unescape(F.replace(role, F.lit(NL), F.lit("\n"))).alias("role"), unescape(x).alias("text")))

    return F.flatten(F.transform(messages, turns))

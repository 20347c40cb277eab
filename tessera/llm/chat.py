"""Chat formatting with Spark expressions only.

The turns of a conversation are collected as structs, sorted, and merged by
aggregating the array: adjacent turns of one role form a message. A message is

    <|im_start|>ROLE\\nTEXT<|im_sep|>TEXT...<|im_end|>\\n

with one TEXT for each turn. Inside texts and roles the escape sign U+241B
becomes U+241B 0, every control string (those of this template and of other
common ones) is broken up by U+241B 1 behind its first character, and line ends
in roles become U+241B 2, so no control string is left and the text can be told
exactly.

Turns are ordered by turn (nulls first), then role and text, so repeated turns
have a defined place. A null text or role counts as empty; rows with a null
conv_id form a conversation of their own. Other columns are not read. A
conversation is one row in the end, so its turns must fit in one row. Work grows
with the turns of a conversation, not with their square: sums are taken in blocks
of BLOCK turns, then over the blocks, and a text is cut out of the CUT characters
around it. (A column that a lambda reads is used twice in its step, as Spark
would otherwise put its expression into the lambda and compute it for each element.)
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ESC = "␛"
#: Turns of a block, characters of a cut.
BLOCK, CUT = 128, 4096


@dataclass(frozen=True)
class Template:
    start: str = "<|im_start|>"
    role_end: str = "\n"
    sep: str = "<|im_sep|>"
    end: str = "<|im_end|>"
    after: str = "\n"
    #: Strings of other templates that must not stay whole in a text either.
    also: tuple[str, ...] = ("<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<|endoftext|>")
    #: Roles whose texts are under the loss mask.
    trained: tuple[str, ...] = ("assistant",)


def _escape(c: Column, controls: list[str]) -> Column:
    c = F.replace(c, F.lit(ESC), F.lit(ESC + "0"))
    for s in controls:
        c = F.replace(c, F.lit(s), F.lit(f"{s[0]}{ESC}1{s[1:]}"))
    return c


def _unescape(c: Column) -> Column:
    return F.replace(F.replace(c, F.lit(ESC + "1"), F.lit("")), F.lit(ESC + "0"), F.lit(ESC))


def _between(s: str) -> str:
    return f"\\Q{s}\\E"


def format_chats(turns: DataFrame, template: Template = Template(), id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:  # noqa: B008
    """turns -> conv_id, n_messages, formatted, loss_spans: array of (start, length), in code points from 0, of each trained turn's text."""
    t = template
    own = [t.start, t.sep, t.end, *t.also]
    rows = turns.select(
        F.col(id_col).alias("conv_id"),
        F.struct(F.col(turn_col).cast("long").alias("turn"), F.coalesce(F.col(role_col).cast("string"), F.lit("")).alias("role"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text")).alias("row"),
    )
    chats = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list("row")).alias("rows"))

    # a message begins at each turn whose role isn't that of the turn before
    earlier = F.concat(F.array(F.lit(None).cast("string")), F.transform(F.slice("rows", F.lit(1), F.size("rows") - 1), lambda x: x["role"]))
    opens = F.zip_with("rows", earlier, lambda x, role: ~x["role"].eqNullSafe(role))
    chats = chats.select("conv_id", "rows", opens.alias("opens")).select("conv_id", "rows", F.filter(F.sequence(F.lit(0), F.size("opens") - 1), lambda i: F.get("opens", i)).alias("first"))
    behind = F.concat(F.slice("first", F.lit(2), F.size("first")), F.array(F.size("rows")))
    chats = chats.select("conv_id", F.zip_with("first", behind, lambda a, b: F.struct(F.get("rows", a)["role"].alias("role"), F.transform(F.slice("rows", a + 1, b - a), lambda x: x["text"]).alias("texts"))).alias("messages"))
    # each text with what stands before and behind it
    head = lambda m: F.concat(F.lit(t.start), F.replace(_escape(m["role"], own), F.lit(t.role_end), F.lit(ESC + "2")), F.lit(t.role_end))
    parts = F.flatten(F.transform("messages", lambda m: F.transform(m["texts"], lambda x, i: F.struct(
        F.when(i == 0, head(m)).otherwise(F.lit(t.sep)).alias("before"), _escape(x, own).alias("text"),
        F.when(i == F.size(m["texts"]) - 1, F.lit(t.end + t.after)).otherwise(F.lit("")).alias("after"), m["role"].isin(*t.trained).alias("loss"),
    ))))
    chats = chats.select("conv_id", F.size("messages").cast("long").alias("n_messages"), parts.alias("parts"))
    n_chars = lambda c: F.char_length(c).cast("long")
    sizes = F.transform("parts", lambda p: F.struct(n_chars(p["before"]).alias("before"), n_chars(p["text"]).alias("text"), n_chars(p["after"]).alias("after"), p["loss"].alias("loss")))
    chats = chats.select("conv_id", "n_messages", F.array_join(F.transform("parts", lambda p: F.concat(p["before"], p["text"], p["after"])), "").alias("formatted"), sizes.alias("sizes"))

    blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size("sizes") - 1) / BLOCK).cast("int")), lambda b: F.slice("sizes", b * BLOCK + 1, F.lit(BLOCK)))
    none = F.struct(F.lit(0).cast("long").alias("at"), F.expr("cast(array() as array<struct<start:bigint,length:bigint>>)").alias("spans"))

    def walk(acc: Column, p: Column) -> Column:
        span = F.struct((acc["at"] + p["before"]).alias("start"), p["text"].alias("length"))
        return F.struct((acc["at"] + p["before"] + p["text"] + p["after"]).alias("at"), F.when(p["loss"], F.concat(acc["spans"], F.array(span))).otherwise(acc["spans"]).alias("spans"))

    chats = chats.select("conv_id", "n_messages", "formatted", F.transform(blocks, lambda b: F.aggregate(b, none, walk)).alias("blocks"))
    zero = F.struct(F.lit(0).cast("long").alias("at"), F.expr("cast(array() as array<bigint>)").alias("starts"))
    starts = F.aggregate("blocks", zero, lambda acc, b: F.struct((acc["at"] + b["at"]).alias("at"), F.concat(acc["starts"], F.array(acc["at"])).alias("starts")))["starts"]
    spans = F.flatten(F.zip_with("blocks", starts, lambda b, at: F.transform(b["spans"], lambda x: F.struct((x["start"] + at).alias("start"), x["length"].alias("length")))))
    return chats.select("conv_id", "n_messages", "formatted", spans.alias("loss_spans"))


def read_chats(formatted: DataFrame, template: Template = Template()) -> DataFrame:  # noqa: B008
    """formatted (conv_id, n_messages, formatted, loss_spans) -> the same with turns: array of (role, text), and loss_texts, all unescaped."""
    t = template
    messages = F.filter(F.split("formatted", _between(t.end + t.after), -1), lambda m: m != "")

    def parsed(m: Column) -> Column:
        body = F.substring(m, F.lit(len(t.start) + 1), F.char_length(m))
        role = F.split_part(body, F.lit(t.role_end), F.lit(1))
        texts = F.split(F.substring(body, F.char_length(role) + len(t.role_end) + 1, F.char_length(body)), _between(t.sep), -1)
        return F.struct(_unescape(F.replace(role, F.lit(ESC + "2"), F.lit(t.role_end))).alias("role"), texts.alias("texts"))

    turns = F.flatten(F.transform(F.transform(messages, parsed), lambda m: F.transform(m["texts"], lambda x: F.struct(m["role"].alias("role"), _unescape(x).alias("text")))))
    cuts = F.transform(F.sequence(F.lit(0), F.floor(F.char_length("formatted") / CUT).cast("int")), lambda b: F.substring(F.col("formatted"), b * CUT + 1, F.lit(CUT)))
    cuts_col = "_cuts"
    while cuts_col in formatted.columns:
        cuts_col += "_"

    def cut_out(s: Column) -> Column:
        first, last = F.floor(s["start"] / CUT).cast("int"), F.floor((s["start"] + s["length"]) / CUT).cast("int")
        near = F.slice(cuts_col, first + 1, F.least(last + 1, F.size(cuts_col)) - first)
        return _unescape(F.substring(F.array_join(near, ""), (s["start"] % CUT + 1).cast("int"), s["length"].cast("int")))

    return formatted.withColumns({"turns": turns, cuts_col: cuts}).withColumn("loss_texts", F.transform("loss_spans", cut_out)).drop(cuts_col)

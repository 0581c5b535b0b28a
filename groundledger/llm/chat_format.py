"""Chat formatting by grammar round trip, in DataFrame functions only.

    chat := turn*      turn := START role NL text END NL

A conversation is rendered, read again by a deterministic parser of this grammar,
and compared with its turns. Where they differ, a text holds what the grammar
reads otherwise: such texts are escaped and the round trip is done again, first
for each turn alone, then for the conversation as a whole. A conversation that
still differs ends the job. Texts that come back unharmed are rendered as they are.

A control string in a text gets one backslash more after its first character, and
the parser takes one away: <|im_end|> becomes <\\|im_end|>, which becomes
<\\\\|im_end|>. Roles end at a line's end, so in them ~, line ends and | become ~0,
~1 and ~2.

Defined cases: a null text or role is empty; turns are ordered by turn (null
first), then role and text, so repeated rows are repeated turns; rows without
conv_id are one conversation; no rows give no conversations; texts are rendered
whole, and a conversation is one row of the result, so it must fit one; other
columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .storage import settle

START, END = "<|im_start|>", "<|im_end|>"
_CONTROL = r"<(\\*)\|(im_start|im_end)\|>"
_ESCAPED = r"<\\(\\*)\|(im_start|im_end)\|>"
#: Characters of a turn besides its role and text.
FRAME = len(START) + len(END) + 2


def escape(text: Column) -> Column:
    return F.regexp_replace(text, _CONTROL, r"<$1\\|$2|>")


def unescape(text: Column) -> Column:
    return F.when(text.contains("<\\"), F.regexp_replace(text, _ESCAPED, "<$1|$2|>")).otherwise(text)


def _escape_role(role: Column) -> Column:
    return F.replace(F.replace(F.replace(role, F.lit("~"), F.lit("~0")), F.lit("\n"), F.lit("~1")), F.lit("|"), F.lit("~2"))


def _unescape_role(role: Column) -> Column:
    return F.replace(F.replace(F.replace(role, F.lit("~2"), F.lit("|")), F.lit("~1"), F.lit("\n")), F.lit("~0"), F.lit("~"))


def render(role: Column, text: Column) -> Column:
    """One turn; the text as it is."""
    return F.concat(F.lit(START), _escape_role(role), F.lit("\n"), text, F.lit(END + "\n"))


def parse(chat: Column) -> Column:
    """Turns (role, text) of a rendered conversation; null where it is not of the grammar."""

    def turn(piece: Column) -> Column:
        role = F.substring_index(piece, "\n", 1)
        start = F.length(role) + 2
        body = F.substr(piece, start, F.length(piece) - start - len(END))
        sound = piece.endswith(END + "\n") & (F.length(piece) >= start + len(END)) & ~body.contains(END)
        return F.when(sound, F.struct(_unescape_role(role).alias("role"), unescape(body).alias("text")))

    pieces = F.split(chat, r"<\|im_start\|>", -1)
    turns = F.transform(F.slice(pieces, F.lit(2), F.size(pieces)), turn)
    return F.when((F.get(pieces, F.lit(0)) == "") & ~F.exists(turns, lambda t: t.isNull()), turns)


def _same(found: Column, turns: Column) -> Column:
    return F.coalesce(found == turns, F.lit(False))


def format_chats(conversations: DataFrame, trained: str = "assistant") -> DataFrame:
    """(conv_id, chat, loss, n_escaped) of conversations(conv_id, turn, role, text).

    chat is the rendered conversation; loss are the spans (start, end) of it, in code
    points with exclusive ends, that hold the texts of the trained role; n_escaped
    counts the turns whose text was escaped.
    """
    turns = conversations.select(
        "conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")
    )
    # Each turn by itself: only what does not come back is escaped.
    alone = F.array(F.struct("role", "text"))
    safe = _same(parse(render(F.col("role"), F.col("text"))), alone)
    turns = turns.withColumn("safe", F.when(F.col("text").contains("<"), safe).otherwise(True))
    turns = turns.withColumn("shown", F.when(F.col("safe"), F.col("text")).otherwise(escape(F.col("text"))))
    size = F.length("shown") + F.length(_escape_role(F.col("role"))) + FRAME
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    upto = F.sum(size).over(order.rowsBetween(Window.unboundedPreceding, 0)).cast("long")
    turns = turns.withColumn("end", upto - len(END) - 1).withColumn("nth", F.row_number().over(order))
    line = F.struct("nth", "role", F.when(~F.col("safe"), F.col("text")).alias("source"), "shown", "end")
    chats = turns.groupBy("conv_id").agg(F.sort_array(F.collect_list(line)).alias("lines"))
    chats = chats.select(
        "conv_id",
        F.array_join(F.transform("lines", lambda t: render(t["role"], t["shown"])), "").alias("chat"),
        F.transform("lines", lambda t: F.struct(t["role"], F.coalesce(t["source"], t["shown"]).alias("text"))).alias("turns"),
        F.transform(
            F.filter("lines", lambda t: t["role"] == trained), lambda t: F.struct((t["end"] - F.length(t["shown"])).alias("start"), t["end"])
        ).alias("loss"),
        F.size(F.filter("lines", lambda t: t["source"].isNotNull())).alias("n_escaped"),
    )
    # The conversation as a whole comes back as well, or the job ends.
    differs = F.raise_error(F.concat(F.lit("conversation differs after its round trip: "), F.coalesce(F.col("conv_id").cast("string"), F.lit("null"))))
    chat = F.when(_same(parse(F.col("chat")), F.col("turns")), F.col("chat")).otherwise(differs.cast("string"))
    return chats.select("conv_id", chat.alias("chat"), "loss", "n_escaped")


def read_back(chats: DataFrame) -> DataFrame:
    """Digests of format_chats()'s rows, read from the rendered text and its spans alone."""
    found = settle(chats).select(
        "conv_id",
        parse(F.col("chat")).alias("turns"),
        F.array_join(F.transform("loss", lambda s: unescape(F.substr("chat", (s["start"] + 1).cast("int"), (s["end"] - s["start"]).cast("int")))), "").alias("learned"),
        F.length("chat").cast("long").alias("formatted_chars"),
        "n_escaped",
    )
    told = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return found.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(told, 256).alias("turns_sha256"),
        F.length("learned").cast("long").alias("loss_chars"),
        F.sha2("learned", 256).alias("loss_sha256"),
        "formatted_chars",
        F.col("n_escaped").cast("long").alias("n_escaped"),
    )

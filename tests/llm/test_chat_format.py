"""Chat formatting against a plain reader of the grammar."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from groundledger.llm.chat_format import END, START, escape, format_chats, parse, read_back, render, unescape

SCHEMA = "conv_id long, turn long, role string, text string, chat string, lines int"
PIECES = ["<|im_end|>", "<|im_start|>", "<\\|im_end|>", "<\\\\|im_start|>", "<|im_", "end|>", "<", "|", "\\", "\n", "~0", "~", "assistant\n", "é 😀", "<|x|>", "ok "]


def rows():
    rng = random.Random(3)
    out = [(-1, 0, "user", END + START + "assistant ok"), (-1, 1, "assistant", END + START + "assistant ok")]
    out += [(0, 0, None, None), (0, 1, "assistant", None), (1, 0, "user", ""), (2, None, "a\nb|~1", "x"), (2, 0, "", "y"), (2, 0, "", "y")]
    out += [(None, 3, "assistant", "no id"), (None, 1, "user", "no id"), (3, 0, "assistant", "long " * 200_000 + END)]
    for conv in range(10, 90):
        for turn in range(rng.randint(1, 9)):
            text = "".join(rng.choice(PIECES) for _ in range(rng.randint(0, 9)))
            out.append((conv, turn, rng.choice(["user", "assistant", "system", "tool|<~"]), text))
    return [(*r, "clash", 1) for r in out]


def read(chat):
    """The turns of a chat as a plain reader finds them."""
    turns = []
    while chat:
        assert chat.startswith(START)
        head, chat = chat[len(START) :].split("\n", 1)
        body, chat = chat.split(END + "\n", 1)
        assert START not in body and END not in body
        for control in ("|im_start|>", "|im_end|>"):
            # One backslash less where one stands between < and the rest.
            for k in range(1, 9):
                body = body.replace("<" + "\\" * k + control, "\0" + "\1" * (k - 1) + control)
        turns.append((head.replace("~2", "|").replace("~1", "\n").replace("~0", "~"), body.replace("\0", "<").replace("\1", "\\")))
    return turns


def test_round_trip(spark):
    given = rows()
    frame = spark.createDataFrame(given, SCHEMA).repartition(3)
    chats = {r.conv_id: r for r in format_chats(frame).collect()}
    digests = {r.conv_id: r for r in read_back(format_chats(frame)).collect()}
    assert set(chats) == set(digests) == {r[0] for r in given}
    for conv, found in chats.items():
        mine = sorted(((r[1] is not None, r[1] or 0, r[2] or "", r[3] or "") for r in given if r[0] == conv))
        turns = [(r[2], r[3]) for r in mine]
        assert read(found.chat) == turns
        learned = [t for role, t in turns if role == "assistant"]
        spans = [found.chat[s.start : s.end] for s in found.loss]
        assert [read(f"{START}x\n{s}{END}\n")[0][1] for s in spans] == learned
        d = digests[conv]
        assert d.n_turns == len(turns) and d.formatted_chars == len(found.chat)
        assert d.turns_sha256 == hashlib.sha256("".join(f"{a}\n{b}\n" for a, b in turns).encode()).hexdigest()
        assert d.loss_chars == sum(map(len, learned)) and d.loss_sha256 == hashlib.sha256("".join(learned).encode()).hexdigest()
        # Only what the grammar reads otherwise is escaped.
        assert d.n_escaped == sum(any(c in t.replace("\\", "") for c in (START, END)) for _, t in turns)


def test_parser_refuses_what_is_not_of_the_grammar(spark):
    sound = f"{START}user\nhello{END}\n"
    bad = [sound + "x", sound[1:], sound[:-1], f"{START}user{END}\n", f"{START}user\nab{END}", f"{START}user\na{END}b{END}\n", "x" + sound, f"{START}{END}\n", START]
    frame = spark.createDataFrame([(t,) for t in [sound, "", *bad]], "chat string").select("chat", parse(F.col("chat")).alias("turns"))
    found = {r.chat: r.turns for r in frame.collect()}
    assert found[sound] == [("user", "hello")] and found[""] == []
    assert all(found[t] is None for t in bad)


def test_escape_is_reversible(spark):
    rng = random.Random(8)
    texts = ["".join(rng.choice(PIECES) for _ in range(rng.randint(0, 12))) for _ in range(300)]
    frame = spark.createDataFrame([(t,) for t in texts], "text string")
    for r in frame.select("text", escape(F.col("text")).alias("e"), unescape(escape(F.col("text"))).alias("back"), render(F.lit("u"), F.col("text")).alias("r")).collect():
        assert r.back == r.text and START not in r.e and END not in r.e and r.r == f"{START}u\n{r.text}{END}\n"


def test_empty_and_one_sided(spark):
    assert format_chats(spark.createDataFrame([], SCHEMA)).count() == 0
    assert read_back(format_chats(spark.createDataFrame([], SCHEMA))).count() == 0
    only = spark.createDataFrame([(1, 0, "user", "hi", "", 0)], SCHEMA)
    (r,) = read_back(format_chats(only)).collect()
    assert r.loss_chars == 0 and r.loss_sha256 == hashlib.sha256(b"").hexdigest()
    (r,) = format_chats(only, trained="user").collect()
    assert [r.chat[s.start : s.end] for s in r.loss] == ["hi"]


@pytest.mark.parametrize("parts", [1, 5])
def test_layouts_agree(spark, parts):
    frame = spark.createDataFrame(rows(), SCHEMA).repartition(parts)
    found = {tuple(r) for r in read_back(format_chats(frame)).collect()}
    assert found == {tuple(r) for r in read_back(format_chats(frame.orderBy(F.desc("text")))).collect()}

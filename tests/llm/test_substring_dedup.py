"""Repeated passages: exact ends, layouts, and a plain search for what all pairs of texts share."""

import random

import pytest
from pyspark.sql import functions as F

from groundledger.llm.substring_dedup import LEAST_WORDS, repeated_passages, without_passages

SCHEMA = "doc_id long, text string"


def prose(rng, n):
    return " ".join("".join(rng.choice(["an", "er", "lo", "été", "ßu", "ka", "s", "t"]) for _ in range(rng.randint(1, 5))) for _ in range(n))


def begun(raw, start, end):
    """Words that begin in the range."""
    space = b" \t\n\v\f\r"
    return sum(raw[k] not in space and (k == 0 or raw[k - 1] in space) for k in range(start, end))


def check(found, texts):
    for r in found:
        raw, other = texts[r.doc_id].encode(), texts[r.first_doc_id].encode()
        piece = raw[r.start_byte : r.end_byte]
        piece.decode()
        assert piece in other and r.first_doc_id <= r.doc_id and r.n_words == begun(raw, r.start_byte, r.end_byte) >= LEAST_WORDS


def maximal(found, texts):
    """No passage goes on in every place of its first document."""
    for r in found:
        text, other = texts[r.doc_id], texts[r.first_doc_id]
        raw = text.encode()
        start, end = len(raw[: r.start_byte].decode()), len(raw[: r.end_byte].decode())
        places = [k for k in range(len(other)) if other.startswith(text[start:end], k) and (r.doc_id != r.first_doc_id or k < start)]
        assert any(
            (k == 0 or start == 0 or other[k - 1] != text[start - 1]) and (k + end - start == len(other) or end == len(text) or other[k + end - start] != text[end])
            for k in places
        )


@pytest.mark.parametrize("n", [13, 20, 60])
def test_identical_documents_are_found_whole(spark, n):
    rng = random.Random(n)
    texts = {}
    for k in range(150):
        texts[k] = texts[1000 + k] = prose(rng, n)
    found = repeated_passages(spark.createDataFrame(list(texts.items()), SCHEMA).repartition(3)).collect()
    whole = {(r.doc_id, r.first_doc_id) for r in found if r.start_byte == 0 and r.end_byte == len(texts[r.doc_id].encode()) and r.n_words == n}
    assert len(whole & {(1000 + k, k) for k in range(150)}) >= 149 if n == 13 else whole == {(1000 + k, k) for k in range(150)}


def test_planted_passages_have_their_exact_ends(spark):
    rng = random.Random(11)
    texts, spans = {}, {}
    for k in range(200):
        passage = prose(rng, rng.choice([25, 51, 58]))
        texts[k] = prose(rng, 40) + " " + passage + ". " + prose(rng, 40)
        lead = prose(rng, 33)
        texts[1000 + k] = lead + "\n" + passage + "!" + prose(rng, 30)
        start = len((lead + "\n").encode())
        spans[1000 + k] = (start, start + len(passage.encode()), len(passage.split()))
    found = repeated_passages(spark.createDataFrame(list(texts.items()), SCHEMA).repartition(3)).collect()
    check(found, texts)
    maximal(found, texts)
    # A passage without two cuts is not seen; that happens below 50 words.
    got = {r.doc_id: (r.start_byte, r.end_byte, r.n_words) for r in found}
    assert got.items() <= spans.items() and {k for k, (_, _, n) in spans.items() if n > 50} <= set(got) and len(got) >= 195


def copied(rng, many):
    """Texts with passages of each other, within themselves, copies, long ones, and all kinds of none."""
    texts = {0: "", 1: "  \n", 2: "one", 3: prose(rng, 3000)}
    for k in range(4, many):
        words = prose(rng, rng.randint(5, 90)).split()
        if rng.random() < 0.6:
            source = texts[rng.randrange(3, k)].split()
            a = rng.randrange(max(1, len(source)))
            words[len(words) // 2 : len(words) // 2] = source[a : a + rng.randint(8, 80)]
        texts[k] = (rng.choice([" ", "\n", "  "])).join(words)
    texts[many] = texts[3] + " x " + texts[3]
    texts[many + 1] = "é" * 3000 + " " + "é" * 3000
    return texts


def test_layouts_and_plain_search(spark):
    rng = random.Random(3)
    texts = copied(rng, 120)
    rows = [(k, t, "clash", 5) for k, t in texts.items()] + [(None, texts[3], "clash", 5), (900, None, "", 0), (10, texts[10], "again", 1)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, digest string, start int")
    found = repeated_passages(frame.repartition(4)).collect()
    check(found, texts)
    for parts, order in ((1, F.asc("doc_id")), (1, F.desc("doc_id")), (6, F.col("text"))):
        other = repeated_passages(frame.repartition(parts).sortWithinPartitions(order)).collect()
        assert sorted(map(tuple, other)) == sorted(map(tuple, found))
    # What a document shares with an earlier one, sixty words or more of it, is covered by its passages.
    for k in range(4, 120):
        text = texts[k]
        words = text.split()
        for a in range(len(words) - 59):
            piece = " ".join(words[a : a + 60])
            if piece in text and any(piece in texts[j] for j in range(3, k)):
                raw = text.encode()
                start = len(text[: text.index(piece)].encode())
                assert any(r.doc_id == k and r.start_byte <= start and r.end_byte >= start + len(piece.encode()) for r in found) or raw.count(piece.encode()) > 1
    clean = {r.doc_id: r.text for r in without_passages(frame.where("digest = 'clash'"), repeated_passages(frame)).where("doc_id is not null").collect()}
    assert clean[120] != texts[120] and clean[3] == texts[3]


def test_no_rows(spark):
    assert repeated_passages(spark.createDataFrame([], SCHEMA)).collect() == []

"""Spelling variants against comparisons of all words."""

import random
import re
from collections import Counter
from zlib import crc32

import pytest

from groundledger.llm.spelling_variants import near_words, spelling_variants, word_counts

SCHEMA = "doc_id long, text string, word string, n long"


def documents():
    rng = random.Random(7)
    base = ["".join(rng.choice(["an", "er", "lo", "été", "ÿu", "ka", "sti", "ÀØ"]) for _ in range(rng.randint(2, 6))) for _ in range(60)]
    rows = [(0, None), (1, ""), (2, " 12 \n"), (None, "etiology " * 6), (3, "Étiology etiologie " * 7), (4, "abcdef " * 40 + "abcdeg " * 8 + "abcdegg ABCDEF " * 5)]
    rows += [(5, "x" * 70_000 + " " + "word×word÷ing " * 9), (6, ("q" * 90 + " ") * 30 + ("q" * 89 + " ") * 6 + ("q" * 45 + "z" + "q" * 44 + " ") * 5)]
    rare = []
    for w in base * 4:
        p = rng.randrange(len(w))
        rare.append(rng.choice([w[:p] + w[p + 1 :], w[:p] + "e" + w[p:], w[:p] + "o" + w[p + 1 :]]))
    for k in range(400):
        words = [rng.choice(rare if rng.random() < 0.2 else base) for _ in range(rng.randint(1, 60))]
        rows.append((10 + k, rng.choice([" ", "-", "\n", "9", "ÖÖ ", "…"]).join(words)))
    rows += [rows[20], rows[20], rows[21]]
    return [(a, b, "clash", 1) for a, b in rows]


def lowered(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text)


def counts_of(rows):
    n = Counter()
    for doc_id, text, *_ in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            w = lowered(run)
            h = crc32(f"{doc_id}:{w}".encode())
            n[w[: h % len(w)] + w[h % len(w) + 1 :] if doc_id is not None and h % 199 == 0 else w] += 1
    return {w: k for w, k in n.items() if k >= 5 and len(w) >= 6}


def near(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:k] + b[k + 1 :] == a for k in range(len(b)))


def variants_of(n):
    out = {}
    for w in n:
        beside = [x for x in n if near(w, x)]
        best = min(beside, key=lambda x: (-n[x], x), default=None)
        form = best if best and n[best] >= 5 * n[w] else None
        out[w] = (form, n[w], len(beside), form and n[form])
    return out


@pytest.fixture(scope="module")
def rows():
    return documents()


@pytest.fixture(scope="module")
def want(rows):
    return variants_of(counts_of(rows))


def test_counts(spark, rows):
    frame = spark.createDataFrame(rows, SCHEMA).repartition(3)
    found = {r.word: r.n for r in word_counts(frame).collect()}
    assert found == counts_of(rows) and any(len(w) > 1000 for w in ["x" * 70_000]) and "q" * 90 in found


@pytest.mark.parametrize(("shard_words", "parts"), [(8192, 3), (40, 1), (5, 4)])
def test_same_as_all_comparisons(spark, rows, want, shard_words, parts):
    found = {r.word: r for r in spelling_variants(spark.createDataFrame(rows, SCHEMA).repartition(parts), shard_words).collect()}
    assert {w: (r.form, r.n, r.n_near, r.form_n) for w, r in found.items()} == want
    assert sum(f is not None for f, *_ in want.values()) > 20 and max(k for _, _, k, _ in want.values()) > 3
    for w, r in found.items():
        root = w
        while want[root][0]:
            root = want[root][0]
        assert r.root == root


def test_ways_of_several_forms(spark):
    chain = ["variants", "variantss", "variantsss", "variantssss", "variantsssss"]
    text = " ".join(w for k, w in enumerate(chain) for _ in range(5 ** (5 - k)))
    found = {r.word: r for r in spelling_variants(spark.createDataFrame([(None, text, "", 0)], SCHEMA)).collect()}
    assert [found[w].form for w in chain] == [None, *chain[:-1]] and {found[w].root for w in chain} == {"variants"}


def test_one_vector_for_many_words(spark):
    # All of one length and one letter group but for their order, so that no level of the trie tells them apart.
    rng = random.Random(2)
    words = sorted({"".join(rng.choice("kqxyzj") for _ in range(7)) for _ in range(900)} | {"k" * 6, "k" * 7, "k" * 8})
    frame = spark.createDataFrame([(w, 5 + k % 7) for k, w in enumerate(words)], "word string, n long").repartition(3)
    found = {r.word: r.n_near for r in near_words(frame, 100).collect()}
    assert found == {w: k for w in words if (k := sum(near(w, x) for x in words))}


def test_no_words(spark):
    for rows in ([], [(1, None, "", 0)], [(1, "few short words", "", 0)]):
        assert spelling_variants(spark.createDataFrame(rows, SCHEMA)).collect() == []

"""Recall of SimHash proposals near the wanted similarity, the guarantee of the blocks, very long texts and clashing columns."""

import random

import numpy as np
import pyarrow as pa
import pytest

from groundledger.llm import decontamination as d
from groundledger.llm.decontamination import contaminated, without_contaminated


def vocabulary(rng, n):
    return ["".join(rng.choice("abcdefghijklmnop") for _ in range(6)) for _ in range(n)]


def weighted(a, b):
    grams = lambda w: [tuple(w[k : k + 5]) for k in range(len(w) - 4)]
    x, y = grams(a), grams(b)
    both = sum(min(x.count(g), y.count(g)) for g in set(x))
    return both / (len(x) + len(y) - both)


def damaged(rng, item, fresh, way, low, high):
    """The item with other words, at its end or here and there, until its similarity lies in the range."""
    for _ in range(200):
        text = list(item)
        if way == "end":
            n = rng.randint(1, len(item) // 4)
            text[-n:] = [rng.choice(fresh) for _ in range(n)]
        else:
            for _ in range(rng.randint(1, max(1, len(item) // 25))):
                text[rng.randrange(len(item))] = rng.choice(fresh)
        if low <= weighted(item, text) < high:
            return text
    return None


@pytest.mark.parametrize("size", [20, 50, 100, 200])
def test_recall(size):
    rng = random.Random(size)
    fresh = vocabulary(rng, 3000)
    items = [[rng.choice(fresh) for _ in range(size)] for _ in range(150)]
    bench = d.Benchmark(list(range(150)), [" ".join(w) for w in items], 75)
    cases = []
    for k, item in enumerate(items):
        for way in ("end", "spread"):
            for low, high in ((0.75, 0.80), (0.80, 0.85), (0.85, 1.01)):
                text = damaged(rng, item, fresh, way, low, high)
                if text:
                    around = [[rng.choice(fresh) for _ in range(30)] for _ in range(2)]
                    cases.append((k, low, " ".join([*around[0], *text, *around[1]])))
    part = pa.record_batch([pa.array([c[2] for c in cases])], ["text"])
    found = {exact: {(row, int(bench.ids[x])) for row, x, *_ in d._matches(part, bench, 75, exact)} for exact in (False, True)}
    want = {(row, k) for row, (k, _, _) in enumerate(cases)}
    assert want <= found[True] and found[False] <= found[True]
    for low in (0.75, 0.80, 0.85):
        own = {(row, k) for row, (k, at, _) in enumerate(cases) if at == low}
        assert len(own & found[False]) >= (0.97 if low == 0.75 else 0.99) * len(own)


def test_blocks_give_all_within_the_radius():
    rng = np.random.default_rng(3)
    prints = rng.integers(0, 256, (300, d.BITS // 8), np.uint8)
    for within in (0, 5, 24, 40):
        blocks = d._Blocks(np.arange(300) + 7, prints, within)
        asked = prints[:60].copy()
        flips = rng.random((60, d.BITS)) < rng.random((60, 1)) * 0.6
        asked ^= np.packbits(flips, axis=1)
        window, item = blocks.near(asked)
        apart = np.bitwise_count(asked[:, None] ^ prints[None]).sum(2)
        assert set(zip(window.tolist(), item.tolist(), strict=True)) == {(int(i), int(j) + 7) for i, j in np.argwhere(apart <= within)}


def test_radius_grows_with_what_may_differ():
    assert d.radius(20, 100) == 0 < d.radius(20, 90) < d.radius(20, 75) <= d.radius(200, 75) < d.BITS // 3


@pytest.mark.parametrize("exact", [False, True])
def test_long_texts_and_clashing_columns(spark, exact):
    rng = random.Random(5)
    fresh = vocabulary(rng, 2000)
    item = [rng.choice(fresh) for _ in range(40)]
    long = [rng.choice(fresh) for _ in range(120_000)]
    long[90_000:90_040] = item
    rows = [(1, " ".join(long), 9, 0.5), (2, " ".join(long[:50_000]), 9, 0.5), (3, "word " * 100_000, 9, 0.5), (None, " ".join(item), 9, 0.5), (4, None, 9, 0.5), (4, "", 9, 0.5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, item_id int, similarity double")
    bench = spark.createDataFrame([(7, " ".join(item)), (8, "word " * 30), (None, "x"), (9, "")], "item_id long, text string")
    found = sorted((r.doc_id or 0, r.item_id, r.first_word, r.n_words, r.similarity) for r in contaminated(docs, bench, exact=exact).collect())
    assert found == [(0, 7, 0, 40, 1.0), (1, 7, 90_000, 40, 1.0), (3, 8, 0, 30, 1.0)]
    assert sorted(r.doc_id for r in without_contaminated(docs, bench, exact=exact).collect()) == [2, 4, 4]

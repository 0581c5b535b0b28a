"""The Merkle manifest against a tree built in one place."""

import random
from hashlib import sha256

import pytest
from pyspark.sql import functions as F

from groundledger.llm.merkle import OpenSubtrees, encoded, folded, hexed, merkle_manifest, proof_digest


def h(text):
    return sha256(text.encode()).hexdigest()


def tree(leaves):
    """Levels of the tree, from the leaves to the root."""
    levels = [leaves]
    while len(levels[-1]) > 1:
        below = levels[-1]
        levels.append([h("".join(below[k : k + 2])) for k in range(0, len(below), 2)])
    return levels


def siblings(levels, k):
    out = []
    for level in levels[:-1]:
        out.append((level[k ^ 1] if k ^ 1 < len(level) else None, k % 2 == 1))
        k //= 2
    return out


@pytest.mark.parametrize("many", [*range(1, 18), 64, 65, 100])
def test_open_subtrees_extend_their_witnesses(many):
    leaves = [sha256(bytes([k])).digest() for k in range(many)]
    levels = tree([x.hex() for x in leaves])
    trees = OpenSubtrees()
    grown = [trees.append(x) for x in leaves]
    # What waits for siblings are the sizes of the number's binary digits.
    assert [1 << height for height, _, _ in trees.open] == [1 << b for b in reversed(range(8)) if many >> b & 1]
    assert trees.close((many - 1).bit_length()).hex() == levels[-1][0]
    assert [[w and w.hex() for w in own] for own in grown] == [[s for s, _ in siblings(levels, k)] for k in range(many)]


def documents():
    rng = random.Random(6)
    rows = [(k, "".join(rng.choice("aé \n😀") for _ in range(rng.randint(0, 12))), [None, "", "de", "en", "é"][min(k % 9, 4)], k % 7, "clash", k) for k in range(150)]
    rows += [rows[3], rows[3], rows[3], (None, "no id", "en", 1, "clash", 0), (None, None, "en", 1, "clash", 0), (7, None, "lone", None, "clash", 0), (8, "long " * 300_000, "en", 2, "clash", 9)]
    return rows


SCHEMA = "doc_id long, text string, lang string, n_chars long, grp string, pos long"


def told(*values):
    return "".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values)


@pytest.mark.parametrize(("bits", "parts"), [(1, 4), (2, 1), (3, 5), (10, 3)])
def test_same_tree_in_blocks(spark, bits, parts):
    rows = documents()
    random.Random(parts).shuffle(rows)
    frame = spark.createDataFrame(rows, SCHEMA).repartition(parts)
    hashed = frame.withColumn("leaf", F.sha2(encoded("doc_id", "lang", "n_chars", "text"), 256))
    made = merkle_manifest(hashed, F.col("lang"), F.col("doc_id"), F.col("leaf"), bits)
    # The first check folds the witness, the second one a leaf that is not the row's.
    made = made.withColumn("again", folded(hexed(F.col("leaf")), F.col("witness"))).withColumn("wrong", folded(F.sha2(F.lit("x"), 256), F.col("witness")))
    found = made.withColumn("proof", proof_digest(F.col("witness"))).withColumn("leaf", hexed(F.col("leaf"))).collect()

    groups = {}
    for r in rows:
        groups.setdefault(r[2], []).append((r[0] is not None, r[0] or 0, h(told(r[0], r[2], r[3], r[1]))))
    order = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    levels = {g: tree([leaf for _, _, leaf in sorted(groups[g])]) for g in order}
    top = tree([levels[g][-1][0] for g in order])
    assert len(found) == len(rows)
    for r in found:
        own, at = levels[r.row.lang], order.index(r.row.lang)
        assert r.leaf == h(told(r.row.doc_id, r.row.lang, r.row.n_chars, r.row.text)) == own[0][r.pos]
        want = siblings(own, r.pos) + siblings(top, at)
        assert [(w.digest and w.digest.hex(), w.left) for w in r.witness] == want
        assert r.subroot.hex() == own[-1][0] and r.root.hex() == top[-1][0] == r.again != r.wrong
        assert r.proof == h("".join(s for s, _ in want if s)) and r.row.grp == "clash"
    for g in order:
        assert sorted(r.pos for r in found if r.row.lang == g) == list(range(len(groups[g])))


def test_empty_and_single(spark):
    def made(rows):
        frame = spark.createDataFrame(rows, SCHEMA).withColumn("leaf", F.sha2(encoded("text"), 256))
        return merkle_manifest(frame, F.col("lang"), F.col("doc_id"), F.col("leaf")).collect()

    assert made([]) == []
    (r,) = made([(1, "a", None, 1, "", 0)])
    assert r.witness == [] and r.leaf == r.subroot == r.root and r.leaf.hex() == h("1:a")

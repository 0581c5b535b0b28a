"""The methods of the operators against plain versions, and the cases their docstrings define."""

import math
import random
import time
from collections import Counter
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from groundledger.llm import mixing, near_dedup, quality_rules, substring_dedup, toxicity
from groundledger.llm.license_scan import Templates, license_scan
from groundledger.llm.near_dedup import near_duplicates
from groundledger.llm.secret_scan import secret_report, secret_scan, without_live_secrets
from groundledger.llm.substring_dedup import repeated_passages


def prose(rng, n, vocab=5000):
    return " ".join(f"w{rng.randrange(vocab)}" for _ in range(n))


# Mixing


@pytest.fixture(scope="module")
def sized(spark):
    rng = random.Random(3)
    rows = [(k, prose(rng, rng.choice([3, 10, 40, 200])), "abc"[k % 3] if k % 10 else None) for k in range(600)]
    return spark.createDataFrame(rows, "doc_id long, text string, source string").cache()


def test_rates_solve_the_dual(sized):
    by = {}
    for r in mixing.mix(sized).collect():
        by.setdefault(r.source, []).append(r)
    for rows in by.values():
        target, sizes = rows[0].target, np.array([r.size for r in rows], float)
        if target >= 2 * sizes.sum():
            assert all(r.rate == 2 for r in rows)
            continue
        x, lo, hi = sizes / sizes.mean(), -200.0, 200.0
        for _ in range(200):
            lam = (lo + hi) / 2
            lo, hi = (lam, hi) if (2 / (1 + np.exp(-lam * x)) * sizes).sum() < target else (lo, lam)
        assert [r.rate for r in rows] == pytest.approx((2 / (1 + np.exp(-lam * x))).tolist(), abs=2e-6)
        assert abs(sum(r.taken for r in rows) - target) <= 0.5
        # A document is taken its rate rounded down or up, but for the few that make up the residue.
        off = [r for r in rows if not math.floor(r.rate) <= r.taken / r.size <= math.ceil(r.rate)]
        assert len(off) <= 0.1 * len(rows)


def test_lambdas_decide_what_is_taken(sized, monkeypatch):
    def order(rows):
        return sorted((r.doc_id, r.taken) for r in rows)

    before = order(mixing.mix(sized).collect())
    solve = mixing.solve_dual
    monkeypatch.setattr(mixing, "solve_dual", lambda *a: solve(*a).withColumn("lam", F.lit(0.0)))
    assert sum(a != b for a, b in zip(before, order(mixing.mix(sized).collect()), strict=True)) > 50


def test_unsolved_dual_is_an_error(sized, monkeypatch):
    monkeypatch.setattr(mixing, "NEWTON_STEPS", 1)
    with pytest.raises(RuntimeError, match="not solved"):
        mixing.mix(sized)


# Secrets


def test_verdicts_belong_to_rows(spark):
    key = "AKIA" + "Q" * 16
    rows = [(None, "password = hunter2hunter2", "a"), (7, f"{key} x", "a"), (7, "no secret in here at all", "b"), (8, f"see {key}", "a")]
    docs = spark.createDataFrame([(*r, "?", "?", "?") for r in rows], "doc_id long, text string, source string, spans string, row string, found string")
    out = {r.text for r in without_live_secrets(docs, F.col("source"), F.col("source")).collect()}
    assert out == {"[SECRET]", "[SECRET] x", "no secret in here at all", "see [SECRET]"}


def test_widely_copied_values_are_no_credentials(spark):
    rows = [(k, "Bearer abcdefghijklmnop0001", f"s{k}", "r") for k in range(4)]  # four owners
    rows += [(10 + k, "Bearer abcdefghijklmnop0002", "s0", f"r{k}") for k in range(9)]  # one owner, nine repositories
    rows += [(30 + k, "Bearer abcdefghijklmnop0003 token=abcdefgh1234", "s0", "r") for k in range(50)]  # one owner
    docs = spark.createDataFrame(rows, "doc_id long, text string, owner string, repository string")
    got = {r.doc_id: r for r in secret_report(secret_scan(docs, F.col("owner"), F.col("repository"), ["doc_id"])).collect()}
    assert {k for k, r in got.items() if r.n_added} == set(range(30, 80))
    assert all(r.n_live == 2 * (k >= 30) for k, r in got.items())


def test_very_many_matches(spark):
    text = " ".join(f"token={k:08d}é" for k in range(100_000))
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    start = time.time()
    row = secret_report(secret_scan(docs, F.lit("a"), F.lit("a"), ["doc_id"])).first()
    assert row.n_assign == row.n_live == 100_000 and row.spans.startswith("assign:0:14,assign:16:30,")
    clean = without_live_secrets(docs, F.lit("a"), F.lit("a")).first().text
    assert clean == " ".join(["[SECRET]é"] * 100_000)
    assert time.time() - start < 90


# Quality


def features(rng, n):
    x = np.column_stack([rng.normal(5, 1, n), rng.normal(1.8, 0.1, n), np.abs(rng.normal(0.1, 0.06, n)), np.abs(rng.normal(0.2, 0.15, n)), np.abs(rng.normal(0.3, 0.2, n))])
    x[:, 1] += 0.05 * (x[:, 0] - 5)
    x[: n // 10] += [4, 1, 0.5, 1.5, 1.5]
    return x


def plain_mcd(x, starts=60):
    """Concentration steps from random rows with an exact half of the rows, the least determinant, one reweighting."""
    rng, h, best = np.random.default_rng(0), math.ceil(quality_rules.SHARE * len(x)), None
    for _ in range(starts):
        some = x[rng.choice(len(x), 12, replace=False)]
        mean, cov = some.mean(0), quality_rules.floored(np.cov(some.T, bias=True))
        for _ in range(50):
            d = np.einsum("ij,jk,ik->i", x - mean, np.linalg.inv(cov), x - mean)
            some = x[np.argsort(d)[:h]]
            mean, cov = some.mean(0), quality_rules.floored(np.cov(some.T, bias=True) * quality_rules.CONSISTENT)
        det = np.linalg.slogdet(cov)[1]
        if best is None or det < best[0] - 1e-9:
            best = det, mean, cov
    d = np.einsum("ij,jk,ik->i", x - best[1], np.linalg.inv(best[2]), x - best[1])
    some = x[d <= quality_rules.CHI2_975]
    return some.mean(0), quality_rules.floored(np.cov(some.T, bias=True) * quality_rules.CONSISTENT_975)


def test_robust_estimate_is_that_of_plain_steps(spark):
    x = features(np.random.default_rng(5), 500)
    rows = spark.createDataFrame([("g", *map(float, r)) for r in x], "grp string, f0 double, f1 double, f2 double, f3 double, f4 double")
    fit = quality_rules.robust_estimates(rows).first()
    mean, cov = plain_mcd(x)
    own = quality_rules.floored(np.array(fit["cov"]).reshape(5, 5))
    distance = lambda m, c: np.einsum("ij,jk,ik->i", x - m, np.linalg.inv(c), x - m)
    a, b = distance(np.array(fit["mean"]), own), distance(mean, cov)
    assert np.abs(a - b)[50:].max() < 1.5 and np.corrcoef(a, b)[0, 1] > 0.999
    assert ((a > quality_rules.CUTOFF) == (b > quality_rules.CUTOFF)).all() and (a > quality_rules.CUTOFF)[:50].all()


def test_a_statistic_alone_rejects(spark):
    rng = random.Random(2)
    line = lambda: prose(rng, 12)
    texts = ["\n".join(line() for _ in range(rng.randint(6, 14))) for _ in range(80)]
    repeated = line()
    bad = "\n".join([line() for _ in range(6)] + [repeated] * 4)
    rows = [(k, t, "en", "a") for k, t in enumerate([*texts, bad])] + [(200 + k, texts[k] + " again", "en", "tiny") for k in range(3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    got = {r.doc_id: r for r in quality_rules.quality_rules(docs).collect()}
    assert not got[80].base_failed and not got[80].kept
    # The three rows of a small group have their language's estimate, nearly.
    assert sum(r.kept for k, r in got.items() if k < 80) >= 78 and all(got[200 + k].kept for k in range(3))


# Licences


def best_windows(texts, templates, least):
    import re

    out = {}
    split = lambda t: re.findall("[a-z0-9]+", t.lower())
    for row, text in enumerate(texts):
        w = split(text)
        for name, t in templates:
            want = Counter(zip(split(t), split(t)[1:], strict=False))
            for i, j in combinations(range(len(w)), 2):
                own = Counter(zip(w[i:j], w[i + 1 : j + 1], strict=True))
                score = 2 * (own & want).total() / (own.total() + want.total())
                if score >= least:
                    out[row, name] = max(out.get((row, name), 0), score)
    return out


def test_license_windows_are_the_best_ones():
    import pyarrow as pa

    rng = random.Random(9)
    templates = (("one", "permission is hereby granted free of charge to any person"), ("two", "all rights are reserved by the owner of this"))
    texts = []
    for k in range(40):
        words = (templates[k % 2][1]).split()
        for _ in range(rng.randint(0, 3)):
            words[rng.randrange(len(words))] = "other"
        if rng.random() < 0.5:
            words.insert(rng.randrange(len(words)), "more")
        texts.append("Some prose, " + ", ".join(words).upper() + "; to any person " * rng.randint(0, 2))
    found = {(r, n): d for r, n, d, *_ in Templates(templates, 0.7).scan(pa.array(texts))}
    assert found == pytest.approx(best_windows(texts, templates, 0.7)) and 10 < len(found) < 40


def test_license_inside_a_line(spark):
    text = "Before it goes on for a while: This file is Licensed under CC BY-NC 4.0. and then goes on, All rights reserved. for long"
    docs = spark.createDataFrame([(1, text), (2, None), (3, "")], "doc_id long, text string")
    got = {r.license: (r.dice, r.first_word) for r in license_scan(docs).collect()}
    assert got == {"CC-BY-NC-4.0": (1.0, 10), "Proprietary": (1.0, 21)}


# Substrings


def test_passages_of_over_50_words(spark):
    rng = random.Random(4)
    rows, planted = [], []
    for k in range(400):
        passage = prose(rng, 51 + k % 10)
        rows += [(k, prose(rng, 60) + " " + passage + " " + prose(rng, 60)), (1000 + k, prose(rng, 45) + "\n" + passage + " " + prose(rng, 30))]
        planted.append(1000 + k)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    found = repeated_passages(docs).collect()
    texts = dict(rows)
    for r in found:
        raw = texts[r.doc_id].encode()[r.start_byte : r.end_byte]
        assert raw in texts[r.first_doc_id].encode() and r.first_doc_id < r.doc_id
        assert raw.decode()[1:].split() and r.n_words >= substring_dedup.LEAST_WORDS
    assert {r.doc_id for r in found} >= set(planted)
    assert {r.doc_id for r in found} <= set(planted)


def test_repeats_within_a_document(spark):
    rng = random.Random(6)
    passage = prose(rng, 100)
    docs = spark.createDataFrame([(5, passage + " " + prose(rng, 80) + " " + passage), (6, prose(rng, 200)), (None, passage)], "doc_id long, text string")
    (row,) = repeated_passages(docs).collect()
    assert (row.doc_id, row.first_doc_id) == (5, 5) and row.n_words > 80 and row.start_byte > len(passage)


# Near-duplicates


def test_crowded_buckets_over_several_blocks(spark):
    """2,600 short texts that share most shingles: buckets of more than 1,000 rows, in which only neighbours are near."""
    rng = random.Random(8)
    some = lambda n: [f"w{rng.randrange(10**6)}" for _ in range(n)]
    common, rows = some(40), []
    for k in range(1300):
        own = some(6)
        rows += [(2 * k + i, " ".join(common + own + some(3))) for i in range(2)]
    got = {r.doc_id: r.component_id for r in near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(6)).collect()}
    assert got == {k: k - k % 2 for k in range(2600)}


def test_least_agreeing_slots():
    assert near_dedup.least_agreeing(75) == 66 and near_dedup.least_agreeing(100) == 128


# Toxicity


def test_lexicons_leave_their_part_out(spark):
    bad = ["vile", "nasty", "crooked", "hateful"]
    rows = [(f"{bad[p]} filler text" if toxic else "plain filler text", toxic, p) for p in range(toxicity.PARTS) for toxic in (0, 1) for _ in range(6)]
    found = toxicity.learn_lexicons(spark.createDataFrame(rows, "text string, toxic int, part int"))
    for p, lexicon in enumerate(found[:-1]):
        assert {w for w in bad if w in lexicon} == {*bad} - {bad[p]}
    assert all(w in found[-1] for w in bad)


def test_calibration_decides(spark):
    d = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{d}/{t}.parquet") for t in ("documents", "labels"))
    clash = docs.withColumns({c: F.lit("?") for c in ("dense", "_dense", "vector", "margin", "features", "raw", "fitted", "chance")})
    model = toxicity.ToxicityModel(docs, labels)
    rows = model.score(clash.where("doc_id < 300"), "own").collect()
    assert set(rows[0].asDict()) == {*clash.columns, "own"} and all(r.dense == "?" and 0 <= r.own <= 1 for r in rows)
    fitted = model.calibration
    held = model.score(docs.join(labels, "doc_id").where(toxicity.fold(F.col("doc_id")) == toxicity.HELD_OUT)).collect()
    caught = [r.score >= 0.5 for r in held if r.toxic]
    assert fitted is not None and sum(caught) >= 0.5 * len(caught)
    assert sum(r.score >= 0.5 for r in held if not r.toxic) <= 0.03 * len(held)

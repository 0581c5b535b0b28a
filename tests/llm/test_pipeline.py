"""Stages of the pipeline against brute force, on documents with nulls, copies, repeated rows and clashing columns."""

import random
import re
from collections import Counter
from itertools import combinations

import corpus_pipeline
import pytest

from groundledger.llm.storage import settle
from groundledger.llm.token_counts import token_counts
from groundledger.llm.secret_scan import secret_report, secret_scan
from groundledger.llm.decontamination import contaminated
from groundledger.llm.toxicity import toxicity
from pyspark.sql import functions as F

STAGE = dict(corpus_pipeline.STAGES)
COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, taken string, size string, score string"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def words(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def grams(seq, n=5):
    return Counter(tuple(seq[k : k + n]) for k in range(len(seq) - n + 1)) if len(seq) >= n else Counter([tuple(seq)] if seq else [])


def make_texts():
    rng = random.Random(11)
    vocab = ["".join(rng.choice("bcdfgklmnprst") + rng.choice("aeiou") for _ in range(rng.randint(2, 4))) for _ in range(300)]
    prose = lambda n: " ".join(rng.choice(vocab) for _ in range(n))
    texts = {k: prose(rng.randint(20, 150)) for k in range(30)}
    for k in range(10):
        w = texts[k].split()
        texts[100 + k] = texts[k].upper() if k % 2 else " ".join([*w[:-1], "other"])
    texts[200] = prose(30) + " " + " ".join(texts[20].split()[:18]) + " " + prose(30)
    return texts | {300: None, 301: "", 302: "short text", 303: prose(9000)}


@pytest.fixture(scope="module")
def texts():
    return make_texts()


@pytest.fixture(scope="module")
def docs(spark, texts):
    rows = [(k, t, [None, "en"][k % 2], [None, "a", "b"][k % 3], None, "?", "?", "?") for k, t in texts.items()]
    rows += [rows[3], (None, "a row without an id but with some words", "en", "a", 1, "?", "?", "?")]
    return settle(spark.createDataFrame(rows, COLUMNS))


@pytest.fixture(scope="module")
def folder(spark, texts, docs, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("tables"))
    docs.write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    items = [(1, " ".join(texts[20].split()[:18])), (2, "nothing of this kind is in any text"), (3, None)]
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    return d


def ids(frame):
    return sorted((r.doc_id for r in frame.select("doc_id").collect()), key=lambda x: -1 if x is None else x)


def test_toxicity_keeps_all_without_labels(spark, docs, folder):
    assert ids(STAGE["toxicity"](spark, docs, folder)) == ids(docs)


def test_near_dedup(spark, docs, texts, folder):
    sets = {k: set(grams(words(t))) for k, t in texts.items()}
    component = {k: k for k in sets}
    links = [(a, b) for a, b in combinations(sets, 2) if sets[a] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])]
    for _ in sets:
        for a, b in links:
            component[a] = component[b] = min(component[a], component[b])
    out = STAGE["near_dedup"](spark, docs, folder)
    assert out.columns == docs.columns
    # The repeated row goes too.
    assert ids(out) == [None, *sorted(k for k in texts if component[k] == k)]
    assert len(ids(out)) < len(ids(docs)) - 8


def test_decontamination(spark, docs, texts, folder):
    item = words(" ".join(texts[20].split()[:18]))
    own, leaks = grams(item), set()
    for k, t in texts.items():
        w = words(t)
        both = max(((grams(w[j : j + len(item)]) & own).total() for j in range(len(w) - len(item) + 1)), default=0)
        if 100 * both >= 75 * (2 * own.total() - both):
            leaks.add(k)
    assert {20, 200} <= leaks
    out = STAGE["decontamination"](spark, docs, folder)
    assert out.columns == docs.columns and ids(out) == [k for k in ids(docs) if k not in leaks]


def test_secrets_masked_in_place(spark, docs, folder):
    planted = docs.withColumn("text", F.when(F.col("doc_id") == 5, "password = hunter2hunter2 end").otherwise(F.col("text")))
    out = STAGE["secret_scan"](spark, planted, folder)
    assert out.columns == docs.columns and ids(out) == ids(docs)
    assert "hunter2" not in out.where("doc_id = 5").first().text
    assert out.where("doc_id != 5").exceptAll(planted.where("doc_id != 5")).isEmpty()


def test_mixing(spark, docs, folder):
    rows = STAGE["mixing"](spark, docs, folder).collect()
    total = Counter()
    for r in docs.collect():
        total[r.source] += len(words(r.text))
    weight = dict(zip(["a", "b", None], (5, 2, 1), strict=True))
    target, left, free = {}, 1.5 * sum(total.values()), set(total)
    while free:
        share = left / sum(weight[s] for s in free)
        full = {s for s in free if weight[s] * share > 2 * total[s]}
        if not full:
            target |= {s: weight[s] * share for s in free}
            break
        target |= {s: 2.0 * total[s] for s in full}
        left -= sum(target[s] for s in full)
        free -= full
    got = Counter()
    for r in rows:
        assert 0 < r.taken <= 2 * len(words(r.text)) and r.copies == -(-r.taken // len(words(r.text)))
        got[r.source] += r.taken
    assert all(abs(got[s] - target[s]) <= 2 for s in total)
    assert None in {r.doc_id for r in rows}


def test_whole_run_and_empty_tables(spark, docs, folder, tmp_path):
    assert 20 < corpus_pipeline.run(spark, folder).count() < docs.count()
    d = str(tmp_path)
    spark.createDataFrame([], COLUMNS).write.parquet(f"{d}/documents.parquet")
    for name in ("labels", "benchmark"):
        spark.read.parquet(f"{folder}/{name}.parquet").limit(0).write.parquet(f"{d}/{name}.parquet")
    assert corpus_pipeline.run(spark, d).count() == 0


def test_operators_on_empty_tables(spark, docs, folder):
    none = spark.createDataFrame([], COLUMNS)
    bench, labels = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("benchmark", "labels"))
    assert contaminated(none, bench).count() == contaminated(docs, bench.limit(0)).count() == 0
    assert secret_report(secret_scan(none, F.col("source"), F.col("lang"))).count() == 0
    assert toxicity(none, labels).count() == 0
    public = pytest.importorskip("public_tokenizers")
    assert token_counts(none, public.path("piece_bpe_32k.model")).count() == 0


def test_stages_with_clashing_columns(spark, folder, texts):
    names = ("_dense", "dense", "_spans", "spans", "row", "doc", "found", "gone", "times", "bin", "own", "whole", "here")
    rows = spark.read.parquet(f"{folder}/documents.parquet").withColumns({c: F.lit("?") for c in names})
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, rows, folder)
        assert set(rows.columns) <= set(out.columns), name
        assert {r.dense for r in out.select("dense").distinct().collect()} == {"?"}


def test_contaminated_rows_without_an_id_go(spark, texts, folder):
    rows = spark.createDataFrame([(None, texts[20], "en", "a", 1, "?", "?", "?"), (1, "clean words only", "en", "a", 1, "?", "?", "?")], COLUMNS)
    assert ids(STAGE["decontamination"](spark, rows, folder)) == [1]

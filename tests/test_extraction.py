"""Worked examples of transliteration, word assignment, merges, quotas and replays."""

from datetime import datetime, timedelta

import pytest

from groundledger.functions.transliteration import english_reader, to_english, transliterated
from groundledger.operators.extraction import model_over_rules, words_of_fields
from groundledger.streaming.events import replace_by_document, replays
from groundledger.streaming.stateful import quotas
from pyspark.sql import functions as F


@pytest.mark.parametrize(
    ("word", "latin"),
    [("राम", "Ram"), ("कमला", "Kamla"), ("दीनदयाल", "Deendayal"), ("मौर्य", "Maurya"), ("कुशवाहा", "Kushwaha"), ("सोनवर्षा", "Sonwarsha"),
     ("सिंह", "Singh"), ("खाता १२।", "Khata 12."), ("plain", "plain"), ("", ""), ("चंपा", "Champa"), ("ॐ", "ॐ")],
)
def test_transliterated(word, latin):
    assert transliterated(word) == latin


def test_english_readings(spark):
    read = english_reader({"रामपुर": "Rampur"})
    assert read("सिंचित") == ("Irrigated", "glossary", True)
    assert read("डेमो  जिला") == ("Demo District", "glossary", True)
    assert read("स्व. राम") == ("Late Ram", "mixed", True)
    assert read("कमला") == ("Kamla", "transliteration", True)
    assert read("ग्राम: रामपुर") == read("ग्राम : रामपुर") == ("Village: Rampur", "glossary", True)
    assert read(None) == read("  ") == ("", "none", False)
    rows = spark.createDataFrame([("राम",), (None,), ("x",)], "v string").select(to_english(F.col("v")).alias("r")).select("r.*").collect()
    assert [tuple(r) for r in rows] == [("Ram", "transliteration", True), ("", "none", False), ("x", "none", False)]


def test_words_go_to_the_smallest_field(spark):
    box = "page long, n int, x1 int, y1 int, x2 int, y2 int"
    words = spark.createDataFrame([(1, 0, 0, 0, 10, 10), (1, 1, 20, 0, 30, 10), (1, 2, 100, 0, 200, 10), (1, 3, 500, 500, 510, 510)], box)
    fields = spark.createDataFrame(
        [(1, 0, 0, 0, 40, 10, "OUTER"), (1, 1, 18, 0, 32, 10, "INNER"), (1, 2, 150, 0, 180, 10, "PART"), (2, 3, 500, 500, 510, 510, "ELSE")], f"{box}, field string"
    )
    got = {(r.n, r.field, r.begins) for r in words_of_fields(words, fields, "page", "field").collect()}
    assert got == {(1, "INNER", True), (0, "OUTER", True), (2, "PART", True)}
    assert words_of_fields(words.limit(0), fields, "page", "field").count() == 0


def test_model_over_rules(spark):
    kind = "doc long, field string, n int, confidence double, value string"
    model = spark.createDataFrame([(1, "AREA", 1, 0.7, "a"), (1, "AREA", 2, 0.9, "b"), (1, "OWNER", 3, 0.6, "c"), (1, "OWNER", 4, 0.8, "d"), (1, "KHATA", 5, 0.2, "e")], kind)
    rules = spark.createDataFrame([(1, "AREA", 6, 1.0, "f"), (1, "KHATA", 7, 0.5, "g"), (1, "KHATA", 8, 0.5, "h"), (2, "AREA", 9, 0.1, None)], kind)
    got = model_over_rules(model, rules, "doc", "field", "confidence", "n", ["OWNER"], 0.5, F.col("value").isNotNull())
    assert {r.value for r in got.collect()} == {"b", "c", "d", "g", "h"}


def stream_rows(spark, rows, schema, folder, build):
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{folder}/in")
    out = build(spark.readStream.schema(schema).parquet(f"{folder}/in"))
    name = f"got_{abs(hash(folder))}"
    run = out.writeStream.format("memory").queryName(name).option("checkpointLocation", f"{folder}/ck").outputMode("append").trigger(availableNow=True).start()
    run.awaitTermination(90)
    return spark.table(name).collect()


def test_quotas(spark, tmp_path):
    at = datetime(2026, 1, 1)
    rows = [("u", "i" if k % 2 else "j", at + timedelta(seconds=s)) for k, s in enumerate([0, 10, 20, 61, 62])] + [(None, "i", at)]
    limits = [("user_minute", "user", 2, 60), ("ip_minute", "ip", 10, 60), ("user_day", "user", 4, 86_400)]
    got = stream_rows(spark, rows, "user string, ip string, ts timestamp", str(tmp_path), lambda s: quotas(s, limits))
    refused = {(r.quota, r.key, (r.ts - at).seconds) for r in got if not r.accepted}
    assert refused == {("user_minute", "u", 20), ("user_day", "u", 62)} and len(got) == 5 * 3 + 1


def test_replays(spark, tmp_path):
    at = datetime(2026, 1, 1)
    rows = [("t", at + timedelta(seconds=s), at + timedelta(seconds=s + 30)) for s in (0, 10, 40)] + [("v", at, at + timedelta(seconds=5))]
    got = stream_rows(spark, rows, "token string, ts timestamp, expires timestamp", str(tmp_path), lambda s: replays(s, "token", "expires", "1 hour"))
    assert sorted((r.token, (r.ts - at).seconds, r.replayed) for r in got) == [("t", 0, False), ("t", 10, True), ("t", 40, False), ("v", 0, False)]


def test_batch_delivered_twice(spark, tmp_path):
    sink, rows = replace_by_document(str(tmp_path / "out"), "doc"), [(1, "a"), (1, "b"), (2, "c")]
    for _ in range(2):
        sink(spark.createDataFrame(rows, "doc long, v string"), 0)
    assert sorted(r.v for r in spark.read.parquet(str(tmp_path / "out")).collect()) == ["a", "b", "c"]

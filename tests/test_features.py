"""The data source of map features: pushed villages, checked rows."""

import json

import pytest
from pyspark.sql import functions as F

from groundledger.sources.features import FeatureSource, _Reader, features, write_features


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("features") / "out")
    rows = spark.createDataFrame([("v1", 1, 2.5), ("v1", 2, None), ("v 2/ü", 3, 1.0), (None, 4, 1.0)] + [("big", 100 + k, 0.5) for k in range(9000)], "village string, id int, x double")
    shape = F.when(F.col("x").isNotNull(), F.struct(F.lit("Point").alias("type"), F.array("x", "x").alias("coordinates")))
    write_features(rows, path, F.col("village"), F.col("id"), shape, F.struct(F.col("id").alias("number"), F.lit("é\n").alias("note")))
    return path


def test_reads_what_was_written(spark, folder):
    rows = {r.id: r for r in features(spark, folder).where("village_id is null or village_id != 'big'").collect()}
    assert {k: r.village_id for k, r in rows.items()} == {"1": "v1", "2": "v1", "3": "v 2/ü", "4": None}
    assert json.loads(rows["1"].geometry)["coordinates"] == [2.5, 2.5] and rows["2"].geometry is None and json.loads(rows["3"].properties) == {"number": 3, "note": "é\n"}
    assert features(spark, folder).count() == 9004 and features(spark, folder, []).count() == 0


def test_filters_are_pushed_and_checked_again(spark, folder, capsys):
    one = features(spark, folder, ["v1"]).where("geometry is not null")
    assert [r.id for r in one.collect()] == ["1"]
    one.explain()
    plan = capsys.readouterr().out
    # The source lists one folder, and Spark's own filter stays above it.
    assert "BatchScan" in plan and "Filter" in plan
    assert one.rdd.getNumPartitions() == 1 < features(spark, folder).rdd.getNumPartitions()
    assert features(spark, folder, ["v1", "v 2/ü"], ["2", "3", "100"]).count() == 2
    assert features(spark, folder, ["v1"]).where("village_id = 'big'").count() == features(spark, folder, ["nowhere"]).count() == 0


def test_listing_opens_only_the_villages_asked_for(folder):
    from pyspark.sql.datasource import EqualTo, GreaterThan, In

    reader = FeatureSource({"path": folder}).reader(None)
    filters = [In(("village_id",), ("v1", "big")), EqualTo(("id",), "1"), GreaterThan(("id",), "0")]
    assert list(reader.pushFilters(filters)) == filters
    assert {p.village for p in reader.partitions()} == {"v1", "big"}
    assert sum(b.num_rows for p in reader.partitions() for b in reader.read(p)) == 1
    assert {p.village for p in _Reader(folder).partitions()} == {"v1", "big", "v 2/ü", None}

import pytest
from pyspark.sql import functions as F

from groundledger.functions import values as v
from groundledger.functions.projective import inverse_map, page_map, projected
from groundledger.functions.shares import common_multiple
from groundledger.operators.intervals import as_of, legal_transitions, sequence_faults
from groundledger.operators.splits import split_groups
from groundledger.sources.sinks import replace_partitions
from groundledger.streaming.stateful import changes_only


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


@pytest.mark.parametrize(
    ("column", "want"),
    [
        (lambda: v.plot_number(F.lit("खसरा १४२ । २")), "142/2"),
        (lambda: v.plot_number(F.lit("none")), None),
        (lambda: v.number(F.lit("area 1,234.50 ha")), 1234.5),
        (lambda: v.tidy(F.lit("  a \n b ")), "a b"),
        (lambda: v.tidy(F.lit(" ")), None),
        (lambda: v.trigram_similarity(F.lit("word"), F.lit("two words")), 4 / 11),
        (lambda: v.hamming(F.lit("ffffffffffffffff"), F.lit("fffffffffffffff0")), 4),
        (lambda: v.relative_difference(F.lit(0.0), F.lit(0.0)), 0.0),
        (lambda: v.relative_difference(F.lit(2.0), F.lit(1.0)), 0.5),
        (lambda: common_multiple(F.array(F.lit("4"), F.lit("6"), F.lit("10"))), "60"),
        (lambda: v.fused_confidence([(F.lit(None).cast("double"), 0.5), (F.lit(0.8), 0.5)]), 0.8),
        (lambda: v.fused_confidence([(F.lit(None).cast("double"), 0.5)]), 0.0),
        (lambda: v.square_metres(F.lit(2.0), F.lit("HECTARE")), 20000.0),
        (lambda: v.square_metres(F.lit(2.0), F.lit("FURLONG")), None),
        # the nearest doubles, as the SQL has them; the quotients are those beside them.
        (lambda: v.square_metres(F.lit(1.0), F.lit("BISWA")) == F.lit(126.46425), True),
        (lambda: v.square_metres(F.lit(1.0), F.lit("GUNTHA")) == F.lit(101.1715), True),
    ],
)
def test_values(spark, column, want):
    got = one(spark, column())
    assert got == pytest.approx(want) if isinstance(want, float) else got == want


def test_as_of_is_closed(spark):
    rows = spark.sql("select date'2020-01-01' as valid_from, date'2020-12-31' as valid_to")
    for day, n in (("2020-01-01", 1), ("2020-12-31", 1), ("2021-01-01", 0)):
        assert rows.where(as_of(F.lit(day).cast("date"))).count() == n


def test_sequence_faults(spark):
    rows = spark.sql("""select * from values ('a', date'2020-01-01', date'2020-01-31'), ('a', date'2020-02-01', date'2020-02-10'),
        ('a', date'2020-02-15', null), ('b', date'2020-01-01', null), ('b', date'2020-05-01', null) as t(k, valid_from, valid_to)""")
    assert sorted((r.k, r.fault) for r in sequence_faults(rows, "k").collect()) == [("a", "GAP"), ("b", "OVERLAP")]


def test_transitions(spark):
    edges = spark.createDataFrame([("NEW", "DONE")], "source string, target string")
    rows = spark.createDataFrame([(1, 1, "NEW"), (1, 2, "DONE"), (2, 1, "DONE"), (2, 2, "NEW")], "k int, n int, state string")
    assert [r.k for r in legal_transitions(rows, edges, "k", "n", "state").collect()] == [2]


def test_replace_partitions(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.createDataFrame([(1, "a"), (2, "b")], "k int, x string").write.partitionBy("k").parquet(path)
    replace_partitions(spark.createDataFrame([("c", 2)], "x string, k int"), path, "k")
    assert sorted((r.k, r.x) for r in spark.read.parquet(path).collect()) == [(1, "a"), (2, "c")]


def test_changes_only(spark, tmp_path):
    rows = spark.sql("""select * from values (1, timestamp'2020-01-01 00:00:00', 'x'), (1, timestamp'2020-01-01 00:00:01', 'x'),
        (1, timestamp'2020-01-01 00:00:02', 'y') as t(job, ts, payload)""")
    rows.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    query = changes_only(stream, "job", "payload").writeStream.format("memory").queryName("changes").trigger(availableNow=True)
    query.option("checkpointLocation", str(tmp_path / "cp")).start().awaitTermination()
    assert [r.payload for r in spark.table("changes").orderBy("ts").collect()] == ["x", "y"]


def test_page_maps_take_corners_to_corners_and_back(spark):
    corners = [(12.0, 7.0), (590.0, 30.0), (610.0, 870.0), (3.0, 850.0)]
    m = page_map([(F.lit(x), F.lit(y)) for x, y in corners], F.lit(620.0), F.lit(880.0))
    for (x, y), (u, v) in zip([(0.0, 0.0), (620.0, 0.0), (620.0, 880.0), (0.0, 880.0), (300.0, 400.0)], [*corners, (None, None)], strict=True):
        there = projected(m, F.lit(x), F.lit(y))
        back = projected(inverse_map(m), *there)
        r = spark.range(1).select(*[c.alias(n) for c, n in zip((*there, *back), "abcd", strict=True)]).first()
        assert (u is None or (r.a, r.b) == pytest.approx((u, v))) and (r.c, r.d) == pytest.approx((x, y), abs=1e-6)
    line = page_map([(F.lit(float(k)), F.lit(float(k))) for k in range(4)], F.lit(620.0), F.lit(880.0))
    assert spark.range(1).select(projected(line, F.lit(1.0), F.lit(1.0))[0].alias("x")).first().x is None


def test_splits_meet_their_shares(spark):
    rows = spark.range(30_000).select((F.col("id") % 2500).alias("g"), (F.pmod(F.xxhash64("id"), F.lit(4))).alias("t"))
    split = split_groups(rows, "g", "t")
    assert split.count() == split.select("g").distinct().count() == 2500
    for r in rows.join(split, "g").groupBy("t").pivot("split").count().collect():
        whole = r.train + r.val + r.test
        assert abs(r.train / whole - 0.70) < 0.01 and abs(r.val / whole - 0.15) < 0.01 and abs(r.test / whole - 0.15) < 0.01

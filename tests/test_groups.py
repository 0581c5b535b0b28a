"""Lists of a group's other rows, against DuckDB and by where they are made."""

import duckdb
import pandas as pd
import pytest
from pyspark.sql import functions as F

from groundledger.operators import groups
from groundledger.plans import catalogue


def parts_table(folder, keys, sizes):
    rows = pd.DataFrame({"p_partkey": pd.array(keys, dtype="Int64"), "p_size": pd.array(sizes, dtype="Int32")})  # noqa: F841
    duckdb.sql(f"copy (select p_partkey::bigint as p_partkey, p_size::int as p_size from rows) to '{folder}/part.parquet' (format parquet)")
    return str(folder)


def same_as_sql(spark, folder):
    got = sorted(((r.parcel_id, list(r.others)) for r in catalogue.QUERIES["u07_others"](spark, folder).collect()), key=str)
    con = duckdb.connect()
    con.execute(f"create view part as select * from '{folder}/part.parquet'")
    assert got == sorted(((p, o) for p, o in con.execute(catalogue.ORACLE_SQL["u07_others"]).fetchall()), key=str)
    return got


def test_repeated_and_missing_ids(spark, tmp_path):
    """Two rows of one id, rows without an id, a group of one row, a null size."""
    folder = parts_table(tmp_path, [7, 7, 157, 307, 8, 8, 9, 10, 160, None, None, None], [1, 1, 1, 1, 1, 1, 1, 3, None, 1, 3, None])
    got = same_as_sql(spark, folder)
    assert got.count(("P7", ["P157", "P307"])) == 2 and got.count(("P8", [])) == 2 and (None, []) in got


@pytest.mark.parametrize(("part", "piece"), [(1, 1), (50, 1000), (4000, 70), (10**6, 150)])
def test_parts_and_pieces(spark, tmp_path, monkeypatch, part, piece):
    """However groups are cut, each row has all others of its group."""
    monkeypatch.setattr(groups, "PART_IDS", part)
    monkeypatch.setattr(groups, "PIECE_IDS", piece)
    keys = [150 * k + 3 for k in range(60)] + [150 * k + 4 for k in range(7)] + [153, 303, 303, 5]
    assert len(same_as_sql(spark, parts_table(tmp_path, keys, [1] * len(keys)))) == 70


def test_lists_of_a_group_are_dealt_to_tasks(spark, tmp_path):
    """One group of 4,000 rows: no task makes most of its lists."""
    folder = parts_table(tmp_path, [150 * k for k in range(4000)], [1] * 4000)
    made = catalogue.QUERIES["u07_others"](spark, folder).groupBy(F.spark_partition_id().alias("task")).agg(F.sum(F.size("others")).alias("ids"), F.count("*").alias("n")).collect()
    assert sum(r.n for r in made) == 4000 and sum(r.ids for r in made) == 4000 * 3999
    assert max(r.ids for r in made) <= 0.75 * 4000 * 3999


def test_groups_are_cut_by_their_share_of_all_lists(spark, tmp_path, monkeypatch):
    """each of many groups was cut into PARTS parts, and its ids shuffled as often."""
    monkeypatch.setattr(groups, "PART_IDS", 10)
    many = [150 * k + 3 * g for g in range(50) for k in range(40)]
    assert len(same_as_sql(spark, parts_table(tmp_path, many, [1] * len(many)))) == 2000
    parts = spark.range(1).select(groups.parts_of(F.lit(1600.0), 500 * 1600.0, 16).alias("many"), groups.parts_of(F.lit(1600.0), 1600.0, 16).alias("one")).first()
    assert parts == (1, groups.PARTS)

"""Small functions of the land records that have a query of their own, and token labels for training."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.geometry import geodesic_area, rectangle, thousandths
from ..functions.projective import inverse_map, page_map, projected, projected_box
from ..functions.values import ascii_digits
from ..operators.anomaly import share_value
from ..operators.extraction import words_of_fields
from ..sources.land import land, land_sql
from .catalogue import query


@query(f"with {land_sql('scans')} select scan_id, translate(raw, '०१२३४५६७८९', '0123456789') as plain from scans where field = 'KHASRA'")
def t02_ascii_digits(spark, d):
    return land(spark, d, "scans").where("field = 'KHASRA'").select("scan_id", ascii_digits(F.col("raw")).alias("plain"))


@query(f"""with {land_sql("holdings")} select parcel_id, round(coalesce(sum(try_cast(split_part(share, '/', 1) as double) / nullif(try_cast(split_part(share, '/', 2) as double), 0)), 0), 4) as total, count(*) as holders
from holdings where valid_to is null group by 1""")
def a21_current_shares(spark, d):
    """Sum of the shares held now (a21) and the number of their holders (a15)."""
    now = land(spark, d, "holdings").where("valid_to is null")
    return now.groupBy("parcel_id").agg(F.round(F.sum(share_value(F.col("share"))), 4).alias("total"), F.count("*").alias("holders"))


@query(f"""with {land_sql("deeds", "mutations")}, r as (select parcel_id, 2001 - min(year(created_at)) as age from deeds where parcel_id is not null group by 1), m as (select parcel_id, count(*) as n from mutations group by 1)
select parcel_id, cast(age as integer) as age, round(case when age >= 1 then n / age else n end, 9) as per_year from r join m using (parcel_id)""")
def d05_record_ages(spark, d):
    age = (F.lit(2001) - F.min(F.year("created_at"))).alias("age")
    r = land(spark, d, "deeds").where("parcel_id is not null").groupBy("parcel_id").agg(age)
    m = land(spark, d, "mutations").groupBy("parcel_id").agg(F.count("*").alias("n"))
    return r.join(m, "parcel_id").select("parcel_id", "age", F.round(F.when(F.col("age") >= 1, F.col("n") / F.col("age")).otherwise(F.col("n")), 9).alias("per_year"))


@query("select p_partkey, round(6371008.8 * 6371008.8 * radians(0.001) * (sin(radians(26.0 + p_size * 0.0001)) - sin(radians(26.0))), 3) as sqm from part")
def m16_geodesic_areas(spark, d):
    ring = rectangle(F.lit(80.0), F.lit(26.0), F.lit(0.001), F.col("p_size") * 0.0001)
    return land(spark, d, "part").select("p_partkey", F.round(geodesic_area(ring), 3).alias("sqm"))


@query("""with b as (select vec_id, list_transform(range(1, 9), lambda r: list_transform(range(1, 8), lambda c: case when embedding[(r - 1) * 8 + c] > embedding[(r - 1) * 8 + c + 1] then '1' else '0' end)) as bits from embeddings)
select vec_id, array_to_string(list_transform(bits, lambda r: array_to_string(r, '')), '') as bits from b""")
def m22_difference_hash(spark, d):
    """Whether each place of an eight by eight picture is brighter than its right neighbour, row by row."""
    at = lambda r, c: F.get("embedding", ((r - 1) * 8 + c - 1).cast("int"))
    row = lambda r: F.array_join(F.transform(F.sequence(F.lit(1), F.lit(7)), lambda c: F.when(at(r, c) > at(r, c + 1), "1").otherwise("0")), "")
    return land(spark, d, "embeddings").select("vec_id", F.array_join(F.transform(F.sequence(F.lit(1), F.lit(8)), row), "").alias("bits"))


@query()
def x12_token_labels(spark, d):
    """Words of pages with the label that training wants: B- where a field begins, I- inside it, O elsewhere; places in thousandths."""
    c = F.col
    rows = land(spark, d, "lineitem").select(
        c("l_orderkey").alias("page"), (c("l_linenumber") * 1000 + c("l_partkey") % 1000).alias("n"), (c("l_partkey") % 60 * 10).cast("double").alias("x1"),
        (c("l_suppkey") % 30 * 10).cast("double").alias("y1"),
    ).dropDuplicates(["page", "n"])
    words = rows.withColumn("x2", c("x1") + 40).withColumn("y2", c("y1") + 10)
    fields = words.where("n % 3 = 0").select("page", "n", F.concat(F.lit("F"), c("n") % 4).alias("field"), (c("x1") - 5).alias("x1"), (c("y1") - 2).alias("y1"), (c("x2") + 50).alias("x2"), (c("y2") + 2).alias("y2"))
    found = words_of_fields(words, fields, "page", "field")
    label = F.coalesce(F.concat(F.when(c("begins"), "B-").otherwise("I-"), c("field")), F.lit("O"))
    out = words.join(found, ["page", "n"], "left")
    return out.select("page", "n", label.alias("label"), thousandths(c("x1"), F.lit(700)).alias("x1"), thousandths(c("y1"), F.lit(320)).alias("y1"))


_CORNERS = (("l_orderkey % 30", "l_orderkey % 23"), ("620 - l_orderkey % 19", "l_orderkey % 17"), ("620 - l_orderkey % 29", "880 - l_orderkey % 31"), ("l_orderkey % 13", "880 - l_orderkey % 37"))
_PLACES = ", ".join(f"{x} as x{k}, {y} as y{k}" for k, (x, y) in enumerate(_CORNERS))


@query(f"""with b as (select row_number() over () as rid, l_orderkey, l_linenumber, (l_partkey % 50) * 10 as bx1, l_suppkey % 40 * 10 as by1, (l_partkey % 50) * 10 + 100 + l_linenumber * 7 as bx2, l_suppkey % 40 * 10 + 30 as by2, {_PLACES} from lineitem),
p as (select *, ((x0 - x1 + x2 - x3) * (y3 - y2) - (x3 - x2) * (y0 - y1 + y2 - y3)) / cast((x1 - x2) * (y3 - y2) - (x3 - x2) * (y1 - y2) as double) as g,
    ((x1 - x2) * (y0 - y1 + y2 - y3) - (x0 - x1 + x2 - x3) * (y1 - y2)) / cast((x1 - x2) * (y3 - y2) - (x3 - x2) * (y1 - y2) as double) as h from b),
c as (select rid, l_orderkey, l_linenumber, x0, y0, x1, y1, x3, y3, g, h, unnest([bx1, bx2, bx2, bx1]) / 620.0 as u, unnest([by1, by1, by2, by2]) / 880.0 as v from p),
m as (select rid, l_orderkey, l_linenumber, ((x1 - x0 + g * x1) * u + (x3 - x0 + h * x3) * v + x0) / (g * u + h * v + 1) as x, ((y1 - y0 + g * y1) * u + (y3 - y0 + h * y3) * v + y0) / (g * u + h * v + 1) as y from c)
select l_orderkey, l_linenumber, cast(floor(min(x) + 1e-6) as integer) as x1, cast(floor(min(y) + 1e-6) as integer) as y1, cast(ceil(max(x) - 1e-6) as integer) as x2, cast(ceil(max(y) - 1e-6) as integer) as y2, cast(0.0 as double) as drift
from m group by rid, l_orderkey, l_linenumber""")
def m13_photographed_boxes(spark, d):
    """Boxes of pages photographed at an angle, each page by a map of its own, and how far the map back is off."""
    c = F.col
    rows = land(spark, d, "lineitem").select(
        "l_orderkey", "l_linenumber",
        F.struct(((c("l_partkey") % 50) * 10).alias("x1"), (c("l_suppkey") % 40 * 10).alias("y1"), ((c("l_partkey") % 50) * 10 + 100 + c("l_linenumber") * 7).alias("x2"), (c("l_suppkey") % 40 * 10 + 30).alias("y2")).alias("b"),
        F.array(*[F.expr(f"cast({v} as double)") for place in _CORNERS for v in place]).alias("at"),
    )
    m = page_map([(c("at")[2 * k], c("at")[2 * k + 1]) for k in range(4)], F.lit(620.0), F.lit(880.0))
    there = projected(m, c("b.x1"), c("b.y2"))
    back = projected(inverse_map(m), *there)
    drift = F.greatest(F.abs(back[0] - c("b.x1")), F.abs(back[1] - c("b.y2")))
    return rows.select("l_orderkey", "l_linenumber", projected_box(m, c("b")).alias("m"), F.round(drift, 6).alias("drift")).select("l_orderkey", "l_linenumber", "m.*", "drift")

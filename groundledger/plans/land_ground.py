"""Plots as polygons of any shape: validity, overlaps within a village, parts outside it, what a view shows."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.polygons import area, extent, geodesic, polygon, polygon_fault, shared_area
from ..operators.quadtree import meeting_boxes
from ..sources.features import features, write_features
from ..sources.land import land, land_sql
from ..sources.shared import scratch, settle
from .catalogue import query

#: Corners of the plots' shapes on a square of twelve: a rectangle, an L, a star, a frame, a bow-tie, a triangle.
SHAPES = (
    (((0, 0), (12, 0), (12, 11), (0, 11)),),
    (((0, 0), (0, 12), (5, 12), (5, 5), (12, 5), (12, 0)),),
    (((6, 0), (8, 4), (12, 6), (8, 8), (6, 12), (4, 8), (0, 6), (4, 4)),),
    (((0, 0), (12, 0), (12, 12), (0, 12)), ((3, 3), (9, 3), (9, 9), (3, 9))),
    (((0, 0), (12, 12), (12, 0), (0, 12)),),
    (((0, 0), (12, 3), (4, 12)),),
)
BOW_TIE = 4
#: A village's ground: a strip with a notch in its left side.
GROUND = ((0, 0), (515, 0), (515, 10_000_000), (0, 10_000_000), (0, 40), (60, 40), (60, 20), (0, 20))
VIEW = (101.5, 10.25, 137.0, 31.75)
#: Fixed value: square metres below which a shared part is no overlap.
SLIVER = 1.0


def _plots(spark, d):
    """(id, village, recorded, rings, box): rings are null where a plot has no geometry.

    Rows come from an inline(), so each plot's rings and box are made once and not in every
    condition on them. A table of plots is a small file, so its rows are dealt to all tasks first.
    """
    c = F.col

    def shape(rings):
        return F.array(*[F.array(*[F.struct((c("x") + c("s") * x).alias("x"), (c("y") + c("s") * y).alias("y")) for x, y in ring]) for ring in rings])

    rings = F.when(c("kind") == 0, shape(SHAPES[0]))
    for k in range(1, len(SHAPES)):
        rings = rings.when(c("kind") == k, shape(SHAPES[k]))
    tasks = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    made = F.transform(F.array(rings), lambda r: F.struct(r.alias("rings"), extent(r).alias("box")))
    return land(spark, d, "plots").repartition(tasks).select("id", "village", "recorded", F.inline(made))


def _sound(spark, d):
    """The valid plots with their boxes."""
    return _plots(spark, d).where(polygon_fault("rings").isNull())


def _corners_sql() -> str:
    rows = [(kind, r, k, *ring[k], *ring[(k + 1) % len(ring)]) for kind, rings in enumerate(SHAPES) for r, ring in enumerate(rings) for k in range(len(ring))]
    values = ", ".join(map(str, rows))
    return f"""shapes as (select * from (values {values}) t(kind, ring, k, px, py, qx, qy)),
sides as (select id, village, x + s * px as x1, y + s * py as y1, x + s * qx as x2, y + s * qy as y2 from plots join shapes using (kind)),
boxes as (select id, village, min(x1) as bx1, max(x1) as bx2, min(y1) as by1, max(y1) as by2 from sides group by all)"""


def _shared_sql(pairs: str, one: str, two: str) -> str:
    """(one, two, shared) of the pairs: between all corners and crossings no edges cross, so even and odd edges bound trapezoids there."""
    return f"""pe as (select one, two, 0 as side, e.* exclude (id) from {pairs} join {one} e on e.id = one union all select one, two, 1, e.* exclude (id) from {pairs} join {two} e on e.id = two),
slope as (select *, (y2 - y1) / (x2 - x1) as m from pe where x1 != x2),
crossing as (select a.one, a.two, (b.y1 - b.m * b.x1 - a.y1 + a.m * a.x1) / (a.m - b.m) as x, a.x1 as a1, a.x2 as a2, b.x1 as b1, b.x2 as b2 from slope a join slope b on a.one = b.one and a.two = b.two and a.side < b.side and a.m != b.m),
cuts as (select one, two, x1 as x from pe union select one, two, x from crossing where x between least(a1, a2) and greatest(a1, a2) and x between least(b1, b2) and greatest(b1, b2)),
slabs as (select one, two, x as l, lead(x) over (partition by one, two order by x) as r from cuts),
heights as (select s.one, s.two, l, r, side, y1 + m * ((l + r) / 2 - x1) as h from slabs s join slope e on e.one = s.one and e.two = s.two and least(x1, x2) <= l and greatest(x1, x2) >= r where r > l),
parity as (select *, sum(1 - side) over w as na, sum(side) over w as nb, lead(h) over (partition by one, two, l order by h, side) as above from heights window w as (partition by one, two, l order by h, side rows unbounded preceding)),
shared as (select one, two, sum((above - h) * (r - l)) as shared from parity where na % 2 = 1 and nb % 2 = 1 group by 1, 2)"""


_GROUND_SIDES = "ground as (select 0 as id, * from (values " + ", ".join(f"({a[0]}.0, {a[1]}.0, {b[0]}.0, {b[1]}.0)" for a, b in zip(GROUND, GROUND[1:] + GROUND[:1], strict=True)) + ") t(x1, y1, x2, y2))"
_PLAIN = "plain as (select id, x1, y1, x2, y2 from sides)"
_SOUND = f"sound as (select b.* from boxes b join plots p using (id) where p.kind is not null and p.kind != {BOW_TIE})"


@query(f"""with {land_sql("plots")}, {_corners_sql()}, {_SOUND}, {_PLAIN},
pairs as (select a.id as one, b.id as two from sound a join sound b on a.village = b.village and a.id < b.id and a.bx1 < b.bx2 and b.bx1 < a.bx2 and a.by1 < b.by2 and b.by1 < a.by2),
{_shared_sql("pairs", "plain", "plain")}
select one, two, round(shared, 6) as shared from shared where shared > {SLIVER}""")
def j13_overlapping_parcels(spark, d):
    """Pairs of a village whose plots share more than a square metre (j14 too): leaves of a quadtree, boxes, then the polygons."""
    pairs = meeting_boxes(settle(_sound(spark, d)), ["village"], 1.0, ["rings"])
    pairs = pairs.select("one", "two", shared_area("rings", "rings2").alias("shared"))
    return pairs.where(F.col("shared") > SLIVER).select("one", "two", F.round("shared", 6).alias("shared"))


@query(f"""with {land_sql("plots")}, {_corners_sql()}, {_SOUND}, {_PLAIN},
eye as (select 0 as id, * from (values ({VIEW[0]}, {VIEW[1]}, {VIEW[2]}, {VIEW[1]}), ({VIEW[2]}, {VIEW[1]}, {VIEW[2]}, {VIEW[3]}), ({VIEW[2]}, {VIEW[3]}, {VIEW[0]}, {VIEW[3]}), ({VIEW[0]}, {VIEW[3]}, {VIEW[0]}, {VIEW[1]})) t(x1, y1, x2, y2)),
pairs as (select id as one, 0 as two from sound where bx1 < {VIEW[2]} and bx2 > {VIEW[0]} and by1 < {VIEW[3]} and by2 > {VIEW[1]}),
{_shared_sql("pairs", "plain", "eye")}
select one as id, round(shared, 6) as shown from shared where shared > 1e-9""")
def j15_parcels_in_view(spark, d):
    """A box on the chart: boxes first, then how much of each polygon it shows."""
    x1, y1, x2, y2 = VIEW
    box = F.col("box")
    rows = _sound(spark, d).where((box["x1"] < x2) & (box["x2"] > x1) & (box["y1"] < y2) & (box["y2"] > y1))
    rows = rows.withColumn("shown", shared_area(F.col("rings"), polygon(((x1, y1), (x2, y1), (x2, y2), (x1, y2)))))
    return rows.where("shown > 1e-9").select("id", F.round("shown", 6).alias("shown"))


@query(f"""with {land_sql("plots")} select id, case when kind is null then 'no geometry' when kind = {BOW_TIE} then 'crosses itself' else 'sound' end as fault from plots""")
def m20_polygon_faults(spark, d):
    return _plots(spark, d).select("id", F.coalesce(polygon_fault("rings"), F.lit("sound")).alias("fault"))


@query(f"""with {land_sql("plots")}, {_corners_sql()}, {_SOUND}, {_PLAIN}, {_GROUND_SIDES},
pairs as (select id as one, 0 as two from sound),
{_shared_sql("pairs", "plain", "ground")},
own as (select id, abs(sum(x1 * y2 - x2 * y1)) / 2 as whole from sides group by 1),
frames as (select id, case when kind = 3 then s * s * 108 else whole end as whole from own join plots using (id))
select id, round(whole, 6) as whole, round(greatest(whole - coalesce(shared, 0), 0), 6) as outside from sound join frames using (id) left join shared on one = id""")
def m20_ground_outside(spark, d):
    """Area of each valid plot and of its difference with the village's ground."""
    return _outside(spark, d).select("id", F.round("whole", 6).alias("whole"), F.round("outside", 6).alias("outside"))


def _outside(spark, d):
    rows = _sound(spark, d).withColumn("whole", area("rings")).withColumn("inside", shared_area(F.col("rings"), polygon(GROUND)))
    return rows.withColumn("outside", F.greatest(F.col("whole") - F.col("inside"), F.lit(0.0)))


@query(f"""with {land_sql("plots")}, {_corners_sql()}, {_SOUND}, {_PLAIN}, {_GROUND_SIDES},
pairs as (select id as one, 0 as two from sound),
{_shared_sql("pairs", "plain", "ground")},
whole as (select id, recorded, s * s * case kind when 0 then 132 when 1 then 95 when 2 then 48 when 3 then 108 else 66 end as whole from plots where kind is not null and kind != {BOW_TIE})
select id, 'no geometry' as problem from plots where kind is null
union all select id, 'crosses itself' from plots where kind = {BOW_TIE}
union all select id, 'implausible' from plots where recorded > 135
union all select id, 'outside village' from whole left join shared on one = id where whole - coalesce(shared, 0) > {SLIVER}
union all select id, 'area differs' from whole where abs(whole - recorded) > greatest(0.05, recorded * 0.02)""")
def x15_cadastre_invariants(spark, d):
    """Checks of plots against their polygons, their records and their village's ground; overlaps are j13."""
    c = F.col
    plots = _plots(spark, d)
    problems = F.array(polygon_fault("rings"), F.when(c("recorded") > 135, "implausible"))
    first = plots.select("id", F.explode(F.array_compact(problems)).alias("problem"))
    differs = F.abs(c("whole") - c("recorded")) > F.greatest(F.lit(0.05), c("recorded") * 0.02)
    problems = F.array(F.when(c("outside") > SLIVER, "outside village"), F.when(differs, "area differs"))
    return first.unionByName(_outside(spark, d).select("id", F.explode(F.array_compact(problems)).alias("problem")))


@query(f"""with {land_sql("plots")}, {_corners_sql().replace("select id, village, x +", "select id, village, ring, x +")}, {_SOUND},
strips as (select id, village, ring, abs(sum(radians((x2 - x1) / 1000) * (2 + sin(radians(20 + y1 / 1000)) + sin(radians(20 + y2 / 1000))))) * 6371008.8 * 6371008.8 / 2 as sqm from sides group by all),
whole as (select id, village, sum(case when ring = 0 then sqm else -sqm end) as sqm from strips where id in (select id from sound) group by all)
select village, count(*) as n, round(min(sqm), 1) as least, round(max(sqm), 1) as most, round(sum(sqm) / 1e6, 3) as total from whole group by 1""")
def a39_parcel_areas(spark, d):
    """Count, least, most and sum (square kilometres) of the geodesic areas by village; a thousandth of a degree is a unit."""
    move = lambda p: F.struct((p["x"] / 1000).alias("x"), (20 + p["y"] / 1000).alias("y"))
    rows = _sound(spark, d).select("village", geodesic(F.transform("rings", lambda ring: F.transform(ring, move))).alias("sqm"))
    sizes = [F.count("*").alias("n"), F.round(F.min("sqm"), 1).alias("least"), F.round(F.max("sqm"), 1).alias("most"), F.round(F.sum("sqm") / 1e6, 3).alias("total")]
    return rows.groupBy("village").agg(*sizes)


@query(f"""with {land_sql("plots")} select village as village_id, id, kind, round(recorded, 6) as recorded from plots where village in (0, 5, 12) and kind is not null""")
def s12_features_in_scope(spark, d):
    """Plots as map features, a folder a village, read back for the villages of a scope: other folders are not opened."""
    folder = scratch(spark, "features")
    shape = F.when(F.col("kind").isNotNull(), F.struct(F.lit("Point").alias("type"), F.array("x", "y").alias("coordinates")))
    write_features(land(spark, d, "plots"), folder, F.col("village"), F.col("id"), shape, F.struct("kind", "recorded"))
    found = features(spark, folder, ["0", "5", "12"]).where("geometry is not null")
    told = F.from_json("properties", "kind int, recorded double")
    return found.select(F.col("village_id").cast("int").alias("village_id"), F.col("id").cast("long").alias("id"), told["kind"].alias("kind"), F.round(told["recorded"], 6).alias("recorded"))

"""Dashboards, histograms, ratios and roll-ups."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.values import band
from ..operators.evaluation import calibration_error, exact_percentiles, leaked, skyline
from ..operators.hierarchy import closure, rolled_up
from ..sources.tables import locations, table
from .catalogue import query
from .relational import LOCATIONS


@query("""select count(*) as total, count(*) filter (o_orderstatus = 'O') as open_, count(*) filter (o_orderpriority = '1-URGENT') as urgent,
count(distinct o_custkey) as customers, avg(o_totalprice) as average from orders""")
def a01_dashboard_cards(spark, d):
    return table(spark, d, "orders").agg(
        F.count("*").alias("total"), F.count_if(F.col("o_orderstatus") == "O").alias("open_"), F.count_if(F.col("o_orderpriority") == "1-URGENT").alias("urgent"),
        F.countDistinct("o_custkey").alias("customers"), F.avg("o_totalprice").alias("average"),
    )


@query("select o_orderstatus, count(*) as n from orders group by o_orderstatus")
def a03_group_counts(spark, d):
    return table(spark, d, "orders").groupBy("o_orderstatus").agg(F.count("*").alias("n"))


@query("""select coalesce(n_name, '?') as place, l_returnflag, count(*) as n from lineitem left join supplier on l_suppkey = s_suppkey
left join nation on s_nationkey = n_nationkey group by all""")
def a04_computed_keys(spark, d):
    rows = table(spark, d, "lineitem").groupBy("l_suppkey", "l_returnflag").agg(F.count("*").alias("n"))
    rows = rows.join(table(spark, d, "supplier"), F.col("l_suppkey") == F.col("s_suppkey"), "left").join(table(spark, d, "nation"), F.col("s_nationkey") == F.col("n_nationkey"), "left")
    return rows.groupBy(F.coalesce("n_name", F.lit("?")).alias("place"), "l_returnflag").agg(F.sum("n").alias("n"))


@query("select l_shipdate_year, n, kept from (select year(l_shipdate) as l_shipdate_year, count(*) as n, cast(sum(case when l_discount <= 0.05 then 1 else 0 end) as bigint) as kept from lineitem group by 1)")
def a06_conditional_sums(spark, d):
    return table(spark, d, "lineitem").groupBy(F.year("l_shipdate").cast("long").alias("l_shipdate_year")).agg(F.count("*").alias("n"), F.sum(F.when(F.col("l_discount") <= 0.05, 1).otherwise(0)).alias("kept"))


@query("""select l_returnflag, l_linestatus, count(*) as n, cast(sum(case when l_discount > 0 then 1 else 0 end) as bigint) as corrected
from lineitem group by grouping sets ((), (l_returnflag), (l_linestatus))""")
def a08_accuracy_report(spark, d):
    table(spark, d, "lineitem").createOrReplaceTempView("_lines")
    return spark.sql("""select l_returnflag, l_linestatus, count(*) as n, sum(case when l_discount > 0 then 1 else 0 end) as corrected
        from _lines group by grouping sets ((), (l_returnflag), (l_linestatus))""")


@query("""select user_id, avg(epoch_us(ts) - epoch_us(b)) / 1e6 as mean_seconds from (select user_id, ts, lag(ts) over (partition by user_id order by ts, event_id) as b from events)
where b is not null group by user_id""")
def a09_mean_duration(spark, d):
    from pyspark.sql import Window

    own = Window.partitionBy("user_id").orderBy("ts", "event_id")
    rows = table(spark, d, "events").select("user_id", "ts", F.lag("ts").over(own).alias("b")).where("b is not null")
    gap = F.unix_micros(F.col("ts").cast("timestamp")) - F.unix_micros(F.col("b").cast("timestamp"))
    return rows.groupBy("user_id").agg((F.avg(gap) / 1e6).alias("mean_seconds"))


@query("""select b as band, coalesce(n, 0) as n from (values ('HIGH'), ('MEDIUM'), ('LOW'), ('NONE')) v(b) left join
(select case when l_discount * 10 >= 0.85 then 'HIGH' when l_discount * 10 >= 0.6 then 'MEDIUM' else 'LOW' end as k, count(*) as n from lineitem group by 1) on b = k""")
def a11_zero_filled_bands(spark, d):
    domain = spark.createDataFrame([("HIGH",), ("MEDIUM",), ("LOW",), ("NONE",)], "band string")
    found = table(spark, d, "lineitem").groupBy(band(F.col("l_discount") * 10).alias("band")).agg(F.count("*").alias("n"))
    return domain.join(found, "band", "left").select("band", F.coalesce("n", F.lit(0)).alias("n"))


@query(f"""with recursive {LOCATIONS},
closed(id, ancestor) as (select id, id from locations union all
    select c.id, l.parent_id from closed c join locations l on l.id = c.ancestor where l.parent_id is not null),
facts as (select 'C' || o_custkey as place, o_orderstatus from orders),
counts as (select ancestor, count(*) filter (o_orderstatus = 'O') as n_open, count(*) filter (o_orderstatus = 'P') as n_pending,
    count(*) filter (o_orderstatus = 'F') as n_done, count(*) as n from facts join closed on place = id group by ancestor)
select id, level, name, coalesce(n_open, 0) as n_open, coalesce(n_pending, 0) as n_pending, coalesce(n_done, 0) as n_done, coalesce(n, 0) as n,
    coalesce(n_done / n, 0.0) as progress from locations left join counts on id = ancestor""")
def a13_progress_by_location(spark, d):
    places = locations(spark, d)
    # Counted by place before the closure multiplies rows.
    facts = table(spark, d, "orders").groupBy("o_custkey").agg(
        F.count_if(F.col("o_orderstatus") == "O").alias("n_open"), F.count_if(F.col("o_orderstatus") == "P").alias("n_pending"),
        F.count_if(F.col("o_orderstatus") == "F").alias("n_done"), F.count("*").alias("n"),
    ).withColumn("place", F.format_string("C%d", "o_custkey"))
    names = ["n_open", "n_pending", "n_done", "n"]
    counts = rolled_up(facts, closure(places), "place", [F.sum(c).alias(c) for c in names])
    rows = places.join(counts, F.col("id") == F.col("ancestor"), "left").select("id", "level", "name", *[F.coalesce(c, F.lit(0)).alias(c) for c in names])
    return rows.withColumn("progress", F.coalesce(F.try_divide("n_done", "n"), F.lit(0.0)))


@query("select o_custkey, count(*) as n, round(sum(o_totalprice), 2) as total, list_sort(list(distinct o_orderstatus)) as states from orders group by o_custkey")
def a17_citizen_summary(spark, d):
    return table(spark, d, "orders").groupBy("o_custkey").agg(F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"), F.sort_array(F.collect_set("o_orderstatus")).alias("states"))


@query("""with p as (select toxic, least(n_chars / 5000.0, 1.0) as p from labels join documents using (doc_id)),
c as (select least(floor(p * 8), 7) as b, count(*) as n, avg(p) as p, avg(toxic) as y, sum((p - toxic) ** 2) as sq from p group by 1)
select round(sum(n * abs(p - y)) / sum(n), 9) as ece, round(sum(sq) / sum(n), 9) as brier, cast(sum(n) as bigint) as n from c""")
def a27_calibration(spark, d):
    rows = table(spark, d, "labels").join(table(spark, d, "documents").select("doc_id", "n_chars"), "doc_id")
    out = calibration_error(rows, F.least(F.col("n_chars") / 5000.0, F.lit(1.0)), F.col("toxic"))
    return out.select(F.round("ece", 9).alias("ece"), F.round("brier", 9).alias("brier"), "n")


@query("""select event_type, quantile_cont(value, 0.5) as p50, quantile_cont(value, 0.95) as p95, quantile_cont(value, 0.99) as p99 from events group by event_type""")
def a29_percentiles(spark, d):
    shares = (0.5, 0.95, 0.99)
    rows = exact_percentiles(table(spark, d, "events"), "event_type", "value", shares)
    return rows.groupBy("event_type").agg(*[F.max(F.when(F.col("share") == p, F.col("value"))).alias(f"p{int(100 * p)}") for p in shares])


@query("""select event_type, count(*) filter (value <= 10) as le_10, count(*) filter (value <= 50) as le_50, count(*) filter (value <= 100) as le_100, count(*) as le_inf from events group by 1""")
def a31_cumulative_histogram(spark, d):
    return table(spark, d, "events").groupBy("event_type").agg(*[F.count_if(F.col("value") <= b).alias(f"le_{b}") for b in (10, 50, 100)], F.count("*").alias("le_inf"))


@query("select text, count(*) as n from documents group by text having count(*) > 1")
def a40_repeated_ids(spark, d):
    return table(spark, d, "documents").groupBy("text").agg(F.count("*").alias("n")).where("n > 1")


@query("select lang, n, n / sum(n) over () as share from (select lang, count(*) as n from documents group by lang)")
def a41_mix_shares(spark, d):
    from pyspark.sql import Window

    rows = table(spark, d, "documents").groupBy("lang").agg(F.count("*").alias("n"))
    # A few languages, so one task can add them up.
    return rows.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy()))


@query("""select lang, count(distinct source) as splits from documents group by lang having count(distinct source) > 1""")
def a42_split_leaks(spark, d):
    return leaked(table(spark, d, "documents"), "lang", "source")


@query("""select c_nationkey, count(*) filter (c_mktsegment = 'BUILDING') as building, count(*) filter (c_mktsegment = 'MACHINERY') as machinery from customer group by 1""")
def a47_pivot(spark, d):
    rows = table(spark, d, "customer").groupBy("c_nationkey").pivot("c_mktsegment", ["BUILDING", "MACHINERY"]).count()
    return rows.select("c_nationkey", F.coalesce("BUILDING", F.lit(0)).alias("building"), F.coalesce("MACHINERY", F.lit(0)).alias("machinery"))


@query("""select p_partkey, p_retailprice, p_size from part a where not exists (select 1 from part b where
(b.p_size >= a.p_size and b.p_retailprice < a.p_retailprice) or (b.p_size > a.p_size and b.p_retailprice <= a.p_retailprice))""")
def o11_skyline(spark, d):
    return skyline(table(spark, d, "part").select("p_partkey", "p_retailprice", "p_size"), "p_size", "p_retailprice")

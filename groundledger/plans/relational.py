"""Scans, filters, scopes, joins, hierarchy, sorts and set operations on the stand-in tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators.hierarchy import closure, descendants, in_scope
from ..operators.intervals import as_of, closed_by_next, current, latest, out_of_order, sequence_faults
from ..sources.tables import locations, table
from .catalogue import query

LOCATIONS = """
locations as (
    select 'R' || r_regionkey as id, cast(null as varchar) as parent_id, 'REGION' as level, r_name as name from region
    union all select 'N' || n_nationkey, 'R' || n_regionkey, 'NATION', n_name from nation
    union all select 'C' || c_custkey, 'N' || c_nationkey, 'CUSTOMER', c_name from customer
    union all select 'S' || s_suppkey, 'N' || s_nationkey, 'SUPPLIER', s_name from supplier)"""
SPANS = """
spans as (
    select o_custkey, o_orderkey, cast(o_orderdate as date) as valid_from,
           cast(lead(cast(o_orderdate as date)) over (partition by o_custkey order by cast(o_orderdate as date), o_orderkey) - interval 1 day as date) as valid_to
    from orders)"""


def spans(spark, d):
    """Orders as ownership spans of their customer, each ending before the next begins."""
    rows = table(spark, d, "orders").select("o_custkey", "o_orderkey", F.to_date("o_orderdate").alias("day"))
    return closed_by_next(rows, "o_custkey", "day", "o_orderkey").drop("day")


@query("select p_partkey, p_brand, p_size from part where p_partkey = 17")
def s02_point_lookup(spark, d):
    return table(spark, d, "part").where("p_partkey = 17").select("p_partkey", "p_brand", "p_size")


@query("select event_id, cast(json_extract_string(props, '$.k') as bigint) as k from events where json_extract_string(props, '$.k') is not null")
def s05_json_fields(spark, d):
    return table(spark, d, "events").select("event_id", F.get_json_object("props", "$.k").cast("long").alias("k")).where("k is not null")


@query("select c_custkey, c_name, c_mktsegment from customer where c_mktsegment = 'BUILDING' and c_acctbal >= 1000 and c_acctbal < 5000")
def f01_conjunctive_filters(spark, d):
    given = {"c_mktsegment = 'BUILDING'": True, "c_acctbal >= 1000 and c_acctbal < 5000": True, "c_nationkey = 3": False}
    rows = table(spark, d, "customer")
    for predicate, wanted in given.items():
        rows = rows.where(predicate) if wanted else rows
    return rows.select("c_custkey", "c_name", "c_mktsegment")


@query("select o_orderkey, o_orderpriority from orders where o_orderstatus in ('O', 'P') and o_orderpriority not in ('5-LOW') and o_totalprice is not null")
def f03_membership(spark, d):
    rows = table(spark, d, "orders").where(F.col("o_orderstatus").isin("O", "P") & ~F.col("o_orderpriority").isin("5-LOW") & F.col("o_totalprice").isNotNull())
    return rows.select("o_orderkey", "o_orderpriority")


@query("select p_partkey, case when trim(coalesce(p_type, '')) <> '' and p_size > 10 then 1 else 0 end as kept from part")
def f12_case_projection(spark, d):
    kept = F.when((F.trim(F.coalesce("p_type", F.lit(""))) != "") & (F.col("p_size") > 10), 1).otherwise(0)
    return table(spark, d, "part").select("p_partkey", kept.alias("kept"))


@query(f"""with recursive {LOCATIONS},
closed(id, ancestor, depth) as (select id, id, 0 from locations union all
    select c.id, l.parent_id, c.depth + 1 from closed c join locations l on l.id = c.ancestor where l.parent_id is not null)
select o_orderkey, o_custkey from orders where 'C' || o_custkey in (select id from closed where ancestor = 'R1')""")
def f08_scoped_documents(spark, d):
    scope = descendants(closure(locations(spark, d)), "R1")
    rows = table(spark, d, "orders").withColumn("place", F.format_string("C%d", "o_custkey"))
    return in_scope(rows, scope, ["place"]).select("o_orderkey", "o_custkey")


@query("""select o_orderkey, n_name, r_name from orders join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey
join region on n_regionkey = r_regionkey where o_totalprice > 200000""")
def j01_dimension_joins(spark, d):
    rows = table(spark, d, "orders").where("o_totalprice > 200000")
    rows = rows.join(table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey")).join(table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    return rows.join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select("o_orderkey", "n_name", "r_name")


@query("select c_custkey, o_orderkey from customer left join (select * from orders where o_orderstatus = 'P') on c_custkey = o_custkey")
def j03_left_history(spark, d):
    pending = table(spark, d, "orders").where("o_orderstatus = 'P'")
    return table(spark, d, "customer").join(pending, F.col("c_custkey") == F.col("o_custkey"), "left").select("c_custkey", "o_orderkey")


@query("select c_custkey from customer where c_custkey in (select o_custkey from orders where o_orderkey in (select l_orderkey from lineitem where l_quantity >= 49))")
def j06_nested_semi_join(spark, d):
    big = table(spark, d, "lineitem").where("l_quantity >= 49").select(F.col("l_orderkey").alias("o_orderkey"))
    of = table(spark, d, "orders").join(big, "o_orderkey", "left_semi").select(F.col("o_custkey").alias("c_custkey"))
    return table(spark, d, "customer").join(of, "c_custkey", "left_semi").select("c_custkey")


@query("select c_custkey from customer c where not exists (select 1 from orders o where o.o_custkey = c.c_custkey and o_orderstatus = 'P')")
def j08_anti_join(spark, d):
    pending = table(spark, d, "orders").where("o_orderstatus = 'P'").select(F.col("o_custkey").alias("c_custkey"))
    return table(spark, d, "customer").join(pending, "c_custkey", "left_anti").select("c_custkey")


@query("select distinct c_custkey, l_suppkey from customer join orders on c_custkey = o_custkey join lineitem on o_orderkey = l_orderkey where l_returnflag = 'R'")
def j09_distinct_holders(spark, d):
    rows = table(spark, d, "orders").select("o_orderkey", F.col("o_custkey").alias("c_custkey"))
    items = table(spark, d, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey"), "l_suppkey")
    return rows.join(table(spark, d, "customer").select("c_custkey"), "c_custkey", "left_semi").join(items, "o_orderkey").select("c_custkey", "l_suppkey").distinct()


@query(f"with {SPANS} select o_custkey, o_orderkey from spans where valid_from <= date '1996-06-30' and (valid_to is null or valid_to >= date '1996-06-30')")
def j10_as_of(spark, d):
    return spans(spark, d).where(as_of(F.lit("1996-06-30").cast("date"))).select("o_custkey", "o_orderkey")


@query("""select p_partkey, cast(n - 1 as bigint) as twins from (select p_partkey, count(*) over (partition by p_brand, p_type, p_size) as n from part) where n > 1""")
def j12_same_key_twins(spark, d):
    n = table(spark, d, "part").groupBy("p_brand", "p_type", "p_size").agg(F.count("*").alias("n")).where("n > 1")
    return table(spark, d, "part").join(n, ["p_brand", "p_type", "p_size"]).select("p_partkey", (F.col("n") - 1).alias("twins"))


@query("""select 'lineitem.orders' as edge, count(*) as missing from lineitem where l_orderkey not in (select o_orderkey from orders)
union all select 'orders.customer', count(*) from orders where o_custkey not in (select c_custkey from customer)
union all select 'labels.documents', count(*) from labels where doc_id not in (select doc_id from documents)
union all select 'customer.nation', count(*) from customer where c_nationkey not in (select n_nationkey from nation)""")
def j29_missing_references(spark, d):
    edges = [("lineitem", "l_orderkey", "orders", "o_orderkey"), ("orders", "o_custkey", "customer", "c_custkey"), ("labels", "doc_id", "documents", "doc_id"), ("customer", "c_nationkey", "nation", "n_nationkey")]
    out = None
    for child, fk, parent, pk in edges:
        rows = table(spark, d, child).select(F.col(fk).alias("k")).join(table(spark, d, parent).select(F.col(pk).alias("k")), "k", "left_anti")
        one = rows.agg(F.count("*").alias("missing")).select(F.lit(f"{child}.{parent}").alias("edge"), "missing")
        out = one if out is None else out.unionByName(one)
    return out


@query(f"""with recursive {LOCATIONS},
closed(id, ancestor, depth) as (select id, id, 0 from locations union all
    select c.id, l.parent_id, c.depth + 1 from closed c join locations l on l.id = c.ancestor where l.parent_id is not null)
select * from closed""")
def h02_ancestor_closure(spark, d):
    return closure(locations(spark, d))


@query(f"with {SPANS} select o_custkey, count(*) as open_spans from spans where valid_to is null group by o_custkey")
def w12_open_spans(spark, d):
    return spans(spark, d).where(current()).groupBy("o_custkey").agg(F.count("*").alias("open_spans"))


@query(f"""with {SPANS}, d as (select distinct o_custkey, valid_from, valid_to from spans),
n as (select *, lead(valid_from) over (partition by o_custkey order by valid_from, valid_to nulls last) as nxt from d),
f as (select *, case when valid_to < valid_from then 'INVERTED' when nxt is null then null when valid_to is null or nxt <= valid_to then 'OVERLAP'
    when nxt > valid_to + interval 1 day then 'GAP' end as fault from n)
select o_custkey, valid_from, fault from f where fault is not null""")
def w04_span_faults(spark, d):
    return sequence_faults(spans(spark, d), "o_custkey")


@query("""select o_custkey, o_orderkey, o_totalprice from (select *, row_number() over (partition by o_custkey order by o_orderdate desc, o_orderkey desc) as n from orders) where n = 1""")
def w01_latest_per_key(spark, d):
    return latest(table(spark, d, "orders"), ["o_custkey"], [F.desc("o_orderdate"), F.desc("o_orderkey")]).select("o_custkey", "o_orderkey", "o_totalprice")


@query("""select o_custkey, o_orderkey from (select *, row_number() over (partition by o_custkey order by o_totalprice desc, o_orderkey) as n from orders) where n <= 5""")
def w16_newest_five(spark, d):
    return latest(table(spark, d, "orders"), ["o_custkey"], [F.desc("o_totalprice"), F.col("o_orderkey")], 5).select("o_custkey", "o_orderkey")


@query("""select o_custkey, o_orderkey from (select *, lag(o_orderdate) over (partition by o_custkey order by o_orderkey) as b from orders) where o_orderdate < b""")
def w03_out_of_order(spark, d):
    return out_of_order(table(spark, d, "orders"), "o_custkey", "o_orderkey", "o_orderdate").select("o_custkey", "o_orderkey")


@query("select o_orderkey, o_orderpriority, o_totalprice from orders where o_orderstatus = 'O' order by o_orderpriority, o_totalprice nulls last, o_orderkey limit 50")
def o02_work_queue(spark, d):
    rows = table(spark, d, "orders").where("o_orderstatus = 'O'").select("o_orderkey", "o_orderpriority", "o_totalprice")
    return rows.orderBy("o_orderpriority", F.col("o_totalprice").asc_nulls_last(), "o_orderkey").limit(50)


@query("select o_orderkey, o_totalprice from orders order by o_totalprice desc nulls first, o_orderkey limit 100")
def o04_top_scores(spark, d):
    return table(spark, d, "orders").select("o_orderkey", "o_totalprice").orderBy(F.col("o_totalprice").desc_nulls_first(), "o_orderkey").limit(100)


@query("""select p_partkey from part where p_size > 45 union select l_partkey from lineitem where l_quantity = 50""")
def u02_union_of_findings(spark, d):
    parts = table(spark, d, "part").where("p_size > 45").select("p_partkey")
    return parts.union(table(spark, d, "lineitem").where("l_quantity = 50").select("l_partkey")).distinct()


@query("select l_suppkey from lineitem where l_returnflag = 'R' intersect select l_suppkey from lineitem where l_returnflag = 'A'")
def u03_intersection(spark, d):
    rows = table(spark, d, "lineitem")
    return rows.where("l_returnflag = 'R'").select("l_suppkey").intersect(rows.where("l_returnflag = 'A'").select("l_suppkey"))


@query("select o_orderstatus as source, 'P' as target, count(*) as n from orders where o_orderstatus <> 'P' group by 1")
def h04_transition_counts(spark, d):
    rows = table(spark, d, "orders").where("o_orderstatus <> 'P'").groupBy(F.col("o_orderstatus").alias("source")).agg(F.count("*").alias("n"))
    return rows.select("source", F.lit("P").alias("target"), "n")

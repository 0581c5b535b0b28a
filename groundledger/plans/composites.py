"""Rules, reconciliation, audit chain and evaluation composites."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators.evaluation import confusion, with_scores
from ..sources.sinks import insert_absent, reconcile_flags, upsert
from ..sources.tables import table
from .catalogue import query


@query("""with flags as (select p_partkey, case when p_size % 2 = 0 then 'A' else 'B' end as kind, case when p_size % 7 = 0 then 'DISMISSED' when p_size % 5 = 0 then 'RESOLVED' else 'OPEN' end as status from part where p_size <= 30),
signals as (select p_partkey, case when p_size % 3 = 0 then 'A' else 'B' end as kind from part where p_size >= 20)
select coalesce(f.p_partkey, s.p_partkey) as p_partkey, coalesce(f.kind, s.kind) as kind,
case when f.p_partkey is null then 'OPEN' when status = 'DISMISSED' then 'DISMISSED' when s.p_partkey is not null then 'OPEN'
     when status = 'OPEN' and f.kind = 'A' then 'RESOLVED' else status end as status
from flags f full join signals s on f.p_partkey = s.p_partkey and f.kind = s.kind""")
def k13_flag_reconciliation(spark, d):
    part = table(spark, d, "part")
    flags = part.where("p_size <= 30").selectExpr("p_partkey", "case when p_size % 2 = 0 then 'A' else 'B' end as kind", "case when p_size % 7 = 0 then 'DISMISSED' when p_size % 5 = 0 then 'RESOLVED' else 'OPEN' end as status")
    signals = part.where("p_size >= 20").selectExpr("p_partkey", "case when p_size % 3 = 0 then 'A' else 'B' end as kind")
    return reconcile_flags(flags, signals, ["p_partkey", "kind"], ["A"])


@query("""select c_custkey, c_acctbal from customer where c_custkey % 3 <> 0 union all select c_custkey, c_acctbal + 100 from customer where c_custkey % 3 = 0""")
def k09_upsert(spark, d):
    old = table(spark, d, "customer").select("c_custkey", "c_acctbal")
    return upsert(old, old.where("c_custkey % 3 = 0").withColumn("c_acctbal", F.col("c_acctbal") + 100), "c_custkey")


@query("select o_orderkey, sha256(o_orderkey || ':' || o_orderstatus) as digest from orders where o_orderstatus <> 'F'")
def k14_insert_absent(spark, d):
    rows = table(spark, d, "orders").select("o_orderkey", F.sha2(F.concat_ws(":", "o_orderkey", "o_orderstatus"), 256).alias("digest"), "o_orderstatus")
    return insert_absent(rows.where("o_orderstatus = 'F'").select("o_orderkey", "digest"), rows.select("o_orderkey", "digest"), ["o_orderkey", "digest"])


@query("""with t as (select distinct l_returnflag as field, l_orderkey, l_linenumber from lineitem where l_discount > 0.02),
f as (select distinct l_returnflag as field, l_orderkey, l_linenumber from lineitem where l_tax > 0.03),
c as (select coalesce(t.field, f.field) as field, count(*) filter (t.field is not null and f.field is not null) as tp, count(*) filter (t.field is null) as fp, count(*) filter (f.field is null) as fn
from t full join f on t.field = f.field and t.l_orderkey = f.l_orderkey and t.l_linenumber = f.l_linenumber group by 1)
select *, tp / (tp + fp) as "precision", tp / (tp + fn) as recall from c""")
def a23_confusion(spark, d):
    rows = table(spark, d, "lineitem").withColumn("field", F.col("l_returnflag"))
    keys = ["field", "l_orderkey", "l_linenumber"]
    return with_scores(confusion(rows.where("l_discount > 0.02"), rows.where("l_tax > 0.03"), keys, "field")).drop("f1")

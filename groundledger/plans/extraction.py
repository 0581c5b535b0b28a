"""Extraction merges, word assignment, readings of Devanagari and job admission over stand-ins."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.transliteration import to_english, transliterate
from ..operators.extraction import missing_fields, model_over_rules, words_of_fields
from ..operators.jobs import admitted_jobs, expired_jobs
from ..sources.tables import table
from .catalogue import query
from .pages import boxes

#: Devanagari stand-ins: the letters of the parts' names put into another script.
_LATIN, _DEVANAGARI = "abcdefghijklmnopqrstuvwxyz", "ाबचदेफगहिजकलमनोपखरसतुवशषयझ"

_LINES = "l as (select l_orderkey as doc, concat('F', l_suppkey % 5) as field, l_partkey * 100000 + l_suppkey as n, l_discount as confidence, l_partkey as value, l_returnflag as flag from lineitem)"


def _values(spark, d):
    return table(spark, d, "lineitem").selectExpr("l_orderkey as doc", "concat('F', l_suppkey % 5) as field", "l_partkey * 100000 + l_suppkey as n", "l_discount as confidence", "l_partkey as value", "l_returnflag as flag")


@query(f"""with {_LINES}, v as (select doc, field, n, confidence, value, flag = 'N' as by_model from l where value % 10 <> 0 and (flag <> 'N' or confidence >= 0.03)),
r as (select *, max(by_model) over (partition by doc, field) as m, row_number() over (partition by doc, field order by by_model desc, confidence desc, n) as k from v)
select doc, field, n, confidence, value, by_model from r where case when m then by_model and (field in ('F0', 'F3') or k = 1) else true end""")
def x09_model_over_rules(spark, d):
    rows = _values(spark, d)
    args = ("doc", "field", "confidence", "n", ["F0", "F3"], 0.03, F.col("value") % 10 != 0)
    return model_over_rules(rows.where("flag = 'N'").drop("flag"), rows.where("flag <> 'N'").drop("flag"), *args)


@query(f"""with {_LINES}, e as (select unnest(['F0', 'F1', 'F2']) as field), d as (select distinct doc from l)
select doc, list(e.field order by e.field) as missing from d cross join e where not exists (select 1 from l where l.doc = d.doc and l.field = e.field) group by doc""")
def x07_missing_fields(spark, d):
    rows = _values(spark, d)
    return missing_fields(rows, rows, "doc", "field", ["F2", "F0", "F1"])


@query()
def j22_words_of_fields(spark, d):
    b = boxes(spark, d)
    fields = b.where("n % 3 = 0").selectExpr("page", "n", "flag as field", "x1 - 60 as x1", "y1 - 20 as y1", "x2 + 60 as x2", "y2 + 20 as y2")
    return words_of_fields(b.where("n % 3 <> 0"), fields, "page", "field")


@query()
def t23_transliteration(spark, d):
    name = F.translate(F.lower("p_name"), _LATIN, _DEVANAGARI)
    return table(spark, d, "part").select("p_partkey", transliterate(name).alias("latin"))


@query()
def t24_english_reading(spark, d):
    name = F.concat(F.lit("ग्राम "), F.translate(F.lower("p_name"), _LATIN, _DEVANAGARI))
    return table(spark, d, "part").select("p_partkey", to_english(name).alias("r")).select("p_partkey", "r.*")


@query("""with n as (select max(ts) as now from events)
select event_id, event_type in ('click', 'view') and ts < now - interval 10 minute as failed from events, n""")
def z06_expired_jobs(spark, d):
    jobs = table(spark, d, "events")
    now = jobs.agg(F.max("ts")).first()[0]
    return expired_jobs(jobs, F.col("event_type").isin("click", "view"), "ts", F.lit(now)).select("event_id", "failed")


@query("""with a as (select distinct user_id from events where event_type = 'purchase' and user_id % 4 = 0),
f as (select user_id, min(ts) as ts from events where event_type <> 'purchase' and user_id not in (select user_id from a) group by 1)
select user_id, ts from f order by ts, user_id limit (select greatest(0, 32 - count(*)) from a)""")
def z06_admitted_jobs(spark, d):
    events = table(spark, d, "events")
    active = events.where("event_type = 'purchase' and user_id % 4 = 0").select("user_id").distinct()
    return admitted_jobs(active, events.where("event_type <> 'purchase'"), "user_id", "ts")

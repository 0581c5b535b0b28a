"""Row security, roles, guards, and listings with their filters on the land-record views."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.values import trigram_similarity
from ..operators.groups import others
from ..operators.hierarchy import closure, descendants
from ..operators.scopes import deeds_within, flags_within, grievances_within, parcels_of, within
from ..sources.land import land, land_sql
from .catalogue import query

ROOT = "R1"
_SCOPE = f"""{land_sql("places", "parcels", "deeds", "flags", "grievances", "holdings", "readings", "corrections")},
    scope as (with recursive s(id) as (select '{ROOT}' union all select p.id from places p join s on p.parent_id = s.id) select id from s),
    own as (select parcel_id from parcels where village_id in (select id from scope)),
    seen as (select * from deeds where (village_id is null or village_id in (select id from scope)) and (parcel_id is null or parcel_id in (select parcel_id from own))
        and (village_id is not null or parcel_id is not null))"""


def _scope(spark, d):
    return descendants(closure(land(spark, d, "places")), ROOT)


@query(f"with {_SCOPE} select deed_id, village_id, parcel_id from seen")
def f08_documents_in_scope(spark, d):
    return deeds_within(land(spark, d, "deeds"), land(spark, d, "parcels"), _scope(spark, d)).select("deed_id", "village_id", "parcel_id")


@query("select o_orderkey as deed_id from orders where false")
def f08_empty_scope(spark, d):
    """An officer without a jurisdiction sees nothing."""
    return deeds_within(land(spark, d, "deeds"), land(spark, d, "parcels"), _scope(spark, d).where("false")).select("deed_id")


@query(f"""with {_SCOPE} select flag_id from flags where (deed_id is null or deed_id in (select deed_id from seen)) and (parcel_id is null or parcel_id in (select parcel_id from own))
and (deed_id is not null or parcel_id is not null)""")
def f09_flags_in_scope(spark, d):
    return flags_within(land(spark, d, "flags"), land(spark, d, "deeds"), land(spark, d, "parcels"), _scope(spark, d)).select("flag_id")


@query(f"""with {_SCOPE} select grievance_id from grievances where parcel_id in (select parcel_id from own)
or (parcel_id is null and raised_by in (select owner_id from holdings where parcel_id in (select parcel_id from own)))""")
def f10_grievances_in_scope(spark, d):
    return grievances_within(land(spark, d, "grievances"), land(spark, d, "parcels"), land(spark, d, "holdings"), _scope(spark, d)).select("grievance_id")


@query(f"with {land_sql('holdings')} select distinct parcel_id from holdings where owner_id = 7 and valid_from <= date '1998-06-30' and (valid_to is null or valid_to >= date '1998-06-30')")
def f11_parcels_of_citizen(spark, d):
    return parcels_of(land(spark, d, "holdings"), F.lit(7), F.lit("1998-06-30").cast("date"))


@query("select event_id from events where ts >= (select date_trunc('day', max(ts)) from events)")
def f13_today(spark, d):
    rows = land(spark, d, "events").select("event_id", "ts")
    now = rows.agg(F.max("ts").alias("now"))  # one row
    return rows.join(F.broadcast(now), F.col("ts") >= F.date_trunc("day", "now")).select("event_id")


_RULES = "(select * from (values ('1-URGENT', 'approve'), ('1-URGENT', 'read'), ('2-HIGH', 'verify'), ('2-HIGH', 'read'), ('3-MEDIUM', 'read'), ('5-LOW', 'read')) r(role, may))"


@query(f"""with {land_sql("deeds")}, g as (select uploader_id, list_sort(list(distinct may)) as permissions from deeds join {_RULES} on role = priority group by 1)
select uploader_id, permissions, list_contains(permissions, 'approve') as may_approve, len(list_intersect(permissions, ['verify', 'approve'])) > 0 as may_any from g""")
def f16_permissions(spark, d):
    rules = [("1-URGENT", "approve"), ("1-URGENT", "read"), ("2-HIGH", "verify"), ("2-HIGH", "read"), ("3-MEDIUM", "read"), ("5-LOW", "read")]
    rows = land(spark, d, "deeds").select("uploader_id", F.col("priority").alias("role")).distinct()
    rows = rows.join(spark.createDataFrame(rules, "role string, may string"), "role").groupBy("uploader_id").agg(F.sort_array(F.collect_set("may")).alias("permissions"))
    return rows.select("uploader_id", "permissions", F.array_contains("permissions", "approve").alias("may_approve"), F.arrays_overlap("permissions", F.array(F.lit("verify"), F.lit("approve"))).alias("may_any"))


@query(f"with {land_sql('flags')} select flag_id, kind from flags where kind = 'AREA_JUMP' and contains(lower(parcel_id), 'p1') and score >= 0.2 and score < 0.6")
def f17_queue_filters(spark, d):
    c = F.col
    return land(spark, d, "flags").where((c("kind") == "AREA_JUMP") & F.lower("parcel_id").contains("p1") & (c("score") >= 0.2) & (c("score") < 0.6)).select("flag_id", "kind")


@query(f"with {land_sql('flags')} select distinct kind from flags")
def f17_distinct_kinds(spark, d):
    return land(spark, d, "flags").select("kind").distinct()


@query(f"with {land_sql('places', 'parcels')} select parcel_id from parcels where village_id in (select id from places where parent_id = 'R2') and area_value > 5")
def s12_pushed_then_rechecked(spark, d):
    """Villages are asked for by name, and what comes back is checked against the scope again, as for f18."""
    villages = land(spark, d, "places").where("parent_id = 'R2'").select("id")
    asked = land(spark, d, "parcels").where("area_value > 5").join(villages.withColumnRenamed("id", "village_id"), "village_id", "left_semi")
    return within(asked, {"village_id": villages}).select("parcel_id")


@query("select c_custkey from customer where sha256(c_name) in (select sha256(c_name) from customer where c_custkey % 10 = 3)")
def f19_key_digests(spark, d):
    keys = land(spark, d, "customer").select("c_custkey", F.sha2("c_name", 256).alias("digest"))
    return keys.join(keys.where("c_custkey % 10 = 3").select("digest"), "digest", "left_semi").select("c_custkey")


@query(f"""with {_SCOPE} select deed_id, exists (select 1 from readings r where r.deed_id = s.deed_id and status = 'CORRECTED') or exists (select 1 from corrections c where c.deed_id = s.deed_id) as refused from seen s""")
def f20_touched_guard(spark, d):
    deeds = deeds_within(land(spark, d, "deeds"), land(spark, d, "parcels"), _scope(spark, d)).select("deed_id")
    touched = land(spark, d, "readings").where("status = 'CORRECTED'").select("deed_id").unionAll(land(spark, d, "corrections").select("deed_id")).distinct()
    return deeds.join(touched.withColumn("refused", F.lit(True)), "deed_id", "left").select("deed_id", F.coalesce("refused", F.lit(False)).alias("refused"))


@query(f"with {land_sql('readings')} select deed_id, list_sort(list(distinct field)) as outstanding from readings where status = 'NEEDS_REVIEW' group by 1")
def f21_outstanding_fields(spark, d):
    return land(spark, d, "readings").where("status = 'NEEDS_REVIEW'").groupBy("deed_id").agg(F.sort_array(F.collect_set("field")).alias("outstanding"))


@query(f"""with {land_sql("readings", "deeds", "parcels")} select deed_id, line, confidence from readings join deeds using (deed_id) left join parcels using (parcel_id)
where (status = 'NEEDS_REVIEW' or confidence < 0.6) and (deeds.village_id = 'N3' or parcels.village_id = 'N3') order by confidence, deed_id, line limit 25""")
def f22_low_confidence(spark, d):
    home = land(spark, d, "parcels").select("parcel_id", F.col("village_id").alias("home"))
    deeds = land(spark, d, "deeds").join(home, "parcel_id", "left").where("village_id = 'N3' or home = 'N3'").select("deed_id")
    rows = land(spark, d, "readings").where("status = 'NEEDS_REVIEW' or confidence < 0.6").join(deeds, "deed_id", "left_semi")
    return rows.orderBy("confidence", "deed_id", "line").limit(25).select("deed_id", "line", "confidence")


@query(f"with {land_sql('parcels')} select parcel_id, village_id, area_value from parcels where area_unit = 'ACRE'")
def f02_allowed_columns(spark, d):
    allowed = [c for c in land(spark, d, "parcels").columns if c not in ("khasra", "khata", "area_unit")]
    return land(spark, d, "parcels").where("area_unit = 'ACRE'").select(*allowed)


_TRI = """len(list_intersect({a}, {b})) / len(list_distinct(list_concat({a}, {b})))"""
_GRAMS = """list_distinct(flatten(list_transform(list_filter(string_split_regex(lower({}), '[^a-z0-9]+'), lambda w: w <> ''), lambda w: list_transform(range(1, len(w) + 2), lambda k: substr('  ' || w || ' ', k, 3)))))"""


@query(f"""with g as (select c_custkey, c_name, {_GRAMS.format("c_name")} as a, {_GRAMS.format("'customer 42'")} as b from customer)
select c_custkey, c_name from g where contains(lower(c_name), '42') or {_TRI.format(a="a", b="b")} > 0.3""")
def f06_name_search(spark, d):
    name = F.col("c_name")
    return land(spark, d, "customer").where(name.ilike("%42%") | (trigram_similarity(name, F.lit("customer 42")) > 0.3)).select("c_custkey", "c_name")


@query(f"""with {land_sql("parcels", "holdings", "places")} select distinct parcel_id, village, owner_id, owner from (
select p.parcel_id, l.name as village, h.owner_id, o.c_name as owner from parcels p join places l on l.id = p.village_id join holdings h on h.parcel_id = p.parcel_id
join customer o on o.c_custkey = h.owner_id where h.valid_to is null and p.area_value > 3) order by parcel_id, owner_id limit 200""")
def j02_owner_search(spark, d):
    """Ownership and owners join only when an owner is asked for; distinct rows in order, 200 at most."""
    by_owner = True
    rows = land(spark, d, "parcels").where("area_value > 3").select("parcel_id", "village_id")
    rows = rows.join(land(spark, d, "places").select(F.col("id").alias("village_id"), F.col("name").alias("village")), "village_id")
    if by_owner:
        rows = rows.join(land(spark, d, "holdings").where("valid_to is null").select("parcel_id", "owner_id"), "parcel_id")
        rows = rows.join(land(spark, d, "customer").select(F.col("c_custkey").alias("owner_id"), F.col("c_name").alias("owner")), "owner_id")
    return rows.select("parcel_id", "village", "owner_id", "owner").distinct().orderBy("parcel_id", "owner_id").limit(200)


@query(f"""with {land_sql("flags", "deeds", "parcels")} select flag_id, d.state, p.khasra from flags f left join deeds d using (deed_id) left join parcels p on p.parcel_id = coalesce(f.parcel_id, d.parcel_id)""")
def j04_flags_with_sides(spark, d):
    deeds = land(spark, d, "deeds").select("deed_id", "state", F.col("parcel_id").alias("via"))
    rows = land(spark, d, "flags").join(deeds, "deed_id", "left").withColumn("parcel_id", F.coalesce("parcel_id", "via"))
    return rows.join(land(spark, d, "parcels").select("parcel_id", "khasra"), "parcel_id", "left").select("flag_id", "state", "khasra")


@query(f"""with {land_sql("grievances", "parcels")} select grievance_id, khasra, c_name from grievances left join parcels using (parcel_id) join customer on c_custkey = raised_by""")
def j05_grievances_with_users(spark, d):
    users = land(spark, d, "customer").select(F.col("c_custkey").alias("raised_by"), "c_name")
    rows = land(spark, d, "grievances").join(land(spark, d, "parcels").select("parcel_id", "khasra"), "parcel_id", "left")
    return rows.join(users, "raised_by").select("grievance_id", "khasra", "c_name")


@query("select c_custkey, c_name from customer where c_name = (select min(c_name) from customer)")
def s03_unique_lookup(spark, d):
    """By a secondary key that may find one row at most; more raise an error in the task that meets them."""
    name = land(spark, d, "customer").agg(F.min("c_name").alias("c_name"))
    rows = land(spark, d, "customer").join(F.broadcast(name), "c_name").select("c_custkey", "c_name")  # one row
    many = rows.groupBy("c_name").agg(F.count("*").alias("n"), F.min("c_custkey").alias("c_custkey"))
    return many.select(F.when(F.col("n") > 1, F.raise_error(F.lit("several rows of one key"))).otherwise(F.col("c_custkey")).alias("c_custkey"), "c_name")


@query(f"with {land_sql('flags')} select flag_id, score from flags order by score desc nulls last, flag_id limit 25")
def o03_top_scores(spark, d):
    return land(spark, d, "flags").select("flag_id", "score").orderBy(F.col("score").desc_nulls_last(), "flag_id").limit(25)


@query(f"with {land_sql('parcels')} select distinct village_id, area_unit from parcels order by village_id, area_unit limit 200")
def o05_distinct_ordered(spark, d):
    return land(spark, d, "parcels").select("village_id", "area_unit").distinct().orderBy("village_id", "area_unit").limit(200)


@query(f"with {land_sql('corrections')} select correction_id, confidence from corrections where not reviewed order by confidence desc, correction_id limit 50")
def o07_priority_pool(spark, d):
    return land(spark, d, "corrections").where("not reviewed").select("correction_id", "confidence").orderBy(F.desc("confidence"), "correction_id").limit(50)


@query(f"with {land_sql('deeds')} select deed_id, parcel_id from deeds order by coalesce(village_id, ''), coalesce(parcel_id, ''), deed_id limit 100")
def o08_nulls_as_empty(spark, d):
    rows = land(spark, d, "deeds").orderBy(F.coalesce("village_id", F.lit("")), F.coalesce("parcel_id", F.lit("")), "deed_id")
    return rows.limit(100).select("deed_id", "parcel_id")


@query("select event_id, ts from events where event_type in ('error', 'click') and value < 40 order by ts, event_id limit 20")
def o09_due_queue(spark, d):
    """First in, first out; Spark has a single writer, so nothing is locked."""
    return land(spark, d, "events").where("event_type in ('error', 'click') and value < 40").orderBy("ts", "event_id").limit(20).select("event_id", "ts")


@query("select level, name from (select 'REGION' as level, r_name as name, 0 as k from region union all select 'NATION', n_name, 1 from nation) order by k, name limit 15")
def w13_level_order(spark, d):
    rank = F.create_map(F.lit("REGION"), F.lit(0), F.lit("NATION"), F.lit(1))
    rows = land(spark, d, "places").where("level in ('REGION', 'NATION')")
    return rows.orderBy(F.try_element_at(rank, F.col("level")), "name").limit(15).select("level", "name")


@query(f"with {land_sql('deeds')} select village_id, count(*) as documents from deeds where village_id is not null group by 1 order by 2 desc, 1 limit 10")
def o13_chart_order(spark, d):
    rows = land(spark, d, "deeds").where("village_id is not null").groupBy("village_id").agg(F.count("*").alias("documents"))
    return rows.orderBy(F.desc("documents"), "village_id").limit(10)


@query("select event_id from events order by ts, event_id desc limit 30")
def s15_pending_first(spark, d):
    return land(spark, d, "events").select("event_id", "ts").orderBy("ts", F.desc("event_id")).limit(30).select("event_id")


@query("select doc_id, n_chars from documents order by doc_id limit 2000")
def s14_bounded_scan(spark, d):
    """The corpus that a report may look at has 2000 rows at most."""
    return land(spark, d, "documents").select("doc_id", "n_chars").orderBy("doc_id").limit(2000)


@query(f"with {land_sql('parcels')} select parcel_id, list_filter(others, lambda x: x <> parcel_id) as others from (select parcel_id, list_sort(list(parcel_id) over (partition by village_id, khasra)) as others from parcels) where len(others) > 1")
def u07_others(spark, d):
    return others(land(spark, d, "parcels"), ["village_id", "khasra"], "parcel_id")

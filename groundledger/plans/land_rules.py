"""Validation, cross-reference and anomaly rules, ownership and the audit chain on the land-record views."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators.anomaly import FEATURES, evaluable, feature_rows, parcel_records, parcel_signals
from ..operators.evaluation import chain_problems, chained
from ..operators.hierarchy import closure
from ..operators.intervals import legal_transitions, whole_at_pivots
from ..operators.validation import FIELDS, cross_findings, field_values, field_worth, matched_parcels, validation_findings, whole_shares
from ..sources.land import land, land_sql
from .catalogue import query

TODAY, YEAR = "2001-12-31", 2001
_KEY = r"regexp_replace(lower(trim(nfc_normalize({}))), '[\s.,;:।|/\\-]+', '', 'g')"
_SQM = """case {} when 'BIGHA' then 2529.285 when 'BISWA' then 126.46425 when 'ACRE' then 4046.86 when 'HECTARE' then 10000.0
    when 'SQUARE_METRE' then 1.0 when 'GUNTHA' then 101.1715 when 'CENT' then 40.4686 end"""
_WIDE = "wide as (select deed_id, " + ", ".join(f"max(v) filter (field = '{f}') as {f}" for f in FIELDS) + """
    from (select deed_id, field, nullif(trim(coalesce(corrected, value)), '') as v from readings) group by deed_id)"""
_SHARES = r"""shares as (select parcel_id, list(share) as shares from holdings where valid_to is null group by parcel_id),
    summed as (select parcel_id, len(list_filter(shares, lambda x: not regexp_full_match(x, '\s*\d+\s*(/\s*0*[1-9]\d*\s*)?'))) as bad,
        list_transform(shares, lambda x: try_cast(split_part(x, '/', 1) as bigint)) as nums, list_transform(shares, lambda x: coalesce(nullif(try_cast(split_part(x, '/', 2) as bigint), 0), 1)) as dens from shares),
    whole as (select parcel_id, bad, list_sum(list_transform(list_zip(nums, dens), lambda p: p[1] * (list_reduce(dens, lambda a, b: lcm(a, b)) // p[2]))) = list_reduce(dens, lambda a, b: lcm(a, b)) as one from summed)"""
_FACTS = f"""{land_sql("readings", "deeds", "holdings", "parcels")}, {_WIDE}, {_SHARES},
    facts as (select w.*, d.declared_khasra, p.area_value as previous_area, s.bad, s.one, try_cast(w.AREA as double) as n,
        case when regexp_full_match(w.DATE, '\\d{{4}}-\\d{{2}}-\\d{{2}}') then try_cast(w.DATE as date) end as day
        from wide w join deeds d using (deed_id) left join parcels p on p.parcel_id = d.parcel_id left join whole s on s.parcel_id = d.parcel_id)"""
_FINDINGS = f"""{_FACTS}, found as (
    select deed_id, 'REQUIRED_FIELD_MISSING' as rule, 'error' as severity, 'VILLAGE' as field from facts where VILLAGE is null
    union all select deed_id, 'REQUIRED_FIELD_MISSING', 'error', 'KHASRA' from facts where KHASRA is null
    union all select deed_id, 'MALFORMED_KHASRA', 'warning', 'KHASRA' from facts where not regexp_full_match(KHASRA, '\\d{{1,5}}(/\\d{{1,3}})*')
    union all select deed_id, 'MALFORMED_KHATA', 'warning', 'KHATA' from facts where not regexp_full_match(KHATA, '\\d{{1,6}}')
    union all select deed_id, 'MALFORMED_AREA', 'warning', 'AREA' from facts where AREA is not null and n is null
    union all select deed_id, 'IMPLAUSIBLE_AREA', 'warning', 'AREA' from facts where coalesce(AREA_UNIT, 'BIGHA') = 'BIGHA' and (n < 0.01 or n > 200)
    union all select deed_id, 'INVALID_DATE', 'warning', 'DATE' from facts where DATE is not null and day is null
    union all select deed_id, 'FUTURE_DATE', 'warning', 'DATE' from facts where day > date '{TODAY}'
    union all select deed_id, 'IMPLAUSIBLE_DATE', 'info', 'DATE' from facts where year(day) < 1900
    union all select deed_id, 'MALFORMED_SHARE', 'warning', 'SHARE' from facts where bad > 0
    union all select deed_id, 'SHARES_DO_NOT_TOTAL_ONE', 'warning', 'SHARE' from facts where bad = 0 and not one
    union all select deed_id, 'DECLARED_KHASRA_MISMATCH', 'warning', 'KHASRA' from facts where declared_khasra <> KHASRA
    union all select deed_id, 'AREA_CHANGE_THRESHOLD', 'warning', 'AREA' from facts where previous_area > 0 and n > 0 and greatest(n, previous_area) / least(n, previous_area) >= 3 and n is not null and MUTATION is null)"""


def _findings(spark, d):
    shares = whole_shares(land(spark, d, "holdings").where("valid_to is null"), "parcel_id")
    area = land(spark, d, "parcels").select("parcel_id", F.col("area_value").alias("previous_area"))
    rows = field_values(land(spark, d, "readings")).join(land(spark, d, "deeds").select("deed_id", "parcel_id", "declared_khasra"), "deed_id")
    return validation_findings(rows.join(area, "parcel_id", "left").join(shares, "parcel_id", "left"), F.lit(TODAY).cast("date"))


@query(f"with {_FINDINGS} select * from found")
def x01_validation_findings(spark, d):
    return _findings(spark, d)


@query(f"""with {_FINDINGS}, worst as (select deed_id, field, max(case severity when 'error' then 3 when 'warning' then 2 else 1 end) as r from found group by all),
of as (select distinct deed_id, field from readings)
select o.deed_id, o.field, case r when 3 then 0.05 when 2 then 0.45 when 1 then 0.75 else 0.85 end as worth from of o left join worst w on o.deed_id = w.deed_id and o.field = w.field""")
def m09_validation_confidence(spark, d):
    return field_worth(_findings(spark, d), land(spark, d, "readings").select("deed_id", "field").distinct())


_MATCH = f"""keyed as (select *, {_KEY.format("khasra")} as key from parcels),
    sought as (select w.deed_id, coalesce(d.village_id, p.village_id) as village_id, w.KHASRA as khasra, {_KEY.format("w.KHASRA")} as key, d.parcel_id
        from wide w join deeds d using (deed_id) left join parcels p on p.parcel_id = d.parcel_id),
    matched as (select s.*, coalesce((select min(k.parcel_id) from keyed k where k.village_id = s.village_id and k.khasra = s.khasra),
        (select min(k.parcel_id) from keyed k where k.village_id = s.village_id and k.key = s.key)) as matched_id from sought s)"""


def _sought(spark, d):
    home = land(spark, d, "parcels").select("parcel_id", F.col("village_id").alias("home"))
    deeds = land(spark, d, "deeds").select("deed_id", "village_id", "parcel_id").join(home, "parcel_id", "left")
    wide = field_values(land(spark, d, "readings"))
    rows = wide.join(deeds, "deed_id").withColumn("village_id", F.coalesce("village_id", "home")).drop("home")
    return matched_parcels(rows.withColumnsRenamed({f: f.lower() for f in FIELDS}), land(spark, d, "parcels"))


@query(f"with {land_sql('readings', 'deeds', 'parcels')}, {_WIDE}, {_MATCH} select deed_id, village_id, khasra, matched_id from matched where khasra is not null and village_id is not null")
def j25_fallback_lookup(spark, d):
    return _sought(spark, d).where("khasra is not null and village_id is not null").select("deed_id", "village_id", "khasra", "matched_id")


@query(f"""with {land_sql("readings", "deeds", "parcels", "places")}, {_WIDE}, {_MATCH},
facts as (select m.*, w.VILLAGE as village, case when m.deed_id % 3 = 0 then (select r_name from region where r_regionkey = m.deed_id % 5) end as district,
    w.KHATA as khata, try_cast(replace(w.AREA, ',', '') as double) as n, w.AREA_UNIT as area_unit, v.name as village_name, u.name as district_name,
    p.khata as plot_khata, p.area_value * {_SQM.format("p.area_unit")} as plot_sqm, p.area_unit as plot_unit,
    pow(6371008.8, 2) * radians(0.002) * (sin(radians(26.0 + 0.00001 * p.area_value)) - sin(radians(26.0))) as measured
    from matched m join wide w using (deed_id) left join places v on v.id = m.village_id left join places u on u.id = v.parent_id
    left join parcels p on p.parcel_id = coalesce(m.matched_id, m.parcel_id)),
areas as (select *, n * {_SQM.format("coalesce(area_unit, plot_unit)")} as stated from facts)
select deed_id, 'village_matches_location' as "check", 'warning' as severity from areas where {_KEY.format("village")} <> {_KEY.format("village_name")}
union all select deed_id, 'district_matches_hierarchy', 'warning' from areas where {_KEY.format("district")} <> {_KEY.format("district_name")}
union all select deed_id, 'khasra_exists_in_cadastre', 'warning' from areas where khasra is not null and village_id is not null and matched_id is null
union all select deed_id, 'khata_matches_parcel', 'warning' from areas where {_KEY.format("khata")} <> {_KEY.format("plot_khata")}
union all select deed_id, 'area_matches_cadastre', 'warning' from areas where abs(stated - plot_sqm) / greatest(stated, plot_sqm) > 0.25
union all select deed_id, 'cadastre_area_matches_its_geometry', 'info' from areas where abs(measured - plot_sqm) / greatest(measured, plot_sqm) > 0.25""")
def x02_cross_references(spark, d):
    from ..functions.geometry import geodesic_area, rectangle

    rows = _sought(spark, d)
    region = land(spark, d, "region").select(F.col("r_regionkey").alias("nth"), F.col("r_name").alias("district"))
    rows = rows.withColumn("nth", F.when(F.col("deed_id") % 3 == 0, F.col("deed_id") % 5)).join(region, "nth", "left")
    places = land(spark, d, "places")
    village = places.select(F.col("id").alias("village_id"), F.col("name").alias("village_name"), F.col("parent_id").alias("district_id"))
    district = places.select(F.col("id").alias("district_id"), F.col("name").alias("district_name"))
    ring = rectangle(F.lit(80.0), F.lit(26.0), F.lit(0.002), 0.00001 * F.col("area_value"))
    plots = land(spark, d, "parcels").select(
        F.col("parcel_id").alias("plot_id"), F.col("khata").alias("plot_khata"), F.col("area_value").alias("plot_area"),
        F.col("area_unit").alias("plot_unit"), geodesic_area(ring).alias("measured_sqm"),
    )
    rows = rows.withColumn("plot_id", F.coalesce("matched_id", "parcel_id")).join(village, "village_id", "left").join(district, "district_id", "left")
    return cross_findings(rows.join(plots, "plot_id", "left")).select("deed_id", "check", "severity")


_RECORDS = f"""{land_sql("parcels", "holdings", "mutations", "deeds", "readings", "corrections")},
sp as (select parcel_id, count(*) as span_count, count(distinct owner_id) as owner_count, greatest(count(distinct valid_from) - 1, 0) as changes,
    round(coalesce(sum(case when valid_to is null then coalesce(try_cast(split_part(share, '/', 1) as double) / nullif(try_cast(split_part(share, '/', 2) as double), 0), 0) end), 0), 4) as total,
    count(*) filter (valid_to < valid_from) as inverted from holdings group by 1),
mu as (select parcel_id, count(*) as n, count(*) filter (effective_date < b) as back from (select *, lag(effective_date) over (partition by parcel_id order by mutation_id) as b from mutations) group by 1),
de as (select parcel_id, arg_max(village_id, deed_id) filter (village_id is not null) as v, min(year(created_at)) as y, count(*) as n from deeds where parcel_id is not null group by 1),
last as (select parcel_id, village_id as v from (select *, row_number() over (partition by parcel_id order by deed_id desc) as k from deeds where parcel_id is not null) where k = 1),
rd as (select parcel_id, max(case when field = 'AREA' then try_cast(value as double) end) as area, avg(confidence) as mean_c, min(confidence) as low from deeds join readings using (deed_id) where parcel_id is not null group by 1),
co as (select parcel_id, count(*) as n from deeds join corrections using (deed_id) where parcel_id is not null group by 1),
tw as (select village_id, {_KEY.format("khasra")} as key, count(*) - 1 as twins from parcels group by all),
rec as (select p.*, twins, coalesce(span_count, 0) as span_count, coalesce(owner_count, 0) as owner_count, coalesce(changes, 0) as changes, coalesce(total, 0) as total, coalesce(inverted, 0) as inverted,
    coalesce(mu.n, 0) as mutation_count, coalesce(back, 0) as back, last.v as dv, coalesce(de.n, 0) as docs, coalesce(co.n, 0) as corr, coalesce(mean_c, 1) as mean_c, coalesce(low, 1) as low,
    cast(greatest(coalesce({YEAR} - y, 0), 0) as double) as age, case when area_value > 0 and rd.area > 0 then greatest(area_value, rd.area) / least(area_value, rd.area) else 1.0 end as ratio
    from parcels p join tw on tw.village_id = p.village_id and tw.key = {_KEY.format("p.khasra")} left join sp using (parcel_id) left join mu using (parcel_id) left join de using (parcel_id)
    left join last using (parcel_id) left join rd using (parcel_id) left join co using (parcel_id)),
rates as (select *, case when age >= 1 then mutation_count / age else mutation_count end as rate from rec)"""


def _records(spark, d):
    return parcel_records(*[land(spark, d, n) for n in ("parcels", "holdings", "mutations", "deeds", "readings", "corrections")], year=YEAR)


@query(f"""with {_RECORDS} select parcel_id, area_value as area, round(ratio, 9) as area_change_ratio, cast(mutation_count as double) as mutation_count, round(cast(rate as double), 9) as mutations_per_year,
cast(owner_count as double) as owner_count, cast(changes as double) as ownership_changes, cast(corr as double) as correction_count, round(mean_c, 9) as mean_confidence, round(low, 9) as lowest_confidence, age as record_age from rates""")
def a18_feature_rows(spark, d):
    rounded = ("area_change_ratio", "mutations_per_year", "mean_confidence", "lowest_confidence")
    return feature_rows(_records(spark, d)).select("parcel_id", *[F.round(c, 9).alias(c) if c in rounded else c for c in FEATURES])


@query(f"""with {_RECORDS}
select parcel_id, 'INVALID_CHRONOLOGY' as anomaly, 1.0 as score from rates where back > 0 or inverted > 0
union all select parcel_id, 'DUPLICATE_PARCEL', 1.0 from rates where twins > 0
union all select parcel_id, 'AREA_JUMP', round(least(ratio / 12, 1), 9) from rates where ratio >= 3
union all select parcel_id, 'MISSING_MUTATION', round(least((changes - mutation_count) / 3, 1), 9) from rates where changes > 0 and changes > mutation_count
union all select parcel_id, 'LOCATION_MISMATCH', 0.8 from rates where dv <> village_id
union all select parcel_id, 'REPEATED_MODIFICATION', round(least(rate / 3, 1), 9) from rates where rate > 1 and mutation_count >= 3
union all select parcel_id, 'UNUSUAL_OWNERSHIP_CHANGE', round(least(abs(total - 1), 1), 9) from rates where span_count > 0 and total <> 0 and abs(total - 1) > 0.01""")
def x03_anomaly_rules(spark, d):
    return parcel_signals(_records(spark, d)).withColumn("score", F.round("score", 9))


@query(f"""with {_RECORDS} select parcel_id, case when docs > 0 then
['AREA_JUMP', 'DUPLICATE_PARCEL', 'INVALID_CHRONOLOGY', 'LOCATION_MISMATCH', 'MISSING_MUTATION', 'REPEATED_MODIFICATION', 'UNUSUAL_OWNERSHIP_CHANGE']
else ['DUPLICATE_PARCEL', 'INVALID_CHRONOLOGY', 'MISSING_MUTATION', 'REPEATED_MODIFICATION', 'UNUSUAL_OWNERSHIP_CHANGE'] end as types from rates""")
def x03_evaluable_types(spark, d):
    return evaluable(_records(spark, d))


_UNITS = f"""{land_sql("holdings")}, good as (select parcel_id, valid_from, valid_to, try_cast(split_part(share, '/', 1) as bigint) as num, try_cast(split_part(share, '/', 2) as bigint) as den
    from holdings where regexp_full_match(share, '\\d+/0*[1-9]\\d*') and (valid_to is null or valid_to >= valid_from)),
    l as (select parcel_id, list_reduce(list(distinct den), lambda a, b: lcm(a, b)) as m from good group by 1)"""


@query(f"""with {_UNITS} select p.parcel_id, p.valid_from as pivot, sum(num * (m // den)) = m as whole from (select distinct parcel_id, valid_from from good) p
join good g on g.parcel_id = p.parcel_id and g.valid_from <= p.valid_from and (g.valid_to is null or g.valid_to >= p.valid_from) join l on l.parcel_id = p.parcel_id group by p.parcel_id, p.valid_from, m""")
def a22_exact_share_sum(spark, d):
    return whole_at_pivots(land(spark, d, "holdings"), "parcel_id", "share")


#: The moves that documents and complaints may make.
DOCUMENT_MOVES = {
    "UPLOADED": ("QUALITY_CHECK", "REJECTED"),
    "QUALITY_CHECK": ("PROCESSING", "RESCAN_REQUIRED", "REJECTED"),
    "PROCESSING": ("AI_EXTRACTED", "REJECTED", "RESCAN_REQUIRED"),
    "AI_EXTRACTED": ("NEEDS_VERIFICATION",),
    "NEEDS_VERIFICATION": ("UNDER_VERIFICATION", "PROCESSING"),
    "UNDER_VERIFICATION": ("VERIFIED", "NEEDS_VERIFICATION", "RESCAN_REQUIRED"),
    "VERIFIED": ("PENDING_APPROVAL",),
    "PENDING_APPROVAL": ("APPROVED", "UNDER_VERIFICATION", "RESCAN_REQUIRED", "REJECTED"),
    "APPROVED": ("ARCHIVED",),
    "REJECTED": ("ARCHIVED",),
    "RESCAN_REQUIRED": ("UPLOADED", "ARCHIVED"),
}
GRIEVANCE_MOVES = {
    "SUBMITTED": ("UNDER_REVIEW", "REJECTED"),
    "UNDER_REVIEW": ("ACTION_REQUIRED", "RESOLVED", "REJECTED"),
    "ACTION_REQUIRED": ("UNDER_REVIEW", "RESOLVED", "REJECTED"),
}


def _illegal(moves: dict, states: list[str]) -> str:
    edges = ", ".join(f"('{a}', '{b}')" for a, to in moves.items() for b in to)
    case = " ".join(f"when {k} then '{s}'" for k, s in enumerate(states))
    return f"""with h as (select user_id, event_id, case cast(floor(value) as bigint) % {len(states)} {case} end as state from events),
s as (select user_id, event_id, lag(state) over (partition by user_id order by event_id) as source, state as target from h)
select user_id, event_id, source, target from s where source is not null and source <> target and (source, target) not in (select * from (values {edges}) e(a, b))"""


def _history(spark, d, moves, states):
    edges = spark.createDataFrame([(a, b) for a, to in moves.items() for b in to], "source string, target string")
    state = F.get(F.array(*map(F.lit, states)), (F.floor("value") % len(states)).cast("int"))
    rows = land(spark, d, "events").select("user_id", "event_id", state.alias("state"))
    return legal_transitions(rows, edges, "user_id", "event_id", "state").select("user_id", "event_id", "source", "target")


_DOC_STATES = ["UPLOADED", "QUALITY_CHECK", "PROCESSING", "AI_EXTRACTED", "NEEDS_VERIFICATION", "UNDER_VERIFICATION", "VERIFIED", "PENDING_APPROVAL", "APPROVED", "ARCHIVED"]
_GRIEVANCE_STATES = ["SUBMITTED", "UNDER_REVIEW", "ACTION_REQUIRED", "RESOLVED", "REJECTED"]


@query(_illegal(DOCUMENT_MOVES, _DOC_STATES))
def h04_illegal_transitions(spark, d):
    return _history(spark, d, DOCUMENT_MOVES, _DOC_STATES)


@query(_illegal(GRIEVANCE_MOVES, _GRIEVANCE_STATES))
def h06_grievance_transitions(spark, d):
    return _history(spark, d, GRIEVANCE_MOVES, _GRIEVANCE_STATES)


_LOG = """ev as (select user_id % 50 as chain, event_id, row_number() over (partition by user_id % 50 order by event_id) as seq, event_type || ':' || user_id as payload from events),
ch(chain, seq, event_id, payload, previous, hashed) as (
    select chain, seq, event_id, payload, repeat('0', 64), sha256(repeat('0', 64) || '|' || seq || '|' || payload) from ev where seq = 1
    union all select e.chain, e.seq, e.event_id, e.payload, c.hashed, sha256(c.hashed || '|' || e.seq || '|' || e.payload) from ch c join ev e on e.chain = c.chain and e.seq = c.seq + 1)"""


@query(f"with recursive {_LOG} select event_id, chain, seq, previous, hashed from ch")
def k16_chained_log(spark, d):
    return chained(_log_rows(spark, d), "chain", "seq", "payload").select("event_id", "chain", "seq", "previous", "hashed")


def _log_rows(spark, d):
    from pyspark.sql import Window

    own = Window.partitionBy("chain").orderBy("event_id")
    rows = land(spark, d, "events").select((F.col("user_id") % 50).alias("chain"), "event_id", F.concat_ws(":", "event_type", "user_id").alias("payload"))
    return rows.withColumn("seq", F.row_number().over(own).cast("long"))


@query(f"""with recursive {_LOG}, bad as (select chain, seq, case when event_id % 97 = 0 then payload || '!' else payload end as payload,
    case when event_id % 83 = 0 then repeat('f', 64) else previous end as previous, hashed from ch where event_id % 89 <> 0 and not (chain = 7 and seq = 1)),
n as (select *, lag(seq, 1, 0) over w as s, lag(hashed, 1, repeat('0', 64)) over w as b, sha256(previous || '|' || seq || '|' || payload) as want from bad window w as (partition by chain order by seq))
select chain, seq, 'sequence_gap' as problem from n where seq <> s + 1 union all select chain, seq, 'broken_link' from n where previous <> b union all select chain, seq, 'hash_mismatch' from n where want <> hashed""")
def a30_chain_verification(spark, d):
    rows = chained(_log_rows(spark, d), "chain", "seq", "payload").where("event_id % 89 != 0 and not (chain = 7 and seq = 1)")
    rows = rows.withColumn("payload", F.when(F.col("event_id") % 97 == 0, F.concat("payload", F.lit("!"))).otherwise(F.col("payload")))
    rows = rows.withColumn("previous", F.when(F.col("event_id") % 83 == 0, F.repeat(F.lit("f"), 64)).otherwise(F.col("previous")))
    return chain_problems(rows, "chain", "seq", "payload")


@query("""with recursive nodes as (select c_custkey as id, case when c_custkey % 16 = 1 then null when c_custkey % 32 = 2 then c_custkey + 6 else c_custkey - 1 end as parent_id from customer),
closed(id, ancestor, path) as (select id, id, [id] from nodes union all
    select c.id, n.parent_id, list_append(c.path, n.parent_id) from closed c join nodes n on n.id = c.ancestor where n.parent_id is not null and not list_contains(c.path, n.parent_id))
select id, ancestor, cast(len(path) - 1 as integer) as depth from closed""")
def h02_deep_ancestors(spark, d):
    nth = F.col("c_custkey")
    parent = F.when(nth % 16 == 1, None).when(nth % 32 == 2, nth + 6).otherwise(nth - 1)
    return closure(land(spark, d, "customer").select(nth.alias("id"), parent.alias("parent_id")))

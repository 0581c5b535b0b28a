"""Shares against a target, an owner's parcels on a day, languages with the reason where there is none, the newest documents."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions.fields import script_profile
from ..sources.land import land, land_sql
from .catalogue import query

#: What the languages' shares should be, and how far they may be off.
TARGET, TOLERANCE = {"en": 0.60, "de": 0.15, "fr": 0.15, "es": 0.10, "it": 0.02}, 0.03
_TARGETS = ", ".join(f"('{k}', {v})" for k, v in TARGET.items())


@query(f"""with t(lang, target) as (values {_TARGETS}), n as (select lang, count(*) as n from documents group by 1), s as (select lang, n / sum(n) over () as share from n)
select coalesce(s.lang, t.lang) as lang, round(coalesce(share, 0), 9) as share, cast(coalesce(target, 0) as double) as target, abs(coalesce(share, 0) - coalesce(target, 0)) <= {TOLERANCE} as met from s full join t on s.lang = t.lang""")
def a41_mix_verdicts(spark, d):
    """Each language's share against its target: languages that are missing, or have none, count as nothing."""
    rows = land(spark, d, "documents").groupBy("lang").agg(F.count("*").alias("n"))
    # A few languages, so one task can add them up.
    rows = rows.select(F.col("lang").alias("own"), (F.col("n") / F.sum("n").over(Window.partitionBy())).alias("part"))
    target = F.explode(F.create_map(*[F.lit(x) for pair in TARGET.items() for x in pair])).alias("lang", "wanted")
    wanted = spark.range(1).select(target)
    both = rows.join(wanted, F.col("own") == F.col("lang"), "full")
    share, aim = F.coalesce("part", F.lit(0.0)), F.coalesce("wanted", F.lit(0.0))
    return both.select(F.coalesce("own", "lang").alias("lang"), F.round(share, 9).alias("share"), aim.alias("target"), (F.abs(share - aim) <= TOLERANCE).alias("met"))


@query(f"""with {land_sql("holdings")} select owner_id, list_sort(list(distinct parcel_id)) as parcels from holdings
where valid_from <= date '1997-03-01' and (valid_to is null or valid_to >= date '1997-03-01') group by 1""")
def j11_parcels_of_owners(spark, d):
    """What each owner held on a day."""
    day = F.lit("1997-03-01").cast("date")
    held = land(spark, d, "holdings").where((F.col("valid_from") <= day) & (F.col("valid_to").isNull() | (F.col("valid_to") >= day)))
    return held.groupBy("owner_id").agg(F.sort_array(F.collect_set("parcel_id")).alias("parcels"))


@query(f"""with {land_sql("scans")}, n as (select scan_id, field, raw, len(regexp_extract_all(raw, '[ऀ-ॿ]')) as deva, len(regexp_extract_all(raw, '[A-Za-z]')) as lat, len(regexp_extract_all(raw, '[ఀ-౿஀-௿]')) as south from scans where field in ('AREA', 'AREA_UNIT', 'DATE'))
select scan_id, field, case when deva + lat + south = 0 then null when deva >= greatest(lat, south) then 'hi' when lat >= south then 'en' when raw like '%గ%' then 'te' else 'ta' end as language,
case when trim(raw) = '' then 'empty' when deva + lat + south = 0 then 'no letter of a known script' end as reason from n""")
def t05_languages_with_reasons(spark, d):
    """The language of a text's script, or why there is none."""
    rows = land(spark, d, "scans").where("field in ('AREA', 'AREA_UNIT', 'DATE')").withColumn("language", script_profile(F.col("raw"))["language"])
    reason = F.when(F.col("language").isNull(), F.when(F.trim("raw") == "", "empty").otherwise("no letter of a known script"))
    return rows.select("scan_id", "field", "language", reason.alias("reason"))


@query(f"with {land_sql('deeds')} select deed_id, created_at, state from deeds order by created_at desc, deed_id desc limit 10")
def o01_recent_documents(spark, d):
    """The ten newest; ties by number. The limit is the feature."""
    return land(spark, d, "deeds").orderBy(F.desc("created_at"), F.desc("deed_id")).limit(10).select("deed_id", "created_at", "state")

"""Normalisers, scripts, questions, dates, confidences, boxes and digests on the land-record views."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.fields import file_name, intent, masked_number, normalised, phone_number, script_profile, script_share, unit_name
from ..functions.geometry import from_local, local_area, moved_box, overlap_share, rectangle, thousandths
from ..functions.values import content_digest, ngram_vector
from ..operators.anomaly import area_ratio, share_value
from ..sources.land import land, land_sql
from .catalogue import query

_ASCII = "translate(trim(regexp_replace(nfc_normalize({}), '\\s+', ' ', 'g')), '०१२३४५६७८९', '0123456789')"
_PLAIN = f"plain as (select scan_id, field, raw, {_ASCII.format('raw')} as t from scans)"
_TAIL = "regexp_replace(t, '^[\\s:\\-–—]+|[\\s:\\-–—]+$', '', 'g')"


@query(f"""with {land_sql("scans")}, {_PLAIN} select scan_id, field, nullif(case field
when 'KHASRA' then regexp_extract(regexp_replace(translate(t, '।|', '//'), '\\s*/\\s*', '/', 'g'), '\\d+(/\\d+)*')
when 'KHATA' then regexp_extract(t, '\\d+')
when 'AREA' then format('{{:g}}', try_cast(nullif(regexp_extract(replace(t, ',', ''), '\\d+(\\.\\d+)?'), '') as double))
when 'AREA_UNIT' then case when contains(t, 'बीघा') then 'BIGHA' when contains(t, 'एकड') then 'ACRE' when contains(t, 'గుంటలు') then 'GUNTHA' when contains(t, 'சென்ட்') then 'CENT' when contains(t, 'वर्ग मीटर') then 'SQUARE_METRE' end
when 'SHARE' then case when t = '1' then '1/1' when cast(regexp_extract(t, '(\\d+)\\s*/\\s*(\\d+)', 2) as int) <> 0 then cast(regexp_extract(t, '(\\d+)\\s*/\\s*(\\d+)', 1) as int) || '/' || cast(regexp_extract(t, '(\\d+)\\s*/\\s*(\\d+)', 2) as int) end
when 'RECORD_YEAR' then coalesce(nullif(regexp_replace(regexp_extract(translate(t, '–—', '--'), '\\d{{4}}\\s*-\\s*\\d{{2,4}}'), '\\s*-\\s*', '-'), ''), regexp_extract(t, '\\d{{4}}'))
when 'DATE' then case when cast(regexp_extract(t, '(\\d{{1,2}})[/\\-.](\\d{{1,2}})[/\\-.](\\d{{4}})', 1) as int) between 1 and 31 and cast(regexp_extract(t, '(\\d{{1,2}})[/\\-.](\\d{{1,2}})[/\\-.](\\d{{4}})', 2) as int) between 1 and 12
    then printf('%04d-%02d-%02d', cast(regexp_extract(t, '(\\d{{1,2}})[/\\-.](\\d{{1,2}})[/\\-.](\\d{{4}})', 3) as int), cast(regexp_extract(t, '(\\d{{1,2}})[/\\-.](\\d{{1,2}})[/\\-.](\\d{{4}})', 2) as int), cast(regexp_extract(t, '(\\d{{1,2}})[/\\-.](\\d{{1,2}})[/\\-.](\\d{{4}})', 1) as int)) end
when 'OWNER' then {_TAIL} else t end, '') as value from plain""")
def t14_normalised_fields(spark, d):
    """Covers the normalisers of plots, accounts, numbers, units, shares, years, dates and names."""
    return land(spark, d, "scans").select("scan_id", "field", normalised(F.col("field"), F.col("raw")).alias("value"))


@query(f"""with {land_sql("scans")}, n as (select scan_id, field, raw, len(regexp_extract_all(raw, '[ऀ-ॿ]')) as deva, len(regexp_extract_all(raw, '[A-Za-z]')) as lat, len(regexp_extract_all(raw, '[ఀ-౿]')) as telu, len(regexp_extract_all(raw, '[஀-௿]')) as tam from scans)
select scan_id, field, case when deva + lat + telu + tam = 0 then null when deva >= greatest(lat, telu, tam) then 'devanagari' when lat >= greatest(telu, tam) then 'latin' when telu >= tam then 'telugu' else 'tamil' end as dominant,
case when deva + lat + telu + tam = 0 then null when deva >= greatest(lat, telu, tam) then 'hi' when lat >= greatest(telu, tam) then 'en' when telu >= tam then 'te' else 'ta' end as language,
cast(deva + lat + telu + tam as integer) as total, round(coalesce(deva / nullif(deva + lat + telu + tam, 0), 0), 9) as devanagari from n where field <> 'OWNER'""")
def t04_script_profiles(spark, d):
    """Dominant script, its language, letters in all and the share of Devanagari: t03, t04 and t05."""
    rows = land(spark, d, "scans").where("field != 'OWNER'").withColumn("p", script_profile(F.col("raw")))
    return rows.select("scan_id", "field", "p.dominant", "p.language", "p.total", F.round(script_share(F.col("p"), F.lit("devanagari")), 9).alias("devanagari"))


@query(f"""with {land_sql("scans")}, n as (select scan_id, avg(case when field = 'KHATA' then 0.9 else 0.5 end) as c, sum(len(regexp_extract_all(raw, '[ऀ-ॿ]'))) as deva, sum(len(regexp_extract_all(raw, '[A-Za-z]'))) as lat from scans where field in ('KHATA', 'LAND_CLASS', 'DATE') group by 1)
select scan_id, case when deva >= lat then 'hi' else 'en' end as language, round(c * greatest(deva, lat) / (deva + lat), 9) as score from n""")
def m23_routing(spark, d):
    """Mean confidence times the share of letters of the script asked for; the best language wins."""
    rows = land(spark, d, "scans").where("field in ('KHATA', 'LAND_CLASS', 'DATE')").withColumn("c", F.when(F.col("field") == "KHATA", 0.9).otherwise(0.5))
    pages = rows.groupBy("scan_id").agg(F.avg("c").alias("c"), F.concat_ws("", F.collect_list("raw")).alias("text"))
    pages = pages.withColumn("p", script_profile(F.col("text")))
    tried = F.array(*[F.struct((F.col("c") * script_share(F.col("p"), F.lit(s))).alias("score"), F.lit(lang).alias("language")) for s, lang in (("devanagari", "hi"), ("latin", "en"))])
    best = F.array_max(tried)
    return pages.select("scan_id", best["language"].alias("language"), F.round(best["score"], 9).alias("score"))


@query("""select c_custkey, case c_custkey % 4 when 0 then null when 3 then case when c_custkey % 3 = 0 then '91' || (9876500000 + c_custkey) end else '91' || (9876500000 + c_custkey) end as phone,
case when c_custkey % 4 = 0 then '***' else '***' || right(cast(9876500000 + c_custkey as varchar), 4) end as masked from customer""")
def t25_phone_numbers(spark, d):
    k = F.col("c_custkey")
    digits = (F.lit(9876500000) + k).cast("string")
    raw = (
        F.when(k % 4 == 0, F.lit("12-a"))
        .when(k % 4 == 1, F.concat(F.lit("0"), digits))
        .when(k % 4 == 2, F.concat(F.lit("+91 "), F.left(digits, F.lit(5)), F.lit(" "), F.right(digits, F.lit(5))))
        .when(k % 3 == 0, digits)
        .otherwise(F.concat(F.lit("1234567890"), digits))
    )
    return land(spark, d, "customer").select("c_custkey", phone_number(raw).alias("phone"), masked_number(raw).alias("masked"))


@query(r"select page_id, regexp_replace(string_split(url, '/')[-1] || ' (1).pdf', '[^A-Za-z0-9._-]', '_', 'g') as name from pages")
def t26_file_names(spark, d):
    return land(spark, d, "pages").select("page_id", file_name(F.concat("url", F.lit(" (1).pdf"))).alias("name"))


@query(f"""with {land_sql("questions")} select question_id, case question_id % 11 when 0 then 'anomaly_explanation' when 1 then 'low_confidence' when 2 then 'area_comparison' when 3 then 'historical_owner'
when 4 then 'ownership_history' when 5 then 'my_holdings' when 6 then 'parcel_area' when 7 then 'my_holdings' when 8 then 'low_confidence' when 9 then 'parcel_area' else 'general' end as intent from questions""")
def t27_intents(spark, d):
    return land(spark, d, "questions").select("question_id", intent(F.col("question")).alias("intent"))


@query(f"""with {land_sql("questions", "parcels", "holdings")}, tok as (select question_id, asked_by, unnest(list_distinct(regexp_extract_all(question, '\\b(\\d{{1,5}}(?:/\\d{{1,3}})*)\\b'))) as token, 'khasra' as how from questions
union all select question_id, asked_by, unnest(list_distinct(regexp_extract_all(upper(question), '\\bP\\d+\\b'))), 'id' from questions),
may as (select distinct parcel_id, owner_id from holdings where valid_to is null),
hit as (select distinct t.question_id, how, p.parcel_id from tok t join may m on m.owner_id % 15 = t.asked_by % 15 join parcels p on p.parcel_id = m.parcel_id and ((how = 'khasra' and p.khasra = token) or (how = 'id' and p.parcel_id = token)))
select question_id, min(parcel_id) as parcel_id from hit group by question_id having count(*) = 1 or (count(*) filter (how = 'id') = 1)""")
def t28_parcels_of_questions(spark, d):
    """The one parcel of those the asker may see that a question names, by id or by plot; several plots are none."""
    asked = land(spark, d, "questions")
    plot = asked.select("question_id", "asked_by", F.explode(F.array_distinct(F.regexp_extract_all("question", F.lit("\\b(\\d{1,5}(?:/\\d{1,3})*)\\b"), F.lit(1)))).alias("khasra"))
    named = asked.select("question_id", "asked_by", F.explode(F.array_distinct(F.regexp_extract_all(F.upper("question"), F.lit("\\bP\\d+\\b"), F.lit(0)))).alias("parcel_id"))
    may = land(spark, d, "holdings").where("valid_to is null").select((F.col("owner_id") % 15).alias("g"), "parcel_id").distinct()
    plots = land(spark, d, "parcels").select("parcel_id", "khasra").join(may, "parcel_id")
    by_plot = plot.withColumn("g", F.col("asked_by") % 15).join(plots, ["g", "khasra"]).select("question_id", "parcel_id", F.lit(0).alias("id"))
    by_id = named.withColumn("g", F.col("asked_by") % 15).join(plots.select("g", "parcel_id"), ["g", "parcel_id"]).select("question_id", "parcel_id", F.lit(1).alias("id"))
    hits = by_plot.unionByName(by_id).distinct().groupBy("question_id").agg(F.count("*").alias("n"), F.sum("id").alias("ids"), F.min("parcel_id").alias("parcel_id"))
    return hits.where("n = 1 or ids = 1").select("question_id", "parcel_id")


@query(f"with {land_sql('questions')} select question_id, min(n_name) as village from questions join nation on contains(' ' || regexp_replace(lower(question), '[^a-z0-9_]+', ' ', 'g') || ' ', ' ' || lower(n_name) || ' ') group by 1")
def t29_villages_of_questions(spark, d):
    """Runs of one to three words of a question are looked up among the villages' names, so no question meets all villages."""
    words = F.filter(F.split(F.lower("question"), "[^a-z0-9_]+"), lambda w: w != "")
    runs = [F.transform(F.sequence(F.lit(1), F.greatest(F.size("w") - k + 1, F.lit(1))), lambda i, k=k: F.array_join(F.slice(F.col("w"), i, k), " ")) for k in (1, 2, 3)]
    rows = land(spark, d, "questions").withColumn("w", words).select("question_id", F.explode(F.array_distinct(F.concat(*runs))).alias("run"))
    names = land(spark, d, "nation").select(F.lower("n_name").alias("run"), F.col("n_name").alias("village"))
    return rows.join(names, "run").groupBy("question_id").agg(F.min("village").alias("village"))


@query(f"""with {land_sql("parcels", "places", "mutations")} select parcel_id, concat_ws(' | ', v.name || ', ' || u.name, 'khasra ' || khasra, 'khata ' || khata, 'area ' || format('{{:g}}', area_value) || ' ' || area_unit,
'mutations ' || m.kinds) as content from parcels join places v on v.id = village_id join places u on u.id = v.parent_id
left join (select parcel_id, array_to_string(list_sort(list(distinct kind)), ', ') as kinds from mutations group by 1) m using (parcel_id)""")
def t30_embedding_content(spark, d):
    from ..functions.fields import short_number

    places = land(spark, d, "places")
    village = places.select(F.col("id").alias("village_id"), F.col("name").alias("v"), F.col("parent_id").alias("up"))
    kinds = land(spark, d, "mutations").groupBy("parcel_id").agg(F.array_join(F.sort_array(F.collect_set("kind")), ", ").alias("kinds"))
    rows = land(spark, d, "parcels").join(village, "village_id").join(places.select(F.col("id").alias("up"), F.col("name").alias("u")), "up").join(kinds, "parcel_id", "left")
    titled = [F.concat(F.lit(f"{t} "), F.col(c)) for t, c in (("khasra", "khasra"), ("khata", "khata"))]
    area = F.concat(F.lit("area "), short_number(F.col("area_value")), F.lit(" "), F.col("area_unit"))
    return rows.select("parcel_id", F.concat_ws(" | ", F.concat_ws(", ", "v", "u"), *titled, area, F.concat(F.lit("mutations "), F.col("kinds"))).alias("content"))


@query(f"""with {land_sql("scans")}, w as (select scan_id, unnest(string_split(trim(regexp_replace(raw, '\\s+', ' ', 'g')), ' ')) as word, generate_subscripts(string_split(trim(regexp_replace(raw, '\\s+', ' ', 'g')), ' '), 1) as k,
length(trim(regexp_replace(raw, '\\s+', ' ', 'g'))) as n from scans where field = 'LAND_CLASS'),
c as (select *, coalesce(sum(length(word) + 1) over (partition by scan_id order by k rows between unbounded preceding and 1 preceding), 0) as a from w)
select scan_id, cast(k as integer) as k, word, cast(floor(100 + 400 * a / n) as integer) as x1, cast(floor(100 + 400 * (a + length(word)) / n) as integer) as x2 from c""")
def t22_word_boxes(spark, d):
    """Words of a block, each with its part of the block's width by characters."""
    text = F.trim(F.regexp_replace("raw", "\\s+", " "))
    rows = land(spark, d, "scans").where("field = 'LAND_CLASS'").select("scan_id", text.alias("t")).withColumn("w", F.split("t", " "))
    before = F.transform(F.col("w"), lambda _, k: F.length(F.array_join(F.slice(F.col("w"), F.lit(1), k), " ")) + F.when(k > 0, 1).otherwise(0))
    rows = rows.select("scan_id", F.length("t").alias("n"), F.posexplode(F.arrays_zip(F.col("w").alias("word"), before.alias("a"))).alias("k", "x"))
    at = lambda c: F.floor(100 + 400 * c / F.col("n")).cast("int")
    return rows.select("scan_id", (F.col("k") + 1).alias("k"), "x.word", at(F.col("x.a")).alias("x1"), at(F.col("x.a") + F.length("x.word")).alias("x2"))


@query("""select o_orderkey, make_date(year(o_orderdate), 12, 31) as as_of, strftime(o_orderdate, '%Y-%m-%dT%H:%M:%SZ') as iso, cast(split_part(year(o_orderdate) || '-' || (year(o_orderdate) % 100 + 1), '-', 1) as integer) as head from orders""")
def d01_dates(spark, d):
    """As of the end of a year (d01), the first half of a record year (d04), UTC in ISO form (d08)."""
    day = F.col("o_orderdate")
    label = F.concat_ws("-", F.year(day), F.year(day) % 100 + 1)
    return land(spark, d, "orders").select("o_orderkey", F.make_date(F.year(day), F.lit(12), F.lit(31)).alias("as_of"), F.date_format(day, "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("iso"), F.split(label, "-")[0].try_cast("int").alias("head"))


@query(f"""with {land_sql("holdings", "parcels")} select holding_id, round(coalesce(try_cast(split_part(share, '/', 1) as double) / nullif(try_cast(split_part(share, '/', 2) as double), 0), 0), 9) as share,
round(case when area_value > 0 then greatest(area_value, 3) / least(area_value, 3) else 1 end, 9) as ratio from holdings join parcels using (parcel_id)""")
def m04_shares_and_ratios(spark, d):
    rows = land(spark, d, "holdings").join(land(spark, d, "parcels"), "parcel_id")
    return rows.select("holding_id", F.round(share_value(F.col("share")), 9).alias("share"), F.round(area_ratio(F.col("area_value"), F.lit(3.0)), 9).alias("ratio"))


@query("""with s as (select l_orderkey, l_linenumber, l_discount * 10 as blur, l_tax * 12 as contrast, (l_quantity - 1) / 49 as resolution, 1 - l_discount * 5 as skew, (l_partkey % 100) / 100 as bright from lineitem),
q as (select *, 0.40 * blur + 0.22 * contrast + 0.18 * resolution + 0.12 * skew + 0.08 * bright as overall from s)
select l_orderkey, l_linenumber, round(overall, 6) as overall, case when overall < 0.22 or blur < 0.04 then 'REJECT_QUALITY' when overall < 0.34 or resolution < 0.55 then 'RESCAN_RECOMMENDED' when overall < 0.58 then 'PROCESS_WITH_WARNING' else 'PROCESS' end as action
from q where abs(overall - 0.22) > 1e-9 and abs(overall - 0.34) > 1e-9 and abs(overall - 0.58) > 1e-9""")
def m07_scan_quality(spark, d):
    c = F.col
    parts = {"blur": c("l_discount") * 10, "contrast": c("l_tax") * 12, "resolution": (c("l_quantity") - 1) / 49, "skew": 1 - c("l_discount") * 5, "bright": (c("l_partkey") % 100) / 100}
    weights = {"blur": 0.40, "contrast": 0.22, "resolution": 0.18, "skew": 0.12, "bright": 0.08}
    rows = land(spark, d, "lineitem").withColumns(parts).withColumn("overall", sum((c(k) * w for k, w in weights.items()), F.lit(0.0)))
    action = F.when((c("overall") < 0.22) | (c("blur") < 0.04), "REJECT_QUALITY").when((c("overall") < 0.34) | (c("resolution") < 0.55), "RESCAN_RECOMMENDED")
    action = action.when(c("overall") < 0.58, "PROCESS_WITH_WARNING").otherwise("PROCESS")
    clear = (F.abs(c("overall") - 0.22) > 1e-9) & (F.abs(c("overall") - 0.34) > 1e-9) & (F.abs(c("overall") - 0.58) > 1e-9)
    return rows.where(clear).select("l_orderkey", "l_linenumber", F.round("overall", 6).alias("overall"), action.alias("action"))


@query(f"""with {land_sql("corrections")}, c as (select correction_id, case when correction_id % 19 = 0 then '' else predicted end as p, case when correction_id % 17 <> 0 then confidence end as c from corrections)
select correction_id, case when p = '' then 'MISSED_ENTIRELY' when c is null then 'MODERATE_MISS' when c >= 0.85 then 'CONFIDENT_BUT_WRONG' when c <= 0.55 then 'UNCERTAIN_AND_WRONG' else 'MODERATE_MISS' end as reason,
round(case when p = '' then 0.6 when c is null then 0.5 when c >= 0.85 then 0.8 + 0.2 * (c - 0.85) / 0.15 when c <= 0.55 then 0.2 + 0.2 * c / 0.55 else 0.45 + 0.3 * (c - 0.55) / 0.3 end, 4) as priority from c""")
def m08_feedback_priority(spark, d):
    c = F.when(F.col("correction_id") % 17 != 0, F.col("confidence"))
    none = F.trim(F.when(F.col("correction_id") % 19 == 0, "").otherwise(F.col("predicted"))) == ""
    reason = F.when(none, "MISSED_ENTIRELY").when(c.isNull(), "MODERATE_MISS").when(c >= 0.85, "CONFIDENT_BUT_WRONG").when(c <= 0.55, "UNCERTAIN_AND_WRONG").otherwise("MODERATE_MISS")
    value = F.when(none, 0.6).when(c.isNull(), 0.5).when(c >= 0.85, 0.8 + 0.2 * (c - 0.85) / 0.15).when(c <= 0.55, 0.2 + 0.2 * c / 0.55).otherwise(0.45 + 0.3 * (c - 0.55) / 0.3)
    return land(spark, d, "corrections").select("correction_id", reason.alias("reason"), F.round(value, 4).alias("priority"))


@query("""select l_orderkey, l_linenumber, case l_linenumber % 6 when 0 then 0.9 when 1 then 0.85 when 2 then 0.78 when 3 then 0.62 when 4 then 0.8 else 0.7 end as layout, round(greatest(least(1 - (l_partkey % 13) / 11, 1), 0), 9) as resemblance from lineitem""")
def m10_layout_evidence(spark, d):
    """What a value's way of being found is worth (m10), and how alike two images of a distance are (m11)."""
    worth = {"label-right": 0.9, "table-column": 0.85, "label-below": 0.78, "inline": 0.62, "adjacent-to-area": 0.8}
    name = F.get(F.array(*map(F.lit, worth)), (F.col("l_linenumber") % 6).cast("int"))
    layout = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for pair in worth.items() for x in pair]), name), F.lit(0.7))
    alike = F.greatest(F.least(1 - (F.col("l_partkey") % 13) / 11, F.lit(1.0)), F.lit(0.0))
    return land(spark, d, "lineitem").select("l_orderkey", "l_linenumber", layout.alias("layout"), F.round(alike, 9).alias("resemblance"))


_BOX = "(l_partkey % 50) * 10 as x1, l_suppkey % 40 * 10 as y1, (l_partkey % 50) * 10 + 100 + l_linenumber * 7 as x2, l_suppkey % 40 * 10 + 30 as y2"


@query(f"""with b as (select l_orderkey, l_linenumber, {_BOX} from lineitem) select l_orderkey, l_linenumber, cast(floor(0.9 * x1 - 0.1 * y2 + 5 + 1e-6) as integer) as x1, cast(floor(0.1 * x1 + 0.9 * y1 + 7 + 1e-6) as integer) as y1,
cast(ceil(0.9 * x2 - 0.1 * y1 + 5 - 1e-6) as integer) as x2, cast(ceil(0.1 * x2 + 0.9 * y2 + 7 - 1e-6) as integer) as y2, cast(least(greatest(trunc(1000 * x1 / 620), 0), 1000) as integer) as left_, cast(least(greatest(trunc(1000 * x2 / 620), 0), 1000) as integer) as right_ from b""")
def m12_moved_boxes(spark, d):
    """Affine images of boxes (m12, m13) and their places in thousandths of the page (m15)."""
    box = F.struct(((F.col("l_partkey") % 50) * 10).alias("x1"), (F.col("l_suppkey") % 40 * 10).alias("y1"), ((F.col("l_partkey") % 50) * 10 + 100 + F.col("l_linenumber") * 7).alias("x2"), (F.col("l_suppkey") % 40 * 10 + 30).alias("y2"))
    rows = land(spark, d, "lineitem").select("l_orderkey", "l_linenumber", box.alias("b"))
    moved = moved_box(F.col("b"), [F.lit(x) for x in (0.9, -0.1, 5.0, 0.1, 0.9, 7.0)])
    rows = rows.withColumn("m", moved)
    return rows.select("l_orderkey", "l_linenumber", "m.x1", "m.y1", "m.x2", "m.y2", thousandths(F.col("b.x1"), F.lit(620)).alias("left_"), thousandths(F.col("b.x2"), F.lit(620)).alias("right_"))


@query(f"""with b as (select l_orderkey, l_linenumber, {_BOX} from lineitem), o as (select a.l_orderkey, a.l_linenumber as one, b.l_linenumber as two, greatest(least(a.x2, b.x2) - greatest(a.x1, b.x1), 0) * greatest(least(a.y2, b.y2) - greatest(a.y1, b.y1), 0) as w,
(a.x2 - a.x1) * (a.y2 - a.y1) as s, (b.x2 - b.x1) * (b.y2 - b.y1) as t from b a join b on a.l_orderkey = b.l_orderkey and a.l_linenumber < b.l_linenumber)
select l_orderkey, one, two, round(w / t, 9) as contained, round(w / s, 9) as covered, round(w / (s + t - w), 9) as iou from o where w > 0""")
def m14_box_overlaps(spark, d):
    box = F.struct(((F.col("l_partkey") % 50) * 10).alias("x1"), (F.col("l_suppkey") % 40 * 10).alias("y1"), ((F.col("l_partkey") % 50) * 10 + 100 + F.col("l_linenumber") * 7).alias("x2"), (F.col("l_suppkey") % 40 * 10 + 30).alias("y2"))
    rows = land(spark, d, "lineitem").select("l_orderkey", F.col("l_linenumber").alias("n"), box.alias("b"))
    pairs = rows.withColumnsRenamed({"n": "one", "b": "a"}).join(rows.withColumnRenamed("n", "two"), "l_orderkey").where("one < two")
    inside, covered, iou = (F.round(x, 9) for x in overlap_share(F.col("a"), F.col("b")))
    return pairs.select("l_orderkey", "one", "two", inside.alias("contained"), covered.alias("covered"), iou.alias("iou")).where("iou > 0")


@query("""select p_partkey, round(pow(111320.0, 2) * 0.893 * 0.001 * (0.0005 + p_size * 0.00001), 6) as area, round(80 + (p_size * 10) / (111320.0 * cos(radians(26))), 9) as lon, round(26 + p_size * 5 / 111320.0, 9) as lat, round(sqrt(p_size * 2529.285 / pi()), 6) as radius from part""")
def m17_local_geometry(spark, d):
    """Planar areas (m17), metres to degrees (m18), the radius of a disc of an area (m19)."""
    size = F.col("p_size")
    place = from_local((size * 10).cast("double"), (size * 5).cast("double"), 80.0, 26.0)
    ring = rectangle(F.lit(0.0), F.lit(0.0), F.lit(0.001), 0.0005 + size * 0.00001)
    return land(spark, d, "part").select("p_partkey", F.round(local_area(ring), 6).alias("area"), F.round(place["x"], 9).alias("lon"), F.round(place["y"], 9).alias("lat"), F.round(F.sqrt(size * 2529.285 / F.pi()), 6).alias("radius"))


_JSON = """'{"amount":' || cast(c_nationkey as varchar) || ',"name":"' || c_name || '","note":' || case when c_custkey % 3 = 0 then 'null' else '"n' || c_custkey || '"' end || '}'"""


@query(f"select c_custkey, {_JSON} as body, sha256({_JSON}) as digest, c_custkey % 5 <> 0 as genuine from customer")
def r02_canonical_digests(spark, d):
    """Canonical JSON and its digest (r02); a certificate is genuine if its digest is that of its content (r03)."""
    note = F.when(F.col("c_custkey") % 3 != 0, F.concat(F.lit("n"), F.col("c_custkey")))
    body, digest = content_digest({"name": F.col("c_name"), "note": note, "amount": F.col("c_nationkey")})
    shown = F.when(F.col("c_custkey") % 5 == 0, F.sha2(F.lit("forged"), 256)).otherwise(digest)
    return land(spark, d, "customer").select("c_custkey", body.alias("body"), digest.alias("digest"), (shown == digest).alias("genuine"))


@query()
def r04_ngram_vectors(spark, d):
    """Hashed trigram vectors of the nations' names, of length one."""
    return land(spark, d, "nation").select("n_nationkey", ngram_vector(F.col("n_name")).alias("vector"))


@query("""select user_id, list(event_type order by event_type) as names, list(n order by event_type) as counts, list_sort(list(event_type))[:3] as first_types from (select user_id, event_type, count(*) as n from events group by all) group by 1""")
def r06_counts_by_name(spark, d):
    """A map of counts by name (r06) and a capped, sorted list of names (r07, r08)."""
    rows = land(spark, d, "events").groupBy("user_id", "event_type").agg(F.count("*").alias("n")).groupBy("user_id")
    entries = F.array_sort(F.collect_list(F.struct("event_type", "n")))
    out = rows.agg(F.map_from_entries(entries).alias("counts"), F.slice(F.sort_array(F.collect_set("event_type")), 1, 3).alias("first_types"))
    return out.select("user_id", F.map_keys("counts").alias("names"), F.map_values("counts").alias("counts"), "first_types")


@query("""select n_nationkey, case when n_nationkey % 2 = 0 then 'BIGHA' when n_nationkey % 3 = 0 then 'CENT' end as unit from nation""")
def t10_unit_names(spark, d):
    k = F.col("n_nationkey")
    raw = F.when(k % 2 == 0, "2.75 बीघा").when(k % 3 == 0, "৫ শতক").otherwise("kanal")
    return land(spark, d, "nation").select("n_nationkey", unit_name(raw).alias("unit"))

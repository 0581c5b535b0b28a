"""Dashboards, evaluation, runs of rows, mutations of tables and assembled documents on the land-record views."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions.values import nfc, square_metres
from ..operators.evaluation import confusion, grouped_calibration, skyline, with_scores
from ..operators.hierarchy import closure, descendants, rolled_up
from ..operators.intervals import islands
from ..operators.near_hashes import hash_number, near_rows
from ..operators.scopes import deeds_within
from ..operators.splits import split_groups
from ..sources.land import land, land_sql
from ..sources.shared import pieces, settle
from ..sources.sinks import changed_where, highest_number, insert_absent, numbered_ids, without_stale
from .catalogue import query
from .land_security import _SCOPE, ROOT

_SQM = """case area_unit when 'BIGHA' then 2529.285 when 'BISWA' then 126.46424999999999 when 'ACRE' then 4046.86 when 'HECTARE' then 10000.0 when 'SQUARE_METRE' then 1.0 when 'GUNTHA' then 101.17150000000001 when 'CENT' then 40.4686 end"""


@query(f"""with {_SCOPE}, up(id, ancestor) as (with recursive u(id, ancestor) as (select id, id from scope union all select u.id, p.parent_id from u join places p on p.id = u.ancestor where p.parent_id in (select id from scope)) select id, ancestor from u),
c as (select coalesce(s.village_id, p.village_id) as v, count(*) as n, count(*) filter (state = 'APPROVED') as done from seen s left join parcels p using (parcel_id) group by 1)
select ancestor as location_id, cast(sum(n) as bigint) as documents, cast(sum(done) as bigint) as approved, round(sum(done) / sum(n), 4) as progress from c join up on v = id group by 1""")
def h03_progress_in_scope(spark, d):
    """Documents are credited to their village and to its ancestors up to the officer's own place, not beyond."""
    closed = closure(land(spark, d, "places"))
    scope = descendants(closed, ROOT)
    inside = closed.join(scope.select(F.col("id").alias("ancestor")), "ancestor", "left_semi").select("id", "ancestor")
    home = land(spark, d, "parcels").select("parcel_id", F.col("village_id").alias("home"))
    seen = deeds_within(land(spark, d, "deeds"), land(spark, d, "parcels"), scope).join(home, "parcel_id", "left")
    by = seen.groupBy(F.coalesce("village_id", "home").alias("v")).agg(F.count("*").alias("n"), F.count_if(F.col("state") == "APPROVED").alias("done"))
    out = rolled_up(by, inside, "v", [F.sum("n").alias("documents"), F.sum("done").alias("approved")])
    return out.select(F.col("ancestor").alias("location_id"), "documents", "approved", F.round(F.col("approved") / F.col("documents"), 4).alias("progress"))


@query(f"with {land_sql('parcels', 'deeds')} select village_id, count(distinct p.parcel_id) as digitized from parcels p where parcel_id in (select parcel_id from deeds where state = 'APPROVED') group by 1")
def a14_digitized_parcels(spark, d):
    done = land(spark, d, "deeds").where("state = 'APPROVED'").select("parcel_id")
    return land(spark, d, "parcels").join(done, "parcel_id", "left_semi").groupBy("village_id").agg(F.count("*").alias("digitized"))


@query(f"""with {land_sql("parcels", "places", "holdings", "mutations", "deeds")} select u.name as district, v.name as village, cast(round({_SQM} * area_value, -2) as bigint) as area_sqm,
coalesce(h.n, 0) as holders, coalesce(m.n, 0) as mutations, m.y as last_year, parcel_id in (select parcel_id from deeds where state = 'APPROVED' and parcel_id is not null) as digitized
from parcels join places v on v.id = village_id join places u on u.id = v.parent_id left join (select parcel_id, count(*) as n from holdings where valid_to is null group by 1) h using (parcel_id)
left join (select parcel_id, count(*) as n, max(year(effective_date)) as y from mutations group by 1) m using (parcel_id)""")
def a16_research_rows(spark, d):
    """A row a parcel that names nobody and no plot; the area is rounded to a hundred square metres."""
    places = land(spark, d, "places")
    village = places.select(F.col("id").alias("village_id"), F.col("name").alias("village"), F.col("parent_id").alias("up"))
    district = places.select(F.col("id").alias("up"), F.col("name").alias("district"))
    holders = land(spark, d, "holdings").where("valid_to is null").groupBy("parcel_id").agg(F.count("*").alias("holders"))
    moved = land(spark, d, "mutations").groupBy("parcel_id").agg(F.count("*").alias("mutations"), F.max(F.year("effective_date")).cast("long").alias("last_year"))
    done = land(spark, d, "deeds").where("state = 'APPROVED' and parcel_id is not null").select("parcel_id").distinct().withColumn("digitized", F.lit(True))
    rows = land(spark, d, "parcels").join(village, "village_id").join(district, "up")
    for part in (holders, moved, done):
        rows = rows.join(part, "parcel_id", "left")
    area = F.round(square_metres(F.col("area_value"), F.col("area_unit")), -2).cast("long")
    zero = [F.coalesce(c, F.lit(0)).alias(c) for c in ("holders", "mutations")]
    return rows.select("district", "village", area.alias("area_sqm"), *zero, "last_year", F.coalesce("digitized", F.lit(False)).alias("digitized"))


@query("""with t as (select distinct l_returnflag as field, l_orderkey, l_linenumber from lineitem where l_discount > 0.02), f as (select distinct l_returnflag as field, l_orderkey, l_linenumber from lineitem where l_tax > 0.03),
c as (select coalesce(t.field, f.field) as field, count(*) filter (t.field is not null and f.field is not null) as tp, count(*) filter (t.field is null) as fp, count(*) filter (f.field is null) as fn
from t full join f on t.field = f.field and t.l_orderkey = f.l_orderkey and t.l_linenumber = f.l_linenumber group by 1)
select field, round(2 * tp / (2 * tp + fp + fn), 9) as f1 from c""")
def a24_f1(spark, d):
    rows = land(spark, d, "lineitem").withColumn("field", F.col("l_returnflag"))
    counts = confusion(rows.where("l_discount > 0.02"), rows.where("l_tax > 0.03"), ["field", "l_orderkey", "l_linenumber"], "field")
    return with_scores(counts).select("field", F.round("f1", 9).alias("f1"))


@query(f"""with {land_sql("readings")}, p as (select field, value as truth, coalesce(corrected, left(value, 3)) as got from readings where length(value) > 0)
select field, round(sum(levenshtein(replace(truth, '।', '|'), replace(got, '।', '|'))) / sum(length(truth)), 9) as cer, round(avg(case when truth = got then 1.0 else 0.0 end), 9) as exact from p group by 1""")
def a25_character_errors(spark, d):
    rows = land(spark, d, "readings").where("length(value) > 0").select("field", F.col("value").alias("truth"), F.coalesce("corrected", F.left("value", F.lit(3))).alias("got"))
    cer = F.sum(F.levenshtein("truth", "got")) / F.sum(F.length("truth"))
    return rows.groupBy("field").agg(F.round(cer, 9).alias("cer"), F.round(F.avg((F.col("truth") == F.col("got")).cast("double")), 9).alias("exact"))


@query("""with t as (select case when l_partkey % 20 = 0 then -100 when l_quantity > 25 then l_linenumber else 0 end as actual, case when l_discount > 0.03 then l_linenumber when l_tax > 0.06 then 1 else 0 end as got from lineitem),
c as (select count(*) filter (got = actual and actual <> 0) as tp, count(*) filter (got <> actual and got <> 0) as fp, count(*) filter (got <> actual and actual <> 0) as fn from t where actual <> -100)
select tp, fp, fn, round(tp / (tp + fp), 9) as "precision", round(tp / (tp + fn), 9) as recall, round(2 * tp / (2 * tp + fp + fn), 9) as f1 from c""")
def a26_token_scores(spark, d):
    """Tokens of class 0 are no field, and masked ones don't count."""
    c = F.col
    actual = F.when(c("l_partkey") % 20 == 0, -100).when(c("l_quantity") > 25, c("l_linenumber")).otherwise(0)
    got = F.when(c("l_discount") > 0.03, c("l_linenumber")).when(c("l_tax") > 0.06, 1).otherwise(0)
    rows = land(spark, d, "lineitem").select(actual.alias("a"), got.alias("g")).where("a != -100")
    same = c("a") == c("g")
    counts = rows.agg(F.count_if(same & (c("a") != 0)).alias("tp"), F.count_if(~same & (c("g") != 0)).alias("fp"), F.count_if(~same & (c("a") != 0)).alias("fn"))
    return with_scores(counts).select("tp", "fp", "fn", *[F.round(x, 9).alias(x) for x in ("precision", "recall", "f1")])


@query("""with p as (select lang, toxic, least(n_chars / 5000.0, 1.0) as p from labels join documents using (doc_id)), b as (select lang, least(floor(p * 8), 7) as b, count(*) as n, abs(avg(p) - avg(toxic)) as gap from p group by all),
e as (select lang, sum(n * gap) / sum(n) as ece from b group by 1) select round(max(ece), 9) as worst, round(max(ece) - min(ece), 9) as gap,
(select round(avg((p - toxic) ** 2), 9) from p) as brier, (select round(avg(case when (p >= 0.5) = (toxic = 1) then 1.0 else 0.0 end), 9) from p) as accuracy from e""")
def a28_calibration_by_group(spark, d):
    rows = land(spark, d, "labels").join(land(spark, d, "documents").select("doc_id", "lang", "n_chars"), "doc_id")
    out = grouped_calibration(rows, "lang", F.least(F.col("n_chars") / 5000.0, F.lit(1.0)), F.col("toxic"))
    return out.select(*[F.round(c, 9).alias(c) for c in ("worst", "gap", "brier", "accuracy")])


@query("select cast(floor(value / 10) as integer) || 'xx' as class, count(*) as n from events group by 1")
def a32_status_classes(spark, d):
    return land(spark, d, "events").groupBy(F.concat(F.floor(F.col("value") / 10).cast("int"), F.lit("xx")).alias("class")).agg(F.count("*").alias("n"))


@query(f"""with {land_sql("readings")} select deed_id, round(avg(case when confidence < 0.7 then 1.0 else 0.0 end), 9) as coverage, list_sort(coalesce(list(distinct field) filter (confidence < 0.7), [])) as fields,
round(avg(case when line <> 3 then confidence end), 9) as score from readings group by 1""")
def a33_flagged_coverage(spark, d):
    low = F.col("confidence") < 0.7
    return land(spark, d, "readings").groupBy("deed_id").agg(
        F.round(F.avg(low.cast("double")), 9).alias("coverage"), F.sort_array(F.collect_set(F.when(low, F.col("field")))).alias("fields"),
        F.round(F.avg(F.when(F.col("line") != 3, F.col("confidence"))), 9).alias("score"),
    )


@query(f"""with {land_sql("readings")} select deed_id, arg_min(line, confidence * 1000 + line) as weakest, list(round(confidence, 6) order by line, confidence) as page_scores from readings group by 1""")
def a34_weakest_page(spark, d):
    listed = F.transform(F.array_sort(F.collect_list(F.struct("line", "confidence"))), lambda x: F.round(x["confidence"], 6))
    weakest = F.min_by("line", F.col("confidence") * 1000 + F.col("line"))
    return land(spark, d, "readings").groupBy("deed_id").agg(weakest.alias("weakest"), listed.alias("page_scores"))


@query("""with pages as (select l_orderkey as doc, l_suppkey % 3 as page, unnest(case when l_tax > 0.04 then ['AREA', 'OWNER'] when l_discount > 0.05 then ['AREA'] else ['KHASRA', 'AREA'] end) as field from lineitem),
n as (select doc, count(distinct page) as n from pages group by 1) select doc, field from pages join n using (doc) group by doc, field, n having count(distinct page) = n""")
def a35_missing_everywhere(spark, d):
    """Fields that every page of a document misses: an intersection over its pages."""
    c = F.col
    lists = F.when(c("l_tax") > 0.04, F.array(F.lit("AREA"), F.lit("OWNER"))).when(c("l_discount") > 0.05, F.array(F.lit("AREA"))).otherwise(F.array(F.lit("KHASRA"), F.lit("AREA")))
    rows = land(spark, d, "lineitem").select(c("l_orderkey").alias("doc"), (c("l_suppkey") % 3).alias("page"), F.explode(lists).alias("field")).distinct()
    pages = rows.select("doc", "page").distinct().groupBy("doc").agg(F.count("*").alias("n"))
    return rows.groupBy("doc", "field").agg(F.count("*").alias("m")).join(pages, "doc").where("m = n").select("doc", "field")


@query(f"with {land_sql('corrections')} select count(*) filter (reviewed) as reviewed, count(*) filter (not reviewed) as pending, count(*) filter (reviewed and accepted) as accepted, count(*) filter (reviewed and accepted) >= 50 as ready from corrections")
def a36_readiness(spark, d):
    out = land(spark, d, "corrections").agg(F.count_if("reviewed").alias("reviewed"), F.count_if(~F.col("reviewed")).alias("pending"), F.count_if(F.col("reviewed") & F.col("accepted")).alias("accepted"))
    return out.withColumn("ready", F.col("accepted") >= 50)


@query(f"with {land_sql('corrections')} select count(*) as fresh from corrections where accepted and corrected_at > (select max(o_orderdate) - interval 365 day from orders)")
def a37_new_since(spark, d):
    since = land(spark, d, "orders").agg((F.max("o_orderdate") - F.expr("interval 365 days")).alias("since"))  # one row
    return land(spark, d, "corrections").where("accepted").join(F.broadcast(since), F.col("corrected_at") > F.col("since")).agg(F.count("*").alias("fresh"))


@query("""with o as (select event_id, case event_id % 5 when 0 then 'FAILED' when 1 then 'PENDING' else 'DELIVERED' end as status from events)
select status, count(*) as n, (select count(*) from orders where o_orderstatus = 'F' and o_orderkey not in (select event_id from events)) as backlog from o group by 1""")
def a38_outbox(spark, d):
    """Deliveries by status, and how many finished documents have none yet."""
    status = F.when(F.col("event_id") % 5 == 0, "FAILED").when(F.col("event_id") % 5 == 1, "PENDING").otherwise("DELIVERED")
    sent = land(spark, d, "events").select(F.col("event_id").alias("o_orderkey"), status.alias("status"))
    behind = land(spark, d, "orders").where("o_orderstatus = 'F'").join(sent, "o_orderkey", "left_anti").agg(F.count("*").alias("backlog"))  # one row
    return sent.groupBy("status").agg(F.count("*").alias("n")).join(F.broadcast(behind))


@query("""select l_orderkey, cast(sum(l_linenumber) as bigint) as agreed, cast(sum(case when l_tax > 0.05 then 1 else 0 end) as bigint) as disagreed,
(list(l_linenumber || ':' || l_partkey order by l_linenumber, l_partkey) filter (l_tax > 0.05))[:2] as examples from lineitem group by 1 having sum(case when l_tax > 0.05 then 1 else 0 end) > 0""")
def a43_second_opinions(spark, d):
    """Sums over the pages and the first few disagreements."""
    off = F.col("l_tax") > 0.05
    listed = F.array_sort(F.collect_list(F.when(off, F.struct("l_linenumber", "l_partkey"))))
    out = land(spark, d, "lineitem").groupBy("l_orderkey").agg(F.sum("l_linenumber").cast("long").alias("agreed"), F.count_if(off).alias("disagreed"), listed.alias("x"))
    examples = F.transform(F.slice("x", 1, 2), lambda x: F.concat_ws(":", x["l_linenumber"], x["l_partkey"]))
    return out.where("disagreed > 0").select("l_orderkey", "agreed", "disagreed", examples.alias("examples"))


@query("""with r as (select event_type, count(*) as pages, sum(case when user_id % 2 = 0 then value end) as now, sum(case when user_id % 2 = 1 then value end) as before from events group by 1)
select event_type, pages, round(before - now, 4) as saved, round((before - now) / pages * 1000, 2) as per_thousand, round((before / now - 1) * 100, 1) as gain, round((1 - now / before) * 100, 1) as reduction from r where now > 0 and before > 0""")
def a44_run_deltas(spark, d):
    c = F.col
    runs = land(spark, d, "events").groupBy("event_type").agg(F.count("*").alias("pages"), F.sum(F.when(c("user_id") % 2 == 0, c("value"))).alias("now"), F.sum(F.when(c("user_id") % 2 == 1, c("value"))).alias("before"))
    saved = c("before") - c("now")
    return runs.where("now > 0 and before > 0").select(
        "event_type", "pages", F.round(saved, 4).alias("saved"), F.round(saved / c("pages") * 1000, 2).alias("per_thousand"),
        F.round((c("before") / c("now") - 1) * 100, 1).alias("gain"), F.round((1 - c("now") / c("before")) * 100, 1).alias("reduction"),
    )


@query(f"""with {land_sql("readings", "flags")}, l as (select deed_id, min(confidence) as low from readings group by 1), f as (select deed_id, count(*) as n from flags where deed_id is not null group by 1)
select deed_id, case when low < 0.6 then 1 when coalesce(n, 0) > 0 then 2 else 3 end as priority from l left join f using (deed_id)""")
def a45_queue_priority(spark, d):
    low = land(spark, d, "readings").groupBy("deed_id").agg(F.min("confidence").alias("low"))
    flags = land(spark, d, "flags").where("deed_id is not null").select("deed_id").distinct().withColumn("some", F.lit(True))
    return low.join(flags, "deed_id", "left").select("deed_id", F.when(F.col("low") < 0.6, 1).when(F.col("some"), 2).otherwise(3).alias("priority"))


@query(f"""with {land_sql("corrections")} select deed_id, list(line || '/' || field || '=' || corrected order by line, field, corrected) as pages from corrections where reviewed and accepted group by 1""")
def a46_accepted_by_page(spark, d):
    rows = land(spark, d, "corrections").where("reviewed and accepted")
    listed = F.array_sort(F.collect_list(F.struct("line", "field", "corrected")))
    out = rows.groupBy("deed_id").agg(listed.alias("x"))
    return out.select("deed_id", F.transform("x", lambda x: F.concat(x["line"], F.lit("/"), x["field"], F.lit("="), x["corrected"])).alias("pages"))


@query(f"""with {land_sql("holdings")}, m as (select *, case when holding_id % 3 = 0 then holding_id end as mutation from holdings)
select parcel_id, valid_from, list_sort(list(owner_id)) as owners, min(mutation) as mutation from m group by 1, 2""")
def a48_eras(spark, d):
    """Spans that begin on one day are one era; a mutation on any of them explains it."""
    rows = land(spark, d, "holdings").withColumn("mutation", F.when(F.col("holding_id") % 3 == 0, F.col("holding_id")))
    return rows.groupBy("parcel_id", "valid_from").agg(F.sort_array(F.collect_list("owner_id")).alias("owners"), F.min("mutation").alias("mutation"))


@query(f"""with {land_sql("readings")} select deed_id, status, line, confidence from (select *, row_number() over (partition by deed_id, status order by line, confidence) as k from readings) where k = 1""")
def w08_first_per_key(spark, d):
    first = F.min(F.struct("line", "confidence")).alias("x")
    return land(spark, d, "readings").groupBy("deed_id", "status").agg(first).select("deed_id", "status", "x.line", "x.confidence")


_LABELS = """lab as (select user_id, event_id, case cast(floor(value) as bigint) % 5 when 0 then 'O' when 1 then 'B-NAME' when 2 then 'I-NAME' when 3 then 'B-AREA' else 'I-AREA' end as label from events)"""


@query(f"""with {_LABELS}, s as (select *, split_part(label, '-', 2) as field, lag(label) over w as b from lab window w as (partition by user_id order by event_id)),
g as (select *, sum(case when label <> 'O' and (left(label, 1) = 'B' or b is null or b = 'O' or split_part(b, '-', 2) <> field) then 1 else 0 end) over (partition by user_id order by event_id) as k from s)
select user_id, field, min(event_id) as first_, max(event_id) as last_, count(*) as words from g where label <> 'O' group by user_id, k, field""")
def w10_label_spans(spark, d):
    """Runs of B- and I- labels of one field; an I- without a B- begins a run, O ends one."""
    label = F.get(F.array(*map(F.lit, ("O", "B-NAME", "I-NAME", "B-AREA", "I-AREA"))), (F.floor("value") % 5).cast("int"))
    rows = land(spark, d, "events").select("user_id", "event_id", label.alias("label"))
    before = F.lag("label").over(Window.partitionBy("user_id").orderBy("event_id"))
    rows = rows.withColumn("field", F.split("label", "-")[F.when(F.col("label") == "O", 0).otherwise(1)]).withColumn("before", before)
    begins = (F.col("label") != "O") & (F.col("label").startswith("B") | F.col("before").isNull() | ~F.col("before").endswith(F.concat(F.lit("-"), F.col("field"))))
    runs = islands(rows, "user_id", "event_id", begins).where("label != 'O'").groupBy("user_id", "island", "field")
    return runs.agg(F.min("event_id").alias("first_"), F.max("event_id").alias("last_"), F.count("*").alias("words")).drop("island")


@query("""with b as (select user_id, event_id, cast(floor(value) as bigint) % 4 as k, value from events), p as (select *, lag(k, 1, 0) over (partition by user_id order by event_id) as before from b),
e as (select * from p where k <> 0 and k <> before) select user_id, string_agg(substr('abc', cast(k as int), 1), '' order by event_id) as text, round(avg(value / 1000), 9) as confidence from e group by 1""")
def w11_collapsed_labels(spark, d):
    """Greedy reading of a line: blanks (0) and repeats go, what stays is spelled."""
    rows = land(spark, d, "events").select("user_id", "event_id", (F.floor("value") % 4).alias("k"), "value")
    rows = rows.withColumn("before", F.lag("k", 1, 0).over(Window.partitionBy("user_id").orderBy("event_id"))).where("k != 0 and k != before")
    out = rows.groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct("event_id", "k"))).alias("x"), F.round(F.avg(F.col("value") / 1000), 9).alias("confidence"))
    return out.select("user_id", F.array_join(F.transform("x", lambda x: F.substring(F.lit("abc"), x["k"].cast("int"), F.lit(1))), "").alias("text"), "confidence")


_HASH = "lpad(printf('%x', (p_partkey * 2654435761 + p_size * 40503) % 1099511627776), 16, '0')"


#: The newest images that an image is compared with, the differing bits that count, and the matches kept as evidence.
NEWEST, DIFFERING, EVIDENCE = 500, 10, 5


def twins(spark, d):
    """(id, twin, distance) of images and the newer ones among the newest that are like them."""
    hashed = F.lpad(F.lower(F.hex((F.col("p_partkey") * 2654435761 + F.col("p_size") * 40503) % 1099511627776)), 16, "0")
    rows = land(spark, d, "part").select(F.col("p_partkey").alias("id"), hash_number(hashed).alias("hash"))
    # The newest are the feature: a top-k of so many rows.
    return near_rows(rows, rows.orderBy(F.desc("id")).limit(NEWEST), DIFFERING).where("id < twin")


_TWINS = f"""with h as (select p_partkey, {_HASH} as h from part), newest as (select * from h order by p_partkey desc limit {NEWEST}),
m as (select a.p_partkey, b.p_partkey as twin, cast(bit_count(xor(cast('0x' || a.h as bigint), cast('0x' || b.h as bigint))) as integer) as distance from h a join newest b on a.p_partkey < b.p_partkey)"""


@query(f"{_TWINS} select * from m where distance <= {DIFFERING}")
def j16_image_twins(spark, d):
    """Images within ten differing bits of one of the newest 500."""
    return twins(spark, d).select(F.col("id").alias("p_partkey"), "twin", "distance")


@query(f"{_TWINS} select p_partkey, list(twin || ':' || distance order by distance, twin)[:{EVIDENCE}] as closest from m where distance <= {DIFFERING} group by 1")
def o12_closest_twins(spark, d):
    """Matches of an image, the closest first, five at most as evidence; distances of 64 bits (m21)."""
    listed = twins(spark, d).groupBy("id").agg(F.slice(F.array_sort(F.collect_list(F.struct("distance", "twin"))), 1, EVIDENCE).alias("x"))
    return listed.select(F.col("id").alias("p_partkey"), F.transform("x", lambda x: F.concat_ws(":", x["twin"], x["distance"])).alias("closest"))


@query(f"""with h as (select p_partkey, cast('0x' || {_HASH} as bigint) as h from part) select a.p_partkey, count(*) as twins, min(cast(bit_count(xor(a.h, b.h)) as integer)) as distance
from h a join h b on a.p_partkey != b.p_partkey and bit_count(xor(a.h, b.h)) <= 7 group by 1""")
def m21_all_near_hashes(spark, d):
    """For each image, those of all images within seven differing bits: how many, and how near the nearest is."""
    hashed = F.lpad(F.lower(F.hex((F.col("p_partkey") * 2654435761 + F.col("p_size") * 40503) % 1099511627776)), 16, "0")
    rows = land(spark, d, "part").select(F.col("p_partkey").alias("id"), hash_number(hashed).alias("hash"))
    near = near_rows(rows, rows, 7).where("id != twin")
    return near.groupBy(F.col("id").alias("p_partkey")).agg(F.count("*").alias("twins"), F.min("distance").alias("distance"))


@query(f"""with {land_sql("holdings")}, o as (select distinct parcel_id, owner_id from holdings) select a.parcel_id, list_sort(list(distinct b.parcel_id)) as others from o a join o b on a.owner_id = b.owner_id and a.parcel_id <> b.parcel_id group by 1""")
def j26_connected_parcels(spark, d):
    own = land(spark, d, "holdings").select("parcel_id", "owner_id").distinct()
    other = own.select("owner_id", F.col("parcel_id").alias("other"))
    return own.join(other, "owner_id").where("parcel_id != other").groupBy("parcel_id").agg(F.sort_array(F.collect_set("other")).alias("others"))


@query(f"""with {land_sql("corrections", "readings", "deeds")} select correction_id, r.value, d.state, n.n_name as owner from corrections c join readings r on r.deed_id = c.deed_id and r.line = c.line join deeds d on d.deed_id = c.deed_id left join nation n on 'N' || n.n_nationkey = d.village_id where c.reviewed""")
def j27_feedback_chain(spark, d):
    """Correction, reading and document in inner joins; the village stays out where there is none (j28)."""
    place = land(spark, d, "nation").select(F.format_string("N%d", "n_nationkey").alias("village_id"), F.col("n_name").alias("owner"))
    rows = land(spark, d, "corrections").where("reviewed").select("correction_id", "deed_id", "line")
    rows = rows.join(land(spark, d, "readings").select("deed_id", "line", "value"), ["deed_id", "line"]).join(land(spark, d, "deeds").select("deed_id", "state", "village_id"), "deed_id")
    return rows.join(place, "village_id", "left").select("correction_id", "value", "state", "owner")


@query("select c_custkey, c_name from customer where c_nationkey not in (select n_nationkey from nation where n_regionkey = 1)")
def k10_without_stale(spark, d):
    """Rows stay whose key came in with the new set."""
    incoming = land(spark, d, "nation").where("n_regionkey != 1").select(F.col("n_nationkey").alias("c_nationkey"))
    return without_stale(land(spark, d, "customer"), incoming, ["c_nationkey"]).select("c_custkey", "c_name")


@query("select event_id, case when event_type in ('click', 'view') and ts < timestamp '2024-01-15' then 'EXPIRED' else event_type end as status from events")
def k12_conditional_update(spark, d):
    rows = land(spark, d, "events").select("event_id", F.col("event_type").alias("status"), "ts")
    when = F.col("status").isin("click", "view") & (F.col("ts") < F.lit("2024-01-15").cast("timestamp"))
    return changed_where(rows, when, {"status": F.lit("EXPIRED")}).select("event_id", "status")


@query("""with given as (select printf('DOC-%05d', o_orderkey) as external_id from orders where o_orderstatus = 'F' union all select 'OLD-999999999'),
top as (select coalesce(max(cast(regexp_extract(external_id, '^DOC-([0-9]+)$', 1) as bigint)), 0) as most from given where regexp_matches(external_id, '^DOC-[0-9]+$'))
select o_orderkey, printf('DOC-%05d', most + row_number() over (order by o_orderkey)) as external_id from orders, top where o_orderstatus = 'P'""")
def k17_sequence_ids(spark, d):
    """Numbers follow the highest one given so far, whatever the gaps, in the order of the keys."""
    orders = land(spark, d, "orders")
    given = orders.where("o_orderstatus = 'F'").select(F.format_string("DOC-%05d", "o_orderkey").alias("external_id"))
    given = given.unionAll(spark.range(1).select(F.lit("OLD-999999999")))
    return numbered_ids(orders.where("o_orderstatus = 'P'").select("o_orderkey"), "o_orderkey", highest_number(given, "external_id", "DOC-"), "DOC-%05d")


@query(f"""with {land_sql("deeds", "parcels", "holdings", "places")} select deed_id, 'khasra=' || khasra || ';village=' || v.name || ';holders=' || array_to_string(h.hs, ',') as record from deeds d join parcels p using (parcel_id) join places v on v.id = p.village_id
join (select parcel_id, list(owner_id || ':' || share order by owner_id, share) as hs from holdings where valid_to is null group by 1) h using (parcel_id) where d.state = 'APPROVED'""")
def k04_record_payload(spark, d):
    """A document's record as one nested value (place, plot and holders in order), shown as text; only approved ones with a plot (x20)."""
    held = F.array_sort(F.collect_list(F.struct("owner_id", "share")))
    holders = land(spark, d, "holdings").where("valid_to is null").groupBy("parcel_id").agg(held.alias("holders"))
    village = land(spark, d, "places").select(F.col("id").alias("village_id"), F.col("name").alias("village"))
    plots = land(spark, d, "parcels").join(village, "village_id").join(holders, "parcel_id")
    record = F.struct(F.struct("khasra", "khata").alias("parcel"), F.struct("village").alias("location"), "holders").alias("r")
    shown = F.array_join(F.transform("r.holders", lambda x: F.concat_ws(":", x["owner_id"], x["share"])), ",")
    text = F.concat(F.lit("khasra="), F.col("r.parcel.khasra"), F.lit(";village="), F.col("r.location.village"), F.lit(";holders="), shown).alias("record")
    # A plot's text is long and many documents have it: it is made once, settled, and documents come sorted by plot, so that files hold it once a task.
    # The longest come first: a writer guesses the next rows' size by those before and would hold thousands of long ones after short ones.
    texts = settle(plots.select("parcel_id", record).select("parcel_id", text).withColumn("rank", -F.length("record")))
    rows = land(spark, d, "deeds").where("state = 'APPROVED' and parcel_id is not null").select("deed_id", "parcel_id")
    rows = rows.join(texts.select("parcel_id", "rank"), "parcel_id")
    tasks = pieces(spark)
    rows = rows.repartition(tasks, "rank", "parcel_id").hint("merge")
    return rows.join(texts.repartition(tasks, "rank", "parcel_id"), ["rank", "parcel_id"]).select("deed_id", "record")


@query(f"""with {land_sql("deeds")} select deed_id, case when state <> 'APPROVED' then 'not approved' when parcel_id is null then 'no parcel' end as reason from deeds""")
def x20_eligibility(spark, d):
    reason = F.when(F.col("state") != "APPROVED", "not approved").when(F.col("parcel_id").isNull(), "no parcel")
    return land(spark, d, "deeds").select("deed_id", reason.alias("reason"))


@query("select 'documents_total{state=\"' || o_orderstatus || '\"} ' || count(*) as line from orders group by o_orderstatus union all select 'documents_worth_max ' || cast(floor(max(o_totalprice)) as bigint) from orders")
def k08_exposition(spark, d):
    """Figures as lines of text, a name, its labels and the value."""
    rows = land(spark, d, "orders").groupBy("o_orderstatus").agg(F.count("*").alias("n"))
    lines = rows.select(F.format_string('documents_total{state="%s"} %d', "o_orderstatus", "n").alias("line"))
    most = land(spark, d, "orders").agg(F.max("o_totalprice").alias("m")).select(F.concat(F.lit("documents_worth_max "), F.floor("m").cast("long")).alias("line"))
    return lines.unionByName(most)


@query(f"""with {land_sql("holdings")} select holding_id, sha256(parcel_id || ':' || owner_id) as digest from holdings where holding_id % 10 = 3 and sha256(parcel_id || ':' || owner_id) not in (select sha256(parcel_id || ':' || owner_id) from holdings where holding_id % 10 = 1)""")
def k06_new_digests(spark, d):
    """What is dropped off is named by its digest, so a second drop of the same adds nothing."""
    rows = land(spark, d, "holdings").select("holding_id", F.sha2(F.concat_ws(":", "parcel_id", "owner_id"), 256).alias("digest"))
    return insert_absent(rows.where("holding_id % 10 = 1").select("digest"), rows.where("holding_id % 10 = 3"), ["digest"]).select("holding_id", "digest")


@query("""select p_partkey, p_retailprice, p_size from part a where p_size >= 20 and p_retailprice <= 1500 and not exists (select 1 from part b where b.p_size >= 20 and b.p_retailprice <= 1500 and
((b.p_size >= a.p_size and b.p_retailprice < a.p_retailprice) or (b.p_size > a.p_size and b.p_retailprice <= a.p_retailprice))) order by p_retailprice, p_partkey limit 1""")
def x19_budgeted_choice(spark, d):
    """Of the points no other beats, the cheapest that is good enough and within the budget."""
    rows = land(spark, d, "part").where("p_size >= 20 and p_retailprice <= 1500").select("p_partkey", "p_retailprice", "p_size")
    return skyline(rows, "p_size", "p_retailprice").orderBy("p_retailprice", "p_partkey").limit(1)


@query("""with c as (select count(*) filter (event_type = 'click') as pending, avg(case when event_type = 'view' then value end) as f1, avg(case when event_type = 'purchase' then value end) as current from events)
select case when pending < 50 then 'skipped' when f1 >= coalesce(current, 0) then 'promoted' else 'kept' end as status from c""")
def x21_promotion(spark, d):
    """A new model takes over if it is no worse, and is only tried when enough corrections wait."""
    c = F.col
    one = land(spark, d, "events").agg(F.count_if(c("event_type") == "click").alias("pending"), F.avg(F.when(c("event_type") == "view", c("value"))).alias("f1"), F.avg(F.when(c("event_type") == "purchase", c("value"))).alias("current"))
    return one.select(F.when(c("pending") < 50, "skipped").when(c("f1") >= F.coalesce("current", F.lit(0.0)), "promoted").otherwise("kept").alias("status"))


@query("""with r as (select event_id, try_cast(json_extract_string(props, '$.k') as bigint) as k, value as v from events) select event_id, case when k is null then 'missing' when k < 0 or k > 50 then 'range' when isinf(v) or isnan(v) then 'not finite' end as fault from r where k is null or k < 0 or k > 50 or isinf(v) or isnan(v)""")
def x23_reply_faults(spark, d):
    """Replies in JSON against their schema: what is missing, out of range or not finite."""
    rows = land(spark, d, "events").select("event_id", F.from_json("props", "k long").alias("p"), "value")
    fault = F.when(F.col("p.k").isNull(), "missing").when(~F.col("p.k").between(0, 50), "range").when(F.isnan("value") | (F.abs("value") == float("inf")), "not finite")
    return rows.select("event_id", fault.alias("fault")).where("fault is not null")


@query(f"""with {land_sql("holdings", "mutations", "flags")}, l as (select parcel_id, valid_from || ' held by ' || owner_id as line from holdings union all select parcel_id, effective_date || ' ' || kind from mutations union all select parcel_id, 'flag ' || kind from flags where parcel_id is not null)
select parcel_id, list_sort(list(line)) as history from l group by 1""")
def x24_history_lines(spark, d):
    held = land(spark, d, "holdings").select("parcel_id", F.concat("valid_from", F.lit(" held by "), "owner_id").alias("line"))
    moved = land(spark, d, "mutations").select("parcel_id", F.concat("effective_date", F.lit(" "), "kind").alias("line"))
    flagged = land(spark, d, "flags").where("parcel_id is not null").select("parcel_id", F.concat(F.lit("flag "), "kind").alias("line"))
    return held.unionByName(moved).unionByName(flagged).groupBy("parcel_id").agg(F.sort_array(F.collect_list("line")).alias("history"))


@query(f"""with {land_sql("deeds", "readings", "corrections", "flags")} select deed_id, coalesce(r.fields, []) as fields, coalesce(c.fixes, []) as fixes, coalesce(f.kinds, []) as kinds from deeds
left join (select deed_id, list(line || ':' || field order by line) as fields from readings group by 1) r using (deed_id) left join (select deed_id, list(line || ':' || corrected order by line, corrected) as fixes from corrections group by 1) c using (deed_id)
left join (select deed_id, list(kind order by flag_id) as kinds from flags where deed_id is not null group by 1) f using (deed_id)""")
def x25_workspace(spark, d):
    """A document with its lists, each gathered on its own and in order."""
    parts = {
        "fields": (land(spark, d, "readings"), ["line", "field"], lambda x: F.concat_ws(":", x["line"], x["field"])),
        "fixes": (land(spark, d, "corrections"), ["line", "corrected"], lambda x: F.concat_ws(":", x["line"], x["corrected"])),
        "kinds": (land(spark, d, "flags").where("deed_id is not null"), ["flag_id", "kind"], lambda x: x["kind"]),
    }
    out = land(spark, d, "deeds").select("deed_id")
    for name, (rows, order, show) in parts.items():
        listed = rows.groupBy("deed_id").agg(F.array_sort(F.collect_list(F.struct(*order))).alias("x"))
        out = out.join(listed.select("deed_id", F.transform("x", show).alias(name)), "deed_id", "left")
    return out.select("deed_id", *[F.coalesce(c, F.array().cast("array<string>")).alias(c) for c in parts])


@query("""with b as (select l_orderkey, l_linenumber, l_partkey % 640 as x1, l_suppkey % 90 as y1, l_partkey % 640 + l_linenumber * 20 - 30 as x2, l_suppkey % 90 + 15 as y2 from lineitem)
select l_orderkey, l_linenumber, 'degenerate' as problem from b where x2 <= x1 or y2 <= y1 union all select l_orderkey, l_linenumber, 'outside' from b where not (x1 >= 0 and x1 < 640 and y1 >= 0 and y1 < 100 and x2 > 0 and x2 <= 640 and y2 > 0 and y2 <= 100)
union all select doc_id, -1, 'not composed' from documents where text <> nfc_normalize(text)""")
def x13_annotation_faults(spark, d):
    c = F.col
    x1, y1 = c("l_partkey") % 640, c("l_suppkey") % 90
    rows = land(spark, d, "lineitem").select("l_orderkey", "l_linenumber", x1.alias("x1"), y1.alias("y1"), (x1 + c("l_linenumber") * 20 - 30).alias("x2"), (y1 + 15).alias("y2"))
    inside = (c("x1") >= 0) & (c("x1") < 640) & (c("y1") >= 0) & (c("y1") < 100) & (c("x2") > 0) & (c("x2") <= 640) & (c("y2") > 0) & (c("y2") <= 100)
    faults = F.array(F.when((c("x2") <= c("x1")) | (c("y2") <= c("y1")), "degenerate"), F.when(~inside, "outside"))
    found = rows.select("l_orderkey", "l_linenumber", F.explode(F.array_compact(faults)).alias("problem"))
    texts = land(spark, d, "documents").where(F.col("text") != nfc(F.col("text"))).select(c("doc_id").alias("l_orderkey"), F.lit(-1).alias("l_linenumber"), F.lit("not composed").alias("problem"))
    return found.unionByName(texts)


@query(f"""with {land_sql("parcels", "places", "holdings", "deeds", "mutations", "flags", "readings", "corrections", "grievances")}
select 'parcels.village' as edge, count(*) as missing from parcels where village_id not in (select id from places)
union all select 'holdings.parcel', count(*) from holdings where parcel_id not in (select parcel_id from parcels)
union all select 'holdings.owner', count(*) from holdings where owner_id not in (select c_custkey from customer)
union all select 'mutations.parcel', count(*) from mutations where parcel_id not in (select parcel_id from parcels)
union all select 'deeds.parcel', count(*) from deeds where parcel_id not in (select parcel_id from parcels)
union all select 'flags.deed', count(*) from flags where deed_id not in (select deed_id from deeds)
union all select 'corrections.reading', count(*) from corrections c where not exists (select 1 from readings r where r.deed_id = c.deed_id and r.line = c.line)
union all select 'grievances.parcel', count(*) from grievances where parcel_id not in (select parcel_id from parcels)
union all select 'owners in lists', count(*) from (select unnest([owner_id, owner_id + 700]) as o from holdings) where o not in (select c_custkey from customer)""")
def x14_world_invariants(spark, d):
    """Nine references, one of them from the elements of a list; those that lead nowhere are counted (j29)."""
    lists = land(spark, d, "holdings").select(F.explode(F.array("owner_id", F.col("owner_id") + 700)).alias("o"))
    edges = [
        ("parcels.village", land(spark, d, "parcels"), ["village_id"], land(spark, d, "places"), ["id"]),
        ("holdings.parcel", land(spark, d, "holdings"), ["parcel_id"], land(spark, d, "parcels"), ["parcel_id"]),
        ("holdings.owner", land(spark, d, "holdings"), ["owner_id"], land(spark, d, "customer"), ["c_custkey"]),
        ("mutations.parcel", land(spark, d, "mutations"), ["parcel_id"], land(spark, d, "parcels"), ["parcel_id"]),
        ("deeds.parcel", land(spark, d, "deeds"), ["parcel_id"], land(spark, d, "parcels"), ["parcel_id"]),
        ("flags.deed", land(spark, d, "flags"), ["deed_id"], land(spark, d, "deeds"), ["deed_id"]),
        ("corrections.reading", land(spark, d, "corrections"), ["deed_id", "line"], land(spark, d, "readings"), ["deed_id", "line"]),
        ("grievances.parcel", land(spark, d, "grievances"), ["parcel_id"], land(spark, d, "parcels"), ["parcel_id"]),
        ("owners in lists", lists, ["o"], land(spark, d, "customer"), ["c_custkey"]),
    ]
    out = None
    for name, child, fk, parent, pk in edges:
        keys = [f"k{i}" for i in range(len(fk))]
        rows = child.select(*[F.col(c).alias(k) for c, k in zip(fk, keys, strict=True)]).dropna()
        lost = rows.join(parent.select(*[F.col(c).alias(k) for c, k in zip(pk, keys, strict=True)]), keys, "left_anti").agg(F.count("*").alias("missing"))
        one = lost.select(F.lit(name).alias("edge"), "missing")
        out = one if out is None else out.unionByName(one)
    return out


@query()
def x11_group_split(spark, d):
    """Whole groups of documents to train, val and test, balanced by size and tier; groups are customers, tiers priorities."""
    rows = land(spark, d, "orders").select(F.col("o_custkey").alias("grp"), F.col("o_orderpriority").alias("tier"))
    return split_groups(rows, "grp", "tier")

"""Stand-ins of the land-record tables, derived from the given ones.

Each view is one SQL text that Spark and DuckDB both read, so that a query and
its SQL start from the same rows. Names in braces are given tables or views.
"""

from __future__ import annotations

from string import Formatter

from pyspark.sql import DataFrame, SparkSession

from .tables import table

VIEWS = {
    "places": """select 'R' || r_regionkey as id, cast(null as string) as parent_id, 'REGION' as level, r_name as name from {region}
        union all select 'N' || n_nationkey, 'R' || n_regionkey, 'NATION', n_name from {nation}
        union all select 'C' || c_custkey, 'N' || c_nationkey, 'CUSTOMER', c_name from {customer}
        union all select 'S' || s_suppkey, 'N' || s_nationkey, 'SUPPLIER', s_name from {supplier}""",
    # Parcels of 25 villages, the nations; khasras repeat, a unit is unknown.
    "parcels": """select 'P' || p_partkey as parcel_id, 'N' || (p_partkey % 25) as village_id,
        cast(p_partkey % 150 as string) || case when p_size % 3 = 0 then ' / ' || (p_size % 4) else '' end as khasra,
        case when p_size % 9 = 0 then null else cast(p_size as string) end as khata, cast(p_size as double) / 4 as area_value,
        case p_partkey % 8 when 0 then 'ACRE' when 1 then 'HECTARE' when 2 then 'BISWA' when 3 then 'SQUARE_METRE'
            when 4 then 'GUNTHA' when 5 then 'CENT' when 6 then 'KANAL' else 'BIGHA' end as area_unit from {part}""",
    # Plots of a shape (kind) at a place and scale: village 0 holds a third of them, three of four stand in its town, four times as dense.
    "plots": """select id, village, kind, s, recorded * s * s * case kind when 0 then 132 when 1 then 95 when 2 then 48 when 3 then 108 when 4 then 72 else 66 end as recorded,
        cast(case when k % 4 < 3 then ((k - k % 4) / 4 * 3 + k % 4) % 64 * 2.5 else 200 + (k - k % 4) / 4 % 32 * 10 end as double) as x,
        cast(case when k % 4 < 3 then floor(((k - k % 4) / 4 * 3 + k % 4) / 64) * 2.5 else floor((k - k % 4) / 4 / 32) * 10 end as double) as y
        from (select *, cast(case when k % 4 < 3 then 0.25 else 1.0 end as double) as s
            from (select p_partkey as id, case when p_partkey % 3 = 0 then 0 else 1 + p_partkey % 24 end as village,
                case when p_partkey % 3 = 0 then (p_partkey - p_partkey % 3) / 3 else (p_partkey - p_partkey % 24) / 24 end as k,
                case when p_partkey % 37 > 0 then (p_partkey + p_size) % 6 end as kind,
                cast(case when p_size % 10 = 0 then 1.05 when p_size % 10 = 1 then 2.5 else 1.0 end as double) as recorded from {part}) t) u""",
    # Documents: some without a village, some without a parcel.
    "deeds": """select o_orderkey as deed_id, case when o_orderkey % 7 = 0 then null else 'N' || c_nationkey end as village_id,
        case when o_orderkey % 5 < 2 then null else 'P' || (o_orderkey % 500 + 1) end as parcel_id,
        case o_orderstatus when 'F' then 'APPROVED' when 'O' then 'IN_REVIEW' else 'REJECTED' end as state,
        o_custkey as uploader_id, o_orderdate as created_at, o_totalprice as worth, o_orderpriority as priority,
        case when o_orderkey % 3 = 0 then cast(o_orderkey % 150 as string) end as declared_khasra
        from {orders} join {customer} on o_custkey = c_custkey""",
    # Fields read from documents, one row a field, with faults of every kind.
    "readings": """select l_orderkey as deed_id, l_linenumber as line, l_partkey as part_no, l_suppkey as reader_id,
        case l_linenumber when 1 then 'VILLAGE' when 2 then 'KHASRA' when 3 then 'KHATA' when 4 then 'AREA' when 5 then 'AREA_UNIT' when 6 then 'DATE' else 'MUTATION' end as field,
        case l_linenumber
            when 1 then case when l_partkey % 4 = 0 then lower(n_name) || ' ।' when l_partkey % 11 = 0 then '' else n_name end
            when 2 then case when l_partkey % 13 = 0 then 'X' || l_partkey when l_partkey % 3 = 0 then (l_partkey % 150) || '/' || (l_partkey % 4) else cast(l_partkey % 150 as string) end
            when 3 then case when l_partkey % 10 = 0 then 'K-' || l_suppkey else cast(l_partkey % 50 as string) end
            when 4 then case when l_partkey % 17 = 0 then 'n/a' else cast(cast(l_quantity as int) * (1 + l_partkey % 3 * 20) as string) || '.5' end
            when 5 then case l_partkey % 5 when 0 then 'BIGHA' when 1 then 'ACRE' when 2 then 'HECTARE' when 3 then 'KANAL' end
            when 6 then case when l_partkey % 9 = 0 then '2006-02-31' when l_partkey % 9 = 1 then '2099-01-01' when l_partkey % 9 = 2 then '1850-05-05' else substr(cast(cast(l_shipdate as date) as string), 1, 10) end
            else case when l_partkey % 2 = 0 then cast(l_suppkey as string) end end as value,
        case when l_tax > 0.06 and l_linenumber < 5 then case l_linenumber when 1 then n_name else cast(l_partkey % 150 as string) end end as corrected,
        1 - l_discount * 5 as confidence,
        case l_returnflag when 'A' then 'AUTO_ACCEPTED' when 'R' then 'NEEDS_REVIEW' else 'CORRECTED' end as status,
        'v' || (l_partkey % 3) as model_version, l_shipdate as read_at
        from {lineitem} join {nation} on n_nationkey = l_suppkey % 25""",
    # Owners' shares of parcels over time; some shares are malformed, some spans run backwards.
    "holdings": """select 'P' || (o_orderkey % 500 + 1) as parcel_id, o_custkey as owner_id, o_orderkey as holding_id,
        case o_orderkey % 7 when 0 then '1/1' when 1 then '1/2' when 2 then '1/2' when 3 then '1/3' when 4 then '2/3' when 5 then '1/0' else 'half' end as share,
        cast(o_orderdate as date) as valid_from,
        case when o_orderkey % 29 = 0 then date '1994-01-01' when o_orderkey % 4 < 3 then cast(lead(cast(o_orderdate as date)) over (partition by o_orderkey % 500 order by o_orderdate, o_orderkey) as date) end as valid_to
        from {orders}""",
    # Mutations in the order of their numbers.
    "mutations": """select event_id as mutation_id, 'P' || (user_id % 500 + 1) as parcel_id, cast(ts as date) as effective_date, event_type as kind
        from {events} where event_type in ('purchase', 'signup')""",
    # Complaints, by citizens (who own what the customer of their number holds), some without a parcel.
    "grievances": """select event_id as grievance_id, user_id as raised_by, case when event_id % 3 = 0 then null else 'P' || (event_id % 500 + 1) end as parcel_id,
        case event_id % 4 when 0 then 'OPEN' when 1 then 'UNDER_REVIEW' when 2 then 'RESOLVED' else 'CLOSED' end as status, ts as created_at
        from {events} where event_type = 'error'""",
    # Flags raised on documents, on parcels, on both or on neither.
    "flags": """select l_orderkey * 10 + l_linenumber as flag_id, case when l_partkey % 3 = 0 then null else l_orderkey end as deed_id,
        case when l_partkey % 4 = 0 then null else 'P' || (l_partkey % 500 + 1) end as parcel_id,
        case l_linenumber % 3 when 0 then 'AREA_JUMP' when 1 then 'DUPLICATE_PARCEL' else 'LOCATION_MISMATCH' end as kind,
        case when l_partkey % 6 = 0 then null else round(l_discount * 10, 4) end as score,
        case l_returnflag when 'A' then 'OPEN' when 'R' then 'DISMISSED' else 'RESOLVED' end as status
        from {lineitem} where l_quantity >= 40""",
    # Texts as they stand on a page, in Devanagari digits where forms have them.
    "scans": """select p_partkey as scan_id, field, raw from (
        select p_partkey, 'KHASRA' as field, translate((p_partkey % 150) || case p_size % 4 when 0 then '' when 1 then ' / 2' when 2 then '।3' else '|4 | 5' end, '0123456789', '०१२३४५६७८९') as raw from {part}
        union all select p_partkey, 'KHATA', 'खाता ' || translate(cast(p_size as string), '0123456789', '०१२३४५६७८९') from {part}
        union all select p_partkey, 'AREA', case when p_size % 7 = 0 then 'x' else p_size || ',' || (100 + p_partkey % 900) || '.' || (10 + p_partkey % 90) end from {part} where p_partkey % 2 = 0
        union all select p_partkey, 'AREA', p_size || '.' || (p_partkey % 100) || ' बीघा' from {part} where p_partkey % 2 = 1
        union all select p_partkey, 'AREA_UNIT', case p_partkey % 6 when 0 then ' बीघा ' when 1 then 'एकड़' when 2 then 'గుంటలు 3' when 3 then 'வ சென்ட்' when 4 then 'kanal' else 'वर्ग  मीटर' end from {part}
        union all select p_partkey, 'SHARE', case when p_partkey % 9 = 0 then ' 1 ' else translate((p_partkey % 5) || ' / 0' || (p_partkey % 4), '0123456789', '०१२३४५६७८९') end from {part}
        union all select p_partkey, 'RECORD_YEAR', translate(cast(1950 + p_partkey % 60 as string), '0123456789', '०१२३४५६७८९') || case p_size % 3 when 0 then ' – 51' when 1 then '' else '-1999' end from {part}
        union all select p_partkey, 'DATE', translate((p_partkey % 34) || case p_size % 3 when 0 then '/' when 1 then '-' else '.' end || (p_size % 14) || '/' || (1900 + p_partkey % 110), '0123456789', '०१२३४५६७८९') from {part}
        union all select p_partkey, 'OWNER', ' : - ' || p_name || case when p_size % 2 = 0 then ' –' else '' end from {part}
        union all select p_partkey, 'LAND_CLASS', '  ' || p_type || '  ' || p_brand from {part}) x""",
    # Questions put to an assistant.
    "questions": """select c_custkey as question_id, c_custkey as asked_by, case c_custkey % 11
        when 0 then 'Why is this flagged as suspicious?' when 1 then 'Show low confidence fields in ' || n_name when 2 then 'Compare the area with the historical record'
        when 3 then 'In 1998, who owned khasra ' || (c_custkey % 150) || '?' when 4 then 'What changed? history of ' || (c_custkey % 150) || '/' || (c_custkey % 3)
        when 5 then 'How many parcels do I hold' when 6 then 'how big is plot P' || c_custkey when 7 then 'मेरी भूमि' when 8 then 'which documents needs review'
        when 9 then 'area of ' || (c_custkey % 150) else 'hello from ' || lower(n_name) end as question from {customer} join {nation} on c_nationkey = n_nationkey""",
    # Corrections that people made to readings.
    "corrections": """select l_orderkey * 10 + l_linenumber as correction_id, l_orderkey as deed_id, l_linenumber as line, l_suppkey as corrected_by,
        case l_linenumber when 1 then 'VILLAGE' when 2 then 'KHASRA' when 3 then 'KHATA' when 4 then 'AREA' when 5 then 'AREA_UNIT' when 6 then 'DATE' else 'MUTATION' end as field,
        'old' || l_partkey as predicted, 'new' || l_suppkey as corrected, round(1 - l_discount * 5, 4) as confidence, 'v' || (l_partkey % 3) as model_version,
        l_tax > 0.04 as reviewed, l_returnflag = 'A' as accepted, l_shipdate as corrected_at, l_quantity > 25 as candidate
        from {lineitem} where l_discount >= 0.04""",
}


def _needs(name: str) -> list[str]:
    return [n for _, n, _, _ in Formatter().parse(VIEWS[name]) if n]


def land(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A view, or a given table."""
    if name not in VIEWS:
        return table(spark, folder, name)
    return spark.sql(VIEWS[name], **{n: land(spark, folder, n) for n in _needs(name)})


def land_sql(*names: str) -> str:
    """The views as common table expressions for DuckDB."""
    ordered: list[str] = []

    def add(name: str) -> None:
        if name in VIEWS and name not in ordered:
            for n in _needs(name):
                add(n)
            ordered.append(name)

    for name in names:
        add(name)
    return ", ".join(f"{n} as ({VIEWS[n].format(**{m: m for m in _needs(n)})})" for n in ordered)

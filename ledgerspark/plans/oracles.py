"""DuckDB SQL with the expected result of each registered query, written from the semantics."""

from __future__ import annotations

from ledgerspark.plans import inputs as src


def _plain(sql: str) -> str:
    text = src.expand(sql)
    for name in src.TABLES:
        text = text.replace("{" + name + "}", name)
    return text


def _canonical(**fields: str) -> str:
    """SQL of the hashed text; kind ``s`` is text to escape, ``t`` other text, ``n`` a whole number."""
    parts = []
    for name in sorted(fields):
        kind, _, expression = fields[name].partition(":")
        text = f"cast({expression} as varchar)"
        if kind == "s":
            text = f"replace(replace({text}, '\\', '\\\\'), '|', '\\|')"
        mark = "#" if kind == "n" else "="
        parts.append(f"coalesce('|{name}{mark}' || {text}, '|{name}~')")
    return "sha256(" + " || ".join(parts) + ")"


LEDGER = f"ledger as ({_plain(src.LEDGER)})"
REGISTRY = (
    f"registry as (select *, concat_ws('|', source_type, logical_cube_name, copy_id) as registry_key "
    f"from ({_plain(src.SUPPLIER_REGISTRY)}) r)"
)
YEARLY = (
    f"yearly as (select *, concat_ws('|', source_type, logical_cube_name, copy_id) as registry_key "
    f"from ({_plain(src.YEARLY_REGISTRY)}) r)"
)
AS_OF = f"date '{src.AS_OF}'"


def _bucket(days: str) -> str:
    return (
        f"case when {days} < 0 then 'not-due' when {days} <= 30 then '0-30' when {days} <= 60 then '31-60' "
        f"when {days} <= 90 then '61-90' when {days} <= 180 then '91-180' when {days} <= 365 then '181-365' "
        f"else '>365' end"
    )


BUCKETS = (
    "(select unnest(['0-30', '31-60', '61-90', '91-180', '181-365', '>365', 'not-due']) as age_bucket) b"
)
DISPLAY = (
    "owner || '.' || object_name || case when access_mode = 'SHARED_DISCRIMINATOR' "
    "then '#' || discriminator_column || '=' || discriminator_value else '' end"
)
STATUS_COLUMNS = (
    "status, registry_key, coalesce(financial_year, '-') as financial_year, "
    f"coalesce(case when owner is not null then {DISPLAY} end, '-') as physical, "
    "coalesce(physical_hint, '-') as hint, authoritative"
)
OVERLAY = f"overlay as ({_plain(src.OVERLAY)})"
OVERLAID = """
overlaid as (
  select r.source_type, r.logical_cube_name, r.registry_key, r.financial_year, r.authoritative,
         coalesce(o.status, r.status) as status,
         coalesce(o.last_refresh_at, r.last_refresh_at) as last_refresh_at, r.physical_hint,
         case when o.owner is not null then o.owner else r.owner end as owner,
         case when o.owner is not null then o.object_name else r.object_name end as object_name,
         case when o.owner is not null then o.access_mode else r.access_mode end as access_mode,
         case when o.owner is not null then o.discriminator_column else r.discriminator_column end as discriminator_column,
         case when o.owner is not null then o.discriminator_value else r.discriminator_value end as discriminator_value
  from base r left join overlay o on o.registry_key = r.registry_key)
"""


def _overlaps(entries: str) -> str:
    """Brute force over pairs, plus the rule that picks the witness."""
    return f"""
live as (select row_number() over () as id, * from {entries}
         where authoritative and status <> 'RETIRED' and date_from <= date_to),
clashing as (select * from live a where exists (
    select 1 from live b where b.source_type = a.source_type and b.id <> a.id
      and a.date_from <= b.date_to and b.date_from <= a.date_to)),
overlapping as (
  select a.source_type, a.registry_key, a.date_from, a.date_to,
         case when same.n > 1 then case when a.registry_key = same.lo then same.hi else same.lo end
              when before.date_to >= a.date_from then before.registry_key
              else after.registry_key end as overlaps_with
  from clashing a
  left join (select source_type, date_from, count(*) as n, min(registry_key) as lo, max(registry_key) as hi
             from live group by all) same on same.source_type = a.source_type and same.date_from = a.date_from
  left join (select a.id, max(struct_pack(t := b.date_to, k := b.registry_key)).t as date_to,
                    max(struct_pack(t := b.date_to, k := b.registry_key)).k as registry_key
             from clashing a join live b on b.source_type = a.source_type and b.date_from < a.date_from
             group by a.id) before on before.id = a.id
  left join (select a.id, min(struct_pack(t := b.date_from, k := b.registry_key)).k as registry_key
             from clashing a join live b on b.source_type = a.source_type and b.date_from > a.date_from
             group by a.id) after on after.id = a.id)
"""


# Ledger rows with the number of live windows that cover them and the fields of one of those.
COVERED = """
covered as (
  select l.source_row_key, l.l_suppkey, count(r.registry_key) as sources, any_value(r.copy_id) as copy_id, any_value(r.status) as status,
         any_value(r.owner) as owner, any_value(r.object_name) as object_name,
         any_value(r.discriminator_column) as discriminator_column, any_value(r.discriminator_value) as discriminator_value
  from ledger l left join registry r on r.source_type = 'SUP_' || cast(l.l_suppkey as varchar)
    and r.authoritative and r.status <> 'RETIRED' and l.entry_date between r.date_from and r.date_to
  group by 1, 2)
"""


IDENTITY_COLUMNS = (
    "source_system, source_owner, source_object, source_copy_id, source_discriminator_column, "
    "source_discriminator_value, source_row_key"
)
LEDGER_HASH = _canonical(
    site_code="s:site_code", entry_glcode="s:entry_glcode", entry_slcode="s:entry_slcode", entry_no="s:entry_no",
    entry_date="t:entry_date", entry_type="s:entry_type", narration="s:narration", debit="t:debit",
    credit="t:credit", release_status="s:release_status",
)


def _merge(facts: str, batch: str, batch_id: str) -> str:
    """State of the one ledger source after a full-refresh batch, with the outcome of each row."""
    carried = "site_code, debit, credit, row_hash"
    new = ", ".join(f"case when o in ('inserted', 'updated', 'revived') then n_{c} else {c} end as {c}" for c in carried.split(", "))
    return f"""
select source_row_key, {new},
       case when o in ('inserted', 'updated', 'revived') then '{batch_id}' else extract_batch_id end as extract_batch_id,
       case when o in ('inserted', 'updated', 'revived') then false when o = 'tombstoned' then true else deleted end
         as deleted,
       o as outcome
from (select coalesce(f.source_row_key, b.source_row_key) as source_row_key,
             f.site_code, f.debit, f.credit, f.row_hash, f.extract_batch_id, f.deleted,
             b.site_code as n_site_code, b.debit as n_debit, b.credit as n_credit, b.row_hash as n_row_hash,
             case when f.source_row_key is null then 'inserted'
                  when b.source_row_key is not null and f.deleted then 'revived'
                  when b.source_row_key is not null and f.row_hash = b.row_hash then 'unchanged'
                  when b.source_row_key is not null then 'updated'
                  when not f.deleted then 'tombstoned' end as o
      from {facts} f full outer join {batch} b on f.source_row_key = b.source_row_key) j
"""


PROMOTION = f"""
{LEDGER},
changed as (select * replace (case when l_partkey % 5 = 0 then cast(debit + 1 as decimal(20,2)) else debit end as debit)
            from ledger),
b1 as (select *, {LEDGER_HASH} as row_hash from ledger where l_partkey % 10 <> 0),
b2 as (select *, {LEDGER_HASH} as row_hash from changed where l_partkey % 7 <> 0),
b3 as (select *, {LEDGER_HASH} as row_hash from changed),
f0 as (select source_row_key, site_code, debit, credit, row_hash, '' as extract_batch_id, false as deleted
       from b1 where false),
f1 as ({_merge("f0", "b1", "b1")}),
f2 as ({_merge("f1", "b2", "b2")}),
f2b as ({_merge("f2", "b2", "b2")}),
f3 as ({_merge("f2", "b3", "b3")})
"""
OUTCOMES = "(select unnest(['inserted', 'updated', 'unchanged', 'tombstoned', 'revived']) as outcome)"


def _totals(rows: str, scopes: dict[str, str]) -> str:
    parts = []
    for scope in ["'company'", *[f"coalesce('{n}:' || cast({e} as varchar), '{n}~')" for n, e in scopes.items()]]:
        for check, value in (("debit", "sum(debit)"), ("credit", "sum(credit)"), ("rows", "count(*)")):
            parts.append(
                f"select '{check}' as check_name, {scope} as scope, cast({value} as decimal(24,2)) as value "
                f"from {rows} group by 1, 2"
            )
    return " union all ".join(parts)


SCOPES = {"site": "site_code", "month": "cast(date_trunc('month', entry_date) as date)", "account": "entry_glcode"}
VENDOR = {"vendor": "entry_slcode"}


def _settled(rows: str, name: str = "settled") -> str:
    """Row by row: each debit keeps what the vendor's credits leave of it, oldest first."""
    return f"""
{name} as (
  select entry_slcode, entry_date as day, debit,
         greatest(0, least(debit, sum(debit) over (partition by entry_slcode order by entry_date, source_row_key)
                                  - sum(credit) over (partition by entry_slcode))) as open,
         sum(credit) over (partition by entry_slcode) as paid
  from {rows})"""


OUTSTANDING = f"""
select 'outstanding' as check_name, 'company' as scope, cast(sum(open) as decimal(24,2)) as value from settled
union all select 'outstanding', 'vendor:' || entry_slcode, cast(sum(open) as decimal(24,2)) from settled group by entry_slcode
union all select 'outstanding', 'age:' || {_bucket(f"date_diff('day', day, {AS_OF})")}, cast(sum(open) as decimal(24,2)) from settled group by 2
union all select 'advances', 'vendor:' || entry_slcode, cast(greatest(max(paid) - sum(debit), 0) as decimal(24,2)) from settled group by entry_slcode
union all select 'advances', 'company', cast(sum(a) as decimal(24,2))
          from (select greatest(max(paid) - sum(debit), 0) as a from settled group by entry_slcode) x"""
RECONCILED = f"""
{PROMOTION},
mart_rows as (select f.source_row_key, b.entry_date, b.entry_glcode, f.site_code, f.credit,
                     cast(f.debit + case when f.site_code = 'N07' and b.entry_date = date '1998-03-15'
                                         then 0.01 else 0 end as decimal(20,2)) as debit
              from f2 f join changed b on b.source_row_key = f.source_row_key where not f.deleted),
source_totals as ({_totals("b2", SCOPES)}),
mart_totals as ({_totals("mart_rows", SCOPES)}),
kpi_totals as (select * from ({_totals("b2", {"account": "entry_glcode"})}) k where check_name <> 'rows'),
results as (
  select *, mart - source as variance_mart, coalesce(kpi - mart, 0) as variance_kpi,
         mart = source and (kpi is null or kpi = mart) as passed
  from (select coalesce(s.check_name, m.check_name) as check_name, coalesce(s.scope, m.scope) as scope,
               coalesce(s.value, 0) as source, coalesce(m.value, 0) as mart, k.value as kpi,
               case when coalesce(s.check_name, m.check_name) = 'debit' and coalesce(s.scope, m.scope) = 'site:N07'
                    then 'late posting' else '' end as explanation
        from source_totals s full outer join mart_totals m on m.check_name = s.check_name and m.scope = s.scope
        left join kpi_totals k on k.check_name = coalesce(s.check_name, m.check_name)
                              and k.scope = coalesce(s.scope, m.scope)) j)
"""
FLAWED_ITEMS = f"flawed as ({_plain(src.FLAWED_ITEMS)})"
SHARED = f"shared as ({_plain(src.SHARED_IDENTITIES)})"
PART = "(select p_partkey, p_name, p_brand, p_type, p_size, cast(p_retailprice as decimal(20,2)) as p_retailprice from part) p"
MASKED = (
    r"regexp_replace(replace(replace(replace(replace(replace(text, 'tokens', '***'), 'ation', '***'), 'token', '***'), "
    r"'eaux', '***'), 'the', '***'), '\b(password|pwd|uid)\s*=\s*[^;\s]+', '\1=***', 'gi')"
)


def _masked_message(secret: str) -> str:
    return rf"regexp_replace(replace(message, '{secret}', '***'), '\b(password|pwd|uid)\s*=\s*[^;\s]+', '\1=***', 'gi')"


def _rank_keys() -> str:
    merged: dict[tuple[str, ...], list[str]] = {}
    for name, columns in src.KEY_CANDIDATES.items():
        merged.setdefault(columns, []).append(name)
    parts = []
    for columns, names in merged.items():
        listed = ", ".join(columns)
        some_null = " or ".join(f"{c} is null" for c in columns)
        null_names = ", ".join(f"case when max(case when {c} is null then 1 else 0 end) = 1 then '{c}' end" for c in sorted(columns))
        parts.append(f"""
select '{";".join(columns)}' as columns, '{";".join(names)}' as sources, {len(columns)} as width,
       cast(sum(n) as bigint) as rows,
       cast(coalesce(sum(case when {some_null} then n end), 0) as bigint) as null_rows,
       cast(coalesce(sum(case when not ({some_null}) then n - 1 end), 0) as bigint) as surplus_rows,
       concat_ws(';', {null_names}) as nullable_columns,
       {"true" if "l_suppkey" in columns else "false"} as includes_discriminator
from (select {listed}, count(*) as n from keyed group by {listed}) g""")
    return f"""
with keyed as ({_plain(src.KEY_TEST)}), tested as ({" union all ".join(parts)}),
labelled as (select *, case when rows > null_rows and surplus_rows = 0 and null_rows = 0 then 'STRONG_CANDIDATE'
                            when rows > null_rows and surplus_rows = 0 then 'WEAK_CANDIDATE' else 'NO_KEY' end
                       as recommendation from tested)
select columns, sources, rows, null_rows, surplus_rows, nullable_columns, includes_discriminator, recommendation,
       concat_ws(';', case when nullable_columns <> '' then 'NULL in: ' || replace(nullable_columns, ';', ', ') end,
                 case when surplus_rows > 0 then cast(surplus_rows as varchar) || ' rows repeat a key' end) as reasons,
       case when (select bool_or(recommendation = 'STRONG_CANDIDATE') from labelled) then 'STRONG_CANDIDATE'
            when (select bool_or(recommendation = 'WEAK_CANDIDATE') from labelled) then 'WEAK_CANDIDATE'
            else 'NO_KEY' end as overall
from labelled"""


def _deep() -> str:
    columns = ("o_orderkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority", "o_comment")
    return f"with d as ({_plain(src.DEEP_ORDERS)}) " + " union all ".join(
        f"select count(*) as exact_rows, '{c.upper()}' as column_name, count({c}) as non_null, "
        f"cast(count(*) - count({c}) as double) / count(*) as null_rate from d"
        for c in columns
    )


def _matched(rows: str) -> str:
    return f"""
with claims as ({_plain(src.CLAIMS)}), evidence as ({rows}), judged as (
  select c.registry_key, c.evidence_row_index, e.row_index is not null as row_exists,
         coalesce(upper(trim(c.copy_id)) in (upper(name), nation, upper(segment), object), false) as has_copy,
         coalesce(upper(c.object_name) in (upper(name), nation, upper(segment), object)
               or upper(c.owner || '.' || c.object_name) in (upper(name), nation, upper(segment), object), false) as has_object,
         coalesce(c.discriminator_value is null
               or upper(trim(c.discriminator_value)) in (upper(name), nation, upper(segment), object), false)
           as has_discriminator
  from claims c left join evidence e on e.row_index = c.evidence_row_index)
select *, case when not row_exists or not (has_copy or has_object) then 'REJECTED'
               when has_copy and has_object and has_discriminator then 'MACHINE_VERIFIED'
               else 'OPERATOR_CONFIRMED' end as verification,
       concat_ws('; ', case when not has_copy then 'copy id not found as a cell value in evidence row' end,
                 case when not has_object then 'object name not found as a cell value in evidence row' end,
                 case when not has_discriminator then 'discriminator value not found as a cell value in evidence row' end)
         as notes
from judged"""


ORACLES: dict[str, str] = {
    "age_summary": f"""
with {LEDGER}, sums as (
  select {_bucket(f"date_diff('day', entry_date, {AS_OF})")} as age_bucket, sum(debit + credit) as s from ledger group by 1)
select b.age_bucket, cast(coalesce(s, 0) as decimal(24,2)) as amount
from {BUCKETS} left join sums on sums.age_bucket = b.age_bucket""",
    "age_by_supplier": f"""
with {LEDGER}, sums as (
  select entry_slcode, {_bucket(f"date_diff('day', entry_date, {AS_OF})")} as age_bucket, sum(debit) as s
  from ledger group by 1, 2)
select p.entry_slcode, b.age_bucket, cast(coalesce(s, 0) as decimal(24,2)) as amount
from (select distinct entry_slcode from ledger) p cross join {BUCKETS}
left join sums on sums.age_bucket = b.age_bucket and sums.entry_slcode = p.entry_slcode""",
    "age_days_and_buckets": f"""
select age_days, {_bucket("age_days")} as age_bucket, count(*) as n
from (select date_diff('day', cast(o_orderdate as date), {AS_OF}) as age_days from orders) o group by 1, 2""",
    "ageing_violations": f"with {LEDGER}, {FLAWED_ITEMS} select * from flawed where entry_date is null or debit is null",
    "fiscal_year_totals": """
select 'FY' || lpad(cast(y % 100 as varchar), 2, '0') || '-' || lpad(cast((y + 1) % 100 as varchar), 2, '0') as fiscal_year,
       count(*) as n, cast(sum(cast(o_totalprice as decimal(20,2))) as decimal(24,2)) as amount
from (select *, year(o_orderdate) - case when month(o_orderdate) < 4 then 1 else 0 end as y from orders) o group by 1""",
    "profile_light_lineitem": f"""
with {LEDGER}
select count(*) as "N", min(entry_date) as "DMIN", max(entry_date) as "DMAX",
       cast(sum(debit) as decimal(24,2)) as "DEBIT", cast(sum(credit) as decimal(24,2)) as "CREDIT",
       count(distinct site_code) as "DISTINCT_SITE_CODE", count(distinct entry_glcode) as "DISTINCT_ENTRY_GLCODE",
       count(distinct entry_slcode) as "DISTINCT_ENTRY_SLCODE", count(distinct release_status) as "DISTINCT_RELEASE_STATUS"
from ledger""",
    "profile_light_integers": """
select count(*) as "N", min(cast(l_shipdate as date)) as "DMIN", max(cast(l_shipdate as date)) as "DMAX",
       cast(sum(cast(l_extendedprice as decimal(20,2))) as decimal(24,2)) as "DEBIT",
       count(distinct l_linenumber) as "DISTINCT_L_LINENUMBER", count(distinct l_suppkey) as "DISTINCT_L_SUPPKEY",
       count(distinct l_partkey) as "DISTINCT_L_PARTKEY", count(distinct cast(l_shipdate as date)) as "DISTINCT_L_SHIPDATE"
from lineitem""",
    "profile_assigned_roles": f"""
with {LEDGER}
select count(*) as "N", min(entry_date) as "DMIN", max(entry_date) as "DMAX",
       cast(sum(debit) as decimal(24,2)) as "DEBIT", cast(sum(credit) as decimal(24,2)) as "CREDIT",
       count(distinct site_code) as "DISTINCT_SITE_CODE", count(distinct entry_glcode) as "DISTINCT_ENTRY_GLCODE"
from ledger""",
    "profile_deep_orders": _deep(),
    "profile_group_release": f"""
with {LEDGER}, g as (select release_status as "GRP", count(*) as "N", cast(sum(debit) as decimal(24,2)) as "DEBIT",
                            cast(sum(credit) as decimal(24,2)) as "CREDIT" from ledger group by 1)
select *, cast(row_number() over (order by "N" desc, "GRP" nulls last) as integer) as position,
       (select count(*) > 100 from g) as truncated from g
qualify row_number() over (order by "N" desc, "GRP" nulls last) <= 100""",
    "profile_group_party": f"""
with {LEDGER}, g as (select entry_slcode as "GRP", count(*) as "N", cast(sum(debit) as decimal(24,2)) as "DEBIT"
                     from ledger group by 1)
select *, cast(row_number() over (order by "N" desc, "GRP" nulls last) as integer) as position,
       (select count(*) > 20 from g) as truncated from g
qualify row_number() over (order by "N" desc, "GRP" nulls last) <= 20""",
    "sample_ordered": "select * from orders order by o_orderkey limit 5",
    "rank_keys_lineitem": _rank_keys(),
    "rank_keys_pruned": _rank_keys(),
    "rank_keys_labels": f"select columns, rows, null_rows, recommendation, overall from ({_rank_keys()}) r",
    "registry_status": f"with {REGISTRY} select {STATUS_COLUMNS} from registry",
    "registry_overlaps": f"with {REGISTRY}, {_overlaps('registry')} select * from overlapping",
    "registry_overlay": f"""
with {REGISTRY}, base as (select * from registry), {OVERLAY}, {OVERLAID}
select {STATUS_COLUMNS} from (select * replace (coalesce(last_refresh_at, physical_hint) as physical_hint) from overlaid) o""",
    "registry_overlay_lines": f"""
with {REGISTRY}, base as (select * from registry), every as ({_plain(src.OVERLAY)}),
overlay as (select * from every where registry_key not like '%5'), {OVERLAID}
select {STATUS_COLUMNS} from (select * replace (coalesce(last_refresh_at, physical_hint) as physical_hint) from overlaid) o""",
    "registry_additions": f"""
with {REGISTRY}, numbered as (select *, cast(substr(source_type, 5) as int) as k from registry)
select 'ADDED' as outcome, registry_key, date_from, date_to, is_current, 'UNVERIFIED' as status, true as authoritative
from numbered where k % 13 not in (5, 7, 9)
union all select case k % 13 when 5 then 'CORRUPT' when 7 then 'MISSING:copy_id' else 'BAD_DATE:date_to' end, null, null, null, null, null, null
from numbered where k % 13 in (5, 7, 9)""",
    "registry_violations": f"""
with {REGISTRY}, doubled as (select * from registry union all
  select * from registry where source_type like '%2' and financial_year = 'FY99-00')
select registry_key, 'DUPLICATE_KEY' as violation, count(*) as n from doubled group by 1 having count(*) > 1
union all select registry_key, 'CONFIRMED_WITHOUT_PHYSICAL', count(*) from doubled
  where status = 'CONFIRMED' and owner is null group by 1
union all select registry_key, 'DATES_REVERSED', count(*) from doubled where date_from > date_to group by 1""",
    "physical_violations": f"""
with {REGISTRY}, judged as (
  select registry_key,
         case when not regexp_matches(owner, '^[A-Za-z][A-Za-z0-9_$#]*$') then 'BAD_OWNER'
              when not regexp_matches(object_name, '^[A-Za-z][A-Za-z0-9_$#]*$') then 'BAD_OBJECT_NAME'
              when access_mode not in ('SEPARATE_OBJECT', 'SHARED_DISCRIMINATOR') then 'BAD_ACCESS_MODE'
              when access_mode = 'SHARED_DISCRIMINATOR' and (discriminator_column is null or discriminator_value is null)
                then 'DISCRIMINATOR_MISSING'
              when access_mode = 'SEPARATE_OBJECT' and (discriminator_column is not null or discriminator_value is not null)
                then 'DISCRIMINATOR_NOT_ALLOWED' end as violation
  from registry where owner is not null)
select * from judged where violation is not null""",
    "duplicate_claims": f"""
with {REGISTRY}
select owner, object_name, discriminator_column, discriminator_value, count(distinct registry_key) as claimants,
       min(registry_key) as first_claimant, max(registry_key) as last_claimant
from registry where owner is not null group by 1, 2, 3, 4 having count(distinct registry_key) > 1""",
    "confirmed_sources": f"""
with {REGISTRY} select registry_key, {DISPLAY} as display_name
from registry where status = 'CONFIRMED' and owner is not null""",
    "live_sources": f"""
with {REGISTRY} select status, count(*) as n, min(date_from) as date_from, max(date_to) as date_to
from registry where authoritative and status <> 'RETIRED' group by 1""",
    "find_entry": f"""
with {REGISTRY}, best as (select l_suppkey from lineitem
                          group by 1 order by count(*) desc, 1 limit 1)
select {STATUS_COLUMNS} from registry
where is_current and source_type = (select 'SUP_' || cast(l_suppkey as varchar) from best)""",
    "combined_registry": f"""
with {REGISTRY}, {YEARLY}, base as (select * from yearly union all select * from registry),
overlay as ({_plain(src.OVERLAY_WITH_RETIRED)}), {OVERLAID}
select logical_cube_name, status, count(*) as n, count(owner) as mapped, count(last_refresh_at) as refreshed
from overlaid group by 1, 2""",
    "refused_entries": f"""
with {REGISTRY}, candidates as (
  select * replace ('new-' || copy_id as copy_id, date '2002-09-30' as date_to,
                    case when is_auto_refresh then date '2001-10-01' else date '2002-04-01' end as date_from,
                    concat_ws('|', source_type, logical_cube_name, 'new-' || copy_id) as registry_key)
  from registry where is_current),
everything as (select * from registry union all select * from candidates), {_overlaps('everything')}
select * from overlapping where registry_key in (select registry_key from candidates)""",
    "resolve_as_of": f"""
with {YEARLY}
select o.o_orderkey, y.registry_key as source_registry_key, y.copy_id as resolved_copy_id
from orders o left join yearly y on y.source_type = 'ORD_' || substr(o.o_orderpriority, 1, 1)
  and y.authoritative and y.status <> 'RETIRED' and cast(o.o_orderdate as date) between y.date_from and y.date_to""",
    "resolve_as_of_many_sources": f"""
with {LEDGER}, {REGISTRY}, {COVERED}
select source_row_key, case when sources = 1 then copy_id end as resolved_copy_id, sources from covered""",
    "coverage_timeline": f"""
with {REGISTRY}, live as (select * from registry where authoritative and status <> 'RETIRED' and date_from <= date_to),
ends as (select source_type, date_from as day from live union select source_type, cast(date_to + 1 as date) from live),
stretches as (select source_type, day as date_from, cast(lead(day) over (partition by source_type order by day) - 1 as date) as date_to
              from ends)
select s.source_type, s.date_from, s.date_to, count(*) as sources, case when count(*) = 1 then min(l.registry_key) end as registry_key
from stretches s join live l on l.source_type = s.source_type and l.date_from <= s.date_from and s.date_from <= l.date_to
group by 1, 2, 3""",
    "coverage_gaps_many_sources": f"""
with {LEDGER}, {REGISTRY}, {COVERED}
select l_suppkey, count(*) as n, min(source_row_key) as first_key from covered where sources = 0 group by 1""",
    "coverage_gaps": f"""
with {YEARLY}
select o_orderkey, o_orderpriority from orders o where not exists (
  select 1 from yearly y where y.financial_year <> 'FY97-98' and y.authoritative and y.status <> 'RETIRED'
    and y.source_type = 'ORD_' || substr(o.o_orderpriority, 1, 1)
    and cast(o.o_orderdate as date) between y.date_from and y.date_to)""",
    "read_source_shared": """
select event_id as "EVENT_ID", user_id as "USER_ID", event_type as "EVENT_TYPE", props as "PROPS"
from events where event_type = 'error'""",
    "trim_char_columns": "select c_custkey, c_name as name, c_mktsegment as segment from customer",
    "ledger_identities": f"""
with {LEDGER}, {REGISTRY}, {COVERED},
found as (select *, sources = 1 and status = 'CONFIRMED' and owner is not null as usable from covered)
select case when usable then 'LAKE' end as source_system, case when usable then owner end as source_owner,
       case when usable then object_name end as source_object, case when usable then copy_id end as source_copy_id,
       case when usable then coalesce(discriminator_column, '') end as source_discriminator_column,
       case when usable then coalesce(discriminator_value, '') end as source_discriminator_value, source_row_key,
       case when sources = 0 then 'NO_SOURCE' when sources > 1 then 'SEVERAL_SOURCES' when not usable then 'NOT_CONFIRMED' end
         as unresolved
from found""",
    "scope_totals": f"""
with {SHARED}
select source_system, source_owner, source_object, source_copy_id, source_discriminator_column,
       source_discriminator_value, count(*) as n, cast(sum(debit) as decimal(24,2)) as debit
from shared group by 1, 2, 3, 4, 5, 6""",
    "identity_violations": f"""
with f as ({_plain(src.FLAWED_IDENTITIES)}), judged as (
  select source_row_key,
         case when trim(source_system) = '' then 'BLANK:source_system'
              when source_owner is null then 'BLANK:source_owner'
              when source_copy_id = '' then 'BLANK:source_copy_id'
              when trim(source_row_key) = '' then 'BLANK:source_row_key'
              when source_discriminator_column is null then 'DISCRIMINATOR_NULL'
              when (source_discriminator_column = '') <> (source_discriminator_value = '') then 'DISCRIMINATOR_HALF_SET'
         end as violation from f)
select violation, count(*) as n, min(source_row_key) as first_key from judged where violation is not null group by 1""",
    "batch_duplicates": f"""
select source_row_key, count(*) as copies from ({_plain(src.REPEATED_IDENTITIES)}) r group by 1 having count(*) > 1""",
    "stray_rows": f"""
with {SHARED} select source_row_key, source_discriminator_value from shared where source_discriminator_value <> 'F'""",
    "fact_violations": f"""
with {FLAWED_ITEMS}
select source_row_key, case when entry_date is null then 'NULL:entry_date' when debit is null then 'NULL:debit'
                            else 'NULL:credit' end as violation
from flawed where entry_date is null or debit is null or credit is null""",
    "default_amounts": f"""
with {FLAWED_ITEMS}
select count(*) as debits, count(*) as credits, cast(sum(debit) as decimal(24,2)) as debit,
       cast(sum(credit) as decimal(24,2)) as credit from flawed""",
    "row_hashes": "select o_orderkey, "
    + _canonical(
        o_orderkey="n:o_orderkey", o_custkey="n:o_custkey", o_orderstatus="s:o_orderstatus",
        o_totalprice="t:cast(o_totalprice as decimal(20,2))", o_orderdate="t:cast(o_orderdate as date)",
        o_orderpriority="s:case when o_orderkey % 9 <> 0 then o_orderpriority end",
    )
    + " as row_hash from orders",
    "staging_append": f"""
with r as ({_plain(src.REPEATED_IDENTITIES)}),
s1 as (select * from r where l_partkey % 3 <> 0
       qualify row_number() over (partition by source_row_key order by sequence) = 1),
s1_more as (select * from r where source_row_key not in (select source_row_key from s1)
            qualify row_number() over (partition by source_row_key order by sequence) = 1),
s2 as (select * from r where l_partkey % 2 = 0
       qualify row_number() over (partition by source_row_key order by sequence) = 1)
select 's1' as extract_batch_id, source_row_key, sequence, amount from s1
union all select 's1', source_row_key, sequence, amount from s1_more
union all select 's2', source_row_key, sequence, amount from s2""",
    "ingest_batches": f"""
with {PROMOTION}, runs as (
  select 1 as version, 'b1' as batch, (select count(*) from b1) as staged, * from f1 union all
  select 2, 'b2', (select count(*) from b2), * from f2 union all
  select 3, 'b2', 0, * from f2b union all
  select 4, 'b3', (select count(*) from b3), * from f3)
select version, batch, staged, {", ".join(f"count(*) filter (outcome = '{o}') as {o}" for o in ("inserted", "updated", "unchanged", "tombstoned", "revived"))},
       count(*) filter (not deleted) as live, cast(sum(debit) filter (not deleted) as decimal(24,2)) as debit,
       cast(sum(credit) filter (not deleted) as decimal(24,2)) as credit
from runs group by 1, 2, 3""",
    "promote_counts": f"""
with {PROMOTION}, runs as (
  select '1 b1' as run, outcome from f1 union all select '2 b2', outcome from f2
  union all select '3 b2 again', outcome from f2b union all select '4 b3', outcome from f3)
select r.run, o.outcome, count(x.outcome) as n
from (select distinct run from runs) r cross join {OUTCOMES} o
left join runs x on x.run = r.run and x.outcome = o.outcome group by 1, 2""",
    "promote_facts": f"""
with {PROMOTION}
select source_row_key, site_code, debit, credit, row_hash, extract_batch_id, deleted from f3""",
    "promote_shared_object": f"""
with {SHARED}
select source_discriminator_value,
       case when source_discriminator_value = 'O' then 'untouched' when l_partkey % 4 <> 0 then 'unchanged'
            else 'tombstoned' end as outcome,
       count(*) as n, cast(sum(debit) as decimal(24,2)) as debit, cast(sum(credit) as decimal(24,2)) as credit
from shared group by 1, 2""",
    "missing_from_refresh": f"""
with {LEDGER} select source_row_key from ledger where l_partkey % 10 <> 0 and l_partkey % 7 = 0""",
    "fact_total": f"""
with {PROMOTION}
select cast(sum(debit) as decimal(24,2)) as debit, cast(sum(credit) as decimal(24,2)) as credit,
       cast(0 as decimal(24,2)) as tax from f2 where not deleted""",
    "recon_totals": f"with {LEDGER} {_totals('ledger', SCOPES)}",
    "recon_totals_vendors": f"with {LEDGER} {_totals('ledger', SCOPES)} union all select * from ({_totals('ledger', VENDOR)}) v where scope <> 'company'",
    "recon_runs": f"""
with {PROMOTION}, s as ({_totals('ledger', SCOPES)}), m as ({_totals('b2', SCOPES)}), runs as (
  select date '2001-07-01' as run_at, coalesce(s.scope, m.scope) as scope, coalesce(s.check_name, m.check_name) as check_name,
         coalesce(s.value, 0) as source_value, coalesce(m.value, 0) as mart_value
  from s full outer join m on m.scope = s.scope and m.check_name = s.check_name
  union all select date '2001-08-01', scope, check_name, value, value from m)
select *, cast(null as decimal(24,2)) as kpi_value, '' as explanation, source_value = mart_value as passed from runs""",
    "settled_open_items": f"""
with {LEDGER}, {_settled('ledger')}
select entry_slcode, {_bucket(f"date_diff('day', day, {AS_OF})")} as age_bucket, cast(sum(open) as decimal(24,2)) as open
from settled group by 1, 2 having sum(open) <> 0""",
    "outstanding_totals": f"with {LEDGER}, {_settled('ledger')} {OUTSTANDING}",
    "recon_creditors": f"""
with {PROMOTION}, live as (
  select f.source_row_key, f.site_code, f.debit, f.credit, l.entry_date, l.entry_glcode, l.entry_slcode
  from f2 f join ledger l on l.source_row_key = f.source_row_key where not f.deleted),
{_settled('b1')}, s as ({_totals('b1', SCOPES)} union all select * from ({_totals('b1', VENDOR)}) v where scope <> 'company' union all {OUTSTANDING}),
{_settled('live', 'settled_live')}, m as ({_totals('live', SCOPES)} union all select * from ({_totals('live', VENDOR)}) v where scope <> 'company'
  union all {OUTSTANDING.replace('settled', 'settled_live')})
select check_name, scope, cast(source as decimal(24,2)) as source, cast(mart as decimal(24,2)) as mart,
       cast(mart - source as decimal(24,2)) as variance_mart, case when mart = source then 'PASS' else 'FAIL' end as status
from (select coalesce(s.check_name, m.check_name) as check_name, coalesce(s.scope, m.scope) as scope, coalesce(s.value, 0) as source,
             coalesce(m.value, 0) as mart
      from s full outer join m on m.scope = s.scope and m.check_name = s.check_name) j""",
    "registry_from_csv": f"""
with {REGISTRY} select source_type, logical_cube_name, copy_id, financial_year, date_from, date_to, is_current, is_auto_refresh,
                       status, authoritative, physical_hint from registry""",
    "recon_report": f"""
with {RECONCILED}
select check_name, scope, cast(source as decimal(24,2)) as source, cast(mart as decimal(24,2)) as mart,
       coalesce(cast(kpi as varchar), '-') as kpi, cast(variance_mart as decimal(24,2)) as variance_mart,
       cast(variance_kpi as decimal(24,2)) as variance_kpi, case when passed then 'PASS' else 'FAIL' end as status,
       explanation
from results""",
    "recon_variances": f"""
with {RECONCILED}
select check_name, scope, cast(variance_mart as decimal(24,2)) as variance_mart,
       cast(variance_kpi as decimal(24,2)) as variance_kpi, explanation <> '' as accepted
from results where not passed""",
    "recon_gate": f"""
with {RECONCILED}
select count(*) as checks, count(*) filter (not passed) as failed, coalesce(bool_and(passed), false) as gate_passed
from results""",
    "match_evidence": _matched(_plain(src.EVIDENCE)),
    "evidence_lines": _matched(_plain(src.EVIDENCE).replace("c_custkey as row_index", "row_number() over (order by c_custkey) - 1 as row_index")),
    "artifact_digests": """
select c_nationkey as nation, sha256(string_agg(line || chr(10), '' order by c_custkey)) as artifact_sha256,
       cast(sum(strlen(line) + 1) as bigint) as length
from (select c_nationkey, c_custkey, concat_ws('|', c_custkey, c_name, c_mktsegment) as line from customer) c group by 1""",
    "evidence_cells": f"""
select row_index, array_to_string(list_sort([upper(name), nation, upper(segment), object]), ',') as cells
from ({_plain(src.EVIDENCE)}) e""",
    "filter_any_like": f"""
select * from {PART} where upper(p_name) like '%RING%' or upper(p_brand) like '%RING%' or upper(p_type) like '%RING%'
  or upper(p_name) like 'BRAND#1_' or upper(p_brand) like 'BRAND#1_' or upper(p_type) like 'BRAND#1_'
  or upper(p_name) like '%ECO%Y' or upper(p_brand) like '%ECO%Y' or upper(p_type) like '%ECO%Y'""",
    "filter_any_regex": rf"""
select * from {PART} where regexp_matches(concat_ws(chr(10), p_name, p_brand, p_type, cast(p_retailprice as varchar)),
                                          '(WIDGET|brand#2\d|77\.)', 'i') or p_partkey = 7 or p_size = 7""",
    "filter_any_contains": f"select * from {PART} where contains(upper(concat_ws('|', p_name, p_brand, p_type)), 'WIDGET')",
    "candidate_rows": f"select * from {PART} where contains(concat_ws('|', p_name, p_brand, p_type, p_size, p_retailprice), '9.5')",
    "evidence_list": """
select * from orders where upper(o_orderpriority) like '%URGENT%' or upper(o_orderpriority) like '5-L_W'""",
    "evidence_list_capped": """
with found as (select * from orders where upper(o_orderpriority) like '%URGENT%' or upper(o_orderpriority) like '5-L_W')
select *, (select count(*) > 50 from found) as truncated from found order by o_orderkey limit 50""",
    "shareable_report": """
select c_custkey, replace(c_mktsegment, 'MACH', '***') as c_mktsegment from customer
where c_mktsegment ilike '%machinery%' or c_name like 'Customer#%7'""",
    "drop_sensitive_columns": "select event_id, ts, event_type, value, props from events",
    "shareable_view": rf"""
select row_id, regexp_replace(replace(site, 'MART', '***'), 'x^', '') as site,
       {_masked_message('MART')} as message
from ({_plain(src.NOTES)}) n
where regexp_matches(concat_ws(chr(10), row_id, created_by, site, message), '(SITE 1|#00000000[0-4])', 'i')""",
    "redact_documents": rf"""
select doc_id, sha256({MASKED}) as text_digest, cast(length({MASKED}) as bigint) as n_chars from documents""",
    "redact_connection_text": rf"select row_id, {_masked_message('MART')} as message from ({_plain(src.NOTES)}) n",
}

"""DuckDB SQL for the registered queries of the trust engine, built from shared parts."""

from __future__ import annotations

TODAY = "date '2026-01-01'"

_U = """
u as (
  select 'CRM' as source_system, 'CRM' || lpad(cast(c_custkey as varchar), 7, '0') as source_customer_id,
    case when c_custkey % 17 = 0 then null when c_custkey % 19 = 0 then '12345' else lpad(cast(3200000000000000 + c_custkey as varchar), 16, '0') end as nik, c_name as full_name,
    case when c_custkey % 23 = 0 then 'ABC' else '08' || lpad(cast((c_custkey * 7919) % 10000000000 as varchar), 10, '0') end as phone,
    'user' || cast(c_custkey as varchar) || '@example.com' as email, cast(date '1960-01-01' + cast(c_custkey % 15000 as int) as date) as birth_date from customer
  union all
  select 'LOS', 'LOS' || lpad(cast(c_custkey as varchar), 7, '0'), lpad(cast(3200000000000000 + c_custkey as varchar), 16, '0'), upper(c_name), '08' || lpad(cast((c_custkey * 7919) % 10000000000 as varchar), 10, '0'),
    case when c_custkey % 5 = 0 then null when c_custkey % 11 = 0 then 'other' || cast(c_custkey as varchar) || '@example.com' else 'user' || cast(c_custkey as varchar) || '@example.com' end,
    cast(date '1960-01-01' + cast(c_custkey % 15000 as int) as date) from customer where c_custkey % 3 <> 0
  union all
  select 'MOBILE', 'MOB' || lpad(cast(c_custkey as varchar), 7, '0'), case when c_custkey % 7 = 0 then null else lpad(cast(3200000000000000 + c_custkey as varchar), 16, '0') end, c_name,
    '08' || lpad(cast((c_custkey * 7919) % 10000000000 as varchar), 10, '0'), 'user' || cast(c_custkey as varchar) || '@example.com',
    case when c_custkey % 13 = 0 then null else cast(date '1960-01-01' + cast(c_custkey % 15000 as int) as date) end from customer where c_custkey % 4 <> 0)"""

_STG = (
    _U
    + """,
stg as (
  select case when k % 97 = 0 then null when k % 89 = 0 then 'CRM0000089' else source_customer_id end as customer_id, nik, full_name, phone,
    case when k % 31 = 0 then 'user' || k || '@examplecom' else email end as email, case when k % 83 = 0 then date '2999-01-01' else birth_date end as birth_date
  from (select *, cast(substring(source_customer_id, 4) as bigint) as k from u where source_system = 'CRM'))"""
)

_RULES = {
    "DQ-CUS-001": ("customer_id", "CRITICAL", "PASS_RATE", 100.0, "customer_id is null"),
    "DQ-CUS-002": ("customer_id", "CRITICAL", "PASS_RATE", 100.0, "customer_id in (select customer_id from stg group by customer_id having count(*) > 1)"),
    "DQ-CUS-003": ("nik", "CRITICAL", "PASS_RATE", 100.0, "nik is null"),
    "DQ-CUS-004": ("nik", "CRITICAL", "PASS_RATE", 100.0, "nik is not null and (length(nik) <> 16 or not regexp_matches(nik, '^[0-9]{16}$'))"),
    "DQ-CUS-005": ("nik", "HIGH", "FAILURE_RATE", 0.1, "nik is not null and nik in (select nik from stg where nik is not null group by nik having count(*) > 1)"),
    "DQ-CUS-006": ("phone", "HIGH", "PASS_RATE", 99.0, "phone is not null and not regexp_matches(phone, '^08[0-9]{8,13}$')"),
    "DQ-CUS-007": ("email", "MEDIUM", "PASS_RATE", 99.0, r"email is not null and not regexp_matches(lower(email), '^[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}$')"),
    "DQ-CUS-008": ("birth_date", "HIGH", "PASS_RATE", 100.0, "birth_date is not null and birth_date > current_date"),
}
_RESULTS = (
    _STG
    + ",\nrules(rule_id, column_name, severity, metric_type, threshold) as (values "
    + ", ".join(f"('{r}', '{c}', '{s}', '{m}', cast({t} as double))" for r, (c, s, m, t, _) in _RULES.items())
    + "),\nresults as ("
    + " union all ".join(f"select 'RUN-1' as run_id, '{r}' as rule_id, 'FAIL' as status, 'Rule failed: {r}' as message, coalesce(customer_id, 'None') as record_id from stg where {p}" for r, (*_, p) in _RULES.items())
    + ")"
)
_SUMMARY = (
    _RESULTS
    + """,
summary0 as (select r.*, (select count(*) from stg) as total_records, (select count(*) from results x where x.rule_id = r.rule_id) as failed_records from rules r),
summary as (select rule_id, 'stg_customer' as dataset, column_name, severity, metric_type, threshold, total_records, failed_records,
  coalesce((total_records - failed_records) * 1.0::double / nullif(total_records, 0) * 100.0, 100.0) as pass_rate, coalesce(failed_records * 1.0::double / nullif(total_records, 0) * 100.0, 0.0) as failure_rate from summary0),
verdicts as (select *, case when metric_type = 'PASS_RATE' then case when pass_rate >= threshold then 'PASS' else 'FAIL' end when metric_type = 'FAILURE_RATE' then case when failure_rate <= threshold then 'PASS' else 'FAIL' end else 'UNKNOWN' end as status from summary)"""
)
_QUARANTINE = (
    _RESULTS
    + """,
long_stg as (select customer_id, unnest(['customer_id', 'nik', 'phone', 'email', 'birth_date']) as column_name, unnest([customer_id, nik, phone, email, cast(birth_date as varchar)]) as v from stg where customer_id is not null),
vals as (select customer_id, column_name, min(v) as original_value from long_stg group by all),
quarantined as (select x.run_id, x.record_id as customer_id, x.rule_id, 'stg_customer' as dataset, r.column_name, v.original_value, 'QUARANTINED' as quarantine_status
  from results x join rules r using (rule_id) left join vals v on v.customer_id = x.record_id and v.column_name = r.column_name)"""
)

_PAIRS = (
    _U
    + """,
n as (select source_system as s, source_customer_id as k, lower(nik) as nik, lower(phone) as phone, lower(email) as email, birth_date as dob from u),
pairs0 as (select l.s as source_system, l.k as source_customer_id, r.s as candidate_source_system, r.k as candidate_source_customer_id,
  coalesce(l.nik = r.nik, false) as nik_match, coalesce(l.dob = r.dob, false) as dob_match, coalesce(l.phone = r.phone, false) as phone_match, coalesce(l.email = r.email, false) as email_match,
  coalesce(l.dob <> r.dob, false) as dob_conflict, coalesce(l.phone <> r.phone, false) as phone_conflict, coalesce(l.email <> r.email, false) as email_conflict
  from n l join n r on l.s < r.s and (l.nik = r.nik or l.phone = r.phone or l.email = r.email)),
pairs as (select *, cast(100 * nik_match::int + 30 * dob_match::int + 30 * phone_match::int + 30 * email_match::int - 50 * dob_conflict::int - 30 * phone_conflict::int - 30 * email_conflict::int as double) as match_score from pairs0)"""
)
_MATCHES = (
    _PAIRS
    + """,
matches0 as (select *, case when nik_match and (dob_conflict or phone_conflict or email_conflict) then 'CONFLICT' when nik_match and match_score >= 100 then 'MATCH'
    when dob_match::int + phone_match::int + email_match::int >= 2 and not (dob_conflict or phone_conflict or email_conflict) then 'POSSIBLE_MATCH' when match_score >= 60 and not (dob_conflict or phone_conflict or email_conflict) then 'POSSIBLE_MATCH' else 'NO_MATCH' end as match_status,
  concat_ws(',', case when nik_match then 'NIK' end, case when dob_match then 'DOB' end, case when phone_match then 'PHONE' end, case when email_match then 'EMAIL' end, case when dob_conflict then 'CONFLICT:DOB' end, case when phone_conflict then 'CONFLICT:PHONE' end, case when email_conflict then 'CONFLICT:EMAIL' end) as matched_on from pairs),
matches as (select *, 'Candidate score=' || cast(match_score as varchar) || '; signals=' || matched_on as reason from matches0)"""
)
# clusters: recursive reach over trusted pairs, then single records beside a conflict join the cluster of their first pair
_ENTITIES = (
    _MATCHES
    + """,
edges as (select source_system || '::' || source_customer_id as a, candidate_source_system || '::' || candidate_source_customer_id as b from matches where match_status = 'MATCH' and match_score >= 150),
sym as (select a, b from edges union select b, a from edges),
reach as (select source_system || '::' || source_customer_id as id, source_system || '::' || source_customer_id as root from u union select sym.b, reach.root from reach join sym on sym.a = reach.id),
comp as (select id, min(root) as cluster from reach group by id),
sized as (select *, count(*) over (partition by cluster) as n from comp),
torn as (select source_system || '::' || source_customer_id as a, candidate_source_system || '::' || candidate_source_customer_id as b, source_customer_id as ka, candidate_source_customer_id as kb from matches where match_status = 'CONFLICT'),
moves as (select t.x as id, arg_min(c.cluster, (t.ka, t.kb)) as cluster from (select a as x, b as y, ka, kb from torn union all select b, a, ka, kb from torn) t join sized s on s.id = t.x and s.n = 1 join sized c on c.id = t.y and c.n >= 2 group by t.x),
placed as (select s.id, coalesce(m.cluster, s.cluster) as cluster from sized s left join moves m using (id)),
shapes as (select cluster, list_sort(list(id)) as members, bool_or(id in (select a from torn union select b from torn)) as has_conflict from placed group by cluster having count(*) > 1),
found as (select 'G' || lpad(cast(row_number() over (order by members) as varchar), 6, '0') as golden_id, members, has_conflict from shapes),
entities as (select golden_id, case when has_conflict then 'REVIEW' else 'ACTIVE' end as entity_status, has_conflict, case when has_conflict then 'MEDIUM' else 'HIGH' end as confidence from found),
member0 as (select golden_id, has_conflict, unnest(members) as m from found),
members as (select golden_id, split_part(m, '::', 1) as source_system, split_part(m, '::', 2) as source_customer_id, case when has_conflict then 'REVIEW' else 'CONFIRMED' end as membership_status, case when has_conflict then 'MEDIUM' else 'HIGH' end as membership_confidence from member0),
idm as (select total_pairs, m * 100.0::double / nullif(total_pairs, 0) as x, m, p, c, total_source_records, confirmed_records, review_records, ne, nm from
  (select count(*) as total_pairs, count(*) filter (where match_status = 'MATCH') as m, count(*) filter (where match_status = 'POSSIBLE_MATCH') as p, count(*) filter (where match_status = 'CONFLICT') as c from matches),
  (select count(*) as total_source_records from u), (select count(*) filter (where membership_status = 'CONFIRMED') as confirmed_records, count(*) filter (where membership_status = 'REVIEW') as review_records, count(distinct golden_id) as ne, count(*) as nm from members)),
metrics as (select total_pairs, m::double / total_pairs * 100.0 as match_rate, p::double / total_pairs * 100.0 as possible_match_rate, c::double / total_pairs * 100.0 as conflict_rate, total_source_records, confirmed_records, review_records,
  total_source_records - confirmed_records - review_records as unresolved_records, (total_source_records - confirmed_records - review_records)::double / total_source_records * 100.0 as unresolved_rate, ne as golden_entity_count, nm::double / ne as avg_cluster_size,
  greatest(0.0::double, least(100.0::double, (confirmed_records + review_records * 0.5::double) / total_source_records * 100.0::double - c::double / total_pairs * 100.0::double * 0.5::double)) as resolution_health from idm)"""
)
_LONG = """,
long_u as (select source_system, source_customer_id, unnest(['nik', 'full_name', 'phone', 'email', 'birth_date']) as attribute_name, unnest([nik, full_name, phone, email, cast(birth_date as varchar)]) as v from u)"""
_VERDICTS = (
    _LONG
    + f""",
attr as (select 'RUN-1' as run_id, source_system, source_customer_id, attribute_name, v as attribute_value,
  case when v is null or trim(v) = '' then 'FAIL' when attribute_name = 'nik' then case when regexp_full_match(v, '[0-9]{{16}}') then 'PASS' else 'FAIL' end when attribute_name = 'phone' then case when regexp_full_match(v, '08[0-9]{{8,13}}') then 'PASS' else 'FAIL' end
    when attribute_name = 'email' then case when contains(v, '@') and contains(regexp_extract(v, '[^@]*$'), '.') then 'PASS' else 'FAIL' end when attribute_name = 'birth_date' then case when cast(v as date) <= {TODAY} then 'PASS' else 'FAIL' end else 'PASS' end as status from long_u),
attr_dq as (select *, case when attribute_value is null or trim(attribute_value) = '' then 'NULL_OR_EMPTY' else case when status = 'PASS' then 'VALID_' else 'INVALID_' end || upper(attribute_name) end as message from attr)"""
)
_SURVIVORS = (
    _ENTITIES
    + _VERDICTS
    + """,
prio(attribute_name, source_system, priority) as (values ('nik','CRM',1),('nik','LOS',2),('nik','MOBILE',3),('full_name','CRM',1),('full_name','LOS',2),('full_name','MOBILE',3),('phone','MOBILE',1),('phone','CRM',2),('phone','LOS',3),
  ('email','CRM',1),('email','MOBILE',2),('email','LOS',3),('birth_date','LOS',1),('birth_date','CRM',2),('birth_date','MOBILE',3)),
survivors as (select golden_id, attribute_name, attribute_value, source_system, source_customer_id, cast(priority as int) as source_priority, true as dq_eligible, 'DQ=PASS; source_priority=' || priority || '; selected_highest_priority_eligible_source' as selection_reason
  from (select m.golden_id, d.*, p.priority, row_number() over (partition by m.golden_id, d.attribute_name order by p.priority, d.source_system, d.source_customer_id) as place
    from members m join entities e using (golden_id) join attr_dq d using (source_system, source_customer_id) join prio p using (attribute_name, source_system) where e.entity_status = 'ACTIVE' and m.membership_status = 'CONFIRMED' and d.status = 'PASS') where place = 1)"""
)
_CONSISTENCY0 = """,
agree0 as (select e.golden_id, a.attribute_name, count(distinct lower(l.v)) as distinct_values, coalesce(string_agg(l.source_system || ':' || l.source_customer_id || '=' || l.v, '; ' order by l.source_system, l.source_customer_id), '') as source_values
  from entities e cross join (select unnest(['nik', 'full_name', 'phone', 'email', 'birth_date']) as attribute_name) a left join (select m.golden_id, x.* from members m join long_u x using (source_system, source_customer_id) where x.v is not null) l on l.golden_id = e.golden_id and l.attribute_name = a.attribute_name group by all),
agree as (select golden_id, attribute_name, distinct_values, case when distinct_values <= 1 then 'CONSISTENT' when attribute_name = 'full_name' then 'VARIATION' else 'CONFLICT' end as consistency_status, case when distinct_values <= 1 then 'NONE' when attribute_name = 'full_name' then 'LOW' else 'HIGH' end as severity, source_values from agree0)"""
_QUALITY = """,
quality as (select golden_id, coalesce(valid, 0) as valid_attributes, 5 - coalesce(valid, 0) as missing_attributes, valid * 100.0::double / 5 as completeness_score, valid * 100.0::double / 5 as validity_score,
  case when valid is not null then case confidence when 'HIGH' then 100.0::double when 'MEDIUM' then 70.0 else 40.0 end end as identity_score, has_conflict from entities left join (select golden_id, count(*) as valid from survivors group by 1) using (golden_id)),
graded as (select *, completeness_score * 0.40::double + validity_score * 0.40::double + identity_score * 0.20::double as quality_score from quality),
golden_quality as (select * exclude (has_conflict), case when quality_score is null then 'NOT_ASSESSED' when has_conflict then 'REVIEW' when quality_score >= 95 then 'EXCELLENT' when quality_score >= 85 then 'GOOD' when quality_score >= 70 then 'WARNING' else 'POOR' end as quality_status from graded)"""
_QUEUE = """,
queue as (
  select 'IDENTITY_CONFLICT' as issue_type, m.golden_id, x.source_system, x.source_customer_id, cast(null as varchar) as attribute_name, 'HIGH' as severity, 'CONFLICT against ' || x.candidate_source_system || ':' || x.candidate_source_customer_id || ' - ' || x.reason as reason, 'OPEN' as status
    from matches x left join members m using (source_system, source_customer_id) where match_status = 'CONFLICT'
  union all select 'ATTRIBUTE_CONFLICT', golden_id, null, null, attribute_name, severity, source_values, 'OPEN' from agree where consistency_status = 'CONFLICT'
  union all select 'POSSIBLE_MATCH', null, x.source_system, x.source_customer_id, null, 'MEDIUM', 'POSSIBLE_MATCH against ' || x.candidate_source_system || ':' || x.candidate_source_customer_id || ' - ' || x.reason, 'OPEN' from matches x
    where match_status = 'POSSIBLE_MATCH' and not exists (select 1 from members a join members b on a.golden_id = b.golden_id where a.source_system = x.source_system and a.source_customer_id = x.source_customer_id and b.source_system = x.candidate_source_system and b.source_customer_id = x.candidate_source_customer_id))"""
_SCORES = (
    _SURVIVORS
    + _CONSISTENCY0
    + _QUALITY
    + _QUEUE
    + _SUMMARY.replace(_U, "", 1)
    + """,
dims0 as (
  select 'source_dq' as dimension, (total - bad)::double / total * 100.0 as score, 0.25::double as weight, (total - bad) || '/' || total || ' records passed source DQ' as detail from (select (select count(*) from stg) as total, (select count(distinct record_id) from results) as bad)
  union all select 'identity', resolution_health, 0.20::double, confirmed_records || '/' || total_source_records || ' confirmed, ' || review_records || ' in review, ' || unresolved_records || ' unresolved' from metrics
  union all select 'golden_quality', s, 0.25::double, n || '/' || a || ' entities assessed, avg score ' || printf('%.1f', s) from (select avg(quality_score) as s, count(quality_score) as n, count(*) as a from golden_quality)
  union all select 'consistency', g::double / a * 100.0, 0.20::double, g || '/' || a || ' attribute groups without conflict' from (select count(*) filter (where consistency_status <> 'CONFLICT') as g, count(*) as a from agree)
  union all select 'review_health', 100.0::double - least(100.0::double, h * 15.0 + (a - h) * 5.0), 0.10::double, a || ' open review(s), ' || h || ' HIGH' from (select count(*) filter (where severity = 'HIGH') as h, count(*) as a from queue)),
overall0 as (select sum(score * weight) / sum(weight) as overall_score from dims0 where score is not null),
overall1 as (select overall_score, case when overall_score >= 95 then 'EXCELLENT' when overall_score >= 85 then 'GOOD' when overall_score >= 70 then 'WARNING' else 'POOR' end as overall_status, (select count(quality_score) from golden_quality) as assessed_entities, (select count(*) from golden_quality) as total_entities from overall0)"""
)
_GATE = (
    _SCORES
    + """,
gate0 as (select *, (select string_agg(rule_id || ' (' || failed_records || ' record(s))', ', ' order by rule_id) from verdicts where severity = 'CRITICAL' and failed_records > 0) as breach, (select count(*) from entities where has_conflict) as torn_n, (select count(*) from queue where severity = 'HIGH') as high_n from overall1),
gate as (select overall_score, concat_ws('; ', 'CRITICAL rule breach - zero tolerance: ' || breach, case when overall_score < 70 then 'overall score ' || printf('%.1f', overall_score) || ' is below 70' end) as blocking_reasons,
  concat_ws('; ', case when torn_n > 0 then torn_n || ' golden entity(ies) carry an unresolved conflict' end, case when overall_score >= 70 and overall_score < 85 then 'overall score ' || printf('%.1f', overall_score) || ' is below 85' end,
    case when total_entities > assessed_entities then (total_entities - assessed_entities) || ' of ' || total_entities || ' entities not assessed' end, case when high_n > 0 then high_n || ' HIGH-severity review(s) still open' end) as warning_reasons from gate0)"""
)
_REJECTED = _ENTITIES + _VERDICTS


def _q(parts: str, select: str) -> str:
    return f"with recursive {parts.strip()}\n{select}"


_CONTRACT = f"""
c as (select case when k % 43 = 0 then ' ' else source_customer_id end as source_customer_id, nik, full_name, phone, case when k % 41 = 0 then strftime(birth_date, '%d/%m/%Y') else cast(birth_date as varchar) end as birth_date from (select *, cast(substring(source_customer_id, 4) as bigint) as k from u where source_system = 'CRM'))"""

ORACLE_SQL = {
    "staging_unified": _q(_U, "select * from u"),
    "contract_check": _q(_U + "," + _CONTRACT, """
select 'crm_customer.csv' as file_name, * from (
  select 'email' as column_name, 'MISSING_COLUMN' as violation_type, 'CRITICAL' as severity, cast(null as bigint) as violation_count, cast(null as varchar) as sample_value, 'DC-CRM-005' as contract_id
  union all select 'extra', 'NEW_COLUMN', 'LOW', null, null, null
  union all select 'birth_date', 'TYPE_MISMATCH', 'HIGH', count(*), min(birth_date), 'DC-CRM-006' from c where try_cast(birth_date as date) is null and birth_date is not null having count(*) > 0
  union all select 'source_customer_id', 'NULL_VIOLATION', 'CRITICAL', count(*), null, 'DC-CRM-001' from c where trim(source_customer_id) = '' having count(*) > 0)"""),
    "dq_rule_results": _q(_RESULTS, "select * from results"),
    "dq_rule_summary": _q(_SUMMARY, "select * from verdicts"),
    "source_gate": _q(_RESULTS, "select critical, high, medium, case when critical > 0 then 'BLOCKED' when high > 0 or medium > 0 then 'WARNING' else 'PASSED' end as gate_status from (select count(*) filter (where severity = 'CRITICAL') as critical, count(*) filter (where severity = 'HIGH') as high, count(*) filter (where severity = 'MEDIUM') as medium from results join rules using (rule_id))"),
    "quarantine": _q(_QUARANTINE, "select * from quarantined"),
    "incidents": _q(_RESULTS, "select 'INC-' || substring(sha1(run_id || '|' || rule_id || '|' || record_id), 1, 20) as incident_id, run_id, rule_id, 'stg_customer' as dataset, record_id, severity, message || '; column=' || column_name || '; record_id=' || record_id as incident_message, 'OPEN' as incident_status from results join rules using (rule_id)"),
    "eligible_rows": _q(_QUARANTINE, "select *, 'RUN-1' as run_id from stg s where not exists (select 1 from quarantined q where q.customer_id = s.customer_id)"),
    "order_rules": """
with lines as (select *, l_orderkey || '-' || l_linenumber as line_id from lineitem), t as (select count(*) as n from lines),
f as (select 'ORD-1' as rule_id, 100.0::double as threshold, count(*) as failed_records from lines where l_orderkey not in (select o_orderkey from orders where o_orderstatus <> 'P')
  union all select 'ORD-2', 10.0, count(*) from lines where l_discount > 0.09 and l_quantity < 3
  union all select 'ORD-3', 100.0, count(*) from lines where line_id in (select line_id from lines group by line_id having count(*) > 1))
select rule_id, failed_records, (n - failed_records)::double / n * 100.0 as pass_rate, case when rule_id = 'ORD-2' then case when failed_records::double / n * 100.0 <= threshold then 'PASS' else 'FAIL' end when (n - failed_records)::double / n * 100.0 >= threshold then 'PASS' else 'FAIL' end as status from f, t""",
    "profile_overview": _q(_U, "union all ".join(f"select '{c}' as column_name, count(*) as total, count(*) - count({c}) as nulls, count(distinct {c}) as distinct_values from u " for c in ("source_customer_id", "nik", "full_name", "phone", "email", "birth_date"))),
    "profile_duplicates": _q(_U, "select phone as value, count(*) as n from u where phone is not null group by 1 having count(*) > 1"),
    "profile_length_hist": _q(_U, "select cast(length(nik) as bigint) as len, count(*) as n from u where nik is not null group by 1"),
    "profile_format_status": _q(_U, "select case when phone is null then 'NULL' when regexp_full_match(phone, '08[0-9]{8,13}') then 'VALID' else 'INVALID' end as format_status, count(*) as n from u group by 1"),
    "profile_ages": _q(_U, f"select min(birth_date) as first_date, max(birth_date) as last_date, min(date_diff('year', birth_date, {TODAY})) as min_years, max(date_diff('year', birth_date, {TODAY})) as max_years, count(*) filter (where birth_date > {TODAY}) as future from u"),
    "staging_tests": _q(_STG, " union all ".join(f"select '{n}' as test_name, count(*) as failing from stg where {p}" for n, p in {
        "not_null_customer_id": "customer_id is null", "not_null_nik": "nik is null", "not_null_email": "email is null", "valid_nik": "not regexp_full_match(nik, '[0-9]{16}')", "valid_phone": "not regexp_full_match(phone, '08[0-9]{8,13}')", "valid_birth_date": f"birth_date > {TODAY}", "valid_email": "not regexp_full_match(lower(email), '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\\.[A-Za-z]{2,}')"}.items()) + "".join(
        f" union all select 'unique_{c}', count(*) from (select {c} from stg where {c} is not null group by 1 having count(*) > 1)" for c in ("customer_id", "nik"))),
    "attribute_dq": _q(_U + _VERDICTS, "select * from attr_dq"),
    "identity_candidates": _q(_PAIRS, "select * from pairs"),
    "identity_decision": _q(_MATCHES, "select source_system, source_customer_id, candidate_source_system, candidate_source_customer_id, match_score, match_status, matched_on, reason from matches"),
    "identity_rank": _q(_MATCHES, """
select source_system, source_customer_id, best_source_system, best_source_customer_id, best_score, second_score, score_gap, candidate_count, conflict_count, confidence,
  case when conflict_count > 0 and best_score >= 100 then 'MATCH_WITH_CONFLICT' when match_status = 'MATCH' and confidence = 'HIGH' then 'MATCH' when best_score >= 60 then 'POSSIBLE_MATCH' else 'NO_MATCH' end as resolution_status
from (select *, case when best_score >= 150 and score_gap >= 30 and conflict_count = 0 then 'HIGH' when best_score >= 100 and score_gap >= 20 then 'MEDIUM' else 'LOW' end as confidence
  from (select source_system, source_customer_id, candidate_source_system as best_source_system, candidate_source_customer_id as best_source_customer_id, match_score as best_score, match_status,
    lead(match_score) over w as second_score, match_score - coalesce(lead(match_score) over w, 0.0) as score_gap, count(*) over p as candidate_count, count(*) filter (where dob_conflict or phone_conflict or email_conflict) over p as conflict_count, row_number() over w as place
    from matches window p as (partition by source_system, source_customer_id), w as (partition by source_system, source_customer_id order by match_score desc, candidate_source_system, candidate_source_customer_id)) where place = 1)"""),
    "identity_clusters": _q(_ENTITIES, "select golden_id, array_to_string(members, '|') as members, has_conflict, sha256(array_to_string(members, '|')) as cluster_signature from found"),
    "golden_members": _q(_ENTITIES, "select * from members"),
    "unresolved_records": _q(_ENTITIES, "select source_system, source_customer_id from u where not exists (select 1 from members m where m.source_system = u.source_system and m.source_customer_id = u.source_customer_id)"),
    "identity_metrics": _q(_ENTITIES, "select * from metrics"),
    "golden_attributes": _q(_SURVIVORS, "select * from survivors"),
    "golden_customer": _q(_SURVIVORS, """
select e.golden_id, max(case when attribute_name = 'nik' then attribute_value end) as nik, max(case when attribute_name = 'full_name' then attribute_value end) as full_name, max(case when attribute_name = 'phone' then attribute_value end) as phone,
  max(case when attribute_name = 'email' then attribute_value end) as email, cast(max(case when attribute_name = 'birth_date' then attribute_value end) as date) as birth_date, e.entity_status from entities e left join survivors s using (golden_id) where e.entity_status = 'ACTIVE' group by e.golden_id, e.entity_status"""),
    "cross_source_consistency": _q(_ENTITIES + _LONG + _CONSISTENCY0, "select * from agree"),
    "golden_quality": _q(_SURVIVORS + _QUALITY, "select * from golden_quality"),
    "scd2_customers": _q(_U, """
, base as (select * exclude (source_system), cast(substring(source_customer_id, 4) as bigint) as k from u where source_system = 'CRM'),
one as (select * from base where k % 41 <> 0),
two as (select source_customer_id, nik, full_name, case when k % 29 = 0 then '0800000000' else phone end as phone, case when k % 58 = 0 then null else email end as email, birth_date, k from base where k % 37 <> 0),
diff as (select o.source_customer_id as id, nullif(concat_ws(',', case when o.phone is distinct from t.phone then 'phone' end, case when o.email is distinct from t.email then 'email' end), '') as ch, t.source_customer_id is null as gone from one o left join two t using (source_customer_id))
select source_customer_id, nik, full_name, phone, email, birth_date, timestamp '2026-01-01' as valid_from, case when ch is not null or gone then timestamp '2026-02-01' end as valid_to, not (ch is not null or gone) as is_current, 'INITIAL' as change_reason from one join diff on id = source_customer_id
union all select t.source_customer_id, nik, full_name, phone, email, birth_date, timestamp '2026-02-01', null, true, coalesce('CHANGED:' || ch, 'INITIAL') from two t left join diff on id = t.source_customer_id where id is null or ch is not null""".replace("\n, base", ",\nbase", 1)).replace("\n,\nbase", ",\nbase"),
    "review_queue": _q(_ENTITIES + _LONG + _CONSISTENCY0 + _QUEUE, "select * from queue"),
    "review_cases": _q(_ENTITIES + _LONG + _CONSISTENCY0 + _QUEUE, """
select subject_type, subject_key, case max(case severity when 'HIGH' then 3 when 'MEDIUM' then 2 else 1 end) when 3 then 'HIGH' when 2 then 'MEDIUM' else 'LOW' end as severity, 'OPEN' as status, cast(count(*) as int) as evidence_count, string_agg(distinct issue_type, ', ' order by issue_type) as issue_types,
  count(*) || ' issue(s) on ' || subject_key || ': ' || string_agg(distinct issue_type, ', ' order by issue_type) as summary
from (select q.*, coalesce(q.golden_id, m.golden_id) as g, case when g is not null then 'GOLDEN_ENTITY' else 'SOURCE_RECORD' end as subject_type, coalesce(g, q.source_system || ':' || q.source_customer_id) as subject_key from queue q left join members m on m.source_system = q.source_system and m.source_customer_id = q.source_customer_id) group by subject_type, subject_key"""),
    "review_ids": """
with h as (select c_custkey, sha1(unhex('6BA7B8119DAD11D180B400C04FD430C8') || encode('POSSIBLE_MATCH|' || c_name)) as h from customer)
select c_custkey, substring(h, 1, 8) || '-' || substring(h, 9, 4) || '-5' || substring(h, 14, 3) || '-' || substring('89ab', cast('0x' || substring(h, 17, 1) as int) % 4 + 1, 1) || substring(h, 18, 3) || '-' || substring(h, 21, 12) as review_id from h""",
    "score_dimensions": _q(_SCORES, "select dimension, round(score, 6) as score, weight, detail, round(score * weight / (select sum(weight) from dims0 where score is not null), 6) as contribution from dims0"),
    "overall_score": _q(_SCORES, "select * replace (round(overall_score, 6) as overall_score) from overall1"),
    "publication_gate": _q(_GATE, "select case when blocking_reasons <> '' then 'BLOCKED' when warning_reasons <> '' then 'WARNING' else 'PASSED' end as gate_status, * replace (round(overall_score, 6) as overall_score) from gate"),
    "golden_lineage": _q(_SURVIVORS, """
select s.*, d.status as attribute_dq_status, d.message as attribute_dq_message, m.membership_status, m.membership_confidence, case when k % 20 = 0 then 'APPROVED' end as resolution_action, case when k % 20 = 0 then 'STEWARD' end as resolved_by, e.entity_status, e.confidence as entity_confidence, 'RUN-1' as run_id
from (select *, cast(substring(source_customer_id, 4) as bigint) as k from survivors) s join attr_dq d using (source_system, source_customer_id, attribute_name) join members m using (golden_id, source_system, source_customer_id) join entities e using (golden_id)""").replace("select s.*,", "select s.* exclude (k),"),
    "rejected_values": _q(_REJECTED, "select distinct m.golden_id, source_system, source_customer_id, attribute_name, attribute_value, message from attr_dq join members m using (source_system, source_customer_id) where status = 'FAIL'"),
    "run_trend": """
with d as (select cast(ts as date) as started_at, strftime(cast(ts as date), '%Y%m%d') as run_id, count(*) as events, count(distinct user_id) as users from events group by 1, 2),
p as (select *, lag(events) over (order by started_at) as previous_events, lag(users) over (order by started_at) as previous_users from d)
select *, case when previous_events is null then '  -' when events = previous_events then '  =' else case when events > previous_events then 'UP ' else 'DOWN' end || ' ' || printf('%+.1f', (events - previous_events)::double) end as events_trend,
  case when previous_users is null then '  -' when users = previous_users then '  =' else case when users < previous_users then 'UP ' else 'DOWN' end || ' ' || printf('%+.1f', (users - previous_users)::double) end as users_trend from p""",
    "latest_per_key": "select user_id, event_id, event_type, value from (select *, row_number() over (partition by user_id order by ts desc, event_id desc) as place from events) where place = 1",
}

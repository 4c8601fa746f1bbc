"""Oracle SQL for the composite operators on their own."""

from oracle import sql_iac_adoption, sql_pull_requests
from oracle.snippets import A, DAYOF, NOTDRAFT, PR_DAYS, RND

SQL = {}

SQL["latest_per_key"] = """
select user_id, event_type, ts, event_id, value, props from (
  select *, row_number() over (partition by user_id, event_type order by ts desc, event_id desc) as rn from events) x where rn = 1
"""

SQL["ends_per_key"] = """
select f.user_id, f.value as first_value, l.event_type as last_type
from (select *, row_number() over (partition by user_id order by ts, event_id) as rn from events) f
join (select *, row_number() over (partition by user_id order by ts desc, event_id desc) as rn from events) l on l.user_id = f.user_id
where f.rn = 1 and l.rn = 1
"""

SQL["trailing_period"] = """
with r as (
  select event_id, cast(user_id % 25 as integer) as repository_id,
         case when user_id % 25 = 3 then ts - to_days(700) else ts end as created_at from events),
a as (select repository_id, max(created_at) as max_date from r group by 1)
select r.event_id, r.repository_id, r.created_at, a.max_date from r join a on a.repository_id = r.repository_id
where r.created_at >= a.max_date - to_days(10)
"""

_RECENT = """
with o as (
  select o_orderkey, o_orderpriority, o_orderdate from orders
  where o_orderdate >= (select max(o_orderdate) from orders) - to_days(720)),
i as (select l_orderkey, l_returnflag, case when l_linenumber <> 7 then l_shipdate end as at_time from lineitem)
"""

SQL["first_related"] = _RECENT + """
select o.*, min(at_time) as first_shipped from o join i on l_orderkey = o_orderkey group by all
"""

SQL["last_related"] = _RECENT + """
select o.*, case when count(*) = count(at_time) then max(at_time) end as last_accepted
from o join i on l_orderkey = o_orderkey where l_returnflag = 'A' group by all
"""

SQL["trend_line"] = f"""
with p as (
  select o_orderpriority as priority, {DAYOF('o_orderdate')} as day, count(*) as orders,
         date_diff('day', (select min({DAYOF('o_orderdate')}) from orders), {DAYOF('o_orderdate')}) as x
  from orders group by all),
m as (select priority, avg(cast(x as double)) as xb, avg(cast(orders as double)) as yb from p group by 1),
s as (
  select p.priority, xb, yb, sum((x - xb) * (orders - yb)) / sum((x - xb) * (x - xb)) as slope
  from p join m on m.priority = p.priority group by all)
select p.priority, day, orders, {RND('slope * x + (yb - slope * xb)', 2)} as trend from p join s on s.priority = p.priority
"""

SQL["bucket_mean"] = " union all ".join(f"""
select o_orderpriority, '{g}' as grain, cast(date_trunc('{g}', o_orderdate) as date) as slot, count(*) as n,
       {RND('avg(cast(o_totalprice as decimal(18,2)))', 2)} as mean_total
from orders group by all""" for g in ("week", "month", "quarter"))

SQL["membership_counts"] = """
with p as (select r.full_name as repository, p.* from pull_requests p join repositories r on r.id = p.repository_id),
m as (
  select repository, author as member, merged_at from p where author in (select username from dx_team_members)
  union all
  select repository, merged_by, merged_at from p where merged_by in (select username from dx_team_members) and merged_by <> author)
select repository, member, count(*) as prs, count(merged_at) as merged from m group by all
"""

SQL["membership_split"] = """
select r.full_name as repository, count(*) filter (merged_by in (select username from dx_team_members)) as inside,
       count(*) filter (merged_by not in (select username from dx_team_members)) as outside
from pull_requests p join repositories r on r.id = p.repository_id group by all
"""

SQL["pending_work"] = """
with done as (
  select concat(o_orderpriority, ':', o_custkey % 200) as k, o_orderdate as s, o_orderdate + to_days(cast(o_orderkey % 90 as integer)) as c
  from orders where o_orderstatus = 'F'),
asked as (select o_orderkey, concat(o_orderpriority, ':', (o_custkey + 1) % 200) as entity_type, o_orderdate as since_date from orders)
select * from asked where not exists (
  select 1 from done where k = entity_type and s <= since_date and c >= since_date)
"""

SQL["replace_partitions"] = """
with scan as (select * from part where p_brand like '%#2%' and p_size > 10)
select p_partkey, p_name, p_size, p_brand as repository from part where p_brand not in (select p_brand from scan)
union all
select p_partkey, concat('new ', p_name), p_size, p_brand from scan
"""

SQL["replace_all"] = "select s_suppkey, s_nationkey, s_acctbal from supplier where s_acctbal >= 0"

SQL["open_per_day"] = f"""
with n as (select max({DAYOF('o_orderdate')}) as today from orders),
o as (
  select o_orderpriority, {DAYOF('o_orderdate')} as s,
         case when o_orderstatus = 'F' then {DAYOF("o_orderdate + to_days(cast(o_orderkey % 40 as integer))")} else today + 1 end as e
  from orders, n),
d as (
  select o_orderpriority, cast(unnest(generate_series(min(s)::timestamp, any_value(today)::timestamp, interval 1 day)) as date) as date
  from o, n group by 1)
select d.o_orderpriority, d.date, count(o.s) as open_orders
from d left join o on o.o_orderpriority = d.o_orderpriority and o.s <= d.date and d.date < o.e group by all
"""

SQL["rate_by"] = f"""
select user_id, count(*) as total_runs, count(*) filter (event_type = 'purchase') as successful_runs,
       count(*) filter (event_type = 'error') as failed_runs,
       {RND("cast(count(*) filter (event_type = 'purchase') as double) / count(*) * 100", 2)} as success_rate_percentage
from events group by 1
"""

SQL["size_buckets"] = f"""
with b as (
  select p_brand, p_size, case when p_size <= 10 then 1 when p_size <= 20 then 2 when p_size <= 30 then 3 when p_size <= 40 then 4 else 5 end as sort_order
  from part)
select p_brand, case sort_order when 1 then '1-10' when 2 then '11-20' when 3 then '21-30' when 4 then '31-40' else '40+' end as size_range,
       cast(sort_order as integer) as sort_order, count(*) as pr_count, {RND('avg(p_size)', 2)} as avg_additions
from b group by all
"""

SQL["import_workflows"] = """
with l as (
  select id, repository_id, concat('new ', name) as name,
         case when id % 7 in (0, 1) then concat('path/', id)
              else concat('name: x', chr(10), chr(10), chr(10), 'uses: ', coalesce(pipeline, 'none')) end as pipeline
  from workflows)
select * from l
"""

SQL["import_tracker"] = """
select make_timestamp(2000 + cast(year(o_orderdate) % 100 as integer), month(o_orderdate), day(o_orderdate), 9, o_orderkey % 60, 0) as submitted_at,
       case when o_orderstatus = 'F' then date_trunc('day', o_orderdate) end as closed_at,
       concat('kind, ', o_custkey) as category, o_orderpriority as priority,
       case when o_orderstatus = 'F' then 'true' else 'false' end as is_closed, o_orderstatus as status,
       concat(day(o_orderdate), '/', month(o_orderdate), '/', lpad(cast(year(o_orderdate) % 100 as varchar), 2, '0'), ', 9:', o_orderkey % 60) as raw_submitted_at,
       case when o_orderstatus = 'F' then strftime(o_orderdate, '%Y-%m-%d') else '' end as raw_closed_at
from orders
"""

SQL["import_registry_releases"] = """
with r as (select * from terraform_registry_releases),
s as (select * from r where major_version <> 3),
n as (select * from r where provider = 'aws')
select s.module_name, s.provider, s.major_version, 'v0.0.1' as first_release_version, s.release_date,
       case when s.provider = 'aws' then s.releases_count else 1 end as releases_count,
       case when s.provider = 'aws' then s.latest_version else 'none' end as latest_version
from s
union all
select module_name, provider, major_version, first_release_version, release_date, releases_count, latest_version
from n where major_version = 3
"""

_SERIES = {"pr_lead_time_weekly": ("week", "avg_lead_time_days"), "pr_size_weekly": ("week", "avg_additions"),
           "pr_comments_weekly": ("week", "avg_comments"), "pr_comments_by_size_weekly": ("week", "avg_comments_per_addition"),
           "pr_lead_time_trend": ("date", "trend_line")}
SQL["pr_weekly_results"] = " union all ".join(
    f"select '{m}' as metric, repository, {slot} as week, {value} as value from ({sql_pull_requests.SQL[m]}) q{i}"
    for i, (m, (slot, value)) in enumerate(_SERIES.items()))

SQL["iac_supervised_wide"] = f"""
with long as ({sql_iac_adoption.SQL["iac_supervised_cumulative"]}),
wide as (
  select repository, run_date, max(case when pr_type = 'Supervised PRs' then cumulative_count end) as s,
         max(case when pr_type = 'Unsupervised PRs' then cumulative_count end) as u from long group by all)
select repository, run_date,
       coalesce(s, last_value(s ignore nulls) over w, 0)::bigint as supervised,
       coalesce(u, last_value(u ignore nulls) over w, 0)::bigint as unsupervised
from wide window w as (partition by repository order by run_date rows between unbounded preceding and current row)
"""

SQL["version_drift"] = f"select repository, module_name, used_version, latest_version, file_path, drift_status, is_dx from ({sql_iac_adoption._DRIFT}) d"

SQL["review_matrix_no_self"] = f"""
select r.full_name as repository, pr.merged_by as author, prr.reviewer, count(*) as review_count
from pull_request_reviews prr
join pull_requests pr on prr.pull_request_id = pr.id
join repositories r on prr.repository_id = r.id
where prr.submitted_at >= {A} - to_days({PR_DAYS}) and pr.merged_by <> prr.reviewer
  and pr.merged_by not in ('MACHINERY') and prr.reviewer not in ('MACHINERY') and {NOTDRAFT.replace("draft", "pr.draft")}
group by 1, 2, 3
"""

SQL["parse_module_scan"] = """
select p_brand as repository, case when p_partkey % 13 = 0 then '' else p_type end as source,
       case when p_partkey % 13 = 0 or p_partkey % 3 = 0 then '' else 'registry' end as "sourceType", '' as version,
       case when p_partkey % 13 = 0 then '' else p_name end as "filePath", '' as scan_repository,
       case when p_partkey % 13 = 0 then 0 else cast(p_partkey as double) end as "lineNumber"
from part where p_partkey % 11 <> 0
"""

SQL["parse_registry"] = """
with m as (select p_type as name, 'aws' as provider, p_brand as namespace, count(*) as pages from part where p_partkey % 5 <> 0 group by all),
v as (
  select p_type, p_brand, count(distinct v) as versions, max(v) as greatest_text
  from (select p_type, p_brand, concat(p_partkey % 9, '.0.', p_size) as v from part where p_partkey % 4 <> 0) x group by all)
select name, provider, namespace, pages, versions, greatest_text from m left join v on p_type = name and p_brand = namespace
"""

SQL["parse_published_at"] = """
select o_orderkey as id, case o_orderkey % 5 when 0 then null when 1 then date_trunc('day', o_orderdate)
         when 2 then date_trunc('day', o_orderdate) + interval '10 hours 30 minutes'
         else date_trunc('day', o_orderdate) + interval '8 hours 30 minutes' end as published_at
from orders
"""

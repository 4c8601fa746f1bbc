"""Oracle SQL (DuckDB) for the pull-request metrics, all repositories at once."""

from oracle.snippets import A, BOTS, CALENDAR_DAYS, NOTDRAFT, RND, SECS, WEEK, PR_DAYS, PR_JOIN

D = PR_DAYS

_merged = f"""merged_at >= {A} - to_days({D}) and merged_at is not null and created_at is not null
  and {BOTS} and {NOTDRAFT}"""
_created = f"""created_at >= {A} - to_days({D}) and {BOTS} and {NOTDRAFT}"""

SQL = {}

SQL["pr_avg_lead_time"] = f"""
select r.full_name as repository, a.avg_lead_time_days
from repositories r left join (
  select repository_id, {RND(f"avg({SECS('created_at', 'merged_at')}) / 86400", 2)} as avg_lead_time_days
  from pull_requests where {_merged} group by repository_id) a on a.repository_id = r.id
"""

SQL["pr_total"] = f"""
select r.full_name as repository, cast(coalesce(a.n, 0) as bigint) as total_prs
from repositories r left join (
  select repository_id, count(*) as n from pull_requests where {_created} group by repository_id
) a on a.repository_id = r.id
"""

SQL["pr_total_comments"] = f"""
select r.full_name as repository, cast(coalesce(a.s, 0) as bigint) as total_comments
from repositories r left join (
  select repository_id, coalesce(sum(total_comments_count), 0) as s
  from pull_requests where {_created} group by repository_id
) a on a.repository_id = r.id
"""

SQL["pr_comments_per_pr"] = f"""
select r.full_name as repository, a.comments_per_pr
from repositories r left join (
  select repository_id,
         {RND("cast(sum(total_comments_count) as double) / nullif(count(*), 0)", 2)} as comments_per_pr
  from pull_requests where {_created} group by repository_id
) a on a.repository_id = r.id
"""

SQL["pr_lead_time_weekly"] = f"""
select r.full_name as repository, {WEEK('merged_at')} as week,
       {RND(f"avg({SECS('created_at', 'merged_at')}) / 86400", 2)} as avg_lead_time_days
{PR_JOIN} where {_merged}
group by 1, 2
"""

SQL["pr_lead_time_trend"] = f"""
with w as (
  select r.full_name as repository, {WEEK('merged_at')} as week,
         {RND(f"avg({SECS('created_at', 'merged_at')}) / 86400", 2)} as y
  {PR_JOIN} where {_merged} group by 1, 2),
x as (select *, row_number() over (partition by repository order by week) as x from w),
st as (select repository, avg(cast(x as double)) as xbar, avg(y) as ybar from x group by repository),
s as (
  select x.repository, st.xbar, st.ybar,
         case when sum((x.x - st.xbar) * (x.x - st.xbar)) != 0
              then sum((x.x - st.xbar) * (x.y - st.ybar)) / sum((x.x - st.xbar) * (x.x - st.xbar))
              else 0 end as slope
  from x join st on x.repository = st.repository group by x.repository, st.xbar, st.ybar)
select x.repository, x.week as date,
       {RND("s.slope * cast(x.x as double) + (s.ybar - s.slope * s.xbar)", 2)} as trend_line
from x join s on x.repository = s.repository
"""


def _zero_filled(ts: str, extra: str) -> str:
    # days >= 240 → Monday weeks, both ends truncated
    return f"""
with cal as (
  select r.full_name as repository,
         cast(unnest(generate_series(
            cast(date_trunc('week', cast({A} - to_days({D}) as date)) as timestamp),
            cast(date_trunc('week', cast({A} as date)) as timestamp),
            interval 7 day)) as date) as date
  from repositories r),
cnt as (
  select r.full_name as repository, {WEEK(ts)} as d, count(*) as n
  {PR_JOIN}
  where {ts} >= {A} - to_days({D}) and {ts} <= {A} {extra} and {NOTDRAFT}
  group by 1, 2)
select cal.repository, cal.date, cast(coalesce(cnt.n, 0) as bigint) as pr_count
from cal left join cnt on cal.repository = cnt.repository and cal.date = cnt.d
"""


SQL["pr_merged_per_day"] = _zero_filled("merged_at", "and merged_at is not null")
SQL["pr_new_per_day"] = _zero_filled("created_at", "")

SQL["pr_open_per_day"] = f"""
with p as (
  select r.full_name as repository, cast(created_at as date) as cd,
         coalesce(cast(closed_at as date), cast({A} as date) + 1) as ed
  {PR_JOIN} where created_at >= {A} - to_days({D}) and {NOTDRAFT}),
b as (select repository, min(cd) as s from p group by repository),
cal as (
  select repository, cast(unnest(generate_series(cast(s as timestamp), cast(cast({A} as date) as timestamp),
                                                 interval 1 day)) as date) as date
  from b)
select cal.repository, cal.date, count(p.cd) as open_prs
from cal left join p on p.repository = cal.repository and cal.date >= p.cd and cal.date < p.ed
group by 1, 2
"""

SQL["pr_new_cumulative"] = f"""
with daily as (
  select r.full_name as repository, cast(created_at as date) as date, count(*) as n
  {PR_JOIN} where created_at >= {A} - to_days({D}) group by 1, 2),
b as (select repository, min(date) as s from daily group by repository),
cal as (
  select repository, cast(unnest(generate_series(cast(s as timestamp), cast(cast({A} as date) as timestamp),
                                                 interval 1 day)) as date) as date
  from b)
select cal.repository, cal.date,
       cast(sum(coalesce(d.n, 0)) over (partition by cal.repository order by cal.date
            rows between unbounded preceding and current row) as bigint) as cumulative_count
from cal left join daily d on d.repository = cal.repository and d.date = cal.date
"""

SQL["pr_size_weekly"] = f"""
select r.full_name as repository, {WEEK('created_at')} as week, {RND("avg(additions)", 2)} as avg_additions
{PR_JOIN} where created_at >= {A} - to_days({D}) and additions is not null
group by 1, 2
"""

SQL["pr_comments_weekly"] = f"""
select r.full_name as repository, {WEEK('created_at')} as week,
       {RND("avg(total_comments_count)", 2)} as avg_comments
{PR_JOIN} where created_at >= {A} - to_days({D})
group by 1, 2
"""

SQL["pr_comments_by_size_weekly"] = f"""
select r.full_name as repository, {WEEK('created_at')} as week,
       {RND("avg(total_comments_count) / nullif(avg(additions), 0)", 2)} as avg_comments_per_addition
{PR_JOIN} where created_at >= {A} - to_days({D})
group by 1, 2
"""

SQL["pr_size_distribution"] = f"""
select repository, size_range, sort_order, count(*) as pr_count, {RND("avg(additions)", 0)} as avg_additions
from (
  select r.full_name as repository, additions,
    case when additions <= 50 then '0-50' when additions <= 200 then '51-200'
         when additions <= 500 then '201-500' when additions <= 1000 then '501-1000' else '1000+' end as size_range,
    case when additions <= 50 then 1 when additions <= 200 then 2
         when additions <= 500 then 3 when additions <= 1000 then 4 else 5 end as sort_order
  {PR_JOIN}
  where created_at >= {A} - to_days({D}) and additions is not null and {NOTDRAFT}) b
group by 1, 2, 3
"""

SQL["pr_slowest"] = f"""
select repository, title, lead_time_days, number, created_at, merged_at from (
  select r.full_name as repository, title, {RND(f"{SECS('created_at', 'merged_at')} / 86400", 2)} as lead_time_days,
         number, created_at, merged_at,
         row_number() over (partition by r.full_name
                            order by {RND(f"{SECS('created_at', 'merged_at')} / 86400", 2)} desc, number asc) as rn
  {PR_JOIN} where {_merged}) t
where rn <= 50
"""

# day grain (days < 240): the composite zero_filled_counts key
SQL["zero_filled_counts"] = f"""
with cal as (
  select r.full_name as repository,
         cast(unnest(generate_series(cast(cast({A} - to_days({CALENDAR_DAYS}) as date) as timestamp),
                                     cast(cast({A} as date) as timestamp), interval 1 day)) as date) as date
  from repositories r),
cnt as (
  select r.full_name as repository, cast(created_at as date) as d, count(*) as n
  {PR_JOIN}
  where created_at >= {A} - to_days({CALENDAR_DAYS}) and created_at <= {A} and {NOTDRAFT}
  group by 1, 2)
select cal.repository, cal.date, cast(coalesce(cnt.n, 0) as bigint) as pr_count
from cal left join cnt on cal.repository = cnt.repository and cal.date = cnt.d
"""

SQL["running_total"] = """
select event_type, run_date,
       cast(sum(n) over (partition by event_type order by run_date
                         rows between unbounded preceding and current row) as bigint) as cumulative_count
from (select event_type, cast(ts as date) as run_date, count(*) as n from events group by 1, 2) x
"""

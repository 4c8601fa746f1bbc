"""Oracle SQL for the team, tracker and release metrics."""

from oracle.snippets import A, NOTDRAFT, PR_JOIN, RND, SECS, TEAM_DAYS, WEEK

D = TEAM_DAYS
MEMBERS = "(select username from dx_team_members)"

SQL = {}

# D >= 240: step by 7 days from the period start, then truncate each step to Monday
SQL["team_pr_split"] = f"""
with cal as (
  select distinct repository, cast(date_trunc('week', d) as date) as date from (
    select r.full_name as repository,
           unnest(generate_series(cast(cast({A} - to_days({D}) as date) as timestamp),
                                  cast(cast({A} as date) as timestamp), interval 7 day)) as d
    from repositories r) s),
pc as (
  select r.full_name as repository, {WEEK('created_at')} as pr_date,
         sum(case when author in {MEMBERS} then 1 else 0 end) as dx_pr,
         sum(case when author not in {MEMBERS} then 1 else 0 end) as non_dx_pr
  {PR_JOIN}
  where created_at >= {A} - to_days({D}) and {NOTDRAFT}
  group by 1, 2)
select cal.repository, cal.date, cast(sum(coalesce(pc.dx_pr, 0)) as bigint) as dx_pr,
       cast(sum(coalesce(pc.non_dx_pr, 0)) as bigint) as non_dx_pr
from cal left join pc on pc.repository = cal.repository and pc.pr_date = cal.date
group by 1, 2
"""

SQL["team_commits_daily"] = f"""
select split_part(repository_full_name, '/', 1) as organization, cast(committer_date as date) as committer_date,
       author as member_name, count(*) as repository_commits
from commits
where author in {MEMBERS} and committer_date >= {A} - to_days({D})
  and not regexp_matches(repository_full_name, '(dx|eng)')
  and repository_full_name not like '%technology-radar%'
group by 1, 2, 3
"""

SQL["team_pr_table"] = f"""
select r.full_name as repository, author, created_at
{PR_JOIN} where created_at >= {A} - to_days({D}) and {NOTDRAFT}
"""

SQL["team_commits_by_repo"] = f"""
select organization, author as member_name, repository_full_name as full_name, count(*) as repository_commits
from (select *, split_part(repository_full_name, '/', 1) as organization from commits) c
where author in {MEMBERS} and committer_date >= {A} - to_days({D})
  and starts_with(repository_full_name, organization || '/')
  and not contains(repository_full_name, organization || '-dx')
  and not starts_with(repository_full_name, organization || '/terraform')
group by 1, 2, 3
"""

SQL["adopting_repositories"] = """
select distinct repository_full_name as repository
from code_search_results
where query = 'acme/dx org:acme' and repository_full_name not like '%dx%'
"""

SQL["shared_pipeline_usage"] = """
select dx_workflow as dx_path, count(distinct repository) as repository_count
from dx_pipeline_usages group by 1
"""

SQL["tracker_opened"] = "select count(*) as opened from tracker_requests where submitted_at is not null"

SQL["tracker_closed"] = """
select count(*) as closed from tracker_requests where is_closed = 'true' or closed_at is not null
"""

SQL["tracker_avg_days_to_close"] = f"""
select {RND(f"avg({SECS('submitted_at', 'closed_at')}) / 86400", 2)} as avg_days_to_close
from tracker_requests
where (is_closed = 'true' or closed_at is not null) and closed_at is not null and submitted_at is not null
"""

# the sums form of the least-squares line, as in the original
_REG = """
with daily as (
  select cast(submitted_at as date) as request_date, count(*) as requests
  from tracker_requests where submitted_at is not null group by 1),
nd as (select request_date, requests, row_number() over (order by request_date) as day_number from daily),
reg as (
  select count(*) as n, sum(day_number) as sx, sum(requests) as sy, sum(day_number * requests) as sxy,
         sum(day_number * day_number) as sxx from nd),
coef as (
  select n, sx, sy, cast(sxy * n - sx * sy as double) / nullif(cast(sxx * n - sx * sx as double), 0) as slope
  from reg)
"""

SQL["tracker_trend_pct"] = _REG + f"""
select {RND("(last_value - first_value) / nullif(first_value, 0) * 100", 2)} as trend_pct
from (select slope * 1 + (sy - slope * sx) / n as first_value,
             slope * n + (sy - slope * sx) / n as last_value from coef) tv
"""

SQL["tracker_daily_trend"] = _REG + f"""
select nd.request_date, nd.requests as actual_requests,
       {RND("c.slope * nd.day_number + (c.sy - c.slope * c.sx) / c.n", 2)} as trend
from nd, coef c
"""

# character by character: upper case after anything that is neither letter nor digit
_INITCAP = ("array_to_string(list_transform(range(1, length({c}) + 1), lambda i: case when i = 1 or not "
            "regexp_matches({c}[i - 1], '[\\p{{L}}\\p{{N}}]') then upper({c}[i]) else lower({c}[i]) end), '')")

SQL["tracker_by_category"] = f"""
select {_INITCAP.format(c='category')} as category, count(*) as requests
from tracker_requests where category is not null and category != '' group by 1
"""

SQL["tracker_by_priority"] = f"""
select {_INITCAP.format(c='priority')} as priority, count(*) as requests
from tracker_requests where priority is not null and priority != '' group by 1
"""

SQL["release_stats"] = """
select count(distinct module_name) as total_modules, count(*) as total_major_versions,
       cast(coalesce(sum(releases_count), 0) as bigint) as total_releases,
       strftime(min(release_date), '%Y-%m-%d') as oldest_release,
       strftime(max(release_date), '%Y-%m-%d') as newest_release
from terraform_registry_releases
"""

SQL["release_module_summary"] = """
select module_name, provider, count(*) as major_versions_count,
       cast(coalesce(sum(releases_count), 0) as bigint) as total_releases,
       cast(min(release_date) as date) as first_release_date, cast(max(release_date) as date) as last_release_date,
       max(major_version) as latest_major,
       string_agg('v' || major_version || ' (' || coalesce(cast(releases_count as varchar), '?') || ')', ', '
                  order by major_version) as versions_detail
from terraform_registry_releases group by 1, 2
"""

SQL["release_timeline"] = """
select strftime(release_date, '%Y-%m') as month, count(*) as major_versions_introduced,
       cast(coalesce(sum(releases_count), 0) as bigint) as total_releases
from terraform_registry_releases where release_date is not null group by 1
"""

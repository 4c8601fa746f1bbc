"""Oracle SQL for the ingest jobs over the driver's tables and for the forms beside the metrics."""

from oracle import sql_iac_adoption, sql_pull_requests, sql_team_tracker_releases
from oracle.snippets import A, CALENDAR_DAYS, PR_DAYS, RND, TEAM_DAYS

SQL = {}

STORED, SINCE = "timestamp '1998-01-01'", "timestamp '1996-01-01'"
MID, MID_DAYS = "timestamp '1998-06-30'", 300

SQL["import_pull_requests"] = f"""
with l as (select * from pull_requests where coalesce(closed_at, created_at) >= {SINCE}),
t as (select * from pull_requests where created_at < {STORED})
select coalesce(t.id, l.id) as id, coalesce(t.repository_id, l.repository_id) as repository_id,
       coalesce(t.number, l.number) as number,
       case when l.id is not null then 'new ' || l.title else t.title end as title,
       case when t.id is not null then t.author else 'someone' end as author,
       coalesce(t.merged_by, l.merged_by) as merged_by, coalesce(t.created_at, l.created_at) as created_at,
       coalesce(l.merged_at, t.merged_at) as merged_at, coalesce(l.closed_at, t.closed_at) as closed_at,
       coalesce(t.additions, l.additions) as additions,
       coalesce(t.total_comments_count, l.total_comments_count) as total_comments_count,
       case when l.id is null then t.draft when l.draft = 1 then 1 else 0 end as draft
from t full outer join l on l.number = t.number and l.repository_id = t.repository_id
"""

SQL["backfill_pr_details"] = f"""
with last as (
  select * from (
    select l_orderkey as k, cast(l_quantity as bigint) as a, concat('rev', cast(l_suppkey % 20 as string)) as m, l_linenumber as n,
           row_number() over (partition by l_orderkey order by l_linenumber desc, l_quantity desc, l_suppkey desc) as rn
    from lineitem) x where rn = 1),
p as (
  select *, (draft is null or additions is null or total_comments_count is null) and created_at >= {SINCE} and last.k is not null as hit
  from pull_requests left join last on last.k = number)
select id, repository_id, number, title, author, case when hit then m else merged_by end as merged_by, created_at, merged_at, closed_at,
       case when hit then a when draft is not null then additions end as additions,
       case when hit then n + case when n % 2 = 1 then 10 else 0 end else total_comments_count end as total_comments_count, draft
from p
"""

SQL["import_reviews"] = f"""
with r as (
  select l_orderkey * 8 + l_linenumber as id, l_orderkey as pull_request_id, l_suppkey, l_partkey,
         case when l_suppkey % 20 <> 7 then concat('rev', cast(l_suppkey % 20 as string)) end as reviewer,
         l_returnflag as state, l_shipdate as submitted_at from lineitem),
landed as (
  select r.*, row_number() over (partition by r.id order by submitted_at, l_suppkey, l_partkey) as up,
         row_number() over (partition by r.id order by submitted_at desc, l_suppkey desc, l_partkey desc) as down
  from r join pull_requests p on p.id = r.pull_request_id
  where p.merged_at is not null and p.created_at >= {SINCE} and reviewer is not null and reviewer <> 'rev3'),
t as (select * from r where submitted_at < {STORED}),
f as (select * from landed where up = 1),
l as (select * from landed where down = 1)
select coalesce(t.id, f.id) as id, case when t.id is not null then t.pull_request_id else f.pull_request_id end as pull_request_id,
       case when t.id is not null then t.reviewer else f.reviewer end as reviewer,
       case when l.id is not null then 'APPROVED' else t.state end as state,
       case when l.id is not null then l.submitted_at else t.submitted_at end as submitted_at
from t full outer join f on f.id = t.id left join l on l.id = coalesce(t.id, f.id)
"""

_SINCE_RUN = "(select max(created_at) - interval 12 day from workflow_runs)"

SQL["import_workflow_runs"] = f"""
select id, repository_id, workflow_id, case when created_at >= {_SINCE_RUN} then 'landed' else conclusion end as conclusion,
       status, created_at, updated_at
from workflow_runs where id % 2 = 0 or created_at >= {_SINCE_RUN}
"""

SQL["import_workflow_stubs"] = f"""
select id, repository_id, name, pipeline from workflows where id % 3 <> 0
union all
select distinct workflow_id, repository_id,
       case when workflow_id % 2 = 0 then concat('run ', cast(workflow_id as string)) else 'unknown' end, cast(null as varchar)
from workflow_runs where workflow_id % 3 = 0 and created_at >= {_SINCE_RUN}
"""

_REPOS = """
with known as (select * from repositories where id < 20),
made as (
  select 19 + row_number() over (order by full_name) as id, name, full_name, organization
  from repositories where id >= 20 and id in (select repository_id from commits)),
repos as (select id, name, full_name, organization from known union all select * from made)
"""

SQL["created_repositories"] = _REPOS + "select id, name, full_name, organization from repos"

SQL["import_member_commits"] = _REPOS + f""",
stored as (select * from commits where committer_date < {STORED}),
fresh as (
  select * from (select *, row_number() over (partition by sha order by committer_date) as rn from commits) x
  where rn = 1 and sha not in (select sha from stored))
select sha, repository_id, repository_full_name, author, committer_date from stored
union all
select f.sha, r.id, f.repository_full_name, 'landed', f.committer_date from fresh f join repos r on r.full_name = f.repository_full_name
"""

SQL["import_code_search"] = """
select 'second' as query, concat('org/', source) as repository_full_name, cast(doc_id as string) as path
from documents where doc_id % 2 = 1
union all
select distinct 'first', concat('org/', source), cast(doc_id % 50 as string) from documents where doc_id % 5 <> 0 and doc_id % 11 <> 0
union all
select 'first', concat('org/', source), null from documents where doc_id % 5 = 0 and doc_id % 11 <> 0
"""

SQL["import_terraform_modules"] = """
with s as (
  select p_brand as repository, lower(p_type) as module, case when p_size % 3 <> 0 then p_name end as file_path,
         case when p_size % 4 <> 0 then concat('~> ', cast(p_size as string)) end as version, p_partkey as o
  from part where contains(p_brand, '#2'))
select repository, module, file_path, version from terraform_modules
where repository not in (select repository from s)
union all
select repository, module, file_path, version from s where file_path is null
union all
select repository, module, file_path, version from (
  select *, row_number() over (partition by repository, module, file_path order by o) as rn from s where file_path is not null) x
where rn = 1
"""

SQL["adoption_pipeline_share"] = f"""
with base as ({sql_iac_adoption.SQL["adoption_pipelines"]})
select repository, pipeline_type, pipeline_count,
       {RND("cast(pipeline_count as double) / sum(pipeline_count) over (partition by repository) * 100.0", 1)} as share_pct
from base
"""


def _at_mid(sql: str, days: int) -> str:
    """The same metric for a period of MID_DAYS that ends at MID."""
    return sql.replace(A, MID).replace(f"to_days({days})", f"to_days({MID_DAYS})")


SQL["team_commits_daily_mid"] = _at_mid(sql_team_tracker_releases.SQL["team_commits_daily"], TEAM_DAYS)

SQL["team_pr_split_daily"] = f"""
with cal as (
  select r.full_name as repository, cast(d as date) as date
  from repositories r, unnest(generate_series(cast(cast({A} - to_days({CALENDAR_DAYS}) as date) as timestamp),
                                              cast(cast({A} as date) as timestamp), interval 1 day)) as s(d)),
pc as (
  select r.full_name as repository, cast(pr.created_at as date) as date,
         count(*) filter (where author in (select username from dx_team_members)) as dx_pr,
         count(*) filter (where author not in (select username from dx_team_members)) as non_dx_pr
  from pull_requests pr join repositories r on pr.repository_id = r.id
  where pr.created_at >= {A} - to_days({CALENDAR_DAYS}) and (draft is null or draft = 0)
  group by 1, 2)
select cal.repository, cal.date, cast(coalesce(pc.dx_pr, 0) as bigint) as dx_pr, cast(coalesce(pc.non_dx_pr, 0) as bigint) as non_dx_pr
from cal left join pc on pc.repository = cal.repository and pc.date = cal.date
"""

for _key in ("pr_total", "pr_new_per_day"):
    SQL[f"{_key}_mid"] = _at_mid(sql_pull_requests.SQL[_key], PR_DAYS)

SQL["pr_cards"] = f"""
select a.repository, nullif(a.avg_lead_time_days, 0) as avg_lead_time_days, nullif(b.total_prs, 0) as total_prs,
       nullif(c.total_comments, 0) as total_comments, nullif(e.comments_per_pr, 0) as comments_per_pr
from ({sql_pull_requests.SQL["pr_avg_lead_time"]}) a join ({sql_pull_requests.SQL["pr_total"]}) b on a.repository = b.repository
join ({sql_pull_requests.SQL["pr_total_comments"]}) c on a.repository = c.repository
join ({sql_pull_requests.SQL["pr_comments_per_pr"]}) e on a.repository = e.repository
"""

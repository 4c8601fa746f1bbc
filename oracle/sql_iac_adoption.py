"""Oracle SQL for the IaC and adoption metrics."""

from oracle.snippets import A, IAC_DAYS, RND, SECS, WEEK

D = IAC_DAYS
TEAM = "('BUILDING', 'rev0', 'rev1', 'rev2')"

_BASE = f"""
with anc as (
  select n.repository, coalesce(m.mx, {A}) as max_date
  from (select full_name as repository from repositories
        union select repository_full_name from iac_pr_lead_times) n
  left join (select repository_full_name as repository, max(greatest(created_at, merged_at)) as mx
             from iac_pr_lead_times group by 1) m on m.repository = n.repository),
base as (
  select i.repository_id, i.pr_number, i.title, i.author, i.created_at, i.merged_at,
         i.repository_full_name as repository, anc.max_date
  from iac_pr_lead_times i join anc on anc.repository = i.repository_full_name
  where i.title != 'Version Packages')
"""

_MERGED = f"merged_at >= max_date - to_days({D}) and created_at is not null and merged_at is not null"
_CREATED = f"b.created_at >= b.max_date - to_days({D}) and b.created_at is not null"
_PRJ = "left join pull_requests pr on pr.repository_id = b.repository_id and pr.number = b.pr_number"

SQL = {}

SQL["iac_anchor"] = _BASE + "select repository, max_date from anc"

SQL["iac_lead_time_weekly"] = _BASE + f"""
select repository, {WEEK('merged_at')} as week,
       {RND(f"avg({SECS('created_at', 'merged_at')}) / 86400", 2)} as avg_lead_time_days
from base where {_MERGED} group by 1, 2
"""

SQL["iac_lead_time_trend"] = _BASE + f""",
p as (
  select repository, pr_number, cast(created_at as date) as date,
         {SECS('created_at', 'merged_at')} / 86400 as y,
         row_number() over (partition by repository order by cast(created_at as date), pr_number) as x
  from base where {_MERGED}),
st as (select repository, avg(cast(x as double)) as xbar, avg(y) as ybar from p group by repository),
s as (
  select p.repository, st.xbar, st.ybar,
         case when sum((p.x - st.xbar) * (p.x - st.xbar)) != 0
              then sum((p.x - st.xbar) * (p.y - st.ybar)) / sum((p.x - st.xbar) * (p.x - st.xbar))
              else 0 end as slope
  from p join st on p.repository = st.repository group by p.repository, st.xbar, st.ybar)
select p.repository, p.pr_number, p.date,
       greatest({RND("s.slope * cast(p.x as double) + (s.ybar - s.slope * s.xbar)", 2)}, 0) as trend_line
from p join s on p.repository = s.repository
"""

SQL["iac_supervised_cumulative"] = _BASE + f""",
c as (
  select b.repository, cast(b.created_at as date) as run_date,
         case when b.author in {TEAM} or pr.merged_by in {TEAM} then 'Supervised PRs'
              else 'Unsupervised PRs' end as pr_type
  from base b {_PRJ}
  where {_CREATED} and (pr.draft is null or pr.draft = 0))
select repository, run_date, pr_type,
       cast(sum(n) over (partition by repository, pr_type order by run_date
                         rows between unbounded preceding and current row) as bigint) as cumulative_count
from (select repository, run_date, pr_type, count(*) as n from c group by 1, 2, 3) x
"""

SQL["iac_count_weekly"] = _BASE + f"""
select b.repository, {WEEK('b.created_at')} as week, count(*) as pr_count
from base b where {_CREATED} group by 1, 2
"""

SQL["iac_by_member"] = _BASE + f""",
bb as (
  select distinct b.repository, b.pr_number, b.author, b.created_at, b.merged_at, pr.merged_by
  from base b {_PRJ} where {_CREATED}),
e as (
  select repository, created_at, merged_at,
         unnest([case when author in {TEAM} then author end,
                 case when merged_by in {TEAM} and merged_by != author then merged_by end]) as member
  from bb)
select repository, member as reviewer, count(*) as total_prs,
       count(*) filter (where merged_at is not null) as merged_prs,
       {RND(f"avg(case when merged_at is not null then {SECS('created_at', 'merged_at')} end) / 86400", 2)}
         as avg_lead_time_days
from e where member is not null group by 1, 2
"""

_W = """
with w as (
  select r.full_name as repository, w.name, w.pipeline,
         row_number() over (partition by r.full_name, w.name
                            order by case when w.pipeline like '%acme/dx%' then 0 else 1 end, w.id) as rn
  from workflows w join repositories r on w.repository_id = r.id
  where w.name not in ('CodeQL', 'Labeler'))
"""

SQL["adoption_pipelines"] = _W + """
select repository,
       case when pipeline like '%acme/dx%' then 'DX Pipelines' else 'Non-DX Pipelines' end as pipeline_type,
       count(*) as pipeline_count
from w where rn = 1 group by 1, 2
"""

SQL["adoption_workflow_list"] = _W + """
select repository, name as workflow_name,
       case when pipeline like '%acme/dx%' then '✓ DX' else 'Non-DX' end as pipeline_type
from w where rn = 1
"""

_DXMOD = "(module like '%acme-dx%' or module like '%acme/dx%')"
_NOTREL = "module not like './%' and module not like '../%'"

SQL["adoption_modules"] = f"""
select repository,
       case when {_DXMOD} then 'DX Terraform Modules' else 'Non-DX Terraform Modules' end as module_type,
       count(*) as module_count
from (select distinct repository, module from terraform_modules where {_NOTREL}) m
group by 1, 2
"""

SQL["adoption_module_list"] = f"""
select repository, module as module_name,
       case when {_DXMOD} then '✓ DX' else 'Non-DX' end as module_type, file_path
from (select *, row_number() over (partition by repository, module order by file_path asc nulls last) as rn
      from terraform_modules where {_NOTREL}) m
where rn = 1
"""

_DRIFT = """
select tm.repository, tm.module as module_name, tm.version as used_version, l.latest_version, tm.file_path,
       case when tm.version is null or l.latest_version is null then 'unknown'
            when try_cast(nullif(regexp_extract(tm.version, '([0-9]+)', 1), '') as integer) = l.major_version
              then 'up-to-date'
            when try_cast(nullif(regexp_extract(tm.version, '([0-9]+)', 1), '') as integer) < l.major_version
              then 'outdated'
            else 'unknown' end as drift_status,
       ((tm.module like '%acme-dx%' or tm.module like '%acme/dx%')
        and tm.module not like './%' and tm.module not like '../%') as is_dx
from terraform_modules tm
left join lateral (
  select latest_version, major_version from terraform_registry_releases trr
  where trr.module_name = split_part(tm.module, '/', 2)
  order by trr.major_version desc, trr.provider desc limit 1) l on true
"""

SQL["module_version_drift"] = f"""
select repository, module_name, used_version, latest_version, file_path, drift_status
from ({_DRIFT}) d where is_dx
"""

SQL["module_version_drift_summary"] = f"""
select repository, up_to_date, outdated, unknown, total,
       {RND("cast(up_to_date as double) / nullif(cast(total as double), 0) * 100", 0)} as up_to_date_pct
from (
  select repository,
         count(*) filter (where is_dx and drift_status = 'up-to-date') as up_to_date,
         count(*) filter (where is_dx and drift_status = 'outdated') as outdated,
         count(*) filter (where is_dx and drift_status = 'unknown') as unknown,
         count(*) filter (where is_dx) as total
  from ({_DRIFT}) d group by repository) s
"""

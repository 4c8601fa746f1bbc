"""Oracle SQL for the CI workflow metrics (anchor = latest run per repository)."""

from oracle.snippets import A, RND, SECS, WORKFLOW_DAYS

D = WORKFLOW_DAYS

_BASE = f"""
with anc as (
  select r.id as rid, r.full_name as repository, coalesce(m.mx, {A}) as max_date
  from repositories r left join (
    select repository_id, max(created_at) as mx from workflow_runs group by repository_id) m
  on m.repository_id = r.id),
base as (
  select anc.repository, anc.max_date, wr.conclusion, wr.status, wr.created_at, wr.updated_at,
         w.name, w.pipeline
  from workflow_runs wr join workflows w on wr.workflow_id = w.id join anc on wr.repository_id = anc.rid)
"""

_LABEL = "concat(case when pipeline like '%acme/dx%' then 'DX ' else '' end, name)"
_OK = f"""status = 'completed' and trim(conclusion) = 'success'
  and updated_at >= max_date - to_days({D}) and updated_at <= max_date and name not in ('CodeQL', 'Labeler')"""

SQL = {}

SQL["wf_anchor"] = _BASE + "select repository, max_date from anc"

SQL["wf_deployments_weekly"] = _BASE + f"""
select repository, date_trunc('week', created_at) as run_week, count(*) as weekly_deployment_count
from base
where (lower(name) like '%deploy%' or lower(name) like '%delivery%' or lower(name) like '%release%'
       or lower(name) like '%apply%')
  and trim(conclusion) = 'success' and created_at >= max_date - to_days({D}) and name != 'Labeler'
group by 1, 2
"""

SQL["wf_dx_runs_cumulative"] = _BASE + f"""
select repository, run_date, pipeline_type,
       cast(sum(n) over (partition by repository, pipeline_type order by run_date
                         rows between unbounded preceding and current row) as bigint) as cumulative_count
from (
  select repository, cast(created_at as date) as run_date,
         case when pipeline like '%acme/dx%' then 'DX Pipelines' else 'Non-DX Pipelines' end as pipeline_type,
         count(*) as n
  from base where created_at >= max_date - to_days({D}) and name not in ('CodeQL', 'Labeler')
  group by 1, 2, 3) x
"""

SQL["wf_failures"] = _BASE + f"""
select repository, {_LABEL} as workflow_name, count(*) as failed_runs
from base
where trim(conclusion) = 'failure' and created_at >= max_date - to_days({D}) and name not in ('CodeQL', 'Labeler')
group by 1, 2
"""

SQL["wf_avg_duration"] = _BASE + f"""
select repository, {_LABEL} as workflow_name,
       avg({SECS('created_at', 'updated_at')}) / 60 as average_duration_minutes
from base where {_OK} group by 1, 2
"""

SQL["wf_run_count"] = _BASE + f"""
select repository, {_LABEL} as workflow_name, count(*) as run_count
from base where {_OK} group by 1, 2
"""

SQL["wf_total_duration"] = _BASE + f"""
select repository, {_LABEL} as workflow_name,
       sum({SECS('created_at', 'updated_at')}) / 60 as cumulative_duration_minutes
from base where {_OK} group by 1, 2
"""


def _infra(file_name: str) -> str:
    return _BASE + f"""
select repository, created_at as run_timestamp, {SECS('created_at', 'updated_at')} / 60 as duration_minutes
from base
where status = 'completed' and created_at >= max_date - to_days({D}) and created_at <= max_date
  and pipeline like '%{file_name}%' and name != 'Labeler'
"""


SQL["wf_infra_plan_duration"] = _infra("infra_plan.yaml")
SQL["wf_infra_apply_duration"] = _infra("infra_apply.yaml")

SQL["wf_success_ratio"] = _BASE + f"""
select repository, name as workflow_name, count(*) as total_runs,
       cast(sum(case when trim(conclusion) = 'success' then 1 else 0 end) as bigint) as successful_runs,
       cast(sum(case when trim(conclusion) = 'failure' then 1 else 0 end) as bigint) as failed_runs,
       {RND("cast(sum(case when trim(conclusion) = 'success' then 1 else 0 end) as double) / count(*) * 100", 2)}
         as success_rate_percentage
from base
where trim(conclusion) in ('success', 'failure') and created_at >= max_date - to_days({D})
  and name not in ('CodeQL', 'Labeler')
group by 1, 2
"""

SQL["wf_summary"] = _BASE + f"""
select a.repository, cast(coalesce(s.total_pipelines, 0) as integer) as total_pipelines,
       s.avg_duration_minutes, s.total_duration_minutes, s.first_pipeline_date
from (select distinct repository from anc) a left join (
  select repository, count(*) as total_pipelines,
         avg({SECS('created_at', 'updated_at')}) / 60 as avg_duration_minutes,
         sum({SECS('created_at', 'updated_at')}) / 60 as total_duration_minutes,
         min(created_at) as first_pipeline_date
  from base where {_OK} group by repository) s on s.repository = a.repository
"""

def _fill(col: str) -> str:
    return f"""cast(case when coalesce({col}, 0) != 0 then {col}
            else coalesce(last_value(case when coalesce({col}, 0) > 0 then {col} end ignore nulls)
                 over (partition by repository order by run_date rows between unbounded preceding and current row), 0)
            end as bigint)"""


SQL["pivot_forward_fill"] = SQL["wf_dx_runs_cumulative"].replace(
    "\nselect repository, run_date, pipeline_type,", ",\nlong_form as (select repository, run_date, pipeline_type,", 1
) + f"""),
wide as (
  select repository, run_date,
         max(case when pipeline_type = 'DX Pipelines' then cumulative_count end) as dx_raw,
         max(case when pipeline_type = 'Non-DX Pipelines' then cumulative_count end) as non_dx_raw
  from long_form group by 1, 2)
select repository, run_date, {_fill('dx_raw')} as dx, {_fill('non_dx_raw')} as non_dx
from wide
"""

"""Oracle SQL for the ingest / merge queries."""

from oracle.snippets import RND, SECS

SQL = {}

SQL["iac_lead_times"] = f"""
with links as (
  select distinct c.repository_id, c.repository_full_name, lower(c.author) as ca, p.number, p.title,
         p.author as pa, p.created_at, p.merged_at
  from commits c
  join pull_requests p on p.repository_id = c.repository_id
                      and p.number = cast(split_part(c.sha, '-', 1) as bigint)
  where split_part(c.repository_full_name, '/', 2) != 'dx'),
rv as (
  select repository_id, number,
         list_sort(list(distinct ca) filter (where ca in ('building', 'rev0', 'rev1', 'rev2')
                                             and coalesce(ca != lower(pa), true) and ca != 'web-flow')) as r
  from links group by 1, 2),
prs as (
  select distinct repository_id, repository_full_name, number, title, pa, created_at, merged_at from links)
select p.repository_id, p.repository_full_name, p.number as pr_number, p.title, coalesce(p.pa, 'unknown') as author,
       p.created_at, p.merged_at, {RND(f"{SECS('p.created_at', 'p.merged_at')} / 86400", 2)} as lead_time_days,
       coalesce(rv.r, []) as target_authors
from prs p join rv on rv.repository_id = p.repository_id and rv.number = p.number
where p.merged_at is not null
"""

SQL["insert_ignore"] = """
with t as (select * from commits where committer_date < timestamp '1999-01-01'),
b as (
  select * from (
    select *, row_number() over (partition by sha order by committer_date, repository_id, author) as rn
    from commits where committer_date >= timestamp '1998-06-01') x
  where rn = 1)
select sha, repository_id, repository_full_name, author, committer_date from t
union all
select sha, repository_id, repository_full_name, author, committer_date from b
where not exists (select 1 from t where t.sha = b.sha)
"""

SQL["upsert"] = """
with t as (select * from pull_requests where created_at < timestamp '1999-01-01'),
b as (
  select p.id, p.repository_id, p.number, concat(p.title, ' / ', r.reviewer) as title, r.reviewer as author,
         p.merged_by, p.created_at, r.submitted_at as merged_at, r.submitted_at as closed_at, p.additions,
         p.total_comments_count, case when r.state = 'APPROVED' then 0 else 1 end as draft,
         r.submitted_at as o1, r.reviewer as o2, r.state as o3
  from pull_request_reviews r join pull_requests p on p.id = r.pull_request_id
  where p.created_at >= timestamp '1998-06-01'),
bf as (select * from (select *, row_number() over (partition by id order by o1 nulls first, o2, o3) as rn from b) x where rn = 1),
bl as (select * from (select *, row_number() over (partition by id order by o1 desc nulls last, o2 desc, o3 desc) as rn
                      from b) x where rn = 1)
select coalesce(t.id, bf.id) as id,
       case when t.id is not null then t.repository_id else bf.repository_id end as repository_id,
       case when t.id is not null then t.number else bf.number end as number,
       case when bl.id is not null then bl.title else t.title end as title,
       case when t.id is not null then t.author else bf.author end as author,
       case when t.id is not null then t.merged_by else bf.merged_by end as merged_by,
       case when t.id is not null then t.created_at else bf.created_at end as created_at,
       case when bl.id is not null then bl.merged_at else t.merged_at end as merged_at,
       case when bl.id is not null then bl.closed_at else t.closed_at end as closed_at,
       case when t.id is not null then t.additions else bf.additions end as additions,
       case when t.id is not null then t.total_comments_count else bf.total_comments_count end as total_comments_count,
       case when bl.id is not null then bl.draft else t.draft end as draft
from t full outer join bf on t.id = bf.id
left join bl on bl.id = coalesce(t.id, bf.id)
"""

SQL["replace_by_key"] = """
with b as (select repository, module, file_path, '~> 9.0' as version from terraform_modules
           where starts_with(version, '~> 1') and contains(repository, '#1'))
select repository, module, file_path, version from terraform_modules
where repository not in (select distinct repository from b)
union all
select repository, module, file_path, version from b
"""

SQL["extract_usages"] = "select repository, caller_file, dx_workflow, ref from dx_pipeline_usages"

SQL["release_summary"] = """
select module_name, provider, major_version, first_release_version, release_date, releases_count, latest_version
from terraform_registry_releases
"""

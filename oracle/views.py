"""The bound views as SQL (DuckDB dialect; the FIXTURES.md §B bodies run as is).

``with_views(sql)`` prefixes a query with the CTEs it needs. The SQL here is
written independently of the DataFrame code in ``cadence/sources/bound.py``;
agreement of the two is itself checked by the oracle runs.
"""

from __future__ import annotations

import re

VIEWS: dict[str, str] = {}

VIEWS["repositories"] = """
select id, name, concat(organization, '/', name) as full_name, organization
from (
  select n_nationkey as id, r_name as organization,
         case when n_nationkey = 1 then 'dx' when n_nationkey = 5 then 'technology-radar'
              when n_nationkey % 8 = 2 then concat(r_name, '-dx-', n_name)
              when n_nationkey % 8 = 3 then concat('terraform-', n_name)
              when n_nationkey % 8 = 4 then concat('eng-', n_name) else n_name end as name
  from nation join region on n_regionkey = r_regionkey
  union all
  select 99, 'AFRICA', 'EMPTY') x
"""

VIEWS["pull_requests"] = """
select o.o_orderkey as id, c.c_nationkey as repository_id, o.o_orderkey as number,
       case when o.o_orderkey % 40 = 0 then 'Version Packages'
            else concat('order ', cast(o.o_orderkey as string)) end as title,
       c.c_mktsegment as author,
       concat('rev', cast(o.o_custkey % 20 as string)) as merged_by,
       o.o_orderdate as created_at, l.merged_at as merged_at,
       case when l.merged_at is not null then l.merged_at
            when o.o_orderstatus = 'F' then o.o_orderdate + interval '30' day end as closed_at,
       l.additions as additions, l.total_comments_count as total_comments_count,
       case when o.o_orderpriority = '5-LOW' then 1
            when o.o_orderpriority = '1-URGENT' then null else 0 end as draft
from orders o
join customer c on o.o_custkey = c.c_custkey
left join (
  select o2.o_orderkey as k,
         min(case when l_shipdate >= o2.o_orderdate then l_shipdate end) as merged_at,
         cast(sum(l_quantity) as bigint) * (case when o2.o_orderkey % 5 = 0 then 4 else 1 end) as additions,
         count(*) as total_comments_count
  from lineitem join orders o2 on l_orderkey = o2.o_orderkey
  group by o2.o_orderkey) l on l.k = o.o_orderkey
"""

VIEWS["pull_request_reviews"] = """
select l_orderkey as pull_request_id, c_nationkey as repository_id,
       concat('rev', cast(l_suppkey % 20 as string)) as reviewer,
       case l_returnflag when 'A' then 'APPROVED' when 'R' then 'CHANGES_REQUESTED'
            else 'COMMENTED' end as state,
       case when l_linenumber <> 7 then l_shipdate end as submitted_at
from lineitem
join orders on l_orderkey = o_orderkey
join customer on o_custkey = c_custkey
"""

VIEWS["workflows"] = """
select distinct user_id as id, user_id % 25 as repository_id,
       case when user_id % 12 = 8 then 'Labeler'
            when user_id % 6 = 2 then 'CodeQL'
            when user_id % 6 = 0 then concat('Deploy ', cast(user_id % 12 as string))
            when user_id % 6 = 1 then concat('Release ', cast(user_id % 12 as string))
            else concat('Build ', cast(user_id % 12 as string)) end as name,
       case when user_id % 5 = 0 then null
            when user_id % 5 = 1 then 'uses: acme/dx/.github/workflows/infra_plan.yaml'
            when user_id % 5 = 2 then 'uses: acme/dx/.github/workflows/infra_apply.yaml'
            when user_id % 5 = 3 then 'infra_plan.yaml'
            else 'ci.yaml' end as pipeline
from events
"""

VIEWS["workflow_runs"] = """
select event_id as id, user_id % 25 as repository_id, user_id as workflow_id,
       case event_type when 'purchase' then 'success' when 'view' then ' success '
            when 'click' then 'success' when 'error' then 'failure' end as conclusion,
       case when event_type = 'signup' then 'in_progress' else 'completed' end as status,
       ts as created_at,
       ts + interval '1' second * cast(floor(value) as int) as updated_at
from events
"""

VIEWS["iac_pr_lead_times"] = """
select p.repository_id, r.full_name as repository_full_name, p.number as pr_number,
       p.title, coalesce(p.author, 'unknown') as author, p.created_at, p.merged_at
from pull_requests p join repositories r on p.repository_id = r.id
where p.merged_at is not null and r.name <> 'dx'
  and exists (select 1 from lineitem where l_orderkey = p.number)
"""

VIEWS["dx_team_members"] = """
select username from (values ('BUILDING'), ('rev0'), ('rev1'), ('rev2')) as t(username)
"""

VIEWS["commits"] = """
select concat(cast(l_orderkey as string), '-', cast(l_linenumber as string)) as sha,
       c_nationkey as repository_id, r.full_name as repository_full_name,
       concat('rev', cast(l_suppkey % 20 as string)) as author,
       l_shipdate as committer_date
from lineitem
join orders on l_orderkey = o_orderkey
join customer on o_custkey = c_custkey
join repositories r on r.id = c_nationkey
"""

VIEWS["terraform_modules"] = """
select p_brand as repository,
       case p_partkey % 7 when 0 then concat('./local/', lower(p_type))
            when 1 then concat('../shared/', lower(p_type))
            when 2 then concat('hashicorp/', lower(p_type), '/aws')
            else concat('acme-dx/', lower(p_type), '/azurerm') end as module,
       p_name as file_path,
       case p_partkey % 6 when 0 then null when 1 then 'main'
            else concat('~> ', cast(p_partkey % 5 as string), '.1') end as version
from part
"""

VIEWS["registry_versions"] = """
select lower(p_type) as module_name,
       case p_partkey % 2 when 0 then 'azurerm' else 'aws' end as provider,
       concat(case p_partkey % 3 when 0 then 'v' else '' end,
              cast(p_size % 4 as string), '.', cast(p_partkey % 13 as string), '.',
              cast(p_partkey % 11 as string)) as version,
       cast(date '2020-01-01' + interval '1' day * cast(p_partkey % 1500 as int) as date) as published_at
from part
"""

VIEWS["tracker_requests"] = """
select o_orderdate as submitted_at, p.merged_at as closed_at,
       lower(p.author) as category, lower(o_orderpriority) as priority,
       case o_orderstatus when 'F' then 'true' else 'false' end as is_closed
from orders join pull_requests p on p.id = o_orderkey
"""

VIEWS["code_search_results"] = """
select 'acme/dx org:acme' as query,
       concat('org/', source, case when doc_id % 7 = 0 then '-dx' else '' end) as repository_full_name,
       cast(doc_id as string) as path
from documents
"""

# Usage extraction over pages: href="(/name)(@ref)?" — every match, first ref
# per (repository, file, workflow).
USAGE_PATTERN = r"""href="(/([^@\s"''\n]+))(?:@([^\s"''\n]+))?"""

VIEWS["pipeline_matches"] = f"""
select repository, caller_file, w as dx_workflow, nullif(r, '') as ref, pos
from (
  select regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#:]*)', 1) as repository,
         url as caller_file,
         unnest(regexp_extract_all(html, '{USAGE_PATTERN}', 1)) as w,
         unnest(regexp_extract_all(html, '{USAGE_PATTERN}', 3)) as r,
         unnest(generate_series(1, len(regexp_extract_all(html, '{USAGE_PATTERN}', 1)))) as pos
  from pages
) m
where repository is not null and repository <> '' and caller_file is not null and caller_file <> ''
"""

VIEWS["dx_pipeline_usages"] = """
select repository, caller_file, dx_workflow, ref from (
  select *, row_number() over (partition by repository, caller_file, dx_workflow order by pos) as rn
  from pipeline_matches) x
where rn = 1
"""

VIEWS["registry_parsed"] = r"""
select module_name, provider, version, cast(published_at as timestamp) as published_at,
       try_cast(regexp_extract(version, '^v?(\d+)\.', 1) as integer) as major_version,
       case when split_part(regexp_replace(version, '^v', ''), '.', 1) = '' then 0
            else try_cast(split_part(regexp_replace(version, '^v', ''), '.', 1) as bigint) end as k1,
       case when split_part(regexp_replace(version, '^v', ''), '.', 2) = '' then 0
            else try_cast(split_part(regexp_replace(version, '^v', ''), '.', 2) as bigint) end as k2,
       case when split_part(regexp_replace(version, '^v', ''), '.', 3) = '' then 0
            else try_cast(split_part(regexp_replace(version, '^v', ''), '.', 3) as bigint) end as k3
from registry_versions
where try_cast(regexp_extract(version, '^v?(\d+)\.', 1) as integer) is not null
"""

VIEWS["registry_ranked"] = """
select *,
  row_number() over (partition by module_name, provider, major_version
                     order by k1 nulls first, k2 nulls first, k3 nulls first, version, published_at nulls first) as rn_first,
  row_number() over (partition by module_name, provider, major_version
                     order by k1 desc nulls last, k2 desc nulls last, k3 desc nulls last, version desc,
                              published_at desc nulls last) as rn_last,
  count(*) over (partition by module_name, provider, major_version) as n_versions
from registry_parsed
"""

VIEWS["terraform_registry_releases"] = """
select f.module_name, f.provider, f.major_version, f.version as first_release_version,
       f.published_at as release_date, cast(f.n_versions as bigint) as releases_count,
       l.version as latest_version
from registry_ranked f
join registry_ranked l
  on l.module_name = f.module_name and l.provider = f.provider and l.major_version = f.major_version
where f.rn_first = 1 and l.rn_last = 1 and f.published_at is not null
"""

ORDER = list(VIEWS)


def with_views(body: str) -> str:
    """Prefix ``body`` with the CTEs it references (and theirs), in order."""
    needed: set[str] = set()

    def visit(text: str) -> None:
        for name in ORDER:
            if name not in needed and re.search(rf"\b{name}\b", text):
                needed.add(name)
                visit(VIEWS[name])

    visit(body)
    ctes = [f"{name} as ({VIEWS[name].strip()})" for name in ORDER if name in needed]
    body = body.strip()
    if body.lower().startswith("with "):
        body = body[5:]
        return "with " + ",\n".join(ctes + [body]) if ctes else "with " + body
    return ("with " + ",\n".join(ctes) + "\n" + body) if ctes else body


AS_OF = "(select max(merged_at) + interval 1 day from pull_requests)"

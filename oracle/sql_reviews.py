"""Oracle SQL for the review metrics. First review / last approval are written
in the LATERAL … ORDER BY … LIMIT 1 form (NULL order as in PostgreSQL), so the
aggregate + join rewrite on the Spark side is checked against it."""

from oracle.snippets import A, BOTS, NOTDRAFT, RND, SECS, WEEK, REVIEW_DAYS

D = REVIEW_DAYS

_first = """join lateral (
    select submitted_at as first_at from pull_request_reviews prr
    where prr.pull_request_id = pr.id order by submitted_at asc nulls last limit 1) f on true"""
_last = """join lateral (
    select submitted_at as last_at from pull_request_reviews prr
    where prr.pull_request_id = pr.id and prr.state = 'APPROVED'
    order by submitted_at desc nulls first limit 1) l on true"""

SQL = {}

SQL["review_avg_time_to_first"] = f"""
select r.full_name as repository, a.avg_hours_to_first_review
from repositories r left join (
  select pr.repository_id, {RND(f"avg({SECS('pr.created_at', 'f.first_at')}) / 3600", 2)} as avg_hours_to_first_review
  from pull_requests pr {_first}
  where pr.merged_at >= {A} - to_days({D}) and pr.{BOTS} and {NOTDRAFT}
  group by pr.repository_id) a on a.repository_id = r.id
"""

SQL["review_time_to_first_weekly"] = f"""
select r.full_name as repository, {WEEK('pr.created_at')} as week,
       {RND(f"avg({SECS('pr.created_at', 'f.first_at')}) / 3600", 2)} as avg_hours_to_first_review
from pull_requests pr join repositories r on pr.repository_id = r.id {_first}
where pr.created_at >= {A} - to_days({D}) and pr.{BOTS} and {NOTDRAFT}
group by 1, 2
"""

SQL["review_avg_time_to_merge"] = f"""
select r.full_name as repository, a.avg_hours_to_merge
from repositories r left join (
  select pr.repository_id, {RND(f"avg({SECS('l.last_at', 'pr.merged_at')}) / 3600", 2)} as avg_hours_to_merge
  from pull_requests pr {_last}
  where pr.merged_at >= {A} - to_days({D}) and pr.{BOTS} and {NOTDRAFT}
  group by pr.repository_id) a on a.repository_id = r.id
"""

SQL["review_time_to_merge_weekly"] = f"""
select r.full_name as repository, {WEEK('pr.merged_at')} as week,
       {RND(f"avg({SECS('l.last_at', 'pr.merged_at')}) / 3600", 2)} as avg_hours_to_merge
from pull_requests pr join repositories r on pr.repository_id = r.id {_last}
where pr.merged_at >= {A} - to_days({D}) and pr.{BOTS} and {NOTDRAFT}
group by 1, 2
"""

SQL["review_distribution"] = f"""
select r.full_name as repository, reviewer, count(*) as total_reviews,
       count(*) filter (where state = 'APPROVED') as approvals,
       count(*) filter (where state = 'CHANGES_REQUESTED') as change_requests
from pull_request_reviews prr join repositories r on prr.repository_id = r.id
where prr.submitted_at >= {A} - to_days({D}) and reviewer not in ('MACHINERY')
group by 1, 2
"""

SQL["review_matrix"] = f"""
select r.full_name as repository, pr.author, prr.reviewer, count(*) as review_count
from pull_request_reviews prr
join pull_requests pr on prr.pull_request_id = pr.id
join repositories r on prr.repository_id = r.id
where prr.submitted_at >= {A} - to_days({D}) and pr.{BOTS} and prr.reviewer not in ('MACHINERY')
  and (pr.draft is null or pr.draft = 0)
group by 1, 2, 3
"""

"""Rules that the oracle must be able to see: without the rule the rows differ, so a green key means something."""

import pytest
from pyspark.sql import functions as F

from cadence.plans import iac, team
from cadence.plans import workflows as wf
from cadence.plans.periods import IAC_DAYS, TEAM_DAYS, WORKFLOW_DAYS
from cadence.plans.pull_requests import METRICS as PR
from cadence.plans.reviews import METRICS as REVIEWS
from cadence.sources.bound import bind, bound_as_of, bound_defaults

D = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def t(spark):
    return bind(spark, D)


def rows(df):
    return sorted(map(str, df.collect()))


@pytest.mark.parametrize("key", sorted(wf.METRICS))
def test_workflow_period(t, key):
    now = bound_as_of(t)
    assert rows(wf.METRICS[key](t, WORKFLOW_DAYS, now, bound_defaults())) != rows(wf.METRICS[key](t, 5000, now, bound_defaults()))


@pytest.mark.parametrize("key, change", [
    ("team_commits_daily", {"own_repo_pattern": "^$"}),
    ("team_commits_daily", {"excluded_repo_substring": "no such name"}),
])
def test_own_repositories(t, key, change):
    now, d = bound_as_of(t), bound_defaults()
    assert rows(team.METRICS[key](t, TEAM_DAYS, now, d)) != rows(team.METRICS[key](t, TEAM_DAYS, now, d.with_(**change)))


def test_shared_tool_repositories(t):
    now, d = bound_as_of(t), bound_defaults()
    names = {r.full_name for r in team.METRICS["team_commits_by_repo"](t, TEAM_DAYS, now, d).collect()}
    stored = {r.full_name for r in t.need("repositories").collect()}
    assert any("-dx-" in n for n in stored - names) and any("/terraform" in n for n in stored - names)


def test_home_repository_has_no_infrastructure_rows(t):
    assert t.need("repositories").where("name = 'dx'").count() == 1
    assert t.need("iac_pr_lead_times").where(F.col("repository_full_name").endswith("/dx")).count() == 0


def test_all_size_buckets_and_a_repository_without_facts(t):
    now, d = bound_as_of(t), bound_defaults()
    assert t.need("pull_requests").where("additions > 1000").count() > 0
    cards = {r.repository: r.total_prs for r in PR["pr_total"](t, 720, now, d).collect()}
    assert cards["AFRICA/EMPTY"] == 0


def test_undated_approvals(t):
    now, d = bound_as_of(t), bound_defaults()
    assert t.need("pull_request_reviews").where("submitted_at is null and state = 'APPROVED'").count() > 0
    f = REVIEWS["review_avg_time_to_merge"]
    assert rows(f(t, 5000, now, d)) != rows(f(t, 5000, now, d, nulls="ignore"))


def test_infrastructure_metrics_see_every_merged_pr(t):
    now, d = bound_as_of(t), bound_defaults()
    n = sum(r.pr_count for r in iac.iac_count_weekly(t, 100_000, now, d).collect())
    merged = t.need("pull_requests").join(t.need("repositories").select(F.col("id").alias("repository_id"), "name"), "repository_id")
    assert n == merged.where("merged_at is not null and name <> 'dx' and title <> 'Version Packages'").count()
    assert IAC_DAYS < 100_000

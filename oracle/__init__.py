"""Independently written DuckDB SQL for every registered query."""

from __future__ import annotations

from oracle.views import with_views


def all_sql() -> dict[str, str]:
    from oracle import sql_iac_adoption, sql_ingest, sql_jobs, sql_operators, sql_pull_requests, sql_reviews, sql_team_tracker_releases, sql_workflows

    out: dict[str, str] = {}
    for mod in (sql_pull_requests, sql_reviews, sql_workflows, sql_iac_adoption, sql_team_tracker_releases, sql_ingest, sql_jobs, sql_operators):
        for key, body in mod.SQL.items():
            out[key] = with_views(body)
    return out

"""SQL fragments shared by the oracle queries, and the parameters both sides use."""

from oracle.views import AS_OF as A  # noqa: F401  (scalar subquery: one day after the last merge)

# parameters of the registered queries (the Spark side reads the same values)
PR_DAYS = 720
REVIEW_DAYS = 720
WORKFLOW_DAYS = 10
IAC_DAYS = 720
TEAM_DAYS = 720
CALENDAR_DAYS = 120

BOTS = "author not in ('MACHINERY')"
NOTDRAFT = "(draft is null or draft = 0)"
DAY = 86400
PR_JOIN = "from pull_requests pr join repositories r on pr.repository_id = r.id"


def SECS(a: str, b: str) -> str:
    return f"(cast(epoch_us({b}) - epoch_us({a}) as double) / 1e6)"


def RND(x: str, n: int) -> str:
    return f"cast(round(cast({x} as decimal(28,8)), {n}) as double)"


def WEEK(ts: str) -> str:
    return f"cast(date_trunc('week', {ts}) as date)"


def DAYOF(ts: str) -> str:
    return f"cast({ts} as date)"

"""Periods, in days, of the registered queries (the oracle repeats them on its own)."""

PR_DAYS = 720
REVIEW_DAYS = 720
WORKFLOW_DAYS = 10
IAC_DAYS = 720
TEAM_DAYS = 720
CALENDAR_DAYS = 120
#: A period that ends amid the data, so that its upper end decides something.
MID_DAYS = 300
MID_AS_OF = "1998-06-30"

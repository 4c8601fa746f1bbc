"""cadence — software-delivery metrics as lazy PySpark DataFrame operators.

Layout:
  sources/    readers of stored tables, bound test views, landed JSON/CSV payloads
  functions/  column expressions (elapsed time, rounding, calendars, text rules)
  operators/  composite DataFrame operators (periods, calendars, trends, merges …)
  plans/      the named metrics, one module per dashboard, plus ingest jobs
  streaming/  landed-file stream feeding the merge operators
"""

from cadence.config import Defaults, DEFAULTS

__all__ = ["Defaults", "DEFAULTS"]

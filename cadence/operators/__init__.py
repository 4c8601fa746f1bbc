"""Composite DataFrame operators: periods, calendars, trends, shaping, joins to
related rows, versions, usages, merges and checkpoints."""

"""Landed-file streams feeding the merge operators."""

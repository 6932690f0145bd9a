"""DataFrame operators: search, joins, ancestry, matching, conflicts, upserts and extraction."""

"""DataFrame operators: revisions, aggregates, rollups, joins, catalogue checks."""

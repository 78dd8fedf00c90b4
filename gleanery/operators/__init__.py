"""DataFrame operators: robots verdicts, limits, extraction, filters, joins, aggregates."""

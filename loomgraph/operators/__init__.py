"""DataFrame to DataFrame operators: filters, joins, aggregates, search, conventions, metrics."""

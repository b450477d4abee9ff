"""DataFrame operators (filters, demos, metrics, windows, joins, sampling, reports)."""

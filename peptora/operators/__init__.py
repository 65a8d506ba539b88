"""DataFrame operators: windows, joins, labels, sampling, learning, metrics, audits."""

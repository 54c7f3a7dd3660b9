"""DataFrame-level operators: ordering, sessions, runs, joins, histograms, fits."""

"""DataFrame → DataFrame operators: cleaning, quality, statistics,
relational helpers, chart series, answers and response tables."""

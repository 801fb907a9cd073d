"""DataFrame operators: mapping, filters, duplicates, splits, statistics, variants, scoring."""

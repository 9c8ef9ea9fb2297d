"""DataFrame operators: projection, filters, lookups, ranges, sorts and duplicate handling."""

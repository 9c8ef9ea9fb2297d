"""Sessions over a database of versioned tables, and the registered queries."""

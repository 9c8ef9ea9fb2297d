"""Where rows come from and go to: memory, and versioned Parquet tables."""

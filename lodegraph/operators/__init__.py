"""DataFrame to DataFrame steps of the ranking."""

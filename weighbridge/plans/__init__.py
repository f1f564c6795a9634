"""Plans: the audit wiring, skew-safe ranking, and the query registry."""

"""Column-level functions: text metrics, paths, placeholders and entropy,
URLs, and the token counters."""

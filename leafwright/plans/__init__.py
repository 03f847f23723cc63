"""Plan-level helpers: cutting lineage, sorted group streams."""

"""Table schemas, readers, writers and the adapter for the star-schema test tables."""

"""DataFrame operators: lookups, joins, search, fusion, tags, ingestion."""

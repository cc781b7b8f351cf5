"""A Structured Streaming front end for ingestion."""

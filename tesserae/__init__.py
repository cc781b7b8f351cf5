"""Tesserae: a document-search analytics engine on Spark DataFrames."""

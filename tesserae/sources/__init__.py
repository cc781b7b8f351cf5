"""Readers: files by glob patterns, loader objects, tables."""

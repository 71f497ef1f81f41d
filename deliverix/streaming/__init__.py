"""Continuous ingestion of commits: the same monthly and weekly counts over a stream."""

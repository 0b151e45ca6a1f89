"""Whole jobs: ingestion, review, consolidation, release, data quality."""

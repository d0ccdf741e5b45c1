"""Whole jobs: ingest, query templates, batch answers."""

"""Pipelines: ingest, roll-up and the report registry."""

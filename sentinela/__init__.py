"""Surveillance data jobs on Spark: ingest, validate, model and analyse."""

"""Whole plans: the ingest run, the sample views and the registered queries."""

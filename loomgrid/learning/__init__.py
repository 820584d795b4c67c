"""Probes, retrieval and training over distributed rows."""

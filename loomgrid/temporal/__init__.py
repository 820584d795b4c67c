"""Signals over fixed graphs: windows, splits, baselines and scores."""

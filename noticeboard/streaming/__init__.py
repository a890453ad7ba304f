"""Incremental arrival of captures; everything later works on snapshots."""

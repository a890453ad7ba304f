"""Operators: ``DataFrame -> DataFrame`` functions over listing tables."""

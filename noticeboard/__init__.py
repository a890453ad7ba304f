"""Listing quality and analytics on Spark: plain DataFrame functions."""

"""Readers and writers: registry, places, stored listings, captures, history, exports."""

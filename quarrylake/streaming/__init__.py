"""Incremental synchronisation and streaming upserts."""

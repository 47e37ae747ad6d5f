"""Replication as a stream of commits."""

"""Readers that turn stored snapshots into flat tables."""

"""Incremental reading of arriving snapshots."""

"""Incremental refresh as a stream of changed files."""

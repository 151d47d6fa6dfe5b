"""Incremental runs over folders, as streams of files."""

"""Incremental runs: new media items arrive as files and go through the same batch operators."""

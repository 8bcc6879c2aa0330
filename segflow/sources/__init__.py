"""Readers: each turns text, JSON or CSV rows of one kind into typed rows.  Bad rows are dropped or set apart, never raised."""

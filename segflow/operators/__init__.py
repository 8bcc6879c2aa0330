"""Operators on tables of segments, turns, pauses, voices and text variants.

All take and return DataFrames, partition by media_id, keep times as BIGINT milliseconds and never collect rows.
"""

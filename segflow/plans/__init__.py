"""Registered queries over the driver's tables, with the same queries as DuckDB SQL."""

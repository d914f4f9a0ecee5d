"""Queries over the order tables, each with the DuckDB SQL that gives the same rows, keyed by inventory ID."""

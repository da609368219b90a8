"""Registered queries: each applies operators to whole tables, beside the DuckDB SQL that checks it."""

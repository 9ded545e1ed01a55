"""Intermediate tables of the operators; see ``ragspark.tables``."""

from __future__ import annotations

from ragspark.tables import column, columns_of, discard, free_name, materialize, new_path, partitions, shared_dir

__all__ = ["column", "columns_of", "discard", "free_name", "materialize", "new_path", "partitions", "shared_dir"]

"""Operators for training-data pipelines. Nothing else in ragspark imports this package."""

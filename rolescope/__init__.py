"""Posting search, ranking and evidence matching as Spark DataFrame operators."""

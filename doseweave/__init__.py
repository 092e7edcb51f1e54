"""Pair-evidence analytics as Spark DataFrame operators."""

"""Pair-similarity analytics as Spark DataFrame operators."""

"""Structured-trace analytics as Spark DataFrame operators."""

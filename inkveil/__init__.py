"""Sensitive-text engine expressed as Spark DataFrame plans."""

"""Duplicate and similarity analytics expressed as Spark DataFrame plans."""

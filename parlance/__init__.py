"""Dialogue-dataset analytics expressed as Spark DataFrame transformations."""

"""Assaykit: laboratory-measurement analytics as PySpark DataFrame operators."""

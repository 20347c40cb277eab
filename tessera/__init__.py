"""Tessera: a PySpark-native analytics engine."""

"""Brindle: a PySpark-native analytics engine for business-lead data."""

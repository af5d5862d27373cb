"""Retail sales analytics as composable PySpark DataFrame operators."""

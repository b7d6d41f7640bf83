"""Tidemark: a customer-analytics and data-processing engine on PySpark."""

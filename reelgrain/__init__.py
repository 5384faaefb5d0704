"""Content-reuse and engagement analytics as PySpark DataFrame operators."""

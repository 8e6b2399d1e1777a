"""Document-corpus analytics as PySpark DataFrame operators."""

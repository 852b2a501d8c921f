"""Timeline retrieval and corpus analytics as PySpark DataFrame operators."""

"""Tessera: hybrid retrieval, evaluation and corpus processing as PySpark DataFrame plans."""

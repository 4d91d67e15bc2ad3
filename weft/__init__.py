"""weft: retrieval, ranking, graph and evaluation analytics as PySpark DataFrame plans."""

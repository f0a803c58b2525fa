"""corpusgraph: code-corpus graph analytics as PySpark DataFrame jobs."""

"""Network-flow security analytics as PySpark DataFrame jobs."""

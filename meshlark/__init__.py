"""meshlark: supply-network analytics as PySpark DataFrame operators."""

"""Price comparison analytics as PySpark DataFrame operators."""

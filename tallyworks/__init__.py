"""Usage-evidence analytics as Spark DataFrame operators."""

"""Column functions: pure expressions, evaluated inside Spark."""

"""Block-I/O trace analytics as Spark DataFrame operators."""

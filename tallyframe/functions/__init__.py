"""Column functions. Each takes and returns columns and stays in the JVM."""

"""Column functions: each takes and returns Columns and stays on the JVM."""

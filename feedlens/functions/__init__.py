"""Column expressions. Each takes and returns Columns and stays on the JVM side."""

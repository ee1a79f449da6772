"""Column functions: each takes columns and returns a column, in JVM code only."""

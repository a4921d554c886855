"""Column expressions. All of them run on the JVM."""

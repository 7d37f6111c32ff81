"""Column -> Column building blocks; every function stays inside the JVM."""

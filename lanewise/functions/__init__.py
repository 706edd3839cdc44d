"""Column -> Column scalar functions; all JVM-side, no Python UDFs."""

"""Column functions; all are JVM expressions except the string similarities in `similarity`."""

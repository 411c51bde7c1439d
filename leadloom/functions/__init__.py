"""Column expressions: URLs, text signals, scores. Everything here is JVM-side."""

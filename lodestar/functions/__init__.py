"""Column expressions: JVM-side building blocks for the operators."""

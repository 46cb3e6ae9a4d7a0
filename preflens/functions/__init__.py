"""Column -> Column building blocks. Everything here is row-local and JVM-side."""

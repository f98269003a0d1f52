"""Column helpers. Everything here is a JVM-side expression; there is no UDF."""

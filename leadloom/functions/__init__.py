"""Column functions: Column -> Column, JVM-side wherever Spark has the primitive."""

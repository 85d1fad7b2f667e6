"""API contracts and generated SDK source code as Spark tables."""

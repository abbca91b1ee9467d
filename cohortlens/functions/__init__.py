"""Column expressions: no job, no UDF."""

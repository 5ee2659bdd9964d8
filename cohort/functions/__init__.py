"""Column expressions and distributed aggregates shared by all operators."""

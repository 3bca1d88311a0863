"""Training-data pipeline operators: one module an operator, `queries` binds them to the tables."""

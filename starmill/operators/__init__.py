"""DataFrame operators. Each takes and returns DataFrames and leaves planning to Spark."""

"""Search, mutation and diagnosis over DataFrames."""

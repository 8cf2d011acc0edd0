"""A relational engine that compiles to lazy Spark DataFrames."""

"""Analytics of bank transactions and purchases on Spark DataFrames."""

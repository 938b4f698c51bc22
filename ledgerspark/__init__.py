"""ledgerspark: build and check a finance mart from many source ledgers, on Spark DataFrames."""

"""suitescope: analytics over test suites and their histories, on Spark DataFrames."""

"""Training-data operators: each module is one operator with a general interface over Spark DataFrames."""

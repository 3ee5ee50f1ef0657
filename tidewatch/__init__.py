"""Risk-news analytics and training-data operators expressed on Spark DataFrames."""

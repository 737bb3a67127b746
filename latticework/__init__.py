"""Region histograms over multi-dimensional grids, and training-data operators, on Spark DataFrames."""
